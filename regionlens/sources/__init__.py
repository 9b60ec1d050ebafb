"""Readers, writers and small built-in dimension tables."""

from .tables import TABLES, lower_headers, read_delimited, read_table  # noqa: F401
from .sinks import write_delimited, write_parquet  # noqa: F401
