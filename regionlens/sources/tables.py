"""Table readers (S-1 parquet scan, S-2 delimited scan, S-3 header normalisation)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, base_dir: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Parquet scan of ``{base_dir}/{name}.parquet``; selecting ``columns`` here prunes the scan."""
    df = spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    sep: str = ";",
    header: bool = True,
    corrupt: str | None = None,
) -> DataFrame:
    """Delimited text with a header and an explicit schema (no inference pass over the data).

    A row with too few or too many fields, or a field that is not of its type, fails the job; with a column
    name ``corrupt`` it is kept instead, what could be read in its columns and its text in that column (NULL
    in good rows).
    """
    given = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    read = spark.read.option("sep", sep).option("header", header)
    if corrupt is None:
        return read.schema(given).option("mode", "FAILFAST").csv(path)
    kept = T.StructType([*given.fields, T.StructField(corrupt, T.StringType())])
    return read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).csv(path)


def lower_headers(df: DataFrame) -> DataFrame:
    """Normalise column names to lower case (S-3)."""
    return df.toDF(*[c.lower() for c in df.columns])


def require_columns(df: DataFrame, *names: str) -> None:
    """Raise KeyError for a missing column before any plan is built (P-8)."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"column(s) {missing} not found; available: {df.columns}")


def resolve_key(df: DataFrame, *candidates: str) -> str:
    """First of ``candidates`` present in ``df`` (for example ``uf`` or ``UF``), else KeyError."""
    for c in candidates:
        if c in df.columns:
            return c
    raise KeyError(f"none of {candidates} in {df.columns}")
