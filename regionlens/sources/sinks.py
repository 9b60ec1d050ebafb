"""Writers (S-7 parquet overwrite, S-8 single-file delimited export)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a parquet table; the writer replaces the folder atomically per job."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_delimited(df: DataFrame, path: str, sep: str = ";", single_file: bool = False) -> None:
    """Delimited export with header.

    ``single_file`` repartitions to one file and is meant for report-sized frames (one row
    per territory / cluster / node); only the finished rows meet in one task, the stages
    before keep their partitioning, and so do big frames by default.
    """
    out = df.repartition(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
