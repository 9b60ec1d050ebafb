"""A stored edge table that takes upserts in batches (U-2).

Parquet, one folder per bucket of hash(src, dst).  A batch is reduced to its last row per edge, meets the rows
of the buckets it touches, and only these buckets are written anew; the others keep their files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, scratch_path
from .tables import require_columns

BUCKETS = 64


class EdgeStore:
    """Edges (src, dst, weight, ord) under ``path``; ``buckets`` must stay the same for the life of the table."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path or scratch_path(spark, "edges"), buckets
        self.schema = None

    def upsert(self, batch: DataFrame, order_col: str = "ord") -> int:
        """Insert or replace the edges of ``batch`` (src, dst, weight, ``order_col``): of all rows ever given for an
        edge the last by order stays (equal orders: the larger weight), whatever batch it came in.  Returns how
        many buckets were written.

        The merged buckets are written aside first and then replace the old ones; a job that dies in between can be
        run again with the same batch.  One writer at a time.
        """
        require_columns(batch, "src", "dst", "weight", order_col)
        rows = batch.select("src", "dst", F.col("weight").cast("double").alias("weight"), F.col(order_col).alias("ord"))
        with Scratch(self.spark, "upsert") as scratch:
            new = scratch.keep(self._last(rows).withColumn("bucket", F.pmod(F.xxhash64("src", "dst"), F.lit(self.buckets)).cast("int")))
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            if not touched:
                return 0
            both = new
            if self.schema is not None:
                both = both.unionByName(self._stored().where(F.col("bucket").isin(touched)))
            merged = scratch.keep(self._last(both, "bucket"))
            out = merged.repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            out.partitionBy("bucket").parquet(self.path)
            self.schema = merged.schema
        return len(touched)

    @staticmethod
    def _last(rows: DataFrame, *more: str) -> DataFrame:
        last = F.max_by(F.struct("weight", "ord"), F.struct("ord", "weight")).alias("x")
        return rows.groupBy("src", "dst", *more).agg(last).select("src", "dst", "x.weight", "x.ord", *more)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def open(self) -> EdgeStore:
        """Take up a table that another run has written."""
        self.schema = self.spark.read.parquet(self.path).schema
        return self

    def edges(self) -> DataFrame:
        """(src, dst, weight)."""
        if self.schema is None:
            raise ValueError("nothing has been stored yet")
        return self._stored().select("src", "dst", "weight")
