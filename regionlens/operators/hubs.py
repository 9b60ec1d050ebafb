"""Joins of edges with node state where a few nodes hold a large share of the edges.

The edges of a hub are dealt into sub-keys by the hash of their other end, and the hub's state row is
repeated once per sub-key; all other nodes keep one sub-key. A hub has more edges than a quarter of an
even task's share (and at least ``LEAST``), so there are at most four of them a core.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 100_000
SALTS = 32


class HubJoin:
    """``edges`` with a ``salt`` column, to be joined with node rows on (``key``, salt)."""

    def __init__(self, edges: DataFrame, key: str, other: str, hub_edges: int | None = None, salts: int = SALTS):
        counts = edges.groupBy(key).agg(F.count(F.lit(1)).alias("_deg"))
        if hub_edges is None:
            m = counts.agg(F.sum("_deg")).first()[0] or 0
            hub_edges = max(LEAST, m // (4 * edges.sparkSession.sparkContext.defaultParallelism))
        self.key, self.salts = key, salts
        self.hubs = [r[0] for r in counts.where(F.col("_deg") > hub_edges).select(key).collect()]  # at most m / hub_edges
        spread = F.pmod(F.xxhash64(other), F.lit(salts)).cast("int")
        self.edges = edges.withColumn("salt", F.when(F.col(key).isin(self.hubs), spread).otherwise(0) if self.hubs else F.lit(0))

    def rows(self, state: DataFrame, id_col: str = "id") -> DataFrame:
        """``state`` with its id called like the edges' key, hubs once per salt."""
        out = state.withColumnRenamed(id_col, self.key)
        if not self.hubs:
            return out.withColumn("salt", F.lit(0))
        copies = F.when(F.col(self.key).isin(self.hubs), F.sequence(F.lit(0), F.lit(self.salts - 1))).otherwise(F.array(F.lit(0)))
        return out.withColumn("salt", F.explode(copies))

    def join(self, state: DataFrame, id_col: str = "id", edges: DataFrame | None = None) -> DataFrame:
        return (self.edges if edges is None else edges).join(self.rows(state, id_col), [self.key, "salt"])
