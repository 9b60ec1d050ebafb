"""Helpers shared by the operators of this subpackage.

* ``written``: cut a lineage by writing a table into the shared checkpoint folder and rereading it.
* ``positions``: gapless positions over a total order, globally or per key, without a window on a
  hot key (range partitions plus per-partition offsets).
* ``components``: connected components by large-star / small-star rounds of joins.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Scratch, scratch_path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Hand this package to the executors' Python workers, once a Spark application, so that
    functions that name its modules run there without an installation."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).parents[1]
        path = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


FILE_ROWS = 1 << 18
"""Rows of small columns that a file of an intermediate table may hold before there is a second one."""


ROW_GROUP = 1 << 24
"""Bytes of a row group of an intermediate table: what a writer holds of it in memory."""


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has at most ``rows`` small rows, in no more partitions than files of FILE_ROWS need."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: the plan behind it is cut, and the
    rows survive the loss of any executor. Where a bound of its ``rows`` is known, a small table gets few files."""
    path = scratch_path(df.sparkSession, name)
    (df if rows is None else gathered(df, rows)).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: Sequence[str], base: str) -> str:
    """``base``, or ``base`` with underscores appended until no column is called so (any case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text column."""
    return text.cast("binary")


def positions(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), out: str = "pos") -> DataFrame:
    """Append ``out``: the 0-based place of each row in ``order`` (within ``keys``, if given).

    Rows are range-partitioned on (keys, order), sorted, and written with their partition and
    their place in it; a table of one row per (partition, key) turns these into places within the
    key. A key that holds most rows is spread over many partitions, and no task sees all of it.
    Rows that tie in ``order`` get different places; nulls come first.
    """
    cols = [*keys, *order]
    pid, mid = free_name(df.columns, "_pid"), free_name(df.columns, "_mid")
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    ranged = written(
        ranged.withColumn(pid, F.spark_partition_id()).withColumn(mid, F.monotonically_increasing_id()), "positions"
    )
    parts = ranged.groupBy(pid, *keys).agg(F.min(mid).alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col(pid).alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    if not keys:
        parts = F.broadcast(parts)  # one row per partition
    same = ranged[pid] == parts["_p"]
    for i, k in enumerate(keys):
        same = same & ranged[k].eqNullSafe(parts[f"_k{i}"])
    return ranged.join(parts, same).select(
        *[ranged[c] for c in df.columns], (ranged[mid] + parts["_shift"]).alias(out)
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the undirected ``edges`` (two long columns): one row per node that
    has an edge, ``node`` and ``component`` (the smallest node reachable); a written table.

    Alternates large-star (every larger neighbour of a node is linked to the node's smallest
    neighbour) and small-star until the edges are stars around the smallest nodes. Each round is
    two aggregations and two joins, written to the shared folder until the next one is; the rounds grow
    with the logarithm of the longest path. Only counts and a checksum reach the driver.
    """
    hi, lo = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    with Scratch(edges.sparkSession, "edges") as scratch:
        cur = scratch.keep(edges.where(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct())
        n, mark = cur.count(), None
        while True:
            both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(
                F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
            )
            cur = scratch.keep(gathered(small.select("e.u", "e.v").where("u != v").distinct(), 2 * n))
            now = cur.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
            if now == mark or now[0] == 0:
                break
            n, mark = now[0], now
        roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return written(cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components", 2 * now[0])
