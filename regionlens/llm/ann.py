"""Approximate nearest neighbours with balanced posting lists.

A bounded sample is split by balanced two-means until its parts are small: every part is one posting
list with a centroid. All vectors are put into the list of their nearest centroid, and boundary
vectors into further lists whose centroids are nearly as near. A query searches the centroids
with an in-memory neighbour graph, keeps the lists whose distance is within a ratio of the nearest
one, and is compared with all vectors of these lists. Lists are cut into blocks, so no task holds a
whole list of any size.

Copies of a vector are stored once with their smallest ids; nothing else of them can be among the k
nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ship, table, written

K = 5
EVERY = 50
SAMPLE = 20_000
"""Vectors that the lists are fitted on, at most; the index holds every vector."""
LIST_SIZE = 500
"""Vectors aimed at per list; a collection beyond SAMPLE gets larger lists, cut into blocks."""
LEAF = 40
"""Sampled vectors per list, at least: with SAMPLE it bounds the number of centroids."""
REPLICA_RATIO, REPLICAS = 1.03, 2
PRUNE_RATIO = 1.22
"""A list is searched if its distance is at most this times the distance of the nearest list."""
BLOCK = 4096
_DEGREE = 24


@dataclass
class Centroids:
    """Unit centroids with a neighbour graph (bounded: SAMPLE / LEAF rows)."""

    points: np.ndarray
    graph: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray, parts: int, seed: int = 1) -> Centroids:
        rng, leaves, todo = np.random.default_rng(seed), [], [(np.arange(len(sample)), parts)]
        while todo:
            rows, n = todo.pop()
            if n <= 1 or len(rows) < 2:
                leaves.append(rows)
                continue
            x = sample[rows]
            two = x[rng.choice(len(rows), 2, replace=False)]
            for _ in range(6):
                gap = x @ (two[0] - two[1])
                order = np.argsort(-gap, kind="stable")
                half = len(rows) * (n // 2) // n  # both sides as large as their numbers of lists
                two = np.stack([x[order[:half]].mean(axis=0), x[order[half:]].mean(axis=0)]) if 0 < half < len(rows) else two
            todo += [(rows[order[:half]], n // 2), (rows[order[half:]], n - n // 2)]
        points = np.stack([sample[r].mean(axis=0) for r in leaves if len(r)])
        norm = np.linalg.norm(points, axis=1, keepdims=True)
        points = points / np.where(norm > 0, norm, 1)
        near = np.argsort(-(points @ points.T), axis=1, kind="stable")[:, 1 : _DEGREE + 1]
        # a ring keeps the graph connected
        ring = np.stack([np.roll(np.arange(len(points)), 1), np.roll(np.arange(len(points)), -1)], axis=1)
        return cls(points, np.concatenate([near, ring], axis=1))

    def search(self, v: np.ndarray, ratio: float, beam: int) -> np.ndarray:
        """Distances (rows of ``v`` x centroids) of the centroids found, infinite for the others.

        Best-first search of all rows side by side: each row expands its nearest open centroid until
        that is beyond both its ``beam`` nearest and ``ratio`` times its nearest.
        """
        n = len(self.points)
        dist = np.full((len(v), n), np.inf)
        start = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))
        dist[:, start] = self._far(v, np.broadcast_to(start, (len(v), len(start))))
        to_open, rows = dist.copy(), np.arange(len(v))
        while len(rows):
            at = to_open[rows].argmin(axis=1)
            near = np.partition(dist[rows], min(beam, n) - 1, axis=1)[:, min(beam, n) - 1]
            go = to_open[rows, at] <= np.maximum(dist[rows].min(axis=1) * ratio, near)
            go &= np.isfinite(to_open[rows, at])
            rows, at = rows[go], at[go]
            to_open[rows, at] = np.inf
            side, grid = self.graph[at], rows[:, None]
            known = dist[grid, side]
            far = np.where(np.isfinite(known), known, self._far(v[rows], side))
            to_open[grid, side] = np.where(np.isfinite(known), to_open[grid, side], far)
            dist[grid, side] = far
        return dist

    def _far(self, v: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * np.einsum("rkd,rd->rk", self.points[at], v), 0))


def _scaled(vectors: pd.Series) -> np.ndarray:
    """The vectors as rows, each times the power of two that brings its largest component below one: cosines
    stay as they are, squares neither overflow nor vanish."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(vectors: pd.Series) -> np.ndarray:
    x = _scaled(vectors)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vec: str):
    """True for vectors that take part: not null or empty, no null, NaN or infinite component, not zero."""
    v = F.col(vec)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0), F.lit(False))


def _routes(shared, kind: int, ratio: float, most: int | None, beam: int):
    """Rows (list, vector row) of an Arrow batch: the lists that a vector is put into or searches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        apart = np.sqrt(np.maximum(2 - 2 * c.points @ c.points.T, 0))
        for batch in batches:
            out = []
            v = _unit(batch["vec"]) if len(batch) else np.empty((0, 1))
            for start in range(0, len(v), 512):
                far = c.search(v[start : start + 512], ratio, beam)
                close = far <= far.min(axis=1, keepdims=True) * ratio + 1e-12
                for i in range(len(far)):
                    lists = np.flatnonzero(close[i])
                    if most is not None:
                        lists, found = lists[np.argsort(far[i, lists], kind="stable")], []
                        for x in lists:
                            # not if a chosen centroid is nearer to this one than the vector is
                            if len(found) < most and all(apart[x, y] > far[i, x] for y in found):
                                found.append(x)
                        lists = found
                    out += [(int(x), start + i) for x in lists]
            rows = batch.iloc[[i for _, i in out]].reset_index(drop=True)
            yield rows.assign(list=[x for x, _ in out], kind=kind)[["list", "kind", "ids", "vec"]]

    return run


def _compare(k: int):
    """For rows sorted by (list, block, kind): the stored vectors of a block, then its queries; yields the
    k + 1 best stored vectors of each query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, raw, stored, norms = None, [], [], None, None
        for batch in batches:
            out = []
            for now, part in batch.groupby(["list", "part"], sort=False):
                if now != key:
                    key, ids, raw, stored = now, [], [], None
                own = part[part["kind"] == 0]
                if len(own):
                    ids += [tuple(x) for x in own["ids"]]
                    raw += list(_scaled(own["vec"]))
                asked = part[part["kind"] == 1]
                if not len(asked) or not raw:
                    continue
                if stored is None:
                    stored = np.stack(raw)
                    norms = np.sqrt(np.einsum("ij,ij->i", stored, stored))
                for i in range(0, len(asked), 256):
                    some = asked.iloc[i : i + 256]
                    q = _scaled(some["vec"])
                    near = (q @ (stored / norms[:, None]).T)
                    best = np.argpartition(-near, min(k, near.shape[1] - 1), axis=1)[:, : k + 1]
                    # ties at the edge are all looked at: smaller ids go first
                    edge = np.take_along_axis(near, best, 1).min(axis=1)
                    for j, qid in enumerate(x[0] for x in some["ids"]):
                        for s in np.flatnonzero(near[j] >= edge[j] - 1e-12):
                            dot = float(np.dot(q[j], stored[s]))
                            score = dot / (float(np.sqrt(np.dot(q[j], q[j]))) * float(np.sqrt(np.dot(stored[s], stored[s]))))
                            out += [(qid, c, score) for c in ids[s] if c != qid]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, k: int = K,
    sample: int = SAMPLE, list_size: int = LIST_SIZE, prune_ratio: float = PRUNE_RATIO,
) -> DataFrame:
    """The ``k`` nearest found (query_id, rank, vec_id, score) of every vector whose id is divisible
    by ``every``, by cosine, ties to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id,
    take no part; vectors of more than one dimension raise. Components of any finite size are compared. Repeated rows count
    once. Queries without any candidate return nothing; an empty table gives an empty result.
    """
    spark = ship(vectors.sparkSession)
    v = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    v = v.where(F.col("id").isNotNull() & usable("vec")).withColumn("digest", F.xxhash64("vec"))
    w = Window.partitionBy("digest", "vec").orderBy("id")
    # only the k + 1 smallest ids of a copied vector can matter (one of them may be the query); the
    # limit is applied before and after the shuffle
    ranked = v.distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    stored = written(ranked.groupBy("digest", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids")), "vectors")
    sizes = [r[0] for r in stored.select(F.size("vec").alias("d")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of different dimensions: {sizes}")
    schema = "query_id bigint, vec_id bigint, score double"
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    n = stored.count()
    share = min(1.0, sample / n)
    some = stored.where(F.pmod(F.xxhash64("digest"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("vec")
    some = some.limit(sample).toPandas()["vec"]  # the hash spreads them evenly
    lists = max(1, min(n // list_size, len(some) // LEAF))
    shared = spark.sparkContext.broadcast(Centroids.of(_unit(some) if len(some) else np.ones((1, sizes[0])), lists))
    rows = "list int, kind int, ids array<bigint>, vec array<double>"
    posted = written(stored.select("ids", "vec").mapInPandas(_routes(shared, 0, REPLICA_RATIO, REPLICAS, 16), rows), "postings")
    asked = v.where(F.pmod("id", F.lit(every)) == 0).select(F.array("id").alias("ids"), "vec").distinct()
    asked = written(asked.mapInPandas(_routes(shared, 1, prune_ratio, None, 64), rows), "routes")
    blocks = posted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row per centroid
    posted = posted.join(F.broadcast(blocks), "list").withColumn("part", F.pmod(F.xxhash64("ids"), F.col("blocks")).cast("int"))
    asked = asked.join(F.broadcast(blocks), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = posted.select("list", "part", "kind", "ids", "vec").union(asked.select("list", "part", "kind", "ids", "vec"))
    both = both.repartition("list", "part").sortWithinPartitions("list", "part", "kind")
    found = both.mapInPandas(_compare(k), schema).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score")


def op6_ann(spark, sf_dir: str) -> DataFrame:
    """The five nearest found of every fiftieth vector."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
