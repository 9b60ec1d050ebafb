"""N-8 by multi-level local moving: communities of large weighted graphs in few rounds.

A level starts with every vertex on its own. In a round, every vertex finds the neighbouring community that
would raise modularity most; those that a coin picks (a hash of id, level and try: the same in every run) move at
once. Moves made together can spoil each other: a round that does not raise modularity is undone and tried
again with half as many movers, in the end with the best one alone, so modularity rises with every round that counts. When no vertex wishes to
move, or the rounds gain less than ``min_gain``, communities become the vertices of the next level. After the last
level the nodes themselves may move again, from the communities found, and the levels go on from there until
no node wishes to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.permutation import dense_index
from ..session import Scratch, stage
from .hubs import HubJoin

TINY = 1e-12
"""A gain must be more than this to be one."""


def coin(vertex: Column, level: int, attempt: int) -> Column:
    """28 bits of the md5 of ``id:level:try``."""
    digest = F.md5(F.concat_ws(":", vertex.cast("string"), F.lit(str(level)), F.lit(str(attempt))).cast("binary"))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")


def wishes(label: DataFrame, vertices: DataFrame, both: HubJoin, m: float) -> DataFrame:
    """(id, to, gain): of every vertex with one the best move, the largest gain (ties: the smallest community).

    Moving i from A to B gains (w(i,B) - w(i,A)) / m - k_i (D_B - D_A + k_i) / 2m^2, where w counts edges to others.
    """
    degree = label.join(vertices, "id").groupBy("c").agg(F.sum("k").alias("D"))
    near = both.join(label.withColumnRenamed("c", "to"), "id").groupBy(F.col("src").alias("id"), "to").agg(F.sum("w").alias("w"))
    own = label.join(vertices.select("id", "k"), "id").join(degree.withColumnRenamed("D", "Dc"), "c")
    seen = near.join(own, "id")
    away = seen.where(F.col("to") != F.col("c")).join(degree.select(F.col("c").alias("to"), F.col("D").alias("Dt")), "to")
    stay = seen.where(F.col("to") == F.col("c")).select("id", F.col("w").alias("wa"))
    gain = (F.col("w") - F.coalesce("wa", F.lit(0.0))) / F.lit(m) - F.col("k") * (F.col("Dt") - F.col("Dc") + F.col("k")) / F.lit(2 * m * m)
    away = away.join(stay, "id", "left").select("id", "to", gain.alias("gain")).where(F.col("gain") > TINY)
    best = away.groupBy("id").agg(F.min(F.struct((-F.col("gain")).alias("order"), "to")).alias("x"))
    return best.select("id", F.col("x.to").alias("to"), (-F.col("x.order")).alias("gain"))


def _quality(label: DataFrame, vertices: DataFrame, pairs: DataFrame, m: float, *counts: Column) -> tuple:
    """Modularity of a level's labels (inner weight, with what lies within vertices, less squared degrees), and
    sums of ``counts`` over the label rows: one job."""
    inner = pairs.join(label.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(label.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
    none = [F.lit(0).cast("long").alias(f"n{i}") for i in range(len(counts))]
    w = inner.where(F.col("ca") == F.col("cb")).agg((F.sum("w") / F.lit(m)).alias("q"), *[F.max(x).alias(f"n{i}") for i, x in enumerate(none)])
    sums = [F.sum(x.cast("long")).alias(f"n{i}") for i, x in enumerate(counts)]
    per = label.join(vertices, "id").groupBy("c").agg(F.sum("k").alias("D"), F.sum("loop").alias("loop"), *sums)
    per = per.agg(F.sum(F.col("loop") / F.lit(m) - F.col("D") * F.col("D") / F.lit(4 * m * m)).alias("q"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(counts))])
    row = w.union(per).agg(F.sum("q"), *[F.sum(f"n{i}") for i in range(len(counts))]).first()
    return (row[0] or 0.0, *[x or 0 for x in row[1:]])


class _Moves:
    """The rounds of all levels: counts, limits and the shared folder."""

    def __init__(self, scratch: Scratch, m: float, min_gain: float, max_rounds: int):
        self.scratch, self.m, self.min_gain, self.max_rounds, self.rounds, self.level = scratch, m, min_gain, max_rounds, 0, 0

    def settle(self, label: DataFrame, vertices: DataFrame, pairs: DataFrame) -> tuple[DataFrame, bool]:
        """Rounds of one level from ``label`` (id, c): the last labels, and whether any vertex moved."""
        both = HubJoin(self.scratch.keep(pairs.select(F.col("a").alias("src"), F.col("b").alias("id"), "w").union(
            pairs.select(F.col("b").alias("src"), F.col("a").alias("id"), "w")
        )), "id", "src")
        (q,) = _quality(label, vertices, pairs, self.m)
        parts, attempt, moved, asked = 2, 0, False, None
        while True:
            fresh = asked is None
            if fresh:
                asked = label.join(wishes(label, vertices, both, self.m), "id", "left").select("id", F.col("c").alias("old"), "to", "gain")
            goes = F.pmod(coin(F.col("id"), self.level, attempt), F.lit(parts)) == 0
            if not fresh and parts > wished:  # one at a time: the move that gains most cannot be spoilt
                goes = F.col("id") == F.lit(asked.where("to is not null").agg(F.min(F.struct((-F.col("gain")).alias("g"), "id")).alias("x")).first()["x"]["id"])
            goes = F.col("to").isNotNull() & goes
            after = self.scratch.keep(asked.select("id", "old", "to", "gain", F.when(goes, F.col("to")).otherwise(F.col("old")).alias("c")))
            now, wished = _quality(after, vertices, pairs, self.m, F.col("to").isNotNull())
            if fresh and not wished:
                break
            attempt, self.rounds = attempt + 1, self.rounds + 1
            if self.rounds > self.max_rounds:
                raise RuntimeError(f"communities still move after {self.max_rounds} rounds")
            if now > q + TINY:
                done = now - q < self.min_gain and parts == 2
                q, label, moved, asked, parts = now, after.select("id", "c"), True, None, max(2, parts // 2)
                if done:
                    break
            else:
                asked, parts = after.select("id", "old", "to", "gain"), 2 * parts
        self.level += 1
        return label, moved

    def lift(self, label: DataFrame, vertices: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The communities as vertices (id, k, loop) and their pairs (a, b, w)."""
        lifted = pairs.join(label.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(label.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
        lifted = self.scratch.keep(lifted.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("w")))
        within = lifted.where("a = b").select(F.col("a").alias("c"), F.col("w").alias("more"))
        sums = label.join(vertices, "id").groupBy("c").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"))
        up = sums.join(within, "c", "left").select(F.col("c").alias("id"), "k", (F.col("loop") + F.coalesce("more", F.lit(0.0))).alias("loop"))
        return self.scratch.keep(up), lifted.where("a != b")


def louvain(nodes: DataFrame, und: DataFrame, min_gain: float = 1e-5, max_rounds: int = 1000) -> DataFrame:
    """Communities of the undirected weighted graph ``und`` (u, v, weight > 0) over ``nodes`` (id).

    Output (id, community, levels, rounds): community 0.. by size (largest first), then smallest member; how many
    levels there were, those of the nodes counted each time, and how many rounds in all. Nodes without edges are communities of their own,
    edge ends that are no nodes are left out; without any edge every node stays alone. A level ends when no
    vertex wishes to move or a full round gains less than ``min_gain``; raises after ``max_rounds``.

    A round costs two joins of the edges with the labels (hubs in sub-keys) and aggregates that are combined
    before they shuffle; it is written to the shared folder. Scalars reach the driver, and the names of hubs.
    """
    spark = nodes.sparkSession
    with Scratch(spark, "louvain") as scratch:
        ids = scratch.keep(nodes.select("id").distinct())
        inside = und.join(ids.select(F.col("id").alias("u")), "u").join(ids.select(F.col("id").alias("v")), "v")
        inside = scratch.keep(inside.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.col("weight").cast("double").alias("w")))
        if not inside.where(~F.coalesce(F.col("w") >= 0, F.lit(False))).isEmpty():
            raise ValueError("communities need weights that are not negative")
        m = inside.agg(F.sum("w")).first()[0] or 0.0
        pairs = scratch.keep(inside.where("a != b").groupBy("a", "b").agg(F.sum("w").alias("w")).where("w > 0"))
        loops = inside.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("loop"))
        ends = pairs.select(F.col("a").alias("id"), "w").union(pairs.select(F.col("b").alias("id"), "w")).groupBy("id").agg(F.sum("w").alias("k"))
        zero = F.lit(0.0)
        vertices = scratch.keep(ids.join(ends, "id", "left").join(loops, "id", "left").select(
            "id", (F.coalesce("k", zero) + 2 * F.coalesce("loop", zero)).alias("k"), F.coalesce("loop", zero).alias("loop")
        ))
        member = scratch.keep(ids.select("id", F.col("id").alias("c")))
        moves, again = _Moves(scratch, m, min_gain, max_rounds), m > 0
        while again:
            member, again = moves.settle(member, vertices, pairs)
            upper, links, label, lifted = vertices, pairs, member, again
            while lifted:
                upper, links = moves.lift(label, upper, links)
                label, lifted = moves.settle(upper.select("id", F.col("id").alias("c")), upper, links)
                if lifted:
                    member = scratch.keep(member.withColumnRenamed("c", "was").join(label.select(F.col("id").alias("was"), "c"), "was").select("id", "c"))
        sizes = member.groupBy("c").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
        order = dense_index(sizes, F.desc("size"), F.asc("first"), out="community")
        return stage(member.join(order.select("c", "community"), "c").select(
            "id", F.col("community").cast("int"), F.lit(moves.level).alias("levels"), F.lit(moves.rounds).alias("rounds")
        ), "communities")
