"""Directed weighted graphs as two DataFrames: ``nodes(id, ...)`` and ``edges(src, dst, weight)``.

N-1..N-10, U-1, U-2, G-14..G-16, J-6, J-7, L-3.  Iterative algorithms run as a driver loop
of joins and aggregates; only one-row scalars are collected per round.  Loop state is written
to the shared folder each round (plan cut, survives executor loss) and deleted when the loop
ends.  Sides small enough to broadcast are left to Spark, which knows their written size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.permutation import dense_index
from ..session import Scratch, stage
from ..sources.tables import require_columns
from .hubs import HubJoin
from .kpi import group_means

BLOCK_SOURCES = 4096
"""Sources per pass of the all-sources algorithms: the state of a pass is at most this many rows per node."""


def materialize(df: DataFrame) -> DataFrame:
    """A (derived, reused) input written once to the shared folder."""
    return stage(df, "input")


def _empty(df: DataFrame) -> bool:
    return df.isEmpty()


# ------------------------------------------------------------------ construction


def build_graph(
    nodes: DataFrame,
    edges: DataFrame,
    features: DataFrame | None = None,
    feature_key: str = "setor",
    order_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """N-1, U-2, J-6: nodes (+ bare endpoint nodes) and de-duplicated edges.

    A repeated (src, dst) keeps the weight of its last row by ``order_col``, as an edge upsert
    in a loop does (ties in the order: the larger weight).  Rows of a table have no order of
    their own, so without an order column the largest weight is kept.
    ``features`` adds the per-key mean of every numeric column to matching nodes.
    """
    require_columns(nodes, "id")
    require_columns(edges, "src", "dst", "weight")
    e = edges.withColumn("weight", F.col("weight").cast("double"))
    if order_col:
        e = e.groupBy("src", "dst").agg(F.max_by("weight", F.struct(order_col, "weight")).alias("weight"))
    else:
        e = e.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    ends = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    extra = ends.join(nodes.select("id"), "id", "left_anti")
    all_nodes = nodes.unionByName(extra, allowMissingColumns=True)
    if features is not None:
        require_columns(features, feature_key)
        means = group_means(features, feature_key)
        all_nodes = all_nodes.join(means.withColumnRenamed(feature_key, "id"), "id", "left")
    return all_nodes, e


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G-14: one row (n_nodes, n_edges): two counts stacked and folded, no join."""
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.lit(None).cast("long").alias("n_edges"))
    m = edges.agg(F.lit(None).cast("long").alias("n_nodes"), F.count(F.lit(1)).alias("n_edges"))
    return n.unionByName(m).agg(F.max("n_nodes").alias("n_nodes"), F.max("n_edges").alias("n_edges"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G-15: weighted in- and out-degree per node (0.0 for none)."""
    ind = edges.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("in_degree_weight"))
    outd = edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("out_degree_weight"))
    return (
        nodes.select("id")
        .join(ind, "id", "left")
        .join(outd, "id", "left")
        .select(
            "id",
            F.coalesce("in_degree_weight", F.lit(0.0)).alias("in_degree_weight"),
            F.coalesce("out_degree_weight", F.lit(0.0)).alias("out_degree_weight"),
        )
    )


def to_undirected(edges: DataFrame, reciprocal: str = "max", order_col: str | None = None) -> DataFrame:
    """U-1 / N-7: one weight per unordered pair ``(u <= v)``.

    ``reciprocal``: "max" (keep the larger of u->v and v->u), "sum", or "last" (the row
    that comes last by ``order_col``).
    """
    u = F.least("src", "dst").alias("u")
    v = F.greatest("src", "dst").alias("v")
    e = edges.select(u, v, F.col("weight").cast("double").alias("weight"), *([order_col] if order_col else []))
    if reciprocal == "max":
        agg = F.max("weight")
    elif reciprocal == "sum":
        agg = F.sum("weight")
    elif reciprocal == "last":
        if not order_col:
            raise ValueError("reciprocal='last' needs order_col")
        agg = F.max_by("weight", order_col)
    else:
        raise ValueError(f"unknown reciprocal policy {reciprocal!r}")
    return e.groupBy("u", "v").agg(agg.alias("weight"))


# ------------------------------------------------------------------ PageRank


def pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    alpha: float = 0.85,
    max_iter: int = 100,
    tol: float = 1.0e-6,
    hub_edges: int | None = None,
    salts: int = 32,
) -> DataFrame:
    """N-3: weighted PageRank, uniform teleport and uniform dangling redistribution.

    Stops when the L1 change is below n * tol and raises if ``max_iter`` rounds do not reach
    that.  Per round:
    one join of the transition edges (partitioned once by (src, salt), reused every round)
    with the rank vector, one aggregate by dst (partial aggregation first), and one scalar
    (L1 change + dangling mass) to the driver.

    Skew: a source with more than ``hub_edges`` out-edges (default: a quarter of an even
    per-task share, at least 100k) has its edges spread over ``salts`` sub-keys by
    hash(dst), and its rank row is replicated once per salt, so a hub holding a large share
    of all edges is joined by many tasks.  The hub list is bounded by m / hub_edges rows.
    Returns (id, pagerank, iterations).
    """
    spark = nodes.sparkSession
    ids = nodes.select("id").distinct()
    n = ids.count()
    if n == 0:
        return ids.withColumn("pagerank", F.lit(None).cast("double")).withColumn("iterations", F.lit(0))
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    outw = e.groupBy("src").agg(F.sum("weight").alias("ws"), F.count(F.lit(1)).alias("deg"))
    if hub_edges is None:
        m = outw.agg(F.sum("deg")).first()[0] or 0
        hub_edges = max(100_000, m // (4 * spark.sparkContext.defaultParallelism))
    hubs = outw.where(F.col("deg") > hub_edges).select("src", F.lit(True).alias("hub"))
    n_hubs = hubs.count()
    salt_of = F.when(F.col("hub"), F.pmod(F.xxhash64("dst"), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    trans = (
        e.join(outw.where(F.col("ws") != 0), "src")
        .join(F.broadcast(hubs), "src", "left")
        .withColumn("hub", F.coalesce("hub", F.lit(False)))
        .select("src", salt_of.alias("salt"), "dst", (F.col("weight") / F.col("ws")).alias("p"))
        .repartition("src", "salt")
    )
    all_salts = F.sequence(F.lit(0), F.lit(salts - 1))
    with Scratch(spark, "pagerank") as scratch:
        trans = scratch.keep(trans)
        marked = scratch.keep(
            ids.join(outw.where(F.col("ws") != 0).select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left")
            .join(F.broadcast(hubs.withColumnRenamed("src", "id")), "id", "left")
            .select("id", F.coalesce("dangling", F.lit(True)).alias("dangling"), F.coalesce("hub", F.lit(False)).alias("hub"))
        )
        x = marked.select("id", "dangling", "hub", F.lit(1.0 / n).alias("x"))
        dsum = marked.agg(F.sum(F.when(F.col("dangling"), F.lit(1.0 / n)).otherwise(0.0))).first()[0] or 0.0
        for it in range(1, max_iter + 1):
            ranks = x.select(F.col("id").alias("src"), "x", "hub")
            if n_hubs:
                ranks = ranks.withColumn("salt", F.explode(F.when(F.col("hub"), all_salts).otherwise(F.array(F.lit(0)))))
            else:
                ranks = ranks.withColumn("salt", F.lit(0))
            contrib = trans.join(ranks.select("src", "salt", "x"), ["src", "salt"]).groupBy(F.col("dst").alias("id")).agg(
                F.sum(F.col("x") * F.col("p")).alias("c")
            )
            xn = scratch.keep(x.join(contrib, "id", "left").select(
                "id",
                "dangling",
                "hub",
                F.col("x").alias("x_old"),
                (
                    F.lit(alpha) * (F.coalesce(F.col("c"), F.lit(0.0)) + F.lit(dsum) * F.lit(1.0 / n))
                    + F.lit((1.0 - alpha) / n)
                ).alias("x"),
            ))
            r = xn.agg(
                F.sum(F.abs(F.col("x") - F.col("x_old"))).alias("err"),
                F.sum(F.when(F.col("dangling"), F.col("x")).otherwise(0.0)).alias("dsum"),
            ).first()
            x = xn.select("id", "dangling", "hub", "x")
            dsum = r["dsum"] or 0.0
            if r["err"] < n * tol:
                return materialize(x.select("id", F.col("x").alias("pagerank"), F.lit(it).alias("iterations")))
    raise RuntimeError(f"PageRank did not converge in {max_iter} rounds (last change {r['err']:.3g}, wanted < {n * tol:.3g})")


# ------------------------------------------------------------------ shortest paths


def _source_blocks(nodes: DataFrame, block_sources: int) -> tuple[DataFrame, int]:
    """(s, block): every node id as a source, hashed into blocks of about ``block_sources``."""
    ids = nodes.select(F.col("id").alias("s")).distinct()
    n = ids.count()
    blocks = max(1, -(-n // block_sources))
    return ids.withColumn("block", F.pmod(F.xxhash64("s"), F.lit(blocks))), blocks


def _hops(scratch: Scratch, sources: DataFrame, adj: DataFrame) -> DataFrame:
    """(s, v, d): hop distances from each source, breadth first.  Each round writes only the new
    frontier; a round's candidates are checked against the frontiers before."""
    frontier = scratch.keep(sources.select("s", F.col("s").alias("v"), F.lit(0).alias("d")))
    reached, h = frontier, 0
    while True:
        h += 1
        nxt = (
            frontier.join(adj, frontier.v == adj.src)
            .select("s", F.col("dst").alias("v"))
            .distinct()
            .join(reached.select("s", "v"), ["s", "v"], "left_anti")
            .withColumn("d", F.lit(h))
        )
        frontier = scratch.keep(nxt)
        if _empty(frontier):
            return reached
        reached = reached.union(frontier)


def closeness(nodes: DataFrame, edges: DataFrame, direction: str = "in", block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """N-4: closeness with the Wasserman-Faust correction, unweighted.

    ``direction="in"`` uses distances *to* the node (the default of the original), "out"
    distances from it.  c(u) = (r-1)/sum d * (r-1)/(n-1), r = nodes reaching u (incl. u).
    Sources are taken in blocks: a block's distances (at most ``block_sources`` x n rows) are
    summed per node and dropped, so no all-pairs table is ever held.
    """
    adj = edges.select("src", "dst") if direction == "in" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    spark = nodes.sparkSession
    with Scratch(spark, "closeness") as outer:
        adj = outer.keep(adj.distinct())
        sources, blocks = _source_blocks(nodes, block_sources)
        sources = outer.keep(sources)
        n = sources.count()
        sums = None
        for b in range(blocks):
            with Scratch(spark, "hops") as scratch:
                dist = _hops(scratch, sources.where(F.col("block") == b), adj)
                part = outer.keep(dist.groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("r"), F.sum("d").alias("tot")))
            sums = part if sums is None else sums.union(part)
        agg = sums.groupBy("id").agg(F.sum("r").alias("r"), F.sum("tot").alias("tot"))
        c = F.when(
            (F.col("tot") > 0) & F.lit(n > 1), (F.col("r") - 1) / F.col("tot") * (F.col("r") - 1) / F.lit(float(max(n - 1, 1)))
        ).otherwise(0.0)
        out = nodes.select("id").join(agg, "id", "left").select("id", F.coalesce(c, F.lit(0.0)).alias("closeness_centrality"))
        return materialize(out)


def _distances(scratch: Scratch, sources: DataFrame, ln: DataFrame) -> DataFrame:
    """(s, v, d): shortest distances from each source, lengths > 0.

    Relaxes from the pairs that the round before improved.  A distance is the sum of its path's
    lengths from the source on, in double precision, as Dijkstra's algorithm adds them.
    """
    dist = scratch.keep(sources.select("s", F.col("s").alias("v"), F.lit(0.0).alias("d"), F.lit(True).alias("chg")))
    while True:
        cand = (
            dist.where("chg").join(ln, F.col("v") == ln.src)
            .groupBy("s", F.col("dst").alias("v"))
            .agg(F.min(F.col("d") + F.col("len")).alias("dc"))
        )
        dist = scratch.keep(dist.join(cand, ["s", "v"], "full_outer").select(
            "s", "v",
            F.least(F.col("d"), F.col("dc")).alias("d"),
            (F.col("dc").isNotNull() & (F.col("d").isNull() | (F.col("dc") < F.col("d")))).alias("chg"),
        ))
        if _empty(dist.where("chg")):
            return dist.select("s", "v", "d")


def _dependencies(scratch: Scratch, sources: DataFrame, ln: DataFrame) -> DataFrame:
    """(id, b): Brandes' dependency sums of the given sources."""
    dist = _distances(scratch, sources, ln)
    du = dist.select("s", F.col("v").alias("src"), F.col("d").alias("du"))
    dv = dist.select("s", F.col("v").alias("dst"), F.col("d").alias("dv"))
    tight = scratch.keep(du.join(ln, "src").join(dv, ["s", "dst"]).where(F.col("du") + F.col("len") == F.col("dv")).select(
        "s", F.col("src").alias("u"), F.col("dst").alias("v"), (F.col("du") == F.col("dv")).alias("flat")
    ))
    if not _empty(tight.where("flat")):
        raise ValueError("an edge is too short beside the distances for double precision to tell its ends apart")
    # path counts by layers of hops; lengths are positive, so the tight edges have no cycle and
    # the layers end.  The last layer of a node is its longest tight path: its level.
    layer = scratch.keep(sources.select("s", F.col("s").alias("v"), F.lit(1).cast("decimal(38,0)").alias("c")))
    layers, h = layer.withColumn("h", F.lit(0)), 0
    while True:
        h += 1
        layer = scratch.keep(tight.join(layer.withColumnRenamed("v", "u"), ["s", "u"]).groupBy("s", "v").agg(F.sum("c").alias("c")))
        if _empty(layer):
            break
        layers = layers.union(layer.withColumn("h", F.lit(h)))
    sigma = scratch.keep(layers.groupBy("s", "v").agg(F.sum("c").cast("double").alias("sigma"), F.max("h").alias("level")))
    su = sigma.select("s", F.col("v").alias("u"), F.col("sigma").alias("su"), F.col("level").alias("above"))
    coef = scratch.path()
    tight.join(su, ["s", "u"]).join(sigma, ["s", "v"]).select(
        "s", "u", "v", "above", "level", (F.col("su") / F.col("sigma")).alias("q")
    ).write.partitionBy("level").parquet(coef)
    # dependencies from the deepest level up; each level is written once, split by the level that reads it
    kind, read = sigma.schema["s"].dataType.simpleString(), scratch.spark.read
    paths = read.schema(f"s {kind}, u {kind}, v {kind}, above int, q double, level int").parquet(coef)
    given, schema = scratch.path(), f"s {kind}, v {kind}, x double, level int"
    for level in range(h - 1, 0, -1):
        here = paths.where(F.col("level") == level)
        if level < h - 1:
            delta = scratch.spark.read.schema(schema).parquet(given).where(F.col("level") == level).groupBy("s", "v").agg(F.sum("x").alias("delta"))
            here = here.join(delta, ["s", "v"], "left")
        else:
            here = here.withColumn("delta", F.lit(0.0))
        x = F.col("q") * (F.lit(1.0) + F.coalesce(F.col("delta"), F.lit(0.0)))
        here.select("s", F.col("u").alias("v"), x.alias("x"), F.col("above").alias("level")).write.mode("append").partitionBy("level").parquet(given)
    if h > 1:
        total = scratch.spark.read.schema(schema).parquet(given).where(F.col("s") != F.col("v"))
        return total.groupBy(F.col("v").alias("id")).agg(F.sum("x").alias("b"))
    return sources.select(F.col("s").alias("id"), F.lit(0.0).alias("b"))


def _lengths(edges: DataFrame, distance: str) -> DataFrame:
    """(src, dst, len, bad): the shortest length per ordered pair of different nodes; ``bad`` counts those not positive."""
    if distance == "weight":
        length: Column = F.col("weight").cast("double")
    elif distance == "inverse":
        length = F.try_divide(F.lit(1.0), F.col("weight").cast("double"))
    elif distance == "hops":
        length = F.lit(1.0)
    else:
        raise ValueError(f"unknown distance {distance!r}")
    ln = edges.where(F.col("src") != F.col("dst")).select("src", "dst", length.alias("len"))
    return ln.groupBy("src", "dst").agg(F.min("len").alias("len"), F.count_if(~F.coalesce(F.col("len") > 0, F.lit(False))).alias("bad"))


def _dependency_sums(outer: Scratch, sources: DataFrame, blocks: int, edges: DataFrame, distance: str) -> DataFrame:
    """(id, b): Brandes' dependencies of the ``sources`` (s, block), summed over the blocks; raises unless all
    lengths are positive."""
    ln = outer.keep(_lengths(edges, distance))
    if not _empty(ln.where("bad > 0")):
        raise ValueError("betweenness needs positive edge lengths")
    ln = ln.select("src", "dst", "len")
    sums = None
    for b in range(blocks):
        with Scratch(sources.sparkSession, "paths") as scratch:
            part = outer.keep(_dependencies(scratch, sources.where(F.col("block") == b).select("s"), ln))
        sums = part if sums is None else sums.union(part)
    return sums.groupBy("id").agg(F.sum("b").alias("b"))


def betweenness(
    nodes: DataFrame, edges: DataFrame, normalized: bool = True, distance: str = "weight", block_sources: int = BLOCK_SOURCES
) -> DataFrame:
    """N-2: shortest-path betweenness (Brandes accumulation as joins).

    ``distance="weight"`` uses the edge weight as length (the original's choice),
    "inverse" uses 1/weight, "hops" ignores weights.  Lengths are the doubles as given and must
    be positive, else this raises.  Steps per block of sources: distances; tight edges
    d(s,u)+len(u,v) = d(s,v); path counts sigma (exact integers); dependencies
    delta(s,u) = sum over tight (u,v) of sigma(s,u)/sigma(s,v) * (1 + delta(s,v)), level by
    level from the farthest.  A block's sums are added per node and its state (at most
    ``block_sources`` rows per node and per edge) is dropped.
    Normalised for directed graphs by 1/((n-1)(n-2)).  Output (id, betweenness_centrality).
    """
    with Scratch(nodes.sparkSession, "betweenness") as outer:
        sources, blocks = _source_blocks(nodes, block_sources)
        sources = outer.keep(sources)
        n = sources.count()
        total = _dependency_sums(outer, sources, blocks, edges, distance)
        scale = 1.0 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0
        return materialize(nodes.select("id").join(total, "id", "left").select(
            "id", (F.coalesce(F.col("b"), F.lit(0.0)) * F.lit(scale)).alias("betweenness_centrality")
        ))


def sampled_sources(nodes: DataFrame, samples: int, seed: int = 123) -> DataFrame:
    """(s): the ``samples`` node ids with the smallest md5 of ``seed:id`` (all, if there are fewer)."""
    ids = nodes.select(F.col("id").alias("s")).distinct()
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("s").cast("string")).cast("binary"))
    return ids.withColumn("order", order).orderBy("order", "s").limit(samples).select("s")


def sampled_betweenness(
    nodes: DataFrame, edges: DataFrame, samples: int, normalized: bool = True, distance: str = "weight", seed: int = 123,
    failure: float = 0.1, block_sources: int = BLOCK_SOURCES,
) -> DataFrame:
    """N-2 for large graphs: Brandes' dependencies of ``samples`` hash-chosen sources, scaled by n / samples.

    The work is samples * m instead of n * m.  Output (id, betweenness_centrality, error_bound): a source's
    dependency on a node is between 0 and n - 2, so by Hoeffding's inequality over all nodes at once, every node
    is within ``error_bound`` of the exact value but with probability ``failure``.  With as many samples as nodes
    the result is exact and the bound 0.
    """
    with Scratch(nodes.sparkSession, "sampled") as outer:
        n = nodes.select("id").distinct().count()
        sources = outer.keep(sampled_sources(nodes, samples, seed))
        k = sources.count()
        blocks = max(1, -(-k // block_sources))
        sources = outer.keep(sources.withColumn("block", F.pmod(F.xxhash64("s"), F.lit(blocks))))
        total = _dependency_sums(outer, sources, blocks, edges, distance)
        scale = n / k if k else 0.0
        bound = scale * (n - 2) * math.sqrt(k * math.log(2 * n / failure) / 2) if 0 < k < n and n > 2 else 0.0
        if normalized and n > 2:
            scale, bound = scale / ((n - 1) * (n - 2)), bound / ((n - 1) * (n - 2))
        return materialize(nodes.select("id").join(total, "id", "left").select(
            "id", (F.coalesce(F.col("b"), F.lit(0.0)) * F.lit(scale)).alias("betweenness_centrality"), F.lit(float(bound)).alias("error_bound")
        ))


def sketched_closeness(nodes: DataFrame, edges: DataFrame, direction: str = "in", lg_k: int = 12) -> DataFrame:
    """N-4 for large graphs: closeness from a sketch of the nodes that reach each node within h hops, h = 1, 2, ...

    A node keeps one HyperLogLog sketch of 2^lg_k registers; in a round it takes the union with the sketches
    that changed at the other ends of its edges (hubs in sub-keys), and what its estimate grows by lies h hops away. n rows of
    state and one pass over the edges a round, as many rounds as the longest shortest path.  The number of nodes
    reached has a relative standard error of about 1.04 / 2^(lg_k / 2) (1.6 % by default), the sum of distances
    likewise; sets of up to some 2^lg_k / 11 nodes are counted exactly.
    Output (id, closeness_centrality, reached): ``reached`` estimates the nodes that reach this one, itself included.
    """
    near, far = ("src", "dst") if direction == "in" else ("dst", "src")
    spark = nodes.sparkSession
    with Scratch(spark, "sketches") as scratch:
        ids = scratch.keep(nodes.select("id").distinct())
        n = ids.count()
        if n == 0:
            return materialize(ids.select("id", F.lit(0.0).alias("closeness_centrality"), F.lit(0).cast("long").alias("reached")))
        arcs = edges.select(F.col(near).alias("from"), F.col(far).alias("to")).where(F.col("from") != F.col("to")).distinct()
        arcs = arcs.join(ids.select(F.col("id").alias("from")), "from").join(ids.select(F.col("id").alias("to")), "to")
        hubs = HubJoin(scratch.keep(arcs.select("from", "to")), "from", "to")
        arcs = scratch.keep(hubs.edges)
        state = ids.groupBy("id").agg(F.hll_sketch_agg("id", lg_k).alias("sketch"))
        state = scratch.keep(state.select("id", "sketch", F.lit(1).cast("long").alias("r"), F.lit(0).cast("long").alias("tot"), F.lit(True).alias("grew")))
        h = 0
        while True:
            h += 1
            sent = hubs.join(state.where("grew").select("id", "sketch"), edges=arcs)
            sent = sent.groupBy(F.col("to").alias("id")).agg(F.hll_union_agg("sketch").alias("more"))
            both = state.join(sent, "id", "left").withColumn("sketch", F.coalesce(F.hll_union("sketch", "more"), "sketch"))
            both = both.withColumn("now", F.greatest(F.hll_sketch_estimate("sketch"), "r"))
            state = scratch.keep(both.select(
                "id", "sketch", F.col("now").alias("r"), (F.col("tot") + h * (F.col("now") - F.col("r"))).alias("tot"), (F.col("now") > F.col("r")).alias("grew")
            ))
            if _empty(state.where("grew")):
                break
        c = F.when((F.col("tot") > 0) & F.lit(n > 1), (F.col("r") - 1) / F.col("tot") * (F.col("r") - 1) / F.lit(float(max(n - 1, 1)))).otherwise(0.0)
        return materialize(nodes.select("id").join(state.select("id", c.alias("closeness_centrality"), F.col("r").alias("reached")), "id"))


# ------------------------------------------------------------------ communities


def modularity(und: DataFrame, membership: DataFrame, community: str = "community") -> DataFrame:
    """N-9: Q = sum_c [ L_c/m - (D_c / 2m)^2 ] for an undirected weighted edge list (u, v, weight).

    A self-loop counts twice in the degree and once in L_c.  One-row result (modularity).
    """
    mem = membership.select(F.col("id"), F.col(community).alias("c"))
    ends = und.select(F.col("u").alias("id"), "weight").unionByName(und.select(F.col("v").alias("id"), "weight"))
    deg = ends.join(mem, "id").groupBy("c").agg(F.sum("weight").alias("D"))
    inside = (
        und.join(mem.withColumnRenamed("id", "u").withColumnRenamed("c", "cu"), "u")
        .join(mem.withColumnRenamed("id", "v").withColumnRenamed("c", "cv"), "v")
        .where(F.col("cu") == F.col("cv"))
        .groupBy(F.col("cu").alias("c"))
        .agg(F.sum("weight").alias("L"))
    )
    m = und.agg(F.sum("weight")).first()[0] or 0.0
    if m == 0:
        return und.sparkSession.range(1).select(F.lit(None).cast("double").alias("modularity"))
    per = deg.join(inside, "c", "left").select(
        (F.coalesce(F.col("L"), F.lit(0.0)) / F.lit(m) - (F.col("D") / F.lit(2.0 * m)) * (F.col("D") / F.lit(2.0 * m))).alias("q")
    )
    return per.agg(F.sum("q").alias("modularity"))


RENAMES = 16
"""Single merges after which the labels are written again (until then they are renamed in the plan)."""


def greedy_communities(nodes: DataFrame, und: DataFrame, mode: str = "sequential") -> DataFrame:
    """N-8: greedy modularity merging on an undirected weighted graph.

    Starts from singletons; joins communities while a pair of neighbouring ones has a gain
    dQ = w_ab/m - 2 (D_a/2m)(D_b/2m) >= 0.  ``mode="sequential"``, the original's order, joins
    the single best pair (ties: smaller ids) and costs one driver round per merge;
    ``mode="parallel"`` joins every pair of communities that are each other's best, which
    needs far fewer rounds and may end in another partition.  Both run until no pair is left.
    Community numbers are 0.. by size desc, then smallest member.  Output (id, community).
    """
    if mode not in ("sequential", "parallel"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = nodes.sparkSession
    with Scratch(spark, "communities") as scratch:
        ids = nodes.select("id").distinct()
        ends = und.select(F.col("u").alias("id"), "weight").unionByName(und.select(F.col("v").alias("id"), "weight"))
        m = und.agg(F.sum("weight")).first()[0] or 0.0
        label = scratch.keep(ids.select("id", F.col("id").alias("c")))
        # communities as a weighted graph of their own: it shrinks with every merge
        deg = scratch.keep(ids.join(ends.groupBy("id").agg(F.sum("weight").alias("k")), "id", "left").select(
            F.col("id").alias("c"), F.coalesce("k", F.lit(0.0)).alias("D")
        ))
        pairs = scratch.keep(und.where(F.col("u") != F.col("v")).groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(
            F.sum("weight").alias("w")
        ))
        merged = 0
        while m > 0:
            gain = (
                pairs.join(deg.select(F.col("c").alias("a"), F.col("D").alias("Da")), "a")
                .join(deg.select(F.col("c").alias("b"), F.col("D").alias("Db")), "b")
                .select("a", "b", (F.col("w") / F.lit(m) - F.lit(2.0) * (F.col("Da") / F.lit(2 * m)) * (F.col("Db") / F.lit(2 * m))).alias("dq"))
                .where(F.col("dq") >= 0)
            )
            if mode == "sequential":
                best = gain.agg(F.min(F.struct((-F.col("dq")).alias("order"), "a", "b")).alias("p")).first()["p"]
                if best is None:
                    break
                merged += 1

                def renamed(df, c, keep=best["a"], drop=best["b"]):
                    return df.withColumn(c, F.when(F.col(c) == F.lit(drop), F.lit(keep)).otherwise(F.col(c)))

            else:
                # best neighbour per community: largest dq, then smallest id, as a partial
                # aggregate (no window group per community, so a hub community is split up)
                both = gain.select(F.col("a").alias("x"), F.col("b").alias("y"), "dq").unionByName(
                    gain.select(F.col("b").alias("x"), F.col("a").alias("y"), "dq")
                )
                choice = scratch.keep(both.groupBy("x").agg(F.min_by("y", F.struct((-F.col("dq")).alias("order"), "y")).alias("y")))
                merges = scratch.keep(choice.alias("p").join(
                    choice.alias("q"), (F.col("p.x") == F.col("q.y")) & (F.col("p.y") == F.col("q.x"))
                ).where(F.col("p.x") < F.col("p.y")).select(F.col("p.x").alias("_keep"), F.col("p.y").alias("_drop")))
                if _empty(merges):
                    break

                def renamed(df, c, merges=merges):
                    to = merges.withColumnRenamed("_drop", c)
                    return df.join(to, c, "left").withColumn(c, F.coalesce("_keep", c)).drop("_keep")

            label = renamed(label, "c").select("id", "c")
            if mode == "parallel" or merged % RENAMES == 0:
                label = scratch.keep(label)
            deg = scratch.keep(renamed(deg, "c").groupBy("c").agg(F.sum("D").alias("D")))
            moved = renamed(renamed(pairs, "a"), "b").where(F.col("a") != F.col("b"))
            pairs = scratch.keep(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")))
        sizes = label.groupBy("c").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
        order = dense_index(sizes, F.desc("size"), F.asc("first"), out="community")
        return materialize(label.join(order.select("c", "community"), "c").select("id", F.col("community").cast("int")))


def community_attributes(nodes: DataFrame, membership: DataFrame, prefix: str = "Ecossistema") -> DataFrame:
    """N-10: community id and its label "<prefix> <id+1>" on every node (NULL if unassigned)."""
    return nodes.join(membership.select("id", "community"), "id", "left").withColumn(
        "community_label",
        F.when(F.col("community").isNotNull(), F.format_string(f"{prefix} %d", F.col("community") + 1)),
    )


MEMBERS_PER_ROW = 1000


def community_members(membership: DataFrame, community: str = "community", per_row: int = MEMBERS_PER_ROW) -> DataFrame:
    """G-16, F-6: members per community in id order, as joined text, largest community first.

    A row holds at most ``per_row`` members (``part`` 0, 1, ...), so that a community of any
    size is no single array.  Output (community, size, part, members_text).
    """
    sizes = membership.groupBy(community).agg(F.count(F.lit(1)).alias("size"))
    placed = dense_index(membership.select(community, "id"), community, "id", out="_at")
    first = placed.groupBy(community).agg(F.min("_at").alias("_first"))
    part = F.floor((F.col("_at") - F.col("_first")) / F.lit(per_row)).cast("int")
    rows = placed.join(first, community).groupBy(community, part.alias("part")).agg(
        F.array_join(F.sort_array(F.collect_list("id")), ", ").alias("members_text")  # <= per_row members
    )
    return rows.join(sizes, community).select(community, "size", "part", "members_text").orderBy(F.desc("size"), F.asc(community), F.asc("part"))


def centrality_ranking(
    nodes: DataFrame,
    edges: DataFrame,
    attributes: Sequence[str] = ("categoria", "cnae"),
    alpha: float = 0.85,
) -> DataFrame:
    """N-6, J-7, L-3: the 8-column centrality table sorted by betweenness (desc), then id."""
    bt = betweenness(nodes, edges)
    pr = pagerank(nodes, edges, alpha=alpha).select("id", "pagerank")
    cl = closeness(nodes, edges)
    dg = degrees(nodes, edges)
    attrs = [F.coalesce(F.col(a).cast("string"), F.lit("N/A")).alias(a) for a in attributes if a in nodes.columns]
    base = nodes.select("id", *attrs)
    out = base
    for part in (bt, pr, cl, dg):
        out = out.join(part, "id", "left")
    metric_cols = ["betweenness_centrality", "pagerank", "closeness_centrality", "in_degree_weight", "out_degree_weight"]
    return out.select(
        F.col("id").alias("setor"), *[a for a in attributes if a in nodes.columns],
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in metric_cols],
    ).orderBy(F.desc("betweenness_centrality"), F.asc("setor"))
