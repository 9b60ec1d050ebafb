"""Spatial neighbour weights as edge DataFrames ``(src, dst, w)`` (J-1..J-5, X-1, P-14, G-17).

W is never a dense matrix: it is a sparse edge list partitioned like any other table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, stage
from ..sources.tables import require_columns

# ------------------------------------------------------------------ k nearest neighbours


def _bbox(points: DataFrame, x: str, y: str) -> tuple[int, float, float, float, float]:
    r = points.agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")
    ).first()
    return int(r["n"]), float(r["x0"] or 0.0), float(r["x1"] or 0.0), float(r["y0"] or 0.0), float(r["y1"] or 0.0)


def knn(points: DataFrame, k: int = 4, id_col: str = "id", x: str = "x", y: str = "y", hot_cell_factor: int = 16) -> DataFrame:
    """J-2: exact k nearest neighbours (Euclidean, self excluded, ties broken by neighbour id).

    Returns ``(src, dst, d2, rank)``.  No all-pairs join: points are bucketed into square
    cells; each point compares itself with the 3x3 block of cells around it and is accepted
    once its k-th distance is strictly inside the block's border (so no point outside the
    block can be closer).  Unresolved points retry on a grid twice as coarse, level by level,
    until one cell spans all points.

    A cell with more than ``hot_cell_factor * (k+1)`` points is halved, and its hot quarters
    again, until every cell is below that bound or holds one location; a point starts on the
    level of its cell.  So a dense spot of any shape is no quadratic candidate set.  A sparse
    point whose larger block reaches into a dense spot goes down the spot's quarters by their
    counts and looks only at the points of cells near enough (``_near_cells``).
    """
    require_columns(points, id_col, x, y)
    spark = points.sparkSession
    pts = points.select(F.col(id_col).alias("pid"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
    pts = pts.where(F.col("px").isNotNull() & F.col("py").isNotNull() & ~F.isnan("px") & ~F.isnan("py"))
    with Scratch(spark, "knn") as scratch:
        pts = scratch.keep(pts)
        n, x0, x1, y0, y1 = _bbox(pts, "px", "py")
        if n == 0:
            return spark.createDataFrame([], f"src {_id_type(points, id_col)}, dst {_id_type(points, id_col)}, d2 double, rank int")
        extent = max(x1 - x0, y1 - y0, 1e-12)
        area = max((x1 - x0) * (y1 - y0), extent * extent * 1e-6)
        c0 = min(extent, math.sqrt(area * (k + 1) / n))
        max_level = max(0, math.ceil(math.log2(extent / c0)) + 1)  # at this level one cell spans the bbox

        def cell(size: float):
            return (
                F.floor((F.col("px") - F.lit(x0)) / F.lit(size)).cast("long"),
                F.floor((F.col("py") - F.lit(y0)) / F.lit(size)).cast("long"),
            )

        # Identical coordinates: points at one location are at equal distance from everyone,
        # so (ties by id) only the k smallest ids of a location can be anyone's neighbour.  The
        # candidate side keeps just those (row_number filter, limited per group before the
        # shuffle), and points of a location holding more than k points take their neighbours
        # directly from its k+1 smallest ids at distance 0 - a location holding a third of all
        # points never becomes a quadratic candidate set.
        results = []
        gsize = pts.groupBy("px", "py").agg(F.count(F.lit(1)).alias("m"))
        max_m = int(gsize.agg(F.max("m")).first()[0] or 0)
        probe_pts, build_pts = pts, pts
        if max_m > k:
            first_ids = pts.withColumn("drk", F.row_number().over(Window.partitionBy("px", "py").orderBy("pid")))
            first_ids = scratch.keep(first_ids.where(F.col("drk") <= k + 1))
            crowded = gsize.where(F.col("m") > k).select("px", "py")
            members = pts.join(crowded, ["px", "py"], "left_semi").select(F.col("pid").alias("src"), "px", "py")
            same = members.join(first_ids.select("px", "py", F.col("pid").alias("dst"), "drk"), ["px", "py"]).where(
                F.col("src") != F.col("dst")
            )
            same = same.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("drk"))).where(F.col("rank") <= k)
            results.append(scratch.keep(same.select("src", "dst", F.lit(0.0).alias("d2"), "rank")))
            probe_pts = scratch.keep(pts.join(crowded, ["px", "py"], "left_anti"))
            build_pts = scratch.keep(first_ids.where(F.col("drk") <= k).select("pid", "px", "py"))

        hot = hot_cell_factor * (k + 1)
        waiting, lowest = _start_levels(scratch, probe_pts, build_pts, cell, c0, extent, hot)
        level = lowest
        slack = 1e-15 * (extent + abs(x0) + abs(y0))  # of a point against its cell's box

        def reach(lvl):
            """Squared distances from (sx, sy) to the nearest and the farthest place of the cell (kx, ky) on ``lvl``."""
            side = F.lit(c0) * F.pow(F.lit(2.0), lvl)
            near, far = F.lit(0.0), F.lit(0.0)
            for at, key, low in ((F.col("sx"), F.col("kx"), x0), (F.col("sy"), F.col("ky"), y0)):
                pad = side * 1e-9 + F.lit(slack)
                lo, hi = F.lit(low) + key * side - pad, F.lit(low) + (key + 1) * side + pad
                outside = F.greatest(lo - at, at - hi, F.lit(0.0))
                across = F.greatest(F.abs(at - lo), F.abs(hi - at))
                near, far = near + outside * outside, far + across * across
            return near, far

        offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
        while True:
            size = c0 * (2.0 ** level)
            covers_all = level >= max_level
            active = waiting.where(F.col("lvl") <= level)
            qx, qy = cell(size)
            probe_cells = active.select(
                F.col("pid").alias("src"), F.col("px").alias("sx"), F.col("py").alias("sy"), "lvl", qx.alias("cx"), qy.alias("cy")
            )
            lo_x = F.lit(x0) + (F.col("cx") - 1).cast("double") * F.lit(size)
            hi_x = F.lit(x0) + (F.col("cx") + 2).cast("double") * F.lit(size)
            lo_y = F.lit(y0) + (F.col("cy") - 1).cast("double") * F.lit(size)
            hi_y = F.lit(y0) + (F.col("cy") + 2).cast("double") * F.lit(size)
            border = F.least(F.col("sx") - lo_x, hi_x - F.col("sx"), F.col("sy") - lo_y, hi_y - F.col("sy")) - F.lit(1e-9 * size)
            probe_cells = probe_cells.withColumn("border", border).withColumn("o", F.explode(offsets)).select(
                "src", "sx", "sy", "lvl", "border", (F.col("cx") + F.col("o.dx")).alias("kx"), (F.col("cy") + F.col("o.dy")).alias("ky")
            )
            build = build_pts.select(F.col("pid").alias("dst"), F.col("px").alias("tx"), F.col("py").alias("ty"), qx.alias("kx"), qy.alias("ky"))
            # left join: a probe whose block is empty still yields one (NULL) row and stays visible
            near = None
            if level > lowest:
                full = build.groupBy("kx", "ky").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") > hot)
                crossing = scratch.keep(probe_cells.join(full, ["kx", "ky"], "left_semi").select("src").distinct())
                if not crossing.isEmpty():
                    blocks = probe_cells.join(crossing, "src", "left_semi")
                    near = _near_cells(scratch, blocks, build_pts, cell, c0, reach, level, lowest, k, hot)
                    probe_cells = probe_cells.join(crossing, "src", "left_anti")
            cand = probe_cells.join(build, ["kx", "ky"], "left")
            if near is not None:
                cand = cand.unionByName(_cell_points(near, build_pts, cell, c0))
            cand = cand.where(F.col("dst").isNull() | (F.col("src") != F.col("dst")))
            dx, dy = F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")
            cand = cand.withColumn("d2", dx * dx + dy * dy)
            w = Window.partitionBy("src").orderBy(F.asc_nulls_last("d2"), F.asc_nulls_last("dst"))
            top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            # per-source resolution stats over the same partitioning as the window (no new shuffle)
            g = Window.partitionBy("src")
            top = top.withColumns({"m": F.count("dst").over(g), "kth": F.max("d2").over(g)})
            ok = F.lit(True) if covers_all else (F.col("m") >= k) & (F.col("kth") < F.col("border") * F.col("border"))
            top = scratch.keep(top.withColumn("ok", ok).select("src", "dst", "d2", "rank", "sx", "sy", "lvl", "ok"))
            results.append(top.where(F.col("ok") & F.col("dst").isNotNull()).select("src", "dst", "d2", "rank"))
            if covers_all:
                break
            retry = top.where(~F.col("ok") & (F.col("rank") == 1)).select(
                F.col("src").alias("pid"), F.col("sx").alias("px"), F.col("sy").alias("py"), "lvl"
            )
            waiting = scratch.keep(retry.unionByName(waiting.where(F.col("lvl") > level)))
            least = waiting.agg(F.min("lvl")).first()[0]
            if least is None:
                break
            level = max(level + 1, least)  # levels on which no point waits are left out
        out = results[0]
        for r in results[1:]:
            out = out.unionByName(r)
        # n x k rows, reused by every statistic built on W
        return stage(out, "neighbours")


def _start_levels(scratch: Scratch, probes: DataFrame, build: DataFrame, cell, c0: float, extent: float, hot: int) -> tuple[DataFrame, int]:
    """(probes with the level ``lvl`` they start on, the lowest level).

    Level by level, only the points of cells that are still too full go on; a cell that a
    double cannot halve any more (and thus one location) stays as it is.
    """
    level, going, inside, settled = 0, probes, build, []
    while True:
        size = c0 * (2.0 ** level)
        bx, by = cell(size)
        full = inside.groupBy(bx.alias("bx"), by.alias("by")).agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") > hot)
        full = scratch.keep(full.select("bx", "by"))
        if full.isEmpty() or extent / size > 2.0**50:
            settled.append(going.withColumn("lvl", F.lit(level)))
            break
        cells = going.withColumns({"bx": bx, "by": by})
        settled.append(scratch.keep(cells.join(full, ["bx", "by"], "left_anti").drop("bx", "by").withColumn("lvl", F.lit(level))))
        going = scratch.keep(cells.join(full, ["bx", "by"], "left_semi").drop("bx", "by"))
        inside = scratch.keep(inside.withColumns({"bx": bx, "by": by}).join(full, ["bx", "by"], "left_semi").drop("bx", "by"))
        level -= 1
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return scratch.keep(out), level


_STEP = 4
"""Levels that a round of ``_near_cells`` goes down: at most 256 parts of a cell."""


def _near_cells(scratch: Scratch, blocks: DataFrame, build: DataFrame, cell, c0: float, reach, level: int, lowest: int, k: int, hot: int) -> DataFrame:
    """The cells (``kx``, ``ky`` on level ``clvl``) of each probe's block that can hold one of its k nearest.

    Starts with the block's cells on ``level`` and their counts.  The nearest cells that hold
    more than k points bound the distance of the k-th one; cells wholly beyond that bound go, and
    those left with more than ``hot`` points are cut into cells ``_STEP`` levels below, until there is
    none or the lowest level is reached.  A round is two joins on cells, the points are only counted.
    """
    probe = ["src", "sx", "sy", "lvl", "border"]
    qx, qy = cell(c0 * 2.0**level)
    counts = build.groupBy(qx.alias("kx"), qy.alias("ky")).agg(F.count(F.lit(1)).alias("cnt"))
    front = blocks.join(counts, ["kx", "ky"]).select(*probe, F.lit(level).alias("clvl"), "kx", "ky", "cnt")
    while True:
        near2, far2 = reach(F.col("clvl"))
        # cells of a probe: those kept in the round before, and the parts of them
        sofar = F.sum("cnt").over(Window.partitionBy("src").orderBy("far2"))  # equal distances count together
        front = front.withColumns({"near2": near2, "far2": far2})
        front = front.withColumn("bound", F.when(sofar > k, F.col("far2")))  # one of them may be the probe itself
        front = front.withColumn("bound", F.min("bound").over(Window.partitionBy("src")))
        front = front.where(F.col("bound").isNull() | (F.col("near2") <= F.col("bound")))
        front = scratch.keep(front.select(*probe, "clvl", "kx", "ky", "cnt"))
        wide = front.where((F.col("clvl") == level) & (F.col("cnt") > hot))
        step = min(_STEP, level - lowest)
        if step <= 0 or wide.isEmpty():
            return front
        hx, hy = cell(c0 * 2.0 ** (level - step))
        parts = build.select(qx.alias("kx"), qy.alias("ky"), hx.alias("hx"), hy.alias("hy"))
        parts = parts.join(wide.select("kx", "ky").distinct(), ["kx", "ky"], "left_semi")
        parts = parts.groupBy("kx", "ky", "hx", "hy").agg(F.count(F.lit(1)).alias("cnt"))
        parts = wide.drop("cnt", "clvl").join(parts, ["kx", "ky"])
        parts = parts.select(*probe, F.lit(level - step).alias("clvl"), F.col("hx").alias("kx"), F.col("hy").alias("ky"), "cnt")
        front = front.where((F.col("clvl") > level) | (F.col("cnt") <= hot)).unionByName(parts)
        level -= step
        qx, qy = hx, hy


def _cell_points(cells: DataFrame, build: DataFrame, cell, c0: float) -> DataFrame:
    """The points ``dst`` (at ``tx``, ``ty``) of each probe's cells of any levels."""
    out = None
    for (clvl,) in cells.select("clvl").distinct().collect():  # as many as the grid has levels
        qx, qy = cell(c0 * 2.0**clvl)
        points = build.select(F.col("pid").alias("dst"), F.col("px").alias("tx"), F.col("py").alias("ty"), qx.alias("kx"), qy.alias("ky"))
        found = cells.where(F.col("clvl") == clvl).drop("clvl", "cnt").join(points, ["kx", "ky"])
        out = found if out is None else out.unionByName(found)
    return out


def _id_type(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


# ------------------------------------------------------------------ contiguity


def ring_vertices(polygons: DataFrame, id_col: str = "id", ring: str = "ring") -> DataFrame:
    """(id, pos, vx, vy) for every ring vertex (F-12 ring geometry, no geometry kernel)."""
    return polygons.select(F.col(id_col).alias("pid"), F.posexplode(ring).alias("pos", "v")).select(
        "pid", "pos", F.col("v.x").alias("vx"), F.col("v.y").alias("vy")
    )


def queen(polygons: DataFrame, id_col: str = "id", ring: str = "ring") -> DataFrame:
    """J-3: polygons sharing at least one vertex.  Equi self-join on the vertex coordinates.

    A vertex is shared by a bounded number of polygons in a planar tiling, so the join key
    cannot concentrate rows; ``distinct`` removes pairs that share several vertices.
    """
    v = ring_vertices(polygons, id_col, ring).select("pid", "vx", "vy").distinct()
    a, b = v.alias("a"), v.alias("b")
    return (
        a.join(b, (F.col("a.vx") == F.col("b.vx")) & (F.col("a.vy") == F.col("b.vy")) & (F.col("a.pid") != F.col("b.pid")))
        .select(F.col("a.pid").alias("src"), F.col("b.pid").alias("dst"))
        .distinct()
    )


def ring_segments(polygons: DataFrame, id_col: str = "id", ring: str = "ring") -> DataFrame:
    """(id, ax, ay, bx, by): closed-ring boundary segments with endpoints in canonical order."""
    nxt = F.element_at(F.col(ring), (F.col("pos") + 1) % F.size(F.col(ring)) + 1)
    seg = polygons.select(F.col(id_col).alias("pid"), F.col(ring), F.posexplode(ring).alias("pos", "p")).select(
        "pid", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), nxt.x.alias("x2"), nxt.y.alias("y2")
    )
    first = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") <= F.col("y2")))
    return seg.select(
        "pid",
        F.when(first, F.col("x1")).otherwise(F.col("x2")).alias("ax"),
        F.when(first, F.col("y1")).otherwise(F.col("y2")).alias("ay"),
        F.when(first, F.col("x2")).otherwise(F.col("x1")).alias("bx"),
        F.when(first, F.col("y2")).otherwise(F.col("y1")).alias("by"),
    )


def rook(polygons: DataFrame, id_col: str = "id", ring: str = "ring") -> DataFrame:
    """J-4: polygons sharing at least one boundary segment (same endpoints)."""
    s = ring_segments(polygons, id_col, ring).distinct()
    keys = ["ax", "ay", "bx", "by"]
    a, b = s.alias("a"), s.alias("b")
    cond = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys] + [F.col("a.pid") != F.col("b.pid")]
    cond_all = cond[0]
    for c in cond[1:]:
        cond_all = cond_all & c
    return a.join(b, cond_all).select(F.col("a.pid").alias("src"), F.col("b.pid").alias("dst")).distinct()


# ------------------------------------------------------------------ transforms and lag


def binary(edges: DataFrame) -> DataFrame:
    """Binary weights (w = 1) for an (src, dst) neighbour list."""
    return edges.select("src", "dst", F.lit(1.0).alias("w"))


def row_standardize(edges: DataFrame, w: str = "w") -> DataFrame:
    """X-1: w_ij / sum_j w_ij (transform 'R').  Window per source = its neighbour list."""
    if w not in edges.columns:
        edges = edges.withColumn(w, F.lit(1.0))
    tot = F.sum(F.col(w)).over(Window.partitionBy("src"))
    return edges.select("src", "dst", F.try_divide(F.col(w).cast("double"), tot).alias("w"))


def row_sums(edges: DataFrame) -> DataFrame:
    """G-17: sum of weights per source (1 after row standardisation)."""
    return edges.groupBy("src").agg(F.sum("w").alias("row_sum"), F.count(F.lit(1)).alias("cardinality"))


def spatial_lag(edges: DataFrame, values: DataFrame, id_col: str = "id", value: str = "value", out: str = "lag") -> DataFrame:
    """J-5: lag_i = sum_j w_ij * v_j for every id in ``values`` (0 for an island)."""
    v = values.select(F.col(id_col).alias("dst"), F.col(value).cast("double").alias("_v"))
    lag = edges.join(v, "dst").groupBy("src").agg(F.sum(F.col("w") * F.col("_v")).alias(out))
    return (
        values.join(lag.withColumnRenamed("src", id_col), id_col, "left")
        .withColumn(out, F.coalesce(F.col(out), F.lit(0.0)))
    )


def create_weights(geo: DataFrame, method: str = "knn", k: int = 4, row_standardized: bool = True, id_col: str = "id") -> DataFrame:
    """P-14: dispatch knn / queen / rook; returns (src, dst, w)."""
    m = method.lower()
    if m == "knn":
        e = knn(geo, k=k, id_col=id_col).select("src", "dst")
    elif m == "queen":
        e = queen(geo, id_col=id_col)
    elif m == "rook":
        e = rook(geo, id_col=id_col)
    else:
        raise ValueError(f"unsupported spatial weights method {method!r}; use 'knn', 'queen' or 'rook'")
    e = binary(e)
    return row_standardize(e) if row_standardized else e


def attach_attributes(geo: DataFrame, attrs: DataFrame, key: str = "uf") -> DataFrame:
    """J-1: every geometry row kept, attributes joined by key (NULL where absent)."""
    return geo.join(attrs, key, "left")


# ------------------------------------------------------------------ ring geometry (F-12)


def buffer_rings(points: DataFrame, radius: float, n_vertices: int = 64, id_col: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """F-12: regular n-gon ring of ``radius`` around every point (the buffer polygon), as
    ``array<struct<x,y>>`` built with ``transform(sequence)`` - no geometry library."""
    step = 2.0 * math.pi / n_vertices
    ring = F.transform(
        F.sequence(F.lit(0), F.lit(n_vertices - 1)),
        lambda i: F.struct(
            (F.col(x) + F.lit(radius) * F.cos(i * F.lit(step))).alias("x"),
            (F.col(y) + F.lit(radius) * F.sin(i * F.lit(step))).alias("y"),
        ),
    )
    return points.select(F.col(id_col).alias("id"), ring.alias("ring"))


def ring_centroids(polygons: DataFrame, id_col: str = "id", ring: str = "ring") -> DataFrame:
    """F-12: vertex centroid of each ring (equals the area centroid for the symmetric rings
    made by ``buffer_rings``), computed per row with ``aggregate``."""
    n = F.size(ring).cast("double")
    sx = F.aggregate(F.col(ring), F.lit(0.0), lambda s, p: s + p["x"])
    sy = F.aggregate(F.col(ring), F.lit(0.0), lambda s, p: s + p["y"])
    return polygons.select(F.col(id_col).alias("id"), (sx / n).alias("cx"), (sy / n).alias("cy"), F.size(ring).alias("n_vertices"))
