"""Contiguity of polygons that touch without common vertices (J-3, J-4): T-junctions, partly shared
edges, crossing boundaries.

Boundary segments are cut into the cells of a grid whose cells are as large as the mean segment, so
the pieces grow with the segments however long single ones are. Only segments that meet in a cell are
compared. A cell that holds too many pieces is halved, and its hot quarters again, until it is much smaller
than the segments in it: what still meets there lies along the same lines or runs through the same place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, stage
from .weights import ring_segments

_ENDS = ("ax", "ay", "bx", "by")
_BLOCK = 1024
_LEVELS = 30
_FINEST = 16  # a cell is not halved for segments that are longer than this many cells


def _range(lo: Column, hi: Column) -> Column:
    """lo..hi as an array, empty where lo > hi."""
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def _cut(segments: DataFrame, size: float, x0: float, y0: float, pad: float, within: bool) -> DataFrame:
    """A row per segment and cell (``cx``, ``cy``) that it comes within ``pad`` of; ``within``: only the quarters
    of the cell that the segment's row names."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    steep = F.abs(dy) > dx  # cut along the longer axis u: v moves by one cell at most in each step
    s = segments.select(
        "*", steep.alias("steep"),
        F.when(steep, F.col("ay") - y0).otherwise(F.col("ax") - x0).alias("u"), F.when(steep, F.col("ax") - x0).otherwise(F.col("ay") - y0).alias("v"),
        F.when(steep, F.col("by") - y0).otherwise(F.col("bx") - x0).alias("u2"),
        F.coalesce(F.when(steep, F.try_divide(dx, dy)).otherwise(F.try_divide(dy, dx)), F.lit(0.0)).alias("slope"),
    )

    def cell(at: Column) -> Column:
        return F.floor(at / F.lit(size)).cast("bigint")

    lo, hi = F.least("u", "u2"), F.greatest("u", "u2")
    first, last = cell(lo - pad), cell(hi + pad)
    if within:
        of_u = F.when(F.col("steep"), F.col("cy")).otherwise(F.col("cx")) * 2
        of_v = F.when(F.col("steep"), F.col("cx")).otherwise(F.col("cy")) * 2
        s = s.withColumn("of_v", of_v).withColumn("i", F.explode(_range(F.greatest(first, of_u), F.least(last, of_u + 1))))
    else:  # in blocks, so that no segment becomes one long array
        s = s.withColumn("block", F.explode(_range(F.floor(first / _BLOCK).cast("bigint"), F.floor(last / _BLOCK).cast("bigint"))))
        inside = _range(F.greatest(first, F.col("block") * _BLOCK), F.least(last, F.col("block") * _BLOCK + (_BLOCK - 1)))
        s = s.withColumn("i", F.explode(inside))
    near = F.greatest(lo, F.col("i") * F.lit(size) - pad)
    far = F.least(hi, (F.col("i") + 1) * F.lit(size) + pad)
    v1, v2 = F.col("v") + (near - F.col("u")) * F.col("slope"), F.col("v") + (far - F.col("u")) * F.col("slope")
    j1, j2 = cell(F.least(v1, v2) - pad), cell(F.greatest(v1, v2) + pad)
    if within:
        j1, j2 = F.greatest(j1, F.col("of_v")), F.least(j2, F.col("of_v") + 1)
    s = s.withColumn("j", F.explode(_range(j1, j2)))
    return s.select(
        "pid", *_ENDS, F.when(F.col("steep"), F.col("j")).otherwise(F.col("i")).alias("cx"),
        F.when(F.col("steep"), F.col("i")).otherwise(F.col("j")).alias("cy"),
    )


def _pieces(scratch: Scratch, segments: DataFrame, tol: float, hot: int) -> DataFrame | None:
    """(pid, ends, lvl, cx, cy): the segments in the cells they cross, hot cells halved."""
    extent = F.greatest(F.col("bx") - F.col("ax"), F.abs(F.col("by") - F.col("ay")))  # along the longer axis
    largest = F.greatest(*[F.max(F.abs(c)) for c in _ENDS])
    r = segments.agg(
        F.min("ax").alias("x0"), F.min(F.least("ay", "by")).alias("y0"), F.avg(extent).alias("mean"), largest.alias("largest")
    ).first()
    if r["x0"] is None:
        return None
    slack = tol + 1e-14 * r["largest"]  # what rounding may move a place by, and more
    size = max(r["mean"], 1e3 * slack) or 1.0
    level, out = 0, []
    pieces = scratch.keep(_cut(segments, size, r["x0"], r["y0"], slack + 1e-9 * size, False))
    while True:
        short = pieces.where(extent <= _FINEST * size)
        full = scratch.keep(short.groupBy("cx", "cy").count().where(F.col("count") > hot).select("cx", "cy"))
        if level == _LEVELS or size < 1e3 * slack or full.isEmpty():
            out.append(pieces.withColumn("lvl", F.lit(level)))
            break
        out.append(pieces.join(full, ["cx", "cy"], "left_anti").withColumn("lvl", F.lit(level)))
        inside = pieces.join(full, ["cx", "cy"], "left_semi")
        size, level = size / 2, level + 1
        pieces = scratch.keep(_cut(inside, size, r["x0"], r["y0"], slack + 1e-9 * size, True))
    x = out[0]
    for y in out[1:]:
        x = x.unionByName(y)
    return x


def _cross(s: str, p: str) -> Column:
    """Twice the signed area of segment ``s`` (``s_ax`` ..) and the point ``p`` (``p`` + ``x``, ``y``)."""
    x, y = F.col(f"{p}x"), F.col(f"{p}y")
    dx, dy = F.col(f"{s}_bx") - F.col(f"{s}_ax"), F.col(f"{s}_by") - F.col(f"{s}_ay")
    return dx * (y - F.col(f"{s}_ay")) - dy * (x - F.col(f"{s}_ax"))


def _length(s: str) -> Column:
    return F.hypot(F.col(f"{s}_bx") - F.col(f"{s}_ax"), F.col(f"{s}_by") - F.col(f"{s}_ay"))


def _on(s: str, p: str, tol: float) -> Column:
    """The point lies on the segment (within ``tol`` of its line and its box)."""
    x, y = F.col(f"{p}x"), F.col(f"{p}y")
    box = x.between(F.col(f"{s}_ax") - tol, F.col(f"{s}_bx") + tol) & y.between(
        F.least(f"{s}_ay", f"{s}_by") - tol, F.greatest(f"{s}_ay", f"{s}_by") + tol
    )
    return box & (F.abs(_cross(s, p)) <= tol * _length(s))


def _share_point(tol: float) -> Column:
    crossing = (F.signum(_cross("l", "s_a")) * F.signum(_cross("l", "s_b")) < 0) & (
        F.signum(_cross("s", "l_a")) * F.signum(_cross("s", "l_b")) < 0
    )
    return crossing | _on("l", "s_a", tol) | _on("l", "s_b", tol) | _on("s", "l_a", tol) | _on("s", "l_b", tol)


def _share_stretch(tol: float) -> Column:
    """Both ends of the shorter segment lie on the longer one's line and they overlap along it."""
    dx, dy = F.col("l_bx") - F.col("l_ax"), F.col("l_by") - F.col("l_ay")

    def along(p: str) -> Column:
        return dx * (F.col(f"{p}x") - F.col("l_ax")) + dy * (F.col(f"{p}y") - F.col("l_ay"))

    overlap = F.least(F.greatest(along("s_a"), along("s_b")), dx * dx + dy * dy) - F.greatest(F.least(along("s_a"), along("s_b")), F.lit(0.0))
    bound = tol * _length("l")
    return (F.abs(_cross("l", "s_a")) <= bound) & (F.abs(_cross("l", "s_b")) <= bound) & (overlap > bound)


def _contacts(polygons: DataFrame, shares: Column, id_col: str, ring: str, tol: float, hot: int) -> DataFrame:
    segments = ring_segments(polygons.where(F.col(id_col).isNotNull()), id_col, ring).select("pid", *[F.col(c).cast("double") for c in _ENDS])
    for c in _ENDS:
        segments = segments.where(F.abs(c) < float("inf"))  # neither null nor NaN nor infinite
    kind = segments.schema["pid"].dataType.simpleString()
    with Scratch(polygons.sparkSession, "contact") as scratch:
        pieces = _pieces(scratch, scratch.keep(segments.distinct()), tol, hot)
        if pieces is None:
            return polygons.sparkSession.createDataFrame([], f"src {kind}, dst {kind}")
        a, b = pieces.alias("a"), pieces.alias("b")
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("lvl", "cx", "cy")]
        pairs = a.join(b, same[0] & same[1] & same[2] & (F.col("a.pid") < F.col("b.pid")))

        def squared(s: str) -> Column:
            dx, dy = F.col(f"{s}.bx") - F.col(f"{s}.ax"), F.col(f"{s}.by") - F.col(f"{s}.ay")
            return dx * dx + dy * dy

        longer = squared("a") >= squared("b")
        ends = [F.when(longer, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(f"l_{c}") for c in _ENDS]
        ends += [F.when(longer, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(f"s_{c}") for c in _ENDS]
        pairs = pairs.select(F.col("a.pid").alias("src"), F.col("b.pid").alias("dst"), *ends)
        pairs = scratch.keep(pairs.where(shares).select("src", "dst").distinct())
        return stage(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "contacts")


def touching(polygons: DataFrame, id_col: str = "id", ring: str = "ring", tol: float = 0.0, hot: int = 64) -> DataFrame:
    """J-3 without common vertices: ``(src, dst)`` of polygons whose boundaries share at least a point.

    With ``tol`` 0 the tests are those of the coordinates as they are, exact where differences and products
    of coordinates are (grids, whole numbers); otherwise state the distance that still counts as touching.
    A polygon inside another one whose boundary it does not reach is no neighbour. Rows that share an id
    are one polygon; null ids and rings and points with a null, NaN or infinite coordinate take no part;
    a ring of one point touches as a point. No polygons give no rows. A cell with more than ``hot`` pieces
    is halved down to a sixteenth of the segments in it; boundaries that run through one place stay together, as
    each pair of them is in the result.
    """
    return _contacts(polygons, _share_point(tol), id_col, ring, tol, hot)


def bordering(polygons: DataFrame, id_col: str = "id", ring: str = "ring", tol: float = 0.0, hot: int = 64) -> DataFrame:
    """J-4 without common segments: ``(src, dst)`` of polygons whose boundaries share a stretch of some length
    (more than ``tol``). Everything else as in ``touching``."""
    return _contacts(polygons, _share_stretch(tol), id_col, ring, tol, hot)
