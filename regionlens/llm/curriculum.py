"""Mixing sources to target weights along a time-varying curriculum, with DataFrame operations only.

Every source has a schedule: knots (time, weight) from time 0 to time 1, straight lines between them. The
integral of a schedule is the source's weight in the whole mix; all sources share the words of the corpus by
these weights, none more than CAP times its own words. At any time the mix has asked a source for its target
times the part of the schedule's integral that lies behind. The documents of a source stand in an order given
by a hash, one epoch after another, and so each copy of a document starts after a known number of words of
its source; the time at which the demand reaches that number is the copy's training position. The copies are
range-sorted by position. A copy at the end of the demand gives only the words that are still asked for.

Running sums are taken within cells of the hash, so that a source of any size is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, positions, table, written

CAP = 3
"""A source gives at most so many times its words, and a document so many copies."""
CELLS = 1 << 12
"""Cells of the hash in a source, at least; there are more of them for more than CELLS x CELL_ROWS documents."""
CELL_ROWS = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"
BASE_WEIGHTS = (1.0, 2.0, 3.0)
TILT = (0.5, 0.0, -0.5)
"""The stated schedules: sources of weight 1 fade out (1.5 to 0.5 times their weight), those of weight 2
stay, those of weight 3 come in (0.5 to 1.5 times)."""


def stated_schedules(weights: Sequence[float] = BASE_WEIGHTS, tilt: Sequence[float] = TILT) -> list[list[tuple[float, float]]]:
    """Schedules whose integrals are ``weights``, each falling by ``tilt`` of it on either side of its middle."""
    return [[(0.0, w * (1 + t)), (0.5, w), (1.0, w * (1 - t))] for w, t in zip(weights, tilt, strict=True)]


def _integrals(knots: Sequence[tuple[float, float]]) -> list[float]:
    """The schedule's integral from 0 to each knot."""
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1:
        raise ValueError("a schedule goes from time 0 to time 1")
    if any(b[0] <= a[0] for a, b in zip(knots, knots[1:], strict=False)) or any(w < 0 for _, w in knots):
        raise ValueError("the times of a schedule rise, its weights are not negative")
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append(out[-1] + (t1 - t0) * (w0 + w1) / 2)
    if out[-1] <= 0:
        raise ValueError("a schedule needs some weight")
    return out


def time_of(part: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of the schedule reaches ``part`` (from 0 to 1) of the whole."""
    at = _integrals(knots)
    asked, out = part * F.lit(at[-1]), F.lit(1.0)
    for (t0, w0), (t1, w1), a, b in reversed(list(zip(knots, knots[1:], at, at[1:], strict=False))):
        if b == a:
            continue
        more = F.greatest(asked - F.lit(a), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * more, F.lit(0.0)))
        out = F.when(asked < F.lit(b), F.lit(t0) + F.try_divide(F.lit(2.0) * more, F.lit(w0) + root)).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def source_key(source: Column) -> Column:
    """A text that is never null and sorts like the source by code point, null last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def targets(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """``sources`` (weight > 0, size) with ``target``: the sum of all sizes shared by weight, none above
    ``cap`` times the size; what is cut off goes to the others by weight until none is above. Each round is
    one aggregate with three numbers for the driver; it ends when the level stands still."""
    most = F.col("size") * F.lit(float(cap))
    level = None
    while True:
        above = F.lit(False) if level is None else most < F.lit(level) * F.col("weight")
        full, weight, whole = sources.agg(
            F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight"))), F.sum("size")
        ).first()
        last, level = level, (float(whole or 0) - (full or 0.0)) / weight if weight else None
        if level is None or level == last:
            break
        if last is not None and level < last:  # rounding at the end
            level = last
            break
    if level is None:
        return sources.withColumn("target", most)
    return sources.withColumn("target", F.least(most, F.lit(level) * F.col("weight")))


def plan(
    docs: DataFrame, schedules: Sequence[Sequence[tuple[float, float]]] | None = None, cap: int = CAP,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (all) of every row and a struct: size (words), source_size, target (of the
    source, words), taken (words the mix takes of this row) and copies, an array (at most ``cap``) of
    (copy, words, position). Returned under the name ``mix`` (with underscores if that is taken).

    The i-th source by code point, the null one last, has the schedule i modulo their number. A null text
    has no words; a document without words, and one behind the demand's end, has no copies. Rows with the
    same id stand by their texts' hash, identical rows one after the other in any order. Without any word all
    targets are 0. Texts of any length count whole. An empty table gives an empty one.
    """
    schedules = [list(s) for s in (schedules or stated_schedules())]
    weights = [_integrals(s)[-1] for s in schedules]
    keep = list(docs.columns if keep is None else keep)
    out = free_name(keep, "mix")
    key, order, size, cell, before, place = (free_name([*keep, out], x) for x in ("_source", "_order", "_size", "_cell", "_before", "_place"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = written(docs.select(
        *keep, source_key(F.col(source_col)).alias(key),
        F.md5(F.concat_ws(":", F.col(id_col).cast("string"), text).cast("binary")).alias(order),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias(size),
    ), "sized")
    cells = max(CELLS, -(-sized.count() // CELL_ROWS))
    # equal ranges of the hash, so that the cells of a source stand in its order
    head = F.conv(F.substring(order, 1, 8), 16, 10).cast("bigint")
    sized = sized.withColumn(cell, F.shiftright(head * F.lit(min(cells, 1 << 30)), 32))
    sums = written(sized.groupBy(key, cell).agg(F.sum(size).alias("words")), "cells")

    sources = positions(sums.groupBy(F.col(key).alias("key")).agg(F.sum("words").alias("size")), ["key"])
    place_of = F.pmod(F.col("pos"), F.lit(len(schedules)))
    sources = sources.withColumn("kind", place_of.cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("kind") + 1)
    sources = written(targets(written(sources.withColumn("weight", weight), "sources"), cap), "targets")

    # where each cell starts in its source: one row per cell
    running = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(key).alias("key"), F.col(cell).alias("cell"), "words").withColumn(
        "start", F.coalesce(F.sum("words").over(running), F.lit(0))
    ).join(sources.select("key", F.col("size").alias("source_size"), "target", "kind"), "key")

    within = Window.partitionBy(key, cell).orderBy(order, size).rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn(before, F.coalesce(F.sum(size).over(within), F.lit(0)))
    rows = rows.join(starts, (F.col(key) == F.col("key")) & (F.col(cell) == F.col("cell")))
    start = F.col("start") + F.col(before)
    asked = F.floor(F.col("target") + 0.5)

    def copy(i: int) -> Column:
        at = F.lit(i) * F.col("source_size") + start
        words = F.greatest(F.least(F.col(size), asked - at), F.lit(0)).cast("bigint")
        part = F.try_divide(at.cast("double"), F.col("target"))
        when = reduce(
            lambda other, k: F.when(F.col("kind") == k, time_of(part, schedules[k])).otherwise(other), range(len(schedules)), F.lit(None).cast("double")
        )
        return F.struct(F.lit(i).alias("copy"), words.alias("words"), when.alias("position"))

    copies = F.filter(F.array(*[copy(i) for i in range(cap)]), lambda x: x["words"] > 0)
    taken = F.aggregate(copies, F.lit(0).cast("bigint"), lambda s, x: s + x["words"])
    mix = F.struct(F.col(size).alias("size"), "source_size", "target", taken.alias("taken"), copies.alias("copies"))
    return rows.select(*[F.col(c) for c in keep], mix.alias(out))


def training_order(docs: DataFrame, schedules: Sequence[Sequence[tuple[float, float]]] | None = None, cap: int = CAP, **columns: str) -> DataFrame:
    """One row per copy that the mix takes, range-sorted by training position: all columns of the row and a
    struct ``copy`` (copy, words, position): the first ``words`` words of the text are trained on, which are
    all of them but for the last copy of a source. Copies at one position stand by a hash of the row."""
    planned = plan(docs, schedules, cap, **columns)
    mix = planned.columns[-1]
    out = free_name(docs.columns, "copy")
    rows = planned.select(*docs.columns, F.explode(F.col(f"{mix}.copies")).alias(out))
    return rows.orderBy(F.col(f"{out}.position"), F.xxhash64(*docs.columns))


def op11_mix(spark, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words the mix takes of it, by first position."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    x = plan(docs, keep=["doc_id"]).select("doc_id", "mix.*")
    first = F.try_element_at(F.col("copies"), F.lit(1))
    x = x.select("doc_id", "size", "source_size", "target", "taken", F.size("copies").cast("bigint").alias("n_copies"), first["position"].alias("position"))
    return x.orderBy(F.asc_nulls_last("position"), F.xxhash64("doc_id"))
