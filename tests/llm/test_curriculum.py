"""Mixing along a curriculum against a plain version that walks every source's stream."""

import hashlib
import math
import re

import pytest
from llm_cases import SCHEMA, awkward, no_documents
from pyspark.sql import functions as F

from regionlens.llm import curriculum as c

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights, cap=3.0):
    """Shares by weight, reshared until none is above its cap."""
    out, open_, rest = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        unit = rest / sum(weights[s] for s in open_)
        over = {s for s in open_ if unit * weights[s] > cap * sizes[s]}
        if not over:
            return out | {s: unit * weights[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            rest -= out[s]
        open_ -= over
    return out


def integral(knots, t):
    total = 0.0
    for (a, u), (b, v) in zip(knots, knots[1:], strict=False):
        x = min(max(t, a), b)
        total += (x - a) * (u + (u + (v - u) * (x - a) / (b - a))) / 2
    return total


def brute(rows, schedules, cap=3):
    """(id, text) -> (size, source size, target, [(copy, words)]) of rows (id, text, source)."""
    key = lambda s: (s is None, s or "")
    sources = sorted({r[2] for r in rows}, key=key)
    size = lambda t: len(WORD.findall(t or ""))
    weights = {s: integral(schedules[i % len(schedules)], 1.0) for i, s in enumerate(sources)}
    sizes = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in sources}
    goals = fill(sizes, weights, float(cap))
    out = []
    for i, s in enumerate(sources):
        name = lambda r: hashlib.md5(":".join(x for x in (None if r[0] is None else str(r[0]), r[1] or "") if x is not None).encode()).hexdigest()
        stream = sorted((r for r in rows if r[2] == s), key=lambda r: (name(r), size(r[1])))
        left, copies = math.floor(goals[s] + 0.5), {j: [] for j in range(len(stream))}
        place = 0
        for epoch in range(cap):
            for j, r in enumerate(stream):
                if (take := min(left, size(r[1]))) > 0:
                    copies[j].append((epoch, take, place / goals[s], i % len(schedules)))
                left -= take
                place += size(r[1])
        out += [(r[0], r[1], size(r[1]), sizes[s], goals[s], copies[j]) for j, r in enumerate(stream)]
    return out


def compare(df, schedules=None, cap=3):
    schedules = schedules or c.stated_schedules()
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    want = brute(rows, schedules, cap)
    got = [(r.doc_id, r.text, r.mix) for r in c.plan(df, schedules, cap, keep=["doc_id", "text"]).collect()]
    order = lambda r: (str(r[0]), str(r[1]))
    short = lambda cs: sorted((x[0], x[1]) for x in cs)
    one = sorted(((r[0], r[1], r[2], r[3], round(r[4], 6), short(r[5])) for r in want), key=repr)
    two = sorted(((r[0], r[1], m.size, m.source_size, round(m.target, 6), short([(x.copy, x.words) for x in m.copies])) for *r, m in got), key=repr)
    assert one == two
    assert all(m.taken == sum(x.words for x in m.copies) <= cap * m.size for *_, m in got)
    # a position is where the demand has asked for what stands before the copy
    demand = {}
    for r in want:
        for x in r[5]:
            demand.setdefault((order(r), x[0]), []).append((x[2], x[3]))
    for r in got:
        for x in r[2].copies:
            parts = [(p, k) for p, k in demand[order(r), x.copy]]
            assert any(abs(integral(schedules[k], x.position) / integral(schedules[k], 1.0) - p) < 1e-9 for p, k in parts)


def test_against_brute(spark):
    compare(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source"))


def test_awkward(spark):
    compare(awkward(spark, ["a b", "a b", ""]).select("doc_id", "text", "source"))


def test_hot_and_small_sources(spark):
    """A third of all rows in one source, sources below their share, a null and an empty one."""
    rows = [(i, "w " * (1 + i % 7), "hot") for i in range(300)] + [(1000 + i, "x y z", f"s{i % 9}") for i in range(30)]
    rows += [(2000, "one", None), (2001, "", "empty"), (2002, None, "zzz"), (2003, "Grüße 日本", "Ä")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    compare(df)
    compare(df, [[(0, 0), (0.25, 4), (1, 0)], [(0, 1), (1, 1)], [(0, 0), (0.5, 0), (1, 2)]], cap=2)


def test_targets(spark):
    df = spark.createDataFrame([("a", 1.0, 1000), ("b", 2.0, 10), ("c", 3.0, 50), ("d", 4.0, 0)], "key string, weight double, size bigint")
    got = {r.key: r.target for r in c.targets(df).collect()}
    assert got == pytest.approx(fill({"a": 1000, "b": 10, "c": 50, "d": 0}, {"a": 1, "b": 2, "c": 3, "d": 4}))
    assert sum(got.values()) == pytest.approx(1060)


def test_training_order(spark):
    """All columns come back, also those with the operator's own names, copies by position."""
    df = spark.createDataFrame(
        [(i, "w " * 5, f"s{i % 3}", i, i, "x") for i in range(60)], "doc_id bigint, text string, source string, mix int, _size int, Copy string"
    )
    out = c.training_order(df)
    assert out.columns == [*df.columns, "copy_"]
    rows = out.collect()
    at = [r.copy_.position for r in rows]
    assert at == sorted(at) and 0 <= min(at) and max(at) < 1
    assert sum(r.copy_.words for r in rows) == 300
    assert all(r.mix == r._size == r.doc_id and r.Copy == "x" for r in rows)
    again = [(r.doc_id, r.copy_) for r in c.training_order(df.repartition(7)).collect()]
    assert again == [(r.doc_id, r.copy_) for r in rows]
    # weights 1 fade out, weights 3 come in
    early = lambda s: sum(r.copy_.words for r in rows if r.source == s and r.copy_.position < 0.5) / sum(r.copy_.words for r in rows if r.source == s)
    assert early("s0") > 0.55 and early("s2") < 0.45


def test_empty_and_bad(spark):
    assert c.plan(no_documents(spark)).collect() == []
    none = spark.createDataFrame([(1, None, "en", None, 0), (2, " ", "en", "s", 1)], SCHEMA)
    assert {(r.mix.size, r.mix.target, r.mix.taken) for r in c.plan(none).collect()} == {(0, 0.0, 0)}
    for bad in ([(0, 1)], [(0, 1), (0.5, 1)], [(0, 0), (1, 0)], [(0, 1), (0.5, -1), (1, 1)], [(0, 1), (0, 2), (1, 1)]):
        with pytest.raises(ValueError):
            c.plan(none, [bad])


def test_no_python_in_the_plan(spark):
    df = c.op11_mix(spark, "/root/testdata/sf0.001")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
    assert df.agg(F.sum("taken")).first()[0] == pytest.approx(df.agg(F.sum("size")).first()[0], abs=20)
