"""Contiguity without common vertices, against exact tests of all pairs of segments."""

import random

import pytest
from pyspark.sql import functions as F

from regionlens.operators import contact
from regionlens.operators import weights as wts

SCHEMA = "id long, ring array<struct<x:double,y:double>>"


def _cross(a, b, p):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _meets(s, t):
    """Whole numbers, so exact: the closed segments share a point."""
    def on(u, p):
        return _cross(*u, p) == 0 and all(min(u[0][i], u[1][i]) <= p[i] <= max(u[0][i], u[1][i]) for i in (0, 1))

    if any(on(s, p) for p in t) or any(on(t, p) for p in s):
        return True
    return _cross(*s, t[0]) * _cross(*s, t[1]) < 0 and _cross(*t, s[0]) * _cross(*t, s[1]) < 0


def _overlaps(s, t):
    if s[0] == s[1] or t[0] == t[1] or any(_cross(*s, p) for p in t):
        return False
    axis = 0 if s[0][0] != s[1][0] else 1
    (a, b), (c, d) = sorted(p[axis] for p in s), sorted(p[axis] for p in t)
    return min(b, d) > max(a, c)


def brute(polygons, test):
    edges = {}
    for i, ring in polygons:
        edges.setdefault(i, []).extend(zip(ring, ring[1:] + ring[:1], strict=True))
    return {(i, j) for i in edges for j in edges if i != j and any(test(s, t) for s in edges[i] for t in edges[j])}


def _check(spark, polygons, **options):
    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in r]) for i, r in polygons], SCHEMA)
    for op, test in ((contact.touching, _meets), (contact.bordering, _overlaps)):
        rows = [tuple(r) for r in op(df, **options).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == brute(polygons, test)


def _square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]


def test_t_junctions_and_partly_shared_edges(spark):
    polygons = [(1, _square(0, 0, 4)), (2, _square(4, 1, 2)), (3, _square(4, 3, 3)), (4, _square(-3, -3, 3)), (5, _square(1, 1, 2)), (6, _square(20, 20, 1))]
    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in r]) for i, r in polygons], SCHEMA)
    assert {r.dst for r in contact.touching(df).where("src = 1").collect()} == {2, 3, 4}  # 5 lies inside, 6 apart
    assert {r.dst for r in contact.bordering(df).where("src = 1").collect()} == {2, 3}
    assert wts.rook(df).count() == 0
    _check(spark, polygons)


@pytest.mark.parametrize("hot", [3, 64])
def test_random_polygons(spark, hot):
    rnd = random.Random(hot)
    polygons = [(i, [(rnd.randrange(40), rnd.randrange(40)) for _ in range(rnd.choice((3, 4)))]) for i in range(25)]
    polygons += [(100 + i, _square(rnd.randrange(-60, 60), rnd.randrange(-60, 60), rnd.choice((2, 3, 5)))) for i in range(60)]
    polygons += [(200, [(-1000, -7), (3000, 9), (3000, 11)])]  # far longer than the cells
    _check(spark, polygons, hot=hot)


def test_dense_spot_beside_large_polygons(spark):
    polygons = [(i, _square(1000 * i, 0, 1000)) for i in range(6)] + [(100 + 20 * i + j, _square(999 + i, j, 1)) for i in range(12) for j in range(12)]
    _check(spark, polygons, hot=16)


def test_same_as_common_vertices_on_a_tiling(spark):
    df = spark.createDataFrame([(10 * x + y, [(float(a), float(b)) for a, b in _square(x, y, 1)]) for x in range(6) for y in range(6)], SCHEMA)
    assert set(map(tuple, contact.touching(df).collect())) == set(map(tuple, wts.queen(df).collect()))
    assert set(map(tuple, contact.bordering(df).collect())) == set(map(tuple, wts.rook(df).collect()))


def test_tolerance(spark):
    rows = [(1, _square(0.0, 0.0, 0.3)), (2, _square(0.1 + 0.2, 0.1, 0.1)), (3, _square(0.35, 0.0, 0.1))]
    df = spark.createDataFrame(rows, SCHEMA)
    for op in (contact.touching, contact.bordering):
        assert set(map(tuple, op(df, tol=1e-9).where("src < 3 and dst < 3").collect())) == {(1, 2), (2, 1)}
    assert contact.bordering(df.where("id <> 2"), tol=0.06).count() == 2


def test_awkward_rows(spark):
    nan = float("nan")
    rows = [(1, _square(0.0, 0.0, 1.0)), (1, _square(0.0, 0.0, 1.0)), (None, _square(1.0, 0.0, 1.0)), (2, None), (3, []), (4, [(nan, 0.0), (1.0, None), (0.5, float("inf"))]), (5, [(1.0, 0.5)])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pid", F.lit(1)).withColumn("cx", F.lit("x"))
    assert set(map(tuple, contact.touching(df).collect())) == {(1, 5), (5, 1)}
    assert contact.bordering(df).count() == 0
    assert contact.touching(df.where("id = 3")).collect() == [] and contact.touching(df.limit(0)).columns == ["src", "dst"]
