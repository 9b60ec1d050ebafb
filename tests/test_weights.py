import random

import pytest
from pyspark.sql import functions as F

from regionlens.operators import weights as wts
from regionlens.plans import stand_ins as si


def brute_knn(points, k):
    out = {}
    for i, xi, yi in points:
        d = sorted(((xj - xi) ** 2 + (yj - yi) ** 2, j) for j, xj, yj in points if j != i)
        out[i] = [j for _, j in d[:k]]
    return out


def _check(spark, pts, k):
    df = spark.createDataFrame(pts, "id long, x double, y double")
    got = {}
    for r in wts.knn(df, k=k).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    assert got == brute_knn(pts, k)


def test_knn_uniform(spark):
    rnd = random.Random(1)
    _check(spark, [(i, rnd.random(), rnd.random()) for i in range(300)], 4)


def test_knn_hot_spot_and_ties(spark):
    rnd = random.Random(2)
    pts = [(i, rnd.random() * 100, rnd.random() * 100) for i in range(200)]
    # a third of the points in one tiny cluster, plus exact duplicates and a lattice (ties)
    pts += [(1000 + i, 50 + rnd.random() * 1e-3, 50 + rnd.random() * 1e-3) for i in range(120)]
    pts += [(2000 + i, 10.0, 10.0) for i in range(6)]
    pts += [(3000 + i * 10 + j, 80.0 + i, 20.0 + j) for i in range(4) for j in range(4)]
    _check(spark, pts, 4)


def test_knn_sparse_points_beside_a_dense_spot(spark, monkeypatch):
    rnd = random.Random(7)
    spot = [(i, 50 + rnd.random(), 50 + rnd.random()) for i in range(1500)]
    pts = spot + [(5000 + i, rnd.random() * 40, rnd.random() * 100) for i in range(10)]
    pts += [(6000 + i, 48.0 - 3 * i, 50.0) for i in range(3)]
    seen, points_of = [], wts._cell_points

    def counted(cells, *rest):
        found = points_of(cells, *rest)
        seen.append(found.groupBy("src").count().agg(F.max("count")).first()[0])
        return found

    monkeypatch.setattr(wts, "_cell_points", counted)
    _check(spark, pts, 4)
    assert seen and max(seen) <= 9 * 16 * 5  # of 1,513: no more than a block of nine cells that are not too full


def test_knn_k_at_least_n(spark):
    pts = [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 2.0)]
    _check(spark, pts, 5)


def test_contiguity_grid(spark):
    cells = [(x, y) for x in range(3) for y in range(3)]
    rows = [(f"{x}:{y}", [(float(x), float(y)), (x + 1.0, float(y)), (x + 1.0, y + 1.0), (float(x), y + 1.0)]) for x, y in cells]
    poly = spark.createDataFrame(rows, "id string, ring array<struct<x:double,y:double>>")
    q = wts.queen(poly)
    r = wts.rook(poly)
    assert q.count() == 40 and r.count() == 24
    assert {x.dst for x in q.where("src = '1:1'").collect()} == {c for c in (f"{a}:{b}" for a, b in cells) if c != "1:1"}
    assert {x.dst for x in r.where("src = '0:0'").collect()} == {"1:0", "0:1"}


def test_row_standardize_and_lag(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a")], "src string, dst string")
    w = wts.row_standardize(wts.binary(e))
    assert {r.src: r.row_sum for r in wts.row_sums(w).collect()} == {"a": 1.0, "b": 1.0}
    vals = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 4.0), ("island", 9.0)], "id string, value double")
    lag = {r.id: r.lag for r in wts.spatial_lag(w, vals).collect()}
    assert lag == {"a": 3.0, "b": 1.0, "c": 0.0, "island": 0.0}


def test_create_weights_dispatch(spark):
    pts = spark.createDataFrame([(i, float(i % 5), float(i // 5)) for i in range(25)], "id long, x double, y double")
    w = wts.create_weights(pts, "KNN", k=3)
    assert w.groupBy("src").agg(F.sum("w").alias("s")).where("abs(s - 1) > 1e-12").count() == 0
    with pytest.raises(ValueError):
        wts.create_weights(pts, "delaunay")


def test_grid_polygons_on_driver_tables(spark):
    pts = si.points(spark, "/root/testdata/sf0.001")
    poly = si.grid_polygons(pts)
    assert poly.count() > 0
    assert wts.queen(poly).count() >= wts.rook(poly).count()


def test_buffer_rings_centroids_and_knn(spark):
    from regionlens.sources.builtin_dims import uf_centroids

    pts = uf_centroids(spark).withColumnRenamed("uf", "id")
    rings = wts.buffer_rings(pts, radius=1.2, n_vertices=64)
    cen = wts.ring_centroids(rings)
    got = {r.id: (r.cx, r.cy, r.n_vertices) for r in cen.collect()}
    for r in pts.collect():
        assert got[r.id][0] == pytest.approx(r.x, abs=1e-9) and got[r.id][1] == pytest.approx(r.y, abs=1e-9)
        assert got[r.id][2] == 64
    a = {(r.src, r.dst) for r in wts.knn(pts, k=4).collect()}
    b = {(r.src, r.dst) for r in wts.knn(cen.select("id", F.col("cx").alias("x"), F.col("cy").alias("y")), k=4).collect()}
    assert a == b


def test_knn_third_of_points_at_one_location(spark):
    rnd = random.Random(3)
    pts = [(i, rnd.random(), rnd.random()) for i in range(200)]
    pts += [(1000 + i, 0.5, 0.5) for i in range(100)]  # a third of all points, identical coordinates
    pts += [(5000, 0.5000001, 0.5)]
    _check(spark, pts, 4)


def test_knn_dense_cluster_and_a_far_point(spark):
    """The whole cluster lies in one cell of the first grid; no cell that a point starts on is too full."""
    import math

    from regionlens.session import Scratch

    rnd = random.Random(4)
    pts = [(i, 0.5 + rnd.random() * 0.1, 0.5 + rnd.random() * 0.1) for i in range(300)] + [(9999, 1e4, 1e4)]
    _check(spark, pts, 4)
    df = spark.createDataFrame(pts, "pid long, px double, py double")
    x0, c0 = min(p[1] for p in pts), math.sqrt(1e8 * 5 / len(pts))

    def cell(size):
        return (F.floor((F.col("px") - F.lit(x0)) / F.lit(size)).cast("long"), F.floor((F.col("py") - F.lit(x0)) / F.lit(size)).cast("long"))

    with Scratch(spark) as scratch:
        probes, lowest = wts._start_levels(scratch, df, df, cell, c0, 1e4, 80)
        levels = {r["lvl"] for r in probes.select("lvl").distinct().collect()}
        assert lowest < -9 and max(levels) == 0
        full = 0
        for level in levels:
            bx, by = cell(c0 * 2.0**level)
            started = probes.where(F.col("lvl") == level).groupBy(bx.alias("bx"), by.alias("by")).count()
            full = max(full, started.agg(F.max("count")).first()[0])
        assert full <= 80


def test_create_weights_on_polygons(spark):
    poly = si.grid_polygons(si.points(spark, "/root/testdata/sf0.001"))
    for method in ("queen", "rook"):
        w = wts.create_weights(poly, method)
        assert w.groupBy("src").agg(F.sum("w").alias("s")).where("abs(s - 1) > 1e-12").count() == 0
