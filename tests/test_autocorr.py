import random
import math

import pytest
from pyspark.sql import functions as F

from goldens import KPI_SUMMARY, LISA_TABLE
from regionlens.operators import autocorr as ac
from regionlens.operators import weights as wts
from regionlens.sources.builtin_dims import uf_centroids


@pytest.fixture(scope="module")
def w27(spark):
    pts = uf_centroids(spark).withColumnRenamed("uf", "id")
    return wts.row_standardize(wts.binary(wts.knn(pts, k=4))).persist()


@pytest.fixture(scope="module")
def jobs(spark):
    return spark.createDataFrame([(u, float(e), p) for u, e, p in KPI_SUMMARY], "id string, value double, prod double")


def test_knn_sp_neighbours(spark):
    pts = uf_centroids(spark).withColumnRenamed("uf", "id")
    e = wts.knn(pts, k=4)
    assert e.count() == 108
    sp = [r.dst for r in e.where("src = 'SP'").orderBy("rank").collect()]
    assert sp == ["PR", "RJ", "SC", "MG"]


def test_local_moran_matches_committed_table(w27, jobs):
    got = {r.id: r.lisa_i for r in ac.local_moran(jobs, w27, transform="none").collect()}
    for uf, i, _, _ in LISA_TABLE:
        assert got[uf] == pytest.approx(i, abs=1e-12)


def test_global_moran_analytic_values(w27, jobs):
    r = ac.moran(jobs, w27, permutations=0, transform="none").first()
    assert r.moran_i == pytest.approx(-0.0566780345, abs=1e-9)
    assert r.expected_i == pytest.approx(-1 / 26)
    assert (r.s0, r.s1, r.s2) == pytest.approx((27.0, 11.875, 110.875))
    assert r.p_norm == pytest.approx(0.8745497, abs=1e-6)
    rp = ac.moran(jobs.select("id", F.col("prod").alias("value")), w27, permutations=0, transform="none").first()
    assert rp.moran_i == pytest.approx(0.6052967341, abs=1e-9)
    assert rp.p_norm == pytest.approx(2.4129e-08, rel=1e-3)


def test_moran_permutations_and_invariants(w27, jobs):
    r = ac.moran(jobs, w27, permutations=99, seed=7, transform="none").first()
    assert 0 < r.p_value <= 0.5 and -1 <= r.moran_i <= 1
    sc = ac.moran_scatter(jobs, w27, transform="none")
    assert sc.first().slope == pytest.approx(r.moran_i, abs=1e-9)
    loc = ac.local_moran(jobs, w27, transform="none")
    mean_i = loc.agg(F.avg("lisa_i")).first()[0]
    assert mean_i == pytest.approx(26 / 27 * r.moran_i, abs=1e-12)


def test_lisa_pseudo_p_close_to_committed(w27, jobs):
    out = {r.id: r for r in ac.lisa(jobs, w27, permutations=999, seed=123, p_threshold=0.10, transform="none").collect()}
    assert len(out) == 27
    for uf, _, p, _ in LISA_TABLE:
        assert abs(out[uf].lisa_p_value - p) < 0.06, uf
        assert out[uf].lisa_quad in range(5)
    # labels where the committed p-value is clear of the threshold agree
    for uf, _, p, label in LISA_TABLE:
        if abs(p - 0.10) > 0.06:
            assert out[uf].lisa_label == label, uf


def test_lisa_is_deterministic(w27, jobs):
    a = sorted((r.id, r.n_ge) for r in ac.lisa(jobs, w27, permutations=49, transform="none").collect())
    b = sorted((r.id, r.n_ge) for r in ac.lisa(jobs, w27, permutations=49, transform="none").collect())
    assert a == b


def test_nan_and_null_are_imputed(spark, w27, jobs):
    holes = jobs.withColumn("value", F.when(F.col("id") == "SP", F.lit(float("nan"))).when(F.col("id") == "RJ", F.lit(None)).otherwise(F.col("value")))
    out, n, mean = ac.impute_mean(holes)
    vals = {r.id: r.value for r in out.collect()}
    assert n == 27 and vals["SP"] == pytest.approx(mean) and vals["RJ"] == pytest.approx(mean)


def test_constant_variable_does_not_fail(spark, w27):
    const = uf_centroids(spark).select(F.col("uf").alias("id"), F.lit(5.0).alias("value"))
    r = ac.moran(const, w27, permutations=0, transform="none").first()
    assert math.isnan(r.moran_i)


def test_constant_variable_with_permutations(spark, w27):
    const = uf_centroids(spark).select(F.col("uf").alias("id"), F.lit(5.0).alias("value"))
    r = ac.moran(const, w27, permutations=49, transform="none").first()
    assert math.isnan(r.moran_i) and r.p_value is None and r.pattern == ac.PATTERN_RANDOM
    assert {x.lisa_i for x in ac.local_moran(const, w27, transform="none").collect()} == {None}
    rows = ac.lisa(const, w27, permutations=49, transform="none").collect()
    assert {(x.lisa_p_value, x.lisa_quad) for x in rows} == {(None, 0)}


def test_islands_have_no_p(spark):
    w = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("a", "c"), ("c", "a")], "src string, dst string")
    values = spark.createDataFrame([(x, float(v)) for x, v in zip("abcdef", [9, 8, 1, 2, 3, 7])], "id string, value double")
    got = {r.id: r for r in ac.lisa(values, w, permutations=99).collect()}
    for island in "ef":
        assert got[island].lisa_p_value is None and got[island].lisa_quad == 0 and got[island].lisa_label == ac.LISA_LABELS[0]
    assert all(0 < got[x].lisa_p_value <= 0.5 for x in "abcd")


def test_bijection_is_uniform_and_a_permutation(spark):
    from regionlens.functions.permutation import permuted_position, round_keys

    for n in (1, 2, 7, 40):
        perms = round_keys(spark.range(1500).select(F.col("id").cast("int").alias("perm")), 5, n)
        rows = perms.select("perm", F.posexplode(F.sequence(F.lit(0), F.lit(n - 1))).alias("at", "x"), "keys")
        got = rows.select("perm", "x", permuted_position(F.col("x"), n, F.col("keys")).alias("y")).collect()
        images = {}
        for r in got:
            images.setdefault(r.perm, {})[r.x] = r.y
        assert all(sorted(m.values()) == list(range(n)) for m in images.values())
        if n == 7:
            # every position goes everywhere about equally often, the first one too
            for x in range(n):
                seen = [sum(m[x] == y for m in images.values()) for y in range(n)]
                assert min(seen) > 1500 / 7 * 0.7 and max(seen) < 1500 / 7 * 1.3
            pairs = {}
            for m in images.values():
                pairs[m[0], m[1]] = pairs.get((m[0], m[1]), 0) + 1
            assert len(pairs) == 42 and min(pairs.values()) > 10


def test_weight_sums_with_a_self_weight(spark):
    rows = [("a", "b", 0.5), ("b", "a", 0.25), ("a", "a", 2.0), ("b", "c", 1.0)]
    w = spark.createDataFrame(rows, "src string, dst string, w double")
    m = {(a, b): x for a, b, x in rows}
    ids = "abc"
    s1 = 0.5 * sum((m.get((i, j), 0) + m.get((j, i), 0)) ** 2 for i in ids for j in ids)
    s2 = sum((sum(m.get((i, j), 0) for j in ids) + sum(m.get((j, i), 0) for j in ids)) ** 2 for i in ids)
    assert ac.weight_sums(w) == pytest.approx((3.75, s1, s2))


def test_lisa_shuffles_no_row_per_weight_and_permutation(spark, tmp_path):
    """The draws come as one broadcast table: between the weights and the counts nothing is exchanged but the weights
    (by id); ids with more neighbours than the table's broadcast part are counted alike."""
    from regionlens.operators import autocorr as ac

    rng = random.Random(3)
    n = 60
    values = spark.createDataFrame([(i, rng.random()) for i in range(n)], "id bigint, value double")
    weights = [(i, (i + d) % n, 1.0) for i in range(n) for d in range(1, 4)] + [(0, j, 1.0) for j in range(5, 40)]
    w = spark.createDataFrame(weights, "src bigint, dst bigint, w double")
    want = {r.id: (r.n_ge, r.lisa_label) for r in ac.lisa(values, w, permutations=99).collect()}
    plan = ac.lisa(values, w, permutations=99)._jdf.queryExecution().executedPlan().toString()
    assert "perm" not in "".join(x for x in plan.splitlines() if "Exchange hash" in x)
    small, ac.DRAWN_BYTES = ac.DRAWN_BYTES, 24 * 99 * 4  # four neighbours
    try:
        assert {r.id: (r.n_ge, r.lisa_label) for r in ac.lisa(values, w, permutations=99).collect()} == want
    finally:
        ac.DRAWN_BYTES = small
    assert len({c for c, _ in want.values()}) > 10


def test_images_of_blocks_are_those_of_the_expression(spark, monkeypatch):
    """All images in arrays, whatever the blocks and batches, at sizes on both sides of the prime's reduction."""
    import pandas as pd

    from regionlens.functions import permutation as pm

    for n, at in ((1, [0]), (7, range(7)), (1000, range(1000)), (3_000_000_000, [0, 1, 2_147_483_646, 2_999_999_999])):
        keys = pm.round_keys(spark.range(13).select(F.col("id").cast("int").alias("perm")), 5, n)
        rows = keys.join(spark.createDataFrame([(x,) for x in at], "x bigint"))
        want = sorted(map(tuple, rows.select("perm", pm.permuted_position(F.col("x"), n, F.col("keys")), F.col("x").cast("double")).collect()))
        monkeypatch.setattr(pm, "IMAGES", 50)
        batches = [pd.DataFrame({"pos": list(at)[a : a + 300], "z": [float(x) for x in list(at)[a : a + 300]]}) for a in range(0, len(at), 300)]
        found = pd.concat(pm.permuted_rows(keys.orderBy("perm").collect(), n)(iter(batches)))
        assert sorted((p % 13, p // 13, x) for p, x in found.itertuples(index=False)) == want
        if n == 1000:
            dealt = found.sort_values("place")
            lists = pd.concat(pm.rows_of(13)(iter([dealt[:5], dealt[5:40], dealt[40:40], dealt[40:]])))
            assert lists["pos"].tolist() == list(range(1000)) and [x for v in lists["v"] for x in v] == dealt["z"].tolist()


def test_simulated_values_are_those_of_single_rows(spark):
    """Every permutation's I against rows (position, permutation) one by one."""
    from regionlens.functions import permutation as pm
    from regionlens.operators import autocorr as ac

    rng = random.Random(4)
    n, seed, perms = 40, 9, 25
    z = spark.createDataFrame([(10 + i, rng.random() - 0.5) for i in range(n)], "id bigint, z double")
    edges = [(10 + i, 10 + (i + d) % n, 1.0 / d) for i in range(n) for d in (1, 2, 5)]
    sims = ac.global_permutations(z, spark.createDataFrame(edges, "src bigint, dst bigint, w double"), n, 2.0, 3.0, perms, seed)
    keys = pm.round_keys(spark.range(perms).select(F.col("id").cast("int").alias("perm")), seed, n)
    images = keys.join(z.select((F.col("id") - 10).alias("pos"), "z")).select("perm", pm.permuted_position(F.col("pos"), n, F.col("keys")), "z").collect()
    value = {(p, x): v for p, x, v in images}
    want = {p: n / 3.0 / 2.0 * sum(w * value[p, s - 10] * value[p, d - 10] for s, d, w in edges) for p in range(perms)}
    assert {r.perm: r.i_sim for r in sims.collect()} == pytest.approx(want, abs=1e-12)
