import numpy as np
import pytest
from llm_cases import SF

from regionlens.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, vec bigint"


def brute(rows, every=50, k=5):
    """The exact answer by comparing every query with every row, in double precision."""
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float64)
    ids = sorted(good)
    out = {}
    for q in ids:
        if q % every == 0:
            x = good[q]
            s = [(-float(x @ good[i]) / (np.sqrt(x @ x) * np.sqrt(good[i] @ good[i])), i) for i in ids if i != q]
            out[q] = sorted(s)[:k]
    return out


def recall(got, want):
    found = {(r["query_id"], r["vec_id"]) for r in got}
    pairs = [(q, i) for q, best in want.items() for _, i in best]
    return sum(p in found for p in pairs) / len(pairs)


def check(got, want):
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    assert set(by) == {q for q, best in want.items() if best}
    for q, rows in by.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(want[q]) + 1))
        assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)


def test_query_recall(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = ann.op6_ann(spark, SF).collect(), brute(rows)
    check(got, want)
    assert recall(got, want) >= 0.9
    exact = {(q, i): -s for q, best in want.items() for s, i in best}
    assert all(abs(exact[r["query_id"], r["vec_id"]] - r["score"]) < 1e-12 for r in got if (r["query_id"], r["vec_id"]) in exact)


def test_many_lists(spark):
    """Clustered vectors in many small lists, and more copies of one vector than k."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.5 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:1100] = x[7]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = ann.nearest(df, list_size=60, sample=1500).collect()
    want = brute(rows)
    check(got, want)
    assert recall(got, want) >= 0.9
    best = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 150)
    assert [v for _, v in best] == [7, 100, 101, 102, 103]


def test_graph_search_finds_the_nearest_lists():
    rng = np.random.default_rng(1)
    sample = rng.normal(size=(4000, 12))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    c = ann.Centroids.of(sample, 100)
    sizes = np.bincount((sample @ c.points.T).argmax(axis=1), minlength=100)
    assert len(c.points) == 100 and sizes.max() < 6 * sizes.mean()
    v = sample[:300]
    far = np.sqrt(np.maximum(2 - 2 * v @ c.points.T, 0))
    found = c.search(v, 1.2, 64)
    close = far <= far.min(axis=1, keepdims=True) * 1.2
    assert np.isfinite(found[close]).mean() > 0.97


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1),
        (5, None, 1), (6, [], 1), (7, [None, 1.0], 1), (None, [1.0, 1.0], 1), (8, [0.0, 1.0], 1), (50, [0.0, 3.0], 1), (100, [0.0, 0.0], 1),
    ]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute([(i, v) for i, v, _ in rows])
    check(got, want)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got)] == [(0, 1, 1), (0, 2, 8), (0, 3, 50), (50, 1, 8), (50, 2, 0), (50, 3, 1)]
    assert recall(got, want) == 1


def test_empty_and_mixed(spark):
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        ann.nearest(spark.createDataFrame([(0, [1.0], 1), (1, [1.0, 2.0], 1)], SCHEMA))


def test_extreme_components(spark):
    """Vectors whose squares overflow or vanish are compared like any other, and harm none."""
    big = [(50, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [1e-200, -1e-200]), (3, [1.0, 1.0]), (4, [1.0, 2.0]), (100, [3e-310, 1e-310]), (5, [1e308, -1e308])]
    rows = spark.createDataFrame(big, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(rows).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ones = {i: np.array(v) / np.abs(v).max() for i, v in big}
    for q in (50, 100):
        cos = sorted((-float(ones[q] @ x / np.linalg.norm(ones[q]) / np.linalg.norm(x)), i) for i, x in ones.items() if i != q)[:5]
        mine = sorted(got[q])
        assert [x[2] for x in mine] == pytest.approx([-c for c, _ in cos], abs=1e-9)
        assert {x[1] for x in mine[:2]} == {i for _, i in cos[:2]}
