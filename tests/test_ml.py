import pytest
from pyspark.sql import functions as F

from regionlens.operators import kpi, ml
from regionlens.plans import stand_ins as si
from regionlens.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def test_silhouette_closed_form_equals_mllib(spark):
    emb = read_table(spark, SF, "embeddings", ["vec_id", "embedding", "label"])
    closed = ml.silhouette(emb, "embedding", "label").first().silhouette
    assert closed == pytest.approx(ml.silhouette_mllib(emb, "embedding", "label"), abs=1e-9)


def test_assign_nearest_is_argmin(spark):
    emb = read_table(spark, SF, "embeddings", ["vec_id", "embedding", "label"])
    centers = ml.centers_from_labels(emb, "embedding", "label")
    local = [(r.c, r.center) for r in centers.collect()]
    rows = ml.assign_nearest(emb, "embedding", centers).select("embedding", "cluster").limit(50).collect()
    for r in rows:
        d = sorted((sum((a - b) ** 2 for a, b in zip(map(float, r.embedding), m)), c) for c, m in local)
        assert r.cluster == d[0][1]


def test_blocks_of_clusters_give_the_same_result(spark, monkeypatch):
    emb = read_table(spark, SF, "embeddings", ["vec_id", "embedding", "label"])
    centers = ml.centers_from_labels(emb, "embedding", "label")
    one = ml.silhouette(emb, "embedding", "label").first().silhouette
    near = ml.assign_nearest(emb, "embedding", centers).groupBy("cluster").count().collect()
    monkeypatch.setattr(ml, "BLOCK_NUMBERS", 3 * 64)
    assert ml.silhouette(emb, "embedding", "label").first().silhouette == pytest.approx(one, abs=1e-12)
    assert sorted(map(tuple, ml.assign_nearest(emb, "embedding", centers).groupBy("cluster").count().collect())) == sorted(map(tuple, near))


def test_missing_features_take_the_mean(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", None, None), ("c", float("nan"), None), ("d", 3.0, None)], "id string, x double, y double")
    rows = ml.impute_means(df, ["x", "y"]).collect()
    assert [r.x for r in rows] == [1.0, 2.0, 2.0, 3.0] and {r.y for r in rows} == {0.0}


def test_wssse_matches_direct_sum(spark):
    emb = read_table(spark, SF, "embeddings", ["vec_id", "embedding", "label"])
    centers = {r.c: r.center for r in ml.centers_from_labels(emb, "embedding", "label").collect()}
    direct = sum(sum((float(a) - b) ** 2 for a, b in zip(r.embedding, centers[r.label])) for r in emb.collect())
    assert ml.wssse(emb, "embedding", "label").first().wssse == pytest.approx(direct, rel=1e-9)


def test_kmeans_pipeline_and_pca(spark):
    prof = kpi.territory_profile(si.sector_facts(spark, SF))
    model, pred = ml.kmeans_pipeline(prof, list(kpi.PROFILE_INDICATORS), k=4, seed=123, key="uf", partitions=2)
    assert pred.select("cluster_id").distinct().count() == 4
    assert pred.count() == prof.count()
    assert ml.cluster_centers(model).count() == 4
    out, ev = ml.pca_2d(pred, "features_scaled", 2)
    assert 0 < sum(ev) <= 1.0 + 1e-9 and ev[0] >= ev[1]
    assert out.where(F.col("pca_1").isNull()).count() == 0
    z = ml.standardize(prof, ["produtividade_media_uf"]).agg(F.avg("produtividade_media_uf_z"), F.stddev_samp("produtividade_media_uf_z")).first()
    assert z[0] == pytest.approx(0.0, abs=1e-9) and z[1] == pytest.approx(1.0)


def test_fitted_results_agree_with_the_facts(spark):
    """The queries with the real clusters, centres and scatter belong to one fit, every row at its nearest centre."""
    from regionlens.plans import ml_queries as q

    rows = {r.uf: r for r in q.q_ml_kmeans_clusters(spark, SF).collect()}
    model, pred = q._kmeans(spark, SF)
    want = {r.uf: r.cluster_id for r in pred.collect()}
    assert {u: r.cluster_id for u, r in rows.items()} == want and all(r.cluster_name for r in rows.values())
    centers = q.q_ml_kmeans_center_values(spark, SF).collect()
    assert {(r.cluster_id, r.n_members) for r in centers} == {(c, list(want.values()).count(c)) for c in range(q.K)}
    table = {(r.cluster_id, r.indicator): r.center for r in centers}
    for r in pred.collect():
        d = [sum((x - table[c, i]) ** 2 for x, i in zip(r.fs, q.INDICATORS, strict=True)) for c in range(q.K)]
        assert d[r.cluster_id] <= min(d) + 1e-4
    scatter = {r.uf: r for r in q.q_ml_pca_clusters(spark, SF).collect()}
    plain = {r.uf: (r.pca_1, r.pca_2) for r in q.q_ml_pca_scatter(spark, SF).collect()}
    assert {u: (r.pca_1, r.pca_2) for u, r in scatter.items()} == plain and {u: r.cluster_id for u, r in scatter.items()} == want
    prof = {r.cluster_id: r.n_members for r in q.q_ml_cluster_profiles(spark, SF).collect()}
    assert prof == {c: list(want.values()).count(c) for c in range(q.K)}


def test_all_k_at_once(spark):
    """Costs per k no worse than MLlib's by 1 %, centres at their members' means, the elbow's silhouette MLlib's."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    emb = read_table(spark, SF, "embeddings", ["embedding"]).select(F.slice("embedding", 1, 6).cast("array<double>").alias("x")).persist()
    fits = ml.kmeans_all(emb, "x", [2, 3, 5], starts=4).persist()
    rows = ml.elbow(emb, "x", fits).collect()
    vectors = emb.select(array_to_vector("x").alias("features")).persist()
    for r in rows:
        model = KMeans(k=r.k, seed=42, maxIter=40).fit(vectors)
        assert r.cost <= 1.01 * model.summary.trainingCost
        mine = fits.where(F.col("k") == r.k).select(F.col("cluster").alias("c"), "center")
        near = ml.assign_nearest(emb, "x", mine, "c")
        facts = ml.fit_facts(near, "x", "c", mine).first()
        assert facts.n_not_nearest == 0 and facts.max_center_gap < 1e-3 and facts.cost == pytest.approx(r.cost, rel=1e-9)
        assert r.silhouette == pytest.approx(ml.silhouette_mllib(near, "x", "c"), abs=1e-9)
        assert r.n_rows == emb.count() == sum(x.n for x in fits.where(F.col("k") == r.k).collect())
    assert ml.kmeans_all(emb.limit(0), "x").count() == 0
