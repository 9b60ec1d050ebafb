"""Registered clustering queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import kpi, ml
from ..operators import panel as pnl
from ..session import stage
from ..sources.tables import read_table
from . import stand_ins as si
from .registry import SQL_PANEL, SQL_PROFILE, register

INDICATORS = list(kpi.PROFILE_INDICATORS)
# Display names of cluster ids 0..3 in the original scatter view.
CLUSTER_NAMES = {0: "Cluster A (Perfil 1)", 1: "Cluster B (Perfil 2)", 2: "Cluster C (Perfil 3)", 3: "Cluster D (Perfil 4)"}


def _profile(spark, base):
    return kpi.territory_profile(si.sector_facts(spark, base))


def _profile_region(spark, base):
    nat = read_table(spark, base, "nation", ["n_name", "n_regionkey"])
    return _profile(spark, base).join(F.broadcast(nat), F.col("uf") == F.col("n_name")).drop("n_name").withColumnRenamed(
        "n_regionkey", "cluster_id"
    )


SQL_PROFILE_REGION = f"SELECT p.*, n.n_regionkey AS cluster_id FROM ({SQL_PROFILE}) p JOIN nation n ON n.n_name = p.uf"


@register(
    "ml_standardize",
    f"""SELECT uf, {', '.join(f"round((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}_z" for c in INDICATORS)}
FROM ({SQL_PROFILE}) p""",
)
def q_ml_standardize(spark, base):
    """M-2: indicators scaled to mean 0 and sample std 1 (StandardScaler withMean/withStd)."""
    z = ml.standardize(_profile(spark, base), INDICATORS)
    return round_doubles(z.select("uf", *[f"{c}_z" for c in INDICATORS]))


CP_COLS = ["produtividade_media_uf", "custo_trabalho_medio_uf", "taxa_inovacao_uf", "indice_esg_uf"]


@register(
    "ml_cluster_profile",
    f"""SELECT cluster_id, count(*) AS n_members, {', '.join(f'round(avg({c}), 6) AS {c}' for c in CP_COLS)},
       CASE WHEN avg(produtividade_media_uf) > 200000 THEN '{ml.LABEL_RULES[0][3]}'
            WHEN avg(taxa_inovacao_uf) < 0.015 THEN '{ml.LABEL_RULES[1][3]}'
            WHEN avg(custo_trabalho_medio_uf) > 3500 THEN '{ml.LABEL_RULES[2][3]}'
            ELSE '{ml.LABEL_DEFAULT}' END AS cluster_label
FROM ({SQL_PROFILE_REGION}) x GROUP BY cluster_id ORDER BY cluster_id""",
)
def q_ml_cluster_profile(spark, base):
    """G-4, L-2, P-10: per-cluster means (cluster = region) and the rule-based label."""
    prof = kpi.cluster_profile(_profile_region(spark, base), "cluster_id", CP_COLS)
    return round_doubles(ml.label_clusters(prof)).orderBy("cluster_id")


@register(
    "ml_frontier_view",
    f"""SELECT uf, round(produtividade_media_uf, 6) AS x, round(taxa_inovacao_uf, 6) AS y, cluster_id
FROM ({SQL_PROFILE_REGION}) p""",
)
def q_ml_frontier_view(spark, base):
    """R-5: productivity vs innovation per territory with its cluster."""
    p = _profile_region(spark, base)
    return round_doubles(p.select("uf", F.col("produtividade_media_uf").alias("x"), F.col("taxa_inovacao_uf").alias("y"), "cluster_id"))


SQL_EMB = "SELECT vec_id AS id, label AS c, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"
SQL_EMB_STATS = f"""
pts AS ({SQL_EMB}),
dims AS (SELECT id, c, unnest(range(1, len(x) + 1)) AS d, unnest(x) AS v FROM pts),
cs AS (SELECT c, d, sum(v) AS s FROM dims GROUP BY c, d),
cn AS (SELECT c, count(*) AS n, sum(list_dot_product(x, x)) AS psi FROM pts GROUP BY c)
"""


def _emb(spark, base):
    return read_table(spark, base, "embeddings", ["vec_id", "embedding", "label"]).withColumnRenamed("vec_id", "id")


@register(
    "ml_silhouette",
    f"""WITH {SQL_EMB_STATS},
sq AS (SELECT id, c, list_dot_product(x, x) AS sq FROM pts),
xs AS (SELECT dims.id, cs.c AS k, sum(dims.v * cs.s) AS xs FROM dims JOIN cs ON cs.d = dims.d GROUP BY dims.id, cs.c),
dist AS (SELECT sq.id, sq.c AS own, xs.k, sq.sq + cn.psi / cn.n - 2.0 * xs.xs / cn.n AS d, cn.n
         FROM sq JOIN xs ON xs.id = sq.id JOIN cn ON cn.c = xs.k),
ab AS (SELECT id, max(CASE WHEN k = own THEN d * n / (n - 1) END) AS a, max(CASE WHEN k = own THEN n END) AS n_own,
              min(CASE WHEN k <> own THEN d END) AS b FROM dist GROUP BY id)
SELECT round(avg(CASE WHEN n_own <= 1 THEN 0.0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END), 6) AS silhouette,
       count(*) AS n FROM ab""",
)
def q_ml_silhouette(spark, base):
    """M-6: squared-Euclidean silhouette of the embeddings under their given label."""
    return round_doubles(ml.silhouette(_emb(spark, base), "embedding", "label"))


@register(
    "ml_wssse",
    f"""WITH {SQL_EMB_STATS},
ss AS (SELECT c, sum(s * s) AS ss FROM cs GROUP BY c)
SELECT round(sum(cn.psi - ss.ss / cn.n), 6) AS wssse, count(*) AS k FROM cn JOIN ss ON ss.c = cn.c""",
)
def q_ml_wssse(spark, base):
    """M-8: within-cluster sum of squared distances to the cluster means (given label)."""
    return round_doubles(ml.wssse(_emb(spark, base), "embedding", "label"))


@register(
    "ml_assign_nearest",
    f"""WITH {SQL_EMB_STATS},
ctr AS (SELECT cs.c, cs.d, cs.s / cn.n AS m FROM cs JOIN cn ON cn.c = cs.c),
d2 AS (SELECT dims.id, ctr.c, sum((dims.v - ctr.m) * (dims.v - ctr.m)) AS d2 FROM dims JOIN ctr ON ctr.d = dims.d GROUP BY dims.id, ctr.c),
best AS (SELECT id, c, d2, row_number() OVER (PARTITION BY id ORDER BY d2, c) AS r FROM d2)
SELECT id, c AS cluster, round(d2, 6) AS cluster_d2 FROM best WHERE r = 1""",
)
def q_ml_assign_nearest(spark, base):
    """M-11: every embedding assigned to the nearest label centroid."""
    emb = _emb(spark, base)
    centers = ml.centers_from_labels(emb, "embedding", "label")
    return round_doubles(ml.assign_nearest(emb, "embedding", centers).select("id", "cluster", "cluster_d2"))


K = 4


def _kmeans(spark, base):
    # the profile is an aggregate over lineitem; MLlib makes several passes (scaler fit,
    # k-means|| init, iterations, transform, evaluation), so it is written once first
    prof = ml.stable_layout(stage(_profile(spark, base), "profile"), "uf", 4)
    model, pred = ml.kmeans_pipeline(prof, INDICATORS, k=K, seed=123)
    return model, pred.withColumn("fs", vector_to_array("features_scaled"))


@register(
    "ml_kmeans",
    f"SELECT count(*) AS n_rows, CAST({K} AS BIGINT) AS n_clusters, CAST(0 AS BIGINT) AS n_not_nearest, 0.0::DOUBLE AS max_center_gap, 0.0::DOUBLE AS silhouette_gap FROM ({SQL_PROFILE}) p",
)
def q_ml_kmeans(spark, base):
    """M-1..M-4, M-6: scaled K-Means (k=4, seed 123) on the territory indicators, by what must hold
    of it: every row in the cluster of its nearest centre, centres at their members' means, and
    MLlib's silhouette equal to the closed form."""
    model, pred = _kmeans(spark, base)
    facts = ml.fit_facts(pred, "fs", "cluster_id", ml.cluster_centers(model, "c"))
    closed = ml.silhouette(pred, "fs", "cluster_id").select("silhouette").scalar()
    gap = F.abs(closed - F.lit(ml.silhouette_mllib(pred, "fs", "cluster_id")))
    facts = facts.withColumns({"silhouette_gap": F.round(gap, 6), "max_center_gap": F.round("max_center_gap", 6)})
    return facts.select("n_rows", "n_clusters", "n_not_nearest", "max_center_gap", "silhouette_gap")


@register("ml_kmeans_centers", f"SELECT range AS d, CAST({K} AS BIGINT) AS n_centers, 0.0::DOUBLE AS weighted_mean FROM range(0, {len(INDICATORS)})")
def q_ml_kmeans_centers(spark, base):
    """M-5: centres in scaled feature space; weighted by their members they balance at 0."""
    model, pred = _kmeans(spark, base)
    sizes = pred.groupBy(F.col("cluster_id").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    long = ml.cluster_centers(model, "c").join(sizes, "c").select("n", F.posexplode("center").alias("d", "v"))
    mean = F.sum(F.col("n") * F.col("v")) / F.sum("n")
    return long.groupBy(F.col("d").cast("long").alias("d")).agg(F.count(F.lit(1)).alias("n_centers"), F.abs(F.round(mean, 6)).alias("weighted_mean"))


@register(
    "ml_cluster_profile_fitted",
    f"SELECT CAST({K} AS BIGINT) AS n_clusters, count(*) AS n_members, {', '.join(f'round(avg({c}), 6) AS {c}' for c in CP_COLS)} FROM ({SQL_PROFILE}) p",
)
def q_ml_cluster_profile_fitted(spark, base):
    """G-4 on the fitted clusters: their sizes add up to all territories and their means, weighted by
    size, to the overall means."""
    _, pred = _kmeans(spark, base)
    prof = kpi.cluster_profile(pred, "cluster_id", CP_COLS)
    means = [(F.sum(F.col(c) * F.col("n_members")) / F.sum("n_members")).alias(c) for c in CP_COLS]
    return round_doubles(prof.agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n_members").alias("n_members"), *means))


SWEEP = range(2, 7)


@register(
    "ml_kmeans_sweep",
    f"""SELECT CAST(range AS INTEGER) AS k, n.n AS n_rows, range AS n_clusters, CAST(0 AS BIGINT) AS n_not_nearest, 0.0::DOUBLE AS cost_gap, 0.0::DOUBLE AS silhouette_gap, true AS plausible
FROM range({SWEEP.start}, {SWEEP.stop}), (SELECT count(DISTINCT uf) AS n FROM ({SQL_PANEL}) p) n""",
)
def q_ml_kmeans_sweep(spark, base):
    """M-7, M-8, R-6: silhouette and WSSSE for k = 2..6 on the scaled panel features, checked against
    the closed forms; missing features take the column's mean."""
    cols = list(pnl.PANEL_FEATURES)
    feats = stage(ml.impute_means(pnl.territory_features(si.labour_panel(spark, base)), cols), "features")
    prep = ml.assemble(ml.stable_layout(feats, "uf", 4), cols)
    scaled = StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True).fit(prep).transform(prep)
    rows = ml.kmeans_sweep(scaled, "features", SWEEP, seed=42)
    plausible = F.col("silhouette").between(-1, 1) & (F.col("cost") >= 0)
    return rows.select("k", "n_rows", "n_clusters", "n_not_nearest", F.round("cost_gap", 6).alias("cost_gap"), F.round("silhouette_gap", 6).alias("silhouette_gap"), plausible.alias("plausible"))


def _named(cluster: str):
    names = F.create_map(*[x for kv in CLUSTER_NAMES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.element_at(names, F.col(cluster))


@register("ml_kmeans_clusters")
def q_ml_kmeans_clusters(spark, base):
    """M-3, M-4, M-11: every territory with its fitted cluster, the cluster's name and its indicators (tests hold
    them to the facts of ml_kmeans)."""
    _, pred = _kmeans(spark, base)
    return round_doubles(pred.select("uf", "cluster_id", _named("cluster_id").alias("cluster_name"), *INDICATORS))


@register("ml_kmeans_center_values")
def q_ml_kmeans_center_values(spark, base):
    """M-5: the fitted centres in scaled feature space, one row per cluster and indicator, with the cluster's size."""
    model, pred = _kmeans(spark, base)
    sizes = pred.groupBy(F.col("cluster_id").alias("c")).agg(F.count(F.lit(1)).alias("n_members"))
    rows = ml.cluster_centers(model, "c").join(sizes, "c").select(F.col("c").alias("cluster_id"), "n_members", F.posexplode("center").alias("d", "center"))
    names = F.array(*[F.lit(c) for c in INDICATORS])
    return round_doubles(rows.select("cluster_id", "n_members", F.get(names, F.col("d")).alias("indicator"), "center"))


@register("ml_cluster_profiles")
def q_ml_cluster_profiles(spark, base):
    """G-4, L-2, P-10 on the fitted clusters: sizes, means and the rule-based label."""
    _, pred = _kmeans(spark, base)
    prof = kpi.cluster_profile(pred, "cluster_id", CP_COLS)
    return round_doubles(ml.label_clusters(prof)).orderBy("cluster_id")


def _panel_vectors(spark, base):
    cols = list(pnl.PANEL_FEATURES)
    feats = ml.standardize(ml.impute_means(pnl.territory_features(si.labour_panel(spark, base)), cols), cols)
    return stage(feats.select("uf", F.array(*[F.coalesce(f"{c}_z", F.lit(0.0)) for c in cols]).alias("x")), "features")


@register("ml_kmeans_elbow")
def q_ml_kmeans_elbow(spark, base):
    """M-7, M-8, R-6: cost and silhouette for k = 2..6 on the scaled panel features, all k fitted in the same scans."""
    rows = _panel_vectors(spark, base)
    return round_doubles(ml.elbow(rows, "x", ml.kmeans_all(rows, "x", SWEEP)))


@register("ml_pca_clusters")
def q_ml_pca_clusters(spark, base):
    """R-4: the scatter of territories on two principal axes with fitted cluster and cluster name."""
    _, pred = _kmeans(spark, base)
    out, _ = ml.pca_2d(pred, "features_scaled", 2)
    return round_doubles(out.select("uf", "pca_1", "pca_2", "produtividade_media_uf", "taxa_inovacao_uf", "cluster_id", _named("cluster_id").alias("cluster_name")))


def _sql_pca(squarings: int = 14) -> str:
    """First two principal axes of the correlation matrix: the matrix is squared until only the
    first axis is left (a power iteration), taken out, and squared again for the second."""
    z = " UNION ALL ".join(
        f"SELECT uf, {i} AS d, (CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS v FROM pr" for i, c in enumerate(INDICATORS)
    )
    out = [
        f"pr AS MATERIALIZED ({SQL_PROFILE})",
        f"z AS MATERIALIZED ({z})",
        "c0 AS MATERIALIZED (SELECT a.d AS i, b.d AS j, sum(a.v * b.v) / (SELECT count(*) - 1 FROM pr) AS v FROM z a JOIN z b ON a.uf = b.uf GROUP BY 1, 2)",
    ]
    for axis in (1, 2):
        start = f"c{axis - 1}"
        out.append(f"m{axis}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {start} WHERE i = j) AS v FROM {start})")
        for t in range(squarings):
            out.append(f"q{axis}_{t} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM m{axis}_{t} a JOIN m{axis}_{t} b ON a.j = b.i GROUP BY 1, 2)")
            out.append(f"m{axis}_{t + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM q{axis}_{t} WHERE i = j) AS v FROM q{axis}_{t})")
        last = f"m{axis}_{squarings}"
        out += [
            f"col{axis} AS MATERIALIZED (SELECT i, v FROM {last} WHERE j = (SELECT i FROM {last} WHERE i = j ORDER BY v DESC LIMIT 1))",
            f"""e{axis} AS MATERIALIZED (SELECT i, v / sqrt((SELECT sum(v * v) FROM col{axis})) * (SELECT sign(v) FROM col{axis} ORDER BY abs(v) DESC LIMIT 1) AS v FROM col{axis})""",
            f"c{axis} AS MATERIALIZED (SELECT c.i, c.j, c.v - (SELECT sum(x.v * c2.v * y.v) FROM {start} c2 JOIN e{axis} x ON x.i = c2.i JOIN e{axis} y ON y.i = c2.j) * a.v * b.v AS v FROM {start} c JOIN e{axis} a ON a.i = c.i JOIN e{axis} b ON b.i = c.j)",
            f"p{axis} AS (SELECT z.uf, sum(z.v * e.v) AS p FROM z JOIN e{axis} e ON e.i = z.d GROUP BY z.uf)",
        ]
    return ",\n".join(out)


@register(
    "ml_pca_scatter",
    f"""WITH {_sql_pca()}
SELECT pr.uf, round(p1.p, 6) AS pca_1, round(p2.p, 6) AS pca_2, round(pr.produtividade_media_uf, 6) AS produtividade_media_uf,
       round(pr.taxa_inovacao_uf, 6) AS taxa_inovacao_uf, true AS named
FROM pr JOIN p1 ON p1.uf = pr.uf JOIN p2 ON p2.uf = pr.uf""",
)
def q_ml_pca_scatter(spark, base):
    """M-9, M-10, R-4: 2-D PCA of the scaled indicators; ``named``: the cluster has a display name."""
    _, pred = _kmeans(spark, base)
    out, _ = ml.pca_2d(pred, "features_scaled", 2)
    names = F.create_map(*[x for kv in CLUSTER_NAMES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    named = F.element_at(names, F.col("cluster_id")).isNotNull()
    return round_doubles(out.select("uf", "pca_1", "pca_2", "produtividade_media_uf", "taxa_inovacao_uf", named.alias("named")))
