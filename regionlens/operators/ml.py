"""Clustering and projection (M-1..M-11, P-10, R-4, R-6).

MLlib does the model fitting (distributed, broadcasting only k centres); the closed-form
evaluators below are DataFrame expressions over per-cluster sufficient statistics
(count, sum vector, sum of squared norms): one row per cluster, whatever n is.  A point is
compared with all clusters, so these rows reach every task as a scalar subquery, in blocks
of at most ``BLOCK_NUMBERS`` numbers; more clusters take more passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.permutation import dense_index
from ..session import stage
from ..sources.tables import require_columns

BLOCK_NUMBERS = 1_000_000

# The labelling rules of the original cluster interpretation
# (first match wins): productivity > 200000, innovation < 0.015, labour cost > 3500.
LABEL_RULES = (
    ("produtividade_media_uf", ">", 200000.0, "1. Polo Industrial Avançado (Maduro)"),
    ("taxa_inovacao_uf", "<", 0.015, "4. Baixo Dinamismo / Tradicional"),
    ("custo_trabalho_medio_uf", ">", 3500.0, "2. Alto Custo / Estagnado"),
)
LABEL_DEFAULT = "3. Emergente / Agro-Indústria"


def label_clusters(profile: DataFrame, rules=LABEL_RULES, default: str = LABEL_DEFAULT, out: str = "cluster_label") -> DataFrame:
    """P-10: first matching threshold rule names the cluster (CASE WHEN chain)."""
    expr = None
    for col, op, thr, text in rules:
        cond = F.col(col) > F.lit(thr) if op == ">" else F.col(col) < F.lit(thr)
        expr = F.when(cond, F.lit(text)) if expr is None else expr.when(cond, F.lit(text))
    return profile.withColumn(out, expr.otherwise(F.lit(default)))


def drop_vector_columns(df: DataFrame) -> DataFrame:
    """P-7: drop every ML vector column (keeps exported tables plain)."""
    from pyspark.ml.linalg import VectorUDT

    return df.drop(*[f.name for f in df.schema.fields if isinstance(f.dataType, VectorUDT)])


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features_raw", handle_invalid: str = "error") -> DataFrame:
    """M-1: VectorAssembler."""
    require_columns(df, *cols)
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=handle_invalid).transform(df)


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """M-2 as column expressions: (x - mean) / sample std (what StandardScaler(withMean,
    withStd) computes).  The 2 x d moments come from one aggregate."""
    require_columns(df, *cols)
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"), F.stddev_samp(F.col(c).cast("double")).alias(f"s_{c}")]
    r = df.agg(*aggs).first()
    return df.withColumns(
        {
            f"{c}{suffix}": F.try_divide(F.col(c).cast("double") - F.lit(r[f"m_{c}"]), F.lit(r[f"s_{c}"]))
            for c in cols
        }
    )


def stable_layout(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Deterministic row placement (MLlib initialisation depends on partitioning)."""
    return df.repartitionByRange(partitions, key).sortWithinPartitions(key)


def kmeans_pipeline(
    df: DataFrame,
    features: Sequence[str],
    k: int = 4,
    seed: int = 123,
    prediction_col: str = "cluster_id",
    max_iter: int = 20,
    key: str | None = None,
    partitions: int | None = None,
):
    """M-1..M-4: assembler -> scaler (mean + sample std) -> KMeans; returns (model, predictions)."""
    if key and partitions:
        df = stable_layout(df, key, partitions)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features_raw")
    scaler = StandardScaler(inputCol="features_raw", outputCol="features_scaled", withMean=True, withStd=True)
    km = KMeans(featuresCol="features_scaled", k=k, seed=seed, predictionCol=prediction_col, maxIter=max_iter)
    model = Pipeline(stages=[assembler, scaler, km]).fit(df)
    return model, model.transform(df)


def cluster_centers(model, prediction_col: str = "cluster_id") -> DataFrame:
    """M-5: centres of the fitted KMeans stage as (cluster_id, center array<double>) - k rows."""
    from pyspark.sql import SparkSession

    km = model.stages[-1] if hasattr(model, "stages") else model
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(km.clusterCenters())]
    return SparkSession.getActiveSession().createDataFrame(rows, f"{prediction_col} int, center array<double>")


def kmeans_sweep(df: DataFrame, features_col: str = "features", ks: Sequence[int] = range(2, 7), seed: int = 42) -> DataFrame:
    """M-7, M-8, R-6: silhouette and training cost (WSSSE) for each k on one cached frame, with
    what must hold of each fit (``fit_facts``).  Null features raise; impute them before."""
    data = df.select(features_col, vector_to_array(features_col).alias("_x")).persist()
    evaluator = ClusteringEvaluator(featuresCol=features_col, predictionCol="prediction", metricName="silhouette",
                                    distanceMeasure="squaredEuclidean")
    rows = []
    for k in ks:
        model = KMeans(featuresCol=features_col, k=k, seed=seed).fit(data)
        pred = model.transform(data)
        facts = fit_facts(pred, "_x", "prediction", cluster_centers(model, "c")).first()
        closed = silhouette(pred, "_x", "prediction").first()["silhouette"]
        sil, cost = float(evaluator.evaluate(pred)), float(model.summary.trainingCost)
        rows.append((int(k), sil, cost, facts["n_rows"], facts["n_clusters"], facts["n_not_nearest"], facts["max_center_gap"], abs(facts["cost"] - cost), abs(closed - sil)))
    data.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "k int, silhouette double, cost double, n_rows long, n_clusters long, n_not_nearest long, max_center_gap double, cost_gap double, silhouette_gap double"
    )


SEED_ROWS = 2000
"""Rows that the starting centres are chosen from, at most."""


def _starts(rows, k: int, seed: int):
    """Starting centres among ``rows`` (an array): each with a probability by its squared distance to those before."""
    import numpy as np

    rng = np.random.default_rng(seed)
    chosen = [rows[rng.integers(len(rows))]]
    while len(chosen) < k:
        d2 = np.min([((rows - c) ** 2).sum(axis=1) for c in chosen], axis=0)
        at = rng.choice(len(rows), p=d2 / d2.sum()) if d2.sum() > 0 else rng.integers(len(rows))
        chosen.append(rows[at])
    return [[float(v) for v in c] for c in chosen]


def kmeans_all(df: DataFrame, vec: str, ks: Sequence[int] = range(2, 7), seed: int = 42, starts: int = 8, max_iter: int = 40, tol: float = 1e-6) -> DataFrame:
    """M-7, M-5: K-Means for every k at once.  Each iteration is one scan: a row finds its nearest centre under every
    fit (k, start), and sums are kept per (fit, cluster); the fits that still move are in the next scan.

    ``starts`` fits per k begin at different centres, chosen from SEED_ROWS rows by hash; the one with the
    smallest cost is returned: one row per (k, cluster) with center, n (members), cost (squared distances of its members).
    Vectors must be without nulls.  A cluster that loses all members keeps its centre.  Only centres and
    sums travel to the driver: at most sum(ks) * starts rows.
    """
    import numpy as np

    rows = df.select(_vec(vec).alias("x"))
    some = rows.distinct().orderBy(F.xxhash64("x"), "x").limit(SEED_ROWS).collect()
    if not some:
        return df.sparkSession.createDataFrame([], "k int, cluster int, center array<double>, n long, cost double")
    points = np.array([r["x"] for r in some])
    fits = {(k, s): _starts(points, k, seed + s) for k in ks for s in range(starts)}
    live, best = dict(fits), {}
    for _ in range(max_iter + 1):
        names = list(live)
        table = F.array(*[F.array(*[F.array(*[F.lit(v) for v in c]) for c in live[f]]) for f in names])
        near = F.transform(table, lambda cs: F.array_min(F.transform(cs, lambda c, i: F.struct(
            F.aggregate(F.zip_with("x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t).alias("d2"), i.alias("c")
        ))))
        found = rows.select("x", F.posexplode(near).alias("f", "e")).select("f", "e.c", "e.d2", array_to_vector("x").alias("v"))
        sums = found.groupBy("f", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("cost"), vector_to_array(Summarizer.sum(F.col("v"))).alias("s")).collect()
        per = {}
        for r in sums:
            per.setdefault(names[r["f"]], {})[r["c"]] = (r["n"], r["cost"], np.array(r["s"]) / r["n"])
        moving = {}
        for f, stats in per.items():
            old = live[f]
            best[f] = (sum(c for _, c, _ in stats.values()), [(old[c], *stats.get(c, (0, 0.0))[:2]) for c in range(f[0])])
            new = [[float(v) for v in stats[c][2]] if c in stats else old[c] for c in range(f[0])]
            if max(abs(a - b) for x, y in zip(old, new, strict=True) for a, b in zip(x, y, strict=True)) > tol:
                moving[f] = new
        live = moving
        if not live:
            break
    out = []
    for k in ks:
        cost, clusters = min((best[k, s] for s in range(starts)), key=lambda x: x[0])
        out += [(int(k), c, center, int(n), float(d)) for c, (center, n, d) in enumerate(clusters)]
    return df.sparkSession.createDataFrame(out, "k int, cluster int, center array<double>, n long, cost double")


def elbow(df: DataFrame, vec: str, fits: DataFrame) -> DataFrame:
    """R-6: per k of ``fits`` (``kmeans_all``) the cost (WSSSE) and the silhouette of the rows at their nearest centres."""
    out = None
    for k in [r[0] for r in fits.select("k").distinct().orderBy("k").collect()]:
        mine = fits.where(F.col("k") == k)
        near = assign_nearest(df.select(vec), vec, mine.select(F.col("cluster").alias("c"), "center"), "near")
        row = silhouette(near, vec, "near").select(
            F.lit(k).alias("k"), mine.agg(F.sum("cost")).scalar().alias("cost"), "silhouette", F.col("n").alias("n_rows")
        )
        out = row if out is None else out.union(row)
    return out


def impute_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL and NaN in ``cols`` replaced by the column's mean; a column without any value gets 0."""
    from ..functions.columns import nan_to_null

    means = df.agg(*[F.coalesce(F.avg(nan_to_null(c)), F.lit(0.0)).alias(c) for c in cols]).first()
    return df.withColumns({c: F.coalesce(nan_to_null(c), F.lit(means[c])) for c in cols})


def pca_2d(df: DataFrame, features_col: str = "features_scaled", k: int = 2):
    """M-9, M-10: PCA projection split into pca_1..pca_k; the sign of each component is
    fixed so its largest-magnitude loading is positive.  Returns (frame, explained variance)."""
    model = PCA(k=k, inputCol=features_col, outputCol="pca_features").fit(df)
    pc = model.pc.toArray()
    signs = []
    for j in range(k):
        col = pc[:, j]
        idx = int(abs(col).argmax())
        signs.append(1.0 if col[idx] >= 0 else -1.0)
    arr = vector_to_array(F.col("pca_features"))
    out = model.transform(df).withColumns({f"pca_{j + 1}": arr[j] * F.lit(signs[j]) for j in range(k)}).drop("pca_features")
    return out, [float(v) for v in model.explainedVariance]


# ------------------------------------------------------------------ closed-form evaluators


def _vec(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.transform(c, lambda v: v.cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, t: s + t)


def cluster_stats(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """Per cluster one row (c, n, s, psi): count, sum vector, sum of squared norms.

    The sums are MLlib's vector summaries, so the width of the vectors need not be known."""
    x = _vec(vec)
    rows = df.select(F.col(cluster).alias("c"), array_to_vector(x).alias("v"), _dot(x, x).alias("q"))
    return rows.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(F.col("v"))).alias("s"), F.sum("q").alias("psi")
    )


def _blocks(rows: DataFrame, key: str, vec: str):
    """The rows, as scalar arrays of structs, in blocks of at most BLOCK_NUMBERS numbers."""
    rows = stage(dense_index(rows, key, out="_pos"), "clusters")
    size = rows.agg(F.count(F.lit(1)).alias("k"), F.max(F.size(vec)).alias("d")).first()
    per = max(1, BLOCK_NUMBERS // max(1, size["d"] or 1))
    entry = F.struct(*[c for c in rows.columns if c != "_pos"])
    for first in range(0, size["k"], per):
        part = rows.where((F.col("_pos") >= first) & (F.col("_pos") < first + per))
        yield part.agg(F.collect_list(entry).alias("e")).scalar()


def silhouette(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """M-6 closed form (squared Euclidean, as MLlib): per point
    d(x, C) = |x|^2 + psi_C/n_C - 2 x.S_C/n_C; a = d(x, own) * n/(n-1); b = min over other
    clusters; s = 1 - a/b if a < b, b/a - 1 if a > b, else 0 (0 for a singleton cluster).
    Returns one row (silhouette, n)."""
    x = F.col("x")
    per = df.select(F.col(cluster).alias("own"), _vec(vec).alias("x")).withColumns(
        {"sq": _dot(x, x), "a": F.lit(None).cast("double"), "b": F.lit(None).cast("double"), "m": F.lit(None).cast("long")}
    )
    for stats in _blocks(cluster_stats(df, vec, cluster), "c", "s"):
        per = per.withColumn("e", stats)
        d = F.transform("e", lambda s: F.struct(
            s["c"].alias("c"), s["n"].alias("n"), (F.col("sq") + s["psi"] / s["n"] - F.lit(2.0) * _dot(x, s["s"]) / s["n"]).alias("d")
        ))
        per = per.withColumn("d", d)
        own = F.get(F.filter("d", lambda e: e["c"] == F.col("own")), F.lit(0))
        others = F.array_min(F.transform(F.filter("d", lambda e: e["c"] != F.col("own")), lambda e: e["d"]))
        per = per.withColumns({"a": F.coalesce("a", own["d"]), "m": F.coalesce("m", own["n"]), "b": F.least("b", others)})
    a = F.col("a") * F.col("m") / (F.col("m") - 1)
    s = (
        F.when(F.col("m") <= 1, F.lit(0.0))
        .when(a < F.col("b"), F.lit(1.0) - a / F.col("b"))
        .when(a > F.col("b"), F.col("b") / a - F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    return per.agg(F.avg(s).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def silhouette_mllib(df: DataFrame, vec: str, cluster: str) -> float:
    """M-6 with MLlib's evaluator (same definition)."""
    data = df.select(array_to_vector(_vec(vec)).alias("features"), F.col(cluster).cast("double").alias("prediction"))
    return float(
        ClusteringEvaluator(featuresCol="features", predictionCol="prediction", metricName="silhouette",
                            distanceMeasure="squaredEuclidean").evaluate(data)
    )


def wssse(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """M-8 for a given assignment: sum over clusters of psi_C - |S_C|^2 / n_C (one aggregate
    per cluster, then a sum).  Returns one row (wssse, k)."""
    per = cluster_stats(df, vec, cluster)
    return per.select((F.col("psi") - _dot(F.col("s"), F.col("s")) / F.col("n")).alias("w")).agg(
        F.sum("w").alias("wssse"), F.count(F.lit(1)).alias("k")
    )


def assign_nearest(df: DataFrame, vec: str, centers: DataFrame, out: str = "cluster") -> DataFrame:
    """M-11: nearest of ``centers`` (c, center) by squared Euclidean distance (ties: smaller c),
    with the distance in ``{out}_d2``."""
    x, best, block_col = _vec(vec), f"{out}_best", f"{out}_centers"
    kind = f"struct<d2: double, c: {centers.schema['c'].dataType.simpleString()}>"
    df = df.withColumn(best, F.lit(None).cast(kind))
    for block in _blocks(centers.select("c", "center"), "c", "center"):
        df = df.withColumn(block_col, block)
        scored = F.transform(block_col, lambda e: F.struct(
            F.aggregate(F.zip_with(x, e["center"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t).alias("d2"),
            e["c"].alias("c"),
        ))
        df = df.withColumn(best, F.least(F.col(best), F.array_min(scored)))
    return df.withColumns({out: F.col(best)["c"], f"{out}_d2": F.col(best)["d2"]}).drop(best, block_col)


def centers_from_labels(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """Mean vector per given label: (c, center)."""
    return cluster_stats(df, vec, cluster).select("c", F.transform("s", lambda v: v / F.col("n")).alias("center"))


def fit_facts(pred: DataFrame, vec: str, cluster: str, centers: DataFrame) -> DataFrame:
    """What must hold of a K-Means result, as one row: n_rows, n_clusters, n_not_nearest (rows whose
    cluster's centre is not the nearest one), max_center_gap (largest distance per coordinate
    between a centre and its members' mean) and cost (sum of squared distances to the centres)."""
    near = assign_nearest(pred.select(vec, cluster), vec, centers, "_near")
    rows = near.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(cluster).alias("n_clusters"),
        F.count_if(F.col("_near") != F.col(cluster)).alias("n_not_nearest"), F.sum("_near_d2").alias("cost"),
    )
    means = centers_from_labels(pred, vec, cluster).withColumnRenamed("center", "mean")
    gap = F.array_max(F.zip_with("center", "mean", lambda a, b: F.abs(a - b)))
    gaps = means.join(centers, "c").agg(F.max(gap).alias("g"))
    return rows.withColumn("max_center_gap", gaps.scalar())
