"""Global and local spatial autocorrelation (G-12, G-13, G-18, X-2..X-8, P-11..P-13).

Inputs are a value table ``(id, value)`` and a weights edge list ``(src, dst, w)``;
values and weights are always joined by id, never aligned by position.
Only one-row scalars (n, mean, sums) travel to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null, normal_two_sided_p
from ..functions.permutation import broadcast_if_small, dense_index, permuted_position, permuted_rows, pseudo_p, round_keys, rows_of, spread_for_fanout
from ..session import stage
from ..sources.tables import require_columns
from .weights import row_standardize, spatial_lag

# Label texts of the original project (quadrant code -> label, pattern texts).
LISA_LABELS = {
    0: "Não Significativo",
    1: "High-High (Hotspot)",
    2: "Low-High (Outlier Espacial)",
    3: "Low-Low (Coldspot)",
    4: "High-Low (Outlier Espacial)",
}
PATTERN_CLUSTERED = "Agrupamento Espacial Significativo (Clustering)"
PATTERN_DISPERSED = "Dispersão Espacial Significativa"
PATTERN_RANDOM = "Distribuição Espacial Aleatória (Sem Autocorrelação)"


def _label_expr(q) -> F.Column:
    m = F.create_map(*[x for kv in LISA_LABELS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.element_at(m, q), F.lit(LISA_LABELS[0]))


def impute_mean(values: DataFrame, value: str = "value") -> tuple[DataFrame, int, float]:
    """G-12: NaN and NULL replaced by the mean of the present values.

    Returns (frame, n, mean); the mean is one distributed aggregate brought back as a scalar.
    """
    require_columns(values, value)
    r = values.agg(F.count(F.lit(1)).alias("n"), F.avg(nan_to_null(value)).alias("m")).first()
    n, mean = int(r["n"]), float(r["m"]) if r["m"] is not None else 0.0
    return values.withColumn(value, F.coalesce(nan_to_null(value), F.lit(mean))), n, mean


def centered(values: DataFrame, id_col: str = "id", value: str = "value") -> tuple[DataFrame, int, float]:
    """(id, y, z = y - mean), written once, plus n and sum(z^2)."""
    values = stage(values.select(F.col(id_col).alias("id"), F.col(value).alias("y")), "values")
    imp, n, mean = impute_mean(values, "y")
    z = imp.select("id", "y", (F.col("y") - F.lit(mean)).alias("z"))
    zz = z.agg(F.sum(F.col("z") * F.col("z"))).first()[0] or 0.0
    return z, n, float(zz)


def zscore(values: DataFrame, id_col: str = "id", value: str = "value") -> DataFrame:
    """G-13: population z-score (std with ddof 0)."""
    imp, n, mean = impute_mean(values.select(id_col, value), value)
    sd = imp.agg(F.stddev_pop(value)).first()[0] or 0.0
    return imp.select(F.col(id_col).alias("id"), F.try_divide(F.col(value) - F.lit(mean), F.lit(sd)).alias("z"))


def weight_sums(w: DataFrame) -> tuple[float, float, float]:
    """S0 = sum w, S1 = 1/2 sum (w_ij + w_ji)^2, S2 = sum_i (w_i. + w_.i)^2.

    S1 groups the weights by unordered pair (a pair's sum counts for both directions); S2
    groups each weight under both of its ends.  No self-join.
    """
    pair = w.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("s"))
    # a self weight stands for itself: (w_ii + w_ii)^2 / 2
    s1 = pair.agg(
        F.sum("s").alias("s0"), F.sum(F.col("s") * F.col("s") * F.when(F.col("a") == F.col("b"), 2.0).otherwise(1.0)).alias("s1")
    ).first()
    ends = w.select(F.explode(F.array("src", "dst")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("t"))
    s2 = ends.agg(F.sum(F.col("t") * F.col("t"))).first()[0]
    return float(s1["s0"] or 0.0), float(s1["s1"] or 0.0), float(s2 or 0.0)


def _prepare_w(w: DataFrame, transform: str) -> DataFrame:
    w = w.select("src", "dst", *(["w"] if "w" in w.columns else []))
    if transform.lower() == "r":
        return row_standardize(w)
    if "w" not in w.columns:
        w = w.withColumn("w", F.lit(1.0))
    return w


def moran(
    values: DataFrame,
    w: DataFrame,
    id_col: str = "id",
    value: str = "value",
    permutations: int = 999,
    seed: int = 123,
    transform: str = "r",
) -> DataFrame:
    """X-2..X-4, G-19, P-13: global Moran's I with analytic and permutation inference.

    One-row result: variable, n, moran_i, expected_i, z_norm, p_norm, p_value (pseudo p),
    z_score (z_sim), mean_sim, std_sim, pattern, permutations, s0, s1, s2.
    Permutation p gives the value of the id at position r (in id order) to that at position
    pi_p(r), a keyed bijection (see ``global_permutations``).  A constant variable has no
    I: moran_i, z and p are NaN or NULL and the pattern is the random one.
    """
    w = stage(_prepare_w(w, transform), "weights")
    z, n, zz = centered(values, id_col, value)
    s0, s1, s2 = weight_sums(w)
    lagged = spatial_lag(w, z.select("id", "z"), "id", "z", "lag")
    num = lagged.agg(F.sum(F.col("z") * F.col("lag"))).first()[0] or 0.0
    i_obs = (n / s0) * num / zz if s0 and zz else float("nan")
    ei = -1.0 / (n - 1) if n > 1 else float("nan")
    vi = (n * n * s1 - n * s2 + 3.0 * s0 * s0) / ((n * n - 1.0) * s0 * s0) - ei * ei if n > 1 and s0 else float("nan")
    z_norm = (i_obs - ei) / math.sqrt(vi) if vi and vi > 0 else float("nan")

    spark = values.sparkSession
    base = spark.range(1).select(
        F.lit(value).alias("variable"),
        F.lit(n).cast("long").alias("n"),
        F.lit(i_obs).alias("moran_i"),
        F.lit(ei).alias("expected_i"),
        F.lit(z_norm).alias("z_norm"),
        normal_two_sided_p(F.lit(z_norm)).alias("p_norm"),
        F.lit(s0).alias("s0"),
        F.lit(s1).alias("s1"),
        F.lit(s2).alias("s2"),
        F.lit(permutations).alias("permutations"),
    )
    if permutations <= 0:
        return base.withColumns(
            {
                "p_value": F.lit(None).cast("double"),
                "z_score": F.lit(None).cast("double"),
                "mean_sim": F.lit(None).cast("double"),
                "std_sim": F.lit(None).cast("double"),
                "pattern": F.lit(PATTERN_RANDOM),
            }
        )
    sims = global_permutations(z, w, n, zz, s0, permutations, seed) if zz and s0 else None
    agg = sims.agg(
        F.sum(F.when(F.col("i_sim") >= F.lit(i_obs), 1).otherwise(0)).alias("n_ge"),
        F.avg("i_sim").alias("mean_sim"),
        F.stddev_pop("i_sim").alias("std_sim"),
    ).first() if sims else {"n_ge": None, "mean_sim": None, "std_sim": None}
    p_sim = z_sim = None
    pattern = PATTERN_RANDOM
    if agg["n_ge"] is not None:
        p_sim = (min(agg["n_ge"], permutations - agg["n_ge"]) + 1.0) / (permutations + 1.0)
        z_sim = (i_obs - agg["mean_sim"]) / agg["std_sim"] if agg["std_sim"] else float("nan")
        if p_sim < 0.05:
            pattern = PATTERN_CLUSTERED if i_obs > ei else PATTERN_DISPERSED
    return base.withColumns(
        {
            "p_value": F.lit(p_sim).cast("double"),
            "z_score": F.lit(z_sim).cast("double"),
            "mean_sim": F.lit(agg["mean_sim"]).cast("double"),
            "std_sim": F.lit(agg["std_sim"]).cast("double"),
            "pattern": F.lit(pattern),
        }
    )


def _perm_keys(spark, permutations: int, seed: int, n: int) -> DataFrame:
    """(perm, keys): the round keys of every permutation of 0..n-1, ``permutations`` rows."""
    perms = spark.range(permutations).select(F.col("id").cast("int").alias("perm"))
    return stage(round_keys(perms, seed, n), "perm_keys")


IMAGES_A_PART = 2_000_000
"""Permuted values that a task sorts by position."""


def global_permutations(z: DataFrame, w: DataFrame, n: int, zz: float, s0: float, permutations: int, seed: int) -> DataFrame:
    """X-3: one simulated I per permutation, ``(perm, i_sim)``.

    Permutation p gives the value of the id at position r (in id order) to the id at position
    pi_p(r), a keyed bijection computed for blocks of positions at once: no sort of the values.  Those that a position gets
    under all permutations meet in one array (n x P small rows shuffled once, into parts of about IMAGES_A_PART; arrays of
    length P, read off the sorted rows); a weight then multiplies the arrays of its two ends, and the products are summed per
    permutation, first within each task.
    """
    idx = stage(dense_index(z.select("id", "z"), "id", out="pos"), "positions")
    keys = _perm_keys(z.sparkSession, permutations, seed, n).orderBy("perm").collect()  # one row a permutation
    reps = spread_for_fanout(idx.select("pos", "z"), n, permutations).mapInPandas(permuted_rows(keys, n), "place bigint, z double")
    parts = max(z.sparkSession.sparkContext.defaultParallelism, -(-n * permutations // IMAGES_A_PART))
    # one number to sort by: position and permutation at once
    dealt = reps.repartition(parts, F.expr(f"place div {permutations}")).sortWithinPartitions("place")
    given = dealt.mapInPandas(rows_of(permutations), "pos bigint, v array<double>")
    given = stage(idx.select("id", "pos").join(given, "pos").select("id", "v"), "permuted")
    ends = w.join(given.select(F.col("id").alias("src"), F.col("v").alias("a")), "src").join(
        given.select(F.col("id").alias("dst"), F.col("v").alias("b")), "dst"
    )
    products = ends.select(F.posexplode(F.zip_with("a", "b", lambda x, y: x * y * F.col("w"))).alias("perm", "x"))
    return products.groupBy("perm").agg((F.lit(n / s0 / zz) * F.sum("x")).alias("i_sim"))


def local_moran(values: DataFrame, w: DataFrame, id_col: str = "id", value: str = "value", transform: str = "r") -> DataFrame:
    """X-5 + P-12: I_i = (n-1) z_i lag_i / sum z^2 and the Moran quadrant.

    Quadrant: 1 HH (z>0, lag>0), 2 LH, 3 LL, 4 HL (zero counts as low).  NULL statistic for a
    constant variable.
    """
    z, n, zz = centered(values, id_col, value)
    return _local(z, n, zz, _prepare_w(w, transform))


def _local(z: DataFrame, n: int, zz: float, w: DataFrame) -> DataFrame:
    lagged = spatial_lag(w, z, "id", "z", "lag")
    hi_z, hi_l = F.col("z") > 0, F.col("lag") > 0
    quad = (
        F.when(hi_z & hi_l, 1).when(~hi_z & hi_l, 2).when(~hi_z & ~hi_l, 3).otherwise(4)
    )
    return lagged.select(
        "id", "y", "z", "lag",
        F.try_divide(F.lit(float(n - 1)) * F.col("z") * F.col("lag"), F.lit(zz)).alias("lisa_i"),
        quad.alias("quadrant"),
    )


def lisa(
    values: DataFrame,
    w: DataFrame,
    id_col: str = "id",
    value: str = "value",
    permutations: int = 999,
    seed: int = 123,
    p_threshold: float = 0.05,
    transform: str = "r",
) -> DataFrame:
    """X-6, X-7, P-11, J-8: local Moran with conditional permutation inference.

    For every (i, perm) the value of i stays and card(i) other ids are drawn without
    replacement: draw r is the image of r under the permutation's keyed bijection of the
    positions 0..n-2, those from pos(i) on shifted by one.  The draws of a permutation are
    shared by all i: one table of max(card) rows holds for every r, as an array over the permutations, the
    position drawn and the values there and at the next position.  A weight reads its row of that table
    (broadcast: at most DRAWN_BYTES) and takes the one or the other value, so |W| rows are dealt out by id once
    and nothing of |W| x P rows is shuffled.  Ids with more neighbours than the broadcast part has rows are
    summed up by a join on r and a shuffle instead.  Ids without neighbours have no distribution: NULL p, quadrant 0.
    Output: id, y, z, lag, lisa_i, quadrant, n_ge, lisa_p_value, lisa_quad, lisa_label.
    """
    w = stage(_prepare_w(w, transform), "weights")
    z, n, zz = centered(values, id_col, value)
    loc = stage(_local(z, n, zz, w), "local")
    idx = stage(dense_index(z.select("id", "z"), "id", out="pos"), "positions")
    cards = w.groupBy("src").agg(F.count(F.lit(1)).alias("card"))
    nbr = w.select("src", "w", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).alias("r"))
    own = idx.select(F.col("id").alias("src"), "pos").join(loc.select(F.col("id").alias("src"), "z", "lisa_i"), "src").join(cards, "src")
    base = stage(nbr.join(own, "src"), "draw_rows")
    most = int(base.agg(F.max("r")).first()[0] or 0)
    table = stage(_drawn_values(idx, n, permutations, seed, most), "drawn_values")
    held = max(1, DRAWN_BYTES // (24 * max(permutations, 1)))
    mine = F.transform("drawn", lambda x: F.col("w") * F.when(x["q"] >= F.col("pos"), x["z1"]).otherwise(x["z0"]))
    factor = F.lit(float(n - 1)) * F.col("z")
    few = spread_for_fanout(base.where(F.col("card") <= held), base.count(), permutations)
    few = few.repartition(max(few.rdd.getNumPartitions(), 1), "src").join(F.broadcast(table.where(F.col("r") < held)), "r")
    lists = few.select("src", "z", "lisa_i", mine.alias("t")).groupBy("src", "z", "lisa_i").agg(F.collect_list("t").alias("ts"))  # <= held arrays
    sums = F.aggregate("ts", F.array_repeat(F.lit(0.0), permutations), lambda s, t: F.zip_with(s, t, lambda a, b: a + b))
    reached = F.filter(F.transform(sums, lambda x: F.try_divide(factor * x, F.lit(zz))), lambda x: x >= F.col("lisa_i"))
    counts = lists.select(F.col("src").alias("id"), F.size(reached).cast("long").alias("n_ge"))
    if most >= held:
        many = base.where(F.col("card") > held).join(table, "r").select("src", "z", "lisa_i", F.posexplode(mine).alias("perm", "t"))
        many = many.groupBy("src", "z", "lisa_i", "perm").agg(F.try_divide(factor * F.sum("t"), F.lit(zz)).alias("i_sim"))
        counts = counts.union(many.groupBy(F.col("src").alias("id")).agg(F.count_if(F.col("i_sim") >= F.col("lisa_i")).alias("n_ge")))
    out = loc.join(counts, "id", "left")
    out = out.withColumn("lisa_p_value", F.when(F.col("lisa_i").isNotNull(), pseudo_p(F.col("n_ge"), permutations)))
    sig_q = F.when(F.col("lisa_p_value") < F.lit(p_threshold), F.col("quadrant")).otherwise(F.lit(0))
    return out.withColumn("lisa_quad", sig_q).withColumn("lisa_label", _label_expr(F.col("lisa_quad")))


DRAWN_BYTES = 16 * 1024 * 1024
"""Size of the part of the draw table that is broadcast (24 bytes a draw and permutation)."""


def _drawn_values(idx: DataFrame, n: int, permutations: int, seed: int, most: int) -> DataFrame:
    """(r, drawn) for r = 0..most: an array over the permutations of the position q drawn and the values of the ids
    at q and at q + 1."""
    draws = spread_for_fanout(_perm_keys(idx.sparkSession, permutations, seed, max(n - 1, 1)), permutations, most + 1)
    q = permuted_position(F.col("r"), max(n - 1, 1), F.col("keys"))
    draws = draws.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(most)))).select("perm", "r", q.alias("q"))
    here = idx.select(F.col("pos").alias("q"), F.col("z").alias("z0"))
    after = idx.select((F.col("pos") - 1).alias("q"), F.col("z").alias("z1"))
    pairs = stage(here.join(after, "q", "left"), "neighbours")
    valued = draws.join(broadcast_if_small(pairs), "q")
    rows = valued.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("perm", "q", "z0", "z1"))).alias("x"))  # one a permutation
    return rows.select("r", F.transform("x", lambda x: F.struct(x["q"].alias("q"), x["z0"].alias("z0"), x["z1"].alias("z1"))).alias("drawn"))


def label_counts(lisa_df: DataFrame, label: str = "lisa_label") -> DataFrame:
    """G-11: observations per LISA label, most frequent first."""
    return lisa_df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(label))


def moran_scatter(values: DataFrame, w: DataFrame, id_col: str = "id", value: str = "value", transform: str = "r") -> DataFrame:
    """X-8, G-13, G-18: standardised value, lag of it, fitted line and quadrant per id.

    The least-squares slope of lag on z equals Moran's I for row-standardised W.
    """
    w = _prepare_w(w, transform)
    zs = zscore(values, id_col, value)
    lagged = spatial_lag(w, zs, "id", "z", "lag")
    fit = lagged.agg(F.regr_slope("lag", "z").alias("slope"), F.regr_intercept("lag", "z").alias("intercept")).first()
    hi_z, hi_l = F.col("z") > 0, F.col("lag") > 0
    quad = F.when(hi_z & hi_l, 1).when(~hi_z & hi_l, 2).when(~hi_z & ~hi_l, 3).otherwise(4)
    return lagged.select(
        "id", "z", "lag",
        F.lit(fit["slope"]).alias("slope"),
        F.lit(fit["intercept"]).alias("intercept"),
        (F.lit(fit["intercept"]) + F.lit(fit["slope"]) * F.col("z")).alias("fitted"),
        quad.alias("quadrant"),
    )
