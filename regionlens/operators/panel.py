"""Panel features per territory (G-5..G-9, W-2).

The consumer contract (avg_growth_rate, volatility_index, avg_salary_nominal,
productivity_proxy, diversification_index) has no producer in the original
project; the definitions below are ours:

* avg_growth_rate       mean over years of (jobs_y - jobs_{y-1}) / jobs_{y-1}
* volatility_index      sample std-dev of month-on-month job growth (none across a missing month)
* avg_salary_nominal    mean of the nominal mean wage over all panel cells
* productivity_proxy    sum(wage mass) / sum(jobs)
* diversification_index 1 - sum_s share_s^2 (Herfindahl complement of sector job shares)

Windows are partitioned by territory over one row per period, so a window group holds
the length of the time axis, never the raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from ..sources.tables import require_columns

PANEL_FEATURES = (
    "avg_growth_rate",
    "volatility_index",
    "avg_salary_nominal",
    "productivity_proxy",
    "diversification_index",
)


def period_index(period: list[str], months: int = 12) -> F.Column:
    """A number that grows by one from period to period: the year, or year x 12 + month."""
    if len(period) == 1:
        return F.col(period[0]).cast("long")
    if len(period) != 2:
        raise ValueError("a period is a year, or a year and a month")
    return F.col(period[0]).cast("long") * months + F.col(period[1]).cast("long") - 1


def calendar(totals: DataFrame, keys: list[str], period: list[str], value: str, months: int = 12) -> DataFrame:
    """``totals`` (one row per key and period) with a row for every period from a key's first to its last:
    keys, period, ``value`` (NULL in a period without a row), ``filled`` (the last known value as of then).

    Rows with a NULL in the period are left out.  A key's rows are as many as its time axis is long.
    """
    require_columns(totals, *keys, *period, value)
    known = totals.withColumn("_t", period_index(period, months)).where(F.col("_t").isNotNull())
    span = known.groupBy(*keys).agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"))
    every = span.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.explode(F.sequence("_a", "_b")).alias("_at"))
    same = F.col("_at") == F.col("_t")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    dense = every.join(known.select(*keys, "_t", value), same, "left")
    named = [F.col("_at").cast("int")] if len(period) == 1 else [F.floor(F.col("_at") / months).cast("int"), (F.pmod("_at", F.lit(months)) + 1).cast("int")]
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_at")
    return dense.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *[x.alias(p) for x, p in zip(named, period, strict=True)], value,
        F.last(value, ignorenulls=True).over(w).alias("filled"),
    )


def period_growth(panel: DataFrame, key: str | list[str], period: list[str], jobs: str, gaps: str = "null") -> DataFrame:
    """W-2: totals per (key, period) and relative change against the period before.

    Where that has no row, ``gaps`` decides: "null" gives NULL, "step" takes the last period that has a row (a
    change over several periods), "fill" adds the missing periods with the last known total (no change in them).
    """
    keys = [key] if isinstance(key, str) else list(key)
    totals = panel.groupBy(*keys, *period).agg(F.sum(jobs).alias("jobs"))
    if gaps == "fill":
        totals = calendar(totals, keys, period, "jobs").select(*keys, *period, F.col("filled").alias("jobs"))
    elif gaps not in ("null", "step"):
        raise ValueError(f"unknown treatment of gaps {gaps!r}")
    w = Window.partitionBy(*keys).orderBy(*period)
    prev = F.lag("jobs", 1).over(w)
    if gaps == "null":
        prev = F.when(period_index(period) - F.lag(period_index(period), 1).over(w) == 1, prev)
    return totals.withColumn("growth", F.try_divide((F.col("jobs") - prev).cast("double"), prev.cast("double")))


def avg_growth_rate(panel: DataFrame, key="uf", year="ano", jobs="empregos", gaps="null") -> DataFrame:
    """G-5."""
    require_columns(panel, key, year, jobs)
    return period_growth(panel, key, [year], jobs, gaps).groupBy(key).agg(F.avg("growth").alias("avg_growth_rate"))


def volatility_index(panel: DataFrame, key="uf", year="ano", month="mes", jobs="empregos", gaps="null") -> DataFrame:
    """G-6."""
    require_columns(panel, key, year, month, jobs)
    return (
        period_growth(panel, key, [year, month], jobs, gaps)
        .groupBy(key)
        .agg(F.stddev_samp("growth").alias("volatility_index"))
    )


def level_features(panel: DataFrame, key="uf", jobs="empregos", wages="massa_salarial", mean_wage="salario_medio_nominal") -> DataFrame:
    """G-7, G-8 in one aggregate."""
    require_columns(panel, key, jobs, wages, mean_wage)
    return panel.groupBy(key).agg(
        F.avg(F.col(mean_wage).cast("double")).alias("avg_salary_nominal"),
        F.try_divide(F.sum(wages).cast("double"), F.sum(jobs).cast("double")).alias("productivity_proxy"),
    )


def diversification_index(panel: DataFrame, key="uf", sector="setor", jobs="empregos") -> DataFrame:
    """G-9: two-level aggregate (sector totals, then shares) — no window over raw rows."""
    require_columns(panel, key, sector, jobs)
    by_sector = panel.groupBy(key, sector).agg(F.sum(jobs).cast("double").alias("j"))
    totals = by_sector.groupBy(key).agg(F.sum("j").alias("t"), F.sum(F.col("j") * F.col("j")).alias("jj"))
    return totals.select(key, (F.lit(1.0) - F.try_divide(F.col("jj"), F.col("t") * F.col("t"))).alias("diversification_index"))


def territory_features(panel: DataFrame, key="uf", year="ano", month="mes", sector="setor",
                       jobs="empregos", wages="massa_salarial", mean_wage="salario_medio_nominal", gaps="null") -> DataFrame:
    """F4 contract: one row per territory with the five panel features; ``gaps`` as in ``period_growth``.

    The panel (one row per territory, period and sector) is written once and read by all five.
    They aggregate to one row per territory, so the joins are between territory-sized frames
    (co-partitioned on ``key`` after their aggregations).
    """
    panel = stage(panel, "panel")
    parts = [
        avg_growth_rate(panel, key, year, jobs, gaps),
        volatility_index(panel, key, year, month, jobs, gaps),
        level_features(panel, key, jobs, wages, mean_wage),
        diversification_index(panel, key, sector, jobs),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key, "full_outer")
    return out.select(key, *PANEL_FEATURES)
