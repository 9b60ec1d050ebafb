"""Ratio KPIs, weighted territory profiles and the KPI report (P-1..P-6, G-1..G-4, G-10, L-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ratio, ratio_of_sums, weighted_mean
from ..sources.tables import require_columns

# Column contract of the territory x sector fact table.
FACT_COLUMNS = dict(
    jobs="emprego_industrial",
    value_added="valor_adicionado_brut",
    wages="massa_salarial",
    energy="consumo_energia_mwh",
    innovation="investimento_inovacao",
    esg="indice_esg",
)

PROFILE_INDICATORS = (
    "produtividade_media_uf",
    "custo_trabalho_medio_uf",
    "intensidade_energetica_uf",
    "taxa_inovacao_uf",
    "indice_esg_uf",
)


def add_ratio_kpis(
    facts: DataFrame,
    jobs: str = FACT_COLUMNS["jobs"],
    value_added: str = FACT_COLUMNS["value_added"],
    wages: str = FACT_COLUMNS["wages"],
    energy: str = FACT_COLUMNS["energy"],
    innovation: str = FACT_COLUMNS["innovation"],
) -> DataFrame:
    """P-1..P-4: productivity, mean labour cost, energy intensity, innovation rate.

    One projection (no chained withColumn); a zero or NULL denominator gives NULL.
    """
    require_columns(facts, jobs, value_added, wages, energy, innovation)
    return facts.withColumns(
        {
            "produtividade_trabalho": ratio(value_added, jobs),
            "custo_medio_trabalho": ratio(wages, jobs),
            "intensidade_energetica": ratio(energy, value_added),
            "taxa_inovacao": ratio(innovation, value_added),
        }
    )


def territory_profile(
    facts: DataFrame,
    key: str = "uf",
    jobs: str = FACT_COLUMNS["jobs"],
    value_added: str = FACT_COLUMNS["value_added"],
    wages: str = FACT_COLUMNS["wages"],
    energy: str = FACT_COLUMNS["energy"],
    innovation: str = FACT_COLUMNS["innovation"],
    esg: str = FACT_COLUMNS["esg"],
    method: str = "ratio_of_sums",
) -> DataFrame:
    """G-1..G-3: one row per ``key`` with totals and weighted indicators.

    ``method="ratio_of_sums"`` computes sum(num)/sum(den) (exact for DECIMAL measures and
    equal to the job/value-added weighted mean of the sector ratios wherever den > 0);
    ``method="weighted_mean"`` evaluates sum(ratio*weight)/sum(weight) literally.
    One hash aggregate: partial per input partition, final after a shuffle on ``key``.
    """
    require_columns(facts, key, jobs, value_added, wages, energy, innovation, esg)
    if method == "ratio_of_sums":
        indicators = [
            ratio_of_sums(value_added, jobs).alias("produtividade_media_uf"),
            ratio_of_sums(wages, jobs).alias("custo_trabalho_medio_uf"),
            ratio_of_sums(energy, value_added).alias("intensidade_energetica_uf"),
            ratio_of_sums(innovation, value_added).alias("taxa_inovacao_uf"),
        ]
    elif method == "weighted_mean":
        indicators = [
            weighted_mean(ratio(value_added, jobs), jobs).alias("produtividade_media_uf"),
            weighted_mean(ratio(wages, jobs), jobs).alias("custo_trabalho_medio_uf"),
            weighted_mean(ratio(energy, value_added), value_added).alias("intensidade_energetica_uf"),
            weighted_mean(ratio(innovation, value_added), value_added).alias("taxa_inovacao_uf"),
        ]
    else:
        raise ValueError(f"unknown method {method!r}")
    return facts.groupBy(key).agg(
        F.sum(jobs).cast("long").alias("total_emprego"),
        F.sum(value_added).cast("double").alias("total_valor_adicionado"),
        *indicators,
        F.avg(F.col(esg).cast("double")).alias("indice_esg_uf"),
    )


def kpi_report(profile: DataFrame, key: str = "uf") -> DataFrame:
    """P-5 + L-1: business-facing projection with rounding, sorted by output (desc)."""
    require_columns(profile, key, "total_emprego", "total_valor_adicionado", *PROFILE_INDICATORS)
    return profile.select(
        F.col(key).alias("UF"),
        F.round(F.col("total_emprego"), 0).cast("long").alias("Emprego_Industrial"),
        F.round(F.col("total_valor_adicionado") / F.lit(1_000_000.0), 2).alias("PIB_Industrial_Milhoes"),
        F.round("produtividade_media_uf", 2).alias("Produtividade_R_por_Trabalhador"),
        F.round("custo_trabalho_medio_uf", 2).alias("Salario_Medio"),
        F.round(F.col("taxa_inovacao_uf") * F.lit(100.0), 2).alias("Inovacao_Pct_VA"),
        F.round("indice_esg_uf", 1).alias("Score_ESG"),
    ).orderBy(F.desc("PIB_Industrial_Milhoes"), F.asc("UF"))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def group_means(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """G-10: mean of every numeric column per ``key`` (NULLs ignored), names kept."""
    require_columns(df, key)
    cols = list(columns) if columns is not None else numeric_columns(df, exclude=[key])
    return df.groupBy(key).agg(*[_mean(df, c).alias(c) for c in cols])


def _mean(df: DataFrame, c: str):
    """Mean as double; DECIMAL inputs are averaged exactly before the conversion."""
    if isinstance(df.schema[c].dataType, T.DecimalType):
        return F.avg(c).cast("double")
    return F.avg(F.col(c).cast("double"))


def cluster_profile(df: DataFrame, cluster_col: str, indicators: Sequence[str]) -> DataFrame:
    """G-4 + L-2: per-cluster means of ``indicators`` ordered by cluster id."""
    require_columns(df, cluster_col, *indicators)
    return (
        df.groupBy(cluster_col)
        .agg(F.count(F.lit(1)).alias("n_members"), *[F.avg(F.col(c).cast("double")).alias(c) for c in indicators])
        .orderBy(cluster_col)
    )


def top_n(df: DataFrame, n: int, *order: str | F.Column) -> DataFrame:
    """L-4: first ``n`` rows under a total order (TakeOrderedAndProject, no global sort)."""
    return df.orderBy(*order).limit(n)
