"""Registered queries (Spark) and their DuckDB oracle SQL.

Every query reads the raw tables under ``base`` and derives its input with the plans in
``stand_ins``; doubles are rounded to 6 places on both sides for a stable comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import kpi
from ..session import stage
from . import stand_ins as si

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return deco


# ---------------------------------------------------------------- SQL building blocks
SQL_FACTS = """
SELECT n.n_name AS uf, p.p_type AS setor,
       CAST(sum(l.l_quantity) AS BIGINT) AS emprego_industrial,
       sum(CAST(l.l_extendedprice AS DECIMAL(12,2))) AS valor_adicionado_brut,
       sum(CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_discount AS DECIMAL(4,2))) AS massa_salarial,
       sum(CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_tax AS DECIMAL(4,2))) AS consumo_energia_mwh,
       sum(CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_discount AS DECIMAL(4,2)) * CAST(l.l_tax AS DECIMAL(4,2))) AS investimento_inovacao,
       CAST(sum(p.p_size) AS DOUBLE) / count(*) AS indice_esg
FROM lineitem l
JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
GROUP BY n.n_name, p.p_type
"""

SQL_PROFILE = f"""
SELECT uf,
       CAST(sum(emprego_industrial) AS BIGINT) AS total_emprego,
       CAST(sum(valor_adicionado_brut) AS DOUBLE) AS total_valor_adicionado,
       CAST(sum(valor_adicionado_brut) AS DOUBLE) / CAST(sum(emprego_industrial) AS DOUBLE) AS produtividade_media_uf,
       CAST(sum(massa_salarial) AS DOUBLE) / CAST(sum(emprego_industrial) AS DOUBLE) AS custo_trabalho_medio_uf,
       CAST(sum(consumo_energia_mwh) AS DOUBLE) / CAST(sum(valor_adicionado_brut) AS DOUBLE) AS intensidade_energetica_uf,
       CAST(sum(investimento_inovacao) AS DOUBLE) / CAST(sum(valor_adicionado_brut) AS DOUBLE) AS taxa_inovacao_uf,
       avg(indice_esg) AS indice_esg_uf
FROM ({SQL_FACTS}) f
GROUP BY uf
"""


def _r6(cols: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


# ---------------------------------------------------------------- tabular layer
def _facts_with_ratios(spark, base):
    return kpi.add_ratio_kpis(si.sector_facts(spark, base))


@register(
    "kpi_sector_facts",
    f"""
SELECT uf, setor, emprego_industrial,
       round(CAST(valor_adicionado_brut AS DOUBLE), 6) AS valor_adicionado_brut,
       round(CAST(massa_salarial AS DOUBLE), 6) AS massa_salarial,
       round(CAST(consumo_energia_mwh AS DOUBLE), 6) AS consumo_energia_mwh,
       round(CAST(investimento_inovacao AS DOUBLE), 6) AS investimento_inovacao,
       round(indice_esg, 6) AS indice_esg,
       round(CAST(valor_adicionado_brut AS DOUBLE) / CAST(emprego_industrial AS DOUBLE), 6) AS produtividade_trabalho,
       round(CAST(massa_salarial AS DOUBLE) / CAST(emprego_industrial AS DOUBLE), 6) AS custo_medio_trabalho,
       round(CAST(consumo_energia_mwh AS DOUBLE) / CAST(valor_adicionado_brut AS DOUBLE), 6) AS intensidade_energetica,
       round(CAST(investimento_inovacao AS DOUBLE) / CAST(valor_adicionado_brut AS DOUBLE), 6) AS taxa_inovacao
FROM ({SQL_FACTS}) f
""",
)
def q_kpi_sector_facts(spark, base):
    df = _facts_with_ratios(spark, base)
    measures = ["valor_adicionado_brut", "massa_salarial", "consumo_energia_mwh", "investimento_inovacao"]
    return round_doubles(df.withColumns({m: F.col(m).cast("double") for m in measures}))


@register(
    "kpi_territory_profile",
    f"""
SELECT uf, total_emprego, {_r6(['total_valor_adicionado', 'produtividade_media_uf', 'custo_trabalho_medio_uf',
                               'intensidade_energetica_uf', 'taxa_inovacao_uf', 'indice_esg_uf'])}
FROM ({SQL_PROFILE}) p
""",
)
def q_kpi_territory_profile(spark, base):
    return round_doubles(kpi.territory_profile(si.sector_facts(spark, base)))


@register(
    "kpi_weighted_mean",
    f"""
SELECT uf,
       round(sum(prod * w_jobs) / sum(w_jobs), 6) AS produtividade_media_uf,
       round(sum(cost * w_jobs) / sum(w_jobs), 6) AS custo_trabalho_medio_uf,
       round(sum(energy * w_va) / sum(w_va), 6) AS intensidade_energetica_uf,
       round(sum(innov * w_va) / sum(w_va), 6) AS taxa_inovacao_uf
FROM (SELECT uf,
             CAST(emprego_industrial AS DOUBLE) AS w_jobs, CAST(valor_adicionado_brut AS DOUBLE) AS w_va,
             CAST(valor_adicionado_brut AS DOUBLE) / CAST(emprego_industrial AS DOUBLE) AS prod,
             CAST(massa_salarial AS DOUBLE) / CAST(emprego_industrial AS DOUBLE) AS cost,
             CAST(consumo_energia_mwh AS DOUBLE) / CAST(valor_adicionado_brut AS DOUBLE) AS energy,
             CAST(investimento_inovacao AS DOUBLE) / CAST(valor_adicionado_brut AS DOUBLE) AS innov
      FROM ({SQL_FACTS}) f) r
GROUP BY uf
""",
)
def q_kpi_weighted_mean(spark, base):
    """G-2 in its literal weighted form (sum(ratio*weight)/sum(weight)), rounded to 6 places."""
    prof = kpi.territory_profile(si.sector_facts(spark, base), method="weighted_mean")
    return round_doubles(
        prof.select("uf", "produtividade_media_uf", "custo_trabalho_medio_uf", "intensidade_energetica_uf", "taxa_inovacao_uf")
    )


@register(
    "kpi_report",
    f"""
SELECT uf AS UF,
       CAST(round(total_emprego, 0) AS BIGINT) AS Emprego_Industrial,
       round(total_valor_adicionado / 1000000.0, 2) AS PIB_Industrial_Milhoes,
       round(produtividade_media_uf, 2) AS Produtividade_R_por_Trabalhador,
       round(custo_trabalho_medio_uf, 2) AS Salario_Medio,
       round(taxa_inovacao_uf * 100.0, 2) AS Inovacao_Pct_VA,
       round(indice_esg_uf, 1) AS Score_ESG
FROM ({SQL_PROFILE}) p
ORDER BY PIB_Industrial_Milhoes DESC, UF
""",
)
def q_kpi_report(spark, base):
    return kpi.kpi_report(kpi.territory_profile(si.sector_facts(spark, base)))


@register(
    "kpi_top_territories",
    f"""
SELECT uf, total_emprego, round(total_valor_adicionado, 6) AS total_valor_adicionado
FROM ({SQL_PROFILE}) p
ORDER BY total_valor_adicionado DESC, uf
LIMIT 5
""",
)
def q_kpi_top_territories(spark, base):
    """L-4: the five territories with the largest output (a top-k report; the limit is the feature)."""
    prof = kpi.territory_profile(si.sector_facts(spark, base))
    return round_doubles(
        kpi.top_n(prof.select("uf", "total_emprego", "total_valor_adicionado"), 5, F.desc("total_valor_adicionado"), "uf")
    )


@register(
    "kpi_sector_means",
    f"""
SELECT setor,
       round(avg(CAST(emprego_industrial AS DOUBLE)), 6) AS emprego_industrial,
       round(CAST(avg(valor_adicionado_brut) AS DOUBLE), 6) AS valor_adicionado_brut,
       round(CAST(avg(massa_salarial) AS DOUBLE), 6) AS massa_salarial,
       round(CAST(avg(consumo_energia_mwh) AS DOUBLE), 6) AS consumo_energia_mwh,
       round(CAST(avg(investimento_inovacao) AS DOUBLE), 6) AS investimento_inovacao,
       round(avg(indice_esg), 6) AS indice_esg
FROM ({SQL_FACTS}) f
GROUP BY setor
""",
)
def q_kpi_sector_means(spark, base):
    """G-10: per-sector mean of every numeric fact column."""
    return round_doubles(kpi.group_means(si.sector_facts(spark, base), "setor"))


# ---------------------------------------------------------------- panel features
from ..operators import panel as pnl  # noqa: E402

SQL_PANEL = """
SELECT n.n_name AS uf, CAST(year(o.o_orderdate) AS INTEGER) AS ano, CAST(month(o.o_orderdate) AS INTEGER) AS mes, o.o_orderpriority AS setor,
       count(*) AS empregos,
       sum(CAST(o.o_totalprice AS DECIMAL(12,2))) AS massa_salarial,
       CAST(sum(CAST(o.o_totalprice AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS salario_medio_nominal
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY 1, 2, 3, 4
"""

SQL_GROWTH_Y = f"""
SELECT uf, avg(g) AS avg_growth_rate FROM (
  SELECT uf, CASE WHEN ano - lag(ano) OVER (PARTITION BY uf ORDER BY ano) = 1
                  THEN (j - lag(j) OVER (PARTITION BY uf ORDER BY ano)) / CAST(lag(j) OVER (PARTITION BY uf ORDER BY ano) AS DOUBLE) END AS g
  FROM (SELECT uf, ano, sum(empregos) AS j FROM ({SQL_PANEL}) p GROUP BY uf, ano) t) s
GROUP BY uf
"""

SQL_VOL = f"""
SELECT uf, stddev_samp(g) AS volatility_index FROM (
  SELECT uf, CASE WHEN ano * 12 + mes - lag(ano * 12 + mes) OVER w = 1 THEN (j - lag(j) OVER w) / CAST(lag(j) OVER w AS DOUBLE) END AS g
  FROM (SELECT uf, ano, mes, sum(empregos) AS j FROM ({SQL_PANEL}) p GROUP BY uf, ano, mes) t
  WINDOW w AS (PARTITION BY uf ORDER BY ano, mes)) s
GROUP BY uf
"""

SQL_LEVELS = f"""
SELECT uf, avg(salario_medio_nominal) AS avg_salary_nominal,
       CAST(sum(massa_salarial) AS DOUBLE) / CAST(sum(empregos) AS DOUBLE) AS productivity_proxy
FROM ({SQL_PANEL}) p GROUP BY uf
"""

SQL_DIVERS = f"""
SELECT uf, 1.0 - sum(share * share) AS diversification_index FROM (
  SELECT uf, CAST(j AS DOUBLE) / sum(j) OVER (PARTITION BY uf) AS share
  FROM (SELECT uf, setor, sum(empregos) AS j FROM ({SQL_PANEL}) p GROUP BY uf, setor) t) s
GROUP BY uf
"""


@register(
    "panel_monthly",
    f"""
SELECT uf, ano, mes, setor, empregos, round(CAST(massa_salarial AS DOUBLE), 6) AS massa_salarial,
       round(salario_medio_nominal, 6) AS salario_medio_nominal
FROM ({SQL_PANEL}) p
""",
)
def q_panel_monthly(spark, base):
    p = si.labour_panel(spark, base)
    return round_doubles(p.withColumn("massa_salarial", F.col("massa_salarial").cast("double")))


@register("panel_growth_rate", f"SELECT uf, round(avg_growth_rate, 6) AS avg_growth_rate FROM ({SQL_GROWTH_Y}) x")
def q_panel_growth_rate(spark, base):
    return round_doubles(pnl.avg_growth_rate(si.labour_panel(spark, base)))


@register("panel_volatility", f"SELECT uf, round(volatility_index, 6) AS volatility_index FROM ({SQL_VOL}) x")
def q_panel_volatility(spark, base):
    return round_doubles(pnl.volatility_index(si.labour_panel(spark, base)))


SQL_CELLS = f"SELECT uf, setor, ano, mes, empregos AS jobs, ano * 12 + mes - 1 AS t FROM ({SQL_PANEL}) p"


@register(
    "panel_sector_growth",
    f"""SELECT uf, setor, ano, mes, jobs, round(CASE WHEN t - lag(t) OVER w = 1 THEN (jobs - lag(jobs) OVER w) / CAST(lag(jobs) OVER w AS DOUBLE) END, 6) AS growth
FROM ({SQL_CELLS}) c WINDOW w AS (PARTITION BY uf, setor ORDER BY t)""",
)
def q_panel_sector_growth(spark, base):
    """W-2 per territory and sector, where many months are missing: no growth across a gap."""
    return round_doubles(pnl.period_growth(si.labour_panel(spark, base), ["uf", "setor"], ["ano", "mes"], "empregos"))


@register(
    "panel_sector_calendar",
    f"""WITH c AS MATERIALIZED ({SQL_CELLS}),
d AS (SELECT uf, setor, unnest(range(a, b + 1)) AS t FROM (SELECT uf, setor, min(t) AS a, max(t) AS b FROM c GROUP BY 1, 2) s)
SELECT d.uf, d.setor, CAST(d.t // 12 AS INTEGER) AS ano, CAST(d.t % 12 + 1 AS INTEGER) AS mes, c.jobs,
       last_value(c.jobs IGNORE NULLS) OVER (PARTITION BY d.uf, d.setor ORDER BY d.t) AS filled
FROM d LEFT JOIN c ON c.uf = d.uf AND c.setor = d.setor AND c.t = d.t""",
)
def q_panel_sector_calendar(spark, base):
    """W-2: every month of a territory's sector from its first to its last, filled as of the last known one."""
    totals = si.labour_panel(spark, base).groupBy("uf", "setor", "ano", "mes").agg(F.sum("empregos").alias("jobs"))
    return pnl.calendar(totals, ["uf", "setor"], ["ano", "mes"], "jobs")


@register(
    "panel_levels",
    f"SELECT uf, round(avg_salary_nominal, 6) AS avg_salary_nominal, round(productivity_proxy, 6) AS productivity_proxy FROM ({SQL_LEVELS}) x",
)
def q_panel_levels(spark, base):
    return round_doubles(pnl.level_features(si.labour_panel(spark, base)))


@register("panel_diversification", f"SELECT uf, round(diversification_index, 6) AS diversification_index FROM ({SQL_DIVERS}) x")
def q_panel_diversification(spark, base):
    return round_doubles(pnl.diversification_index(si.labour_panel(spark, base)))


SQL_PANEL_FEATURES = f"""
SELECT g.uf, g.avg_growth_rate, v.volatility_index, l.avg_salary_nominal, l.productivity_proxy, d.diversification_index
FROM ({SQL_GROWTH_Y}) g JOIN ({SQL_VOL}) v USING (uf) JOIN ({SQL_LEVELS}) l USING (uf) JOIN ({SQL_DIVERS}) d USING (uf)
"""


@register(
    "panel_territory_features",
    f"SELECT uf, {_r6(list(pnl.PANEL_FEATURES))} FROM ({SQL_PANEL_FEATURES}) x",
)
def q_panel_territory_features(spark, base):
    return round_doubles(pnl.territory_features(si.labour_panel(spark, base)))


# ---------------------------------------------------------------- spatial weights
from ..operators import contact  # noqa: E402
from ..operators import weights as wts  # noqa: E402

SQL_POINTS = """
SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
       CAST(embedding[3] AS DOUBLE) AS value, label
FROM embeddings
"""

SQL_KNN4 = f"""
SELECT src, dst, d2, rank FROM (
  SELECT a.id AS src, b.id AS dst, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS d2,
         row_number() OVER (PARTITION BY a.id ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.id) AS rank
  FROM ({SQL_POINTS}) a JOIN ({SQL_POINTS}) b ON a.id <> b.id) t
WHERE rank <= 4
"""

SQL_CELLS = f"""
SELECT CAST(floor(x * 10) AS BIGINT) AS gx, CAST(floor(y * 10) AS BIGINT) AS gy,
       CAST(floor(x * 10) AS BIGINT) || ':' || CAST(floor(y * 10) AS BIGINT) AS id,
       count(*) AS n_points, avg(value) AS value
FROM ({SQL_POINTS}) p GROUP BY 1, 2
"""

SQL_QUEEN = f"""
SELECT a.id AS src, b.id AS dst FROM ({SQL_CELLS}) a JOIN ({SQL_CELLS}) b
  ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND a.id <> b.id
"""

SQL_ROOK = f"""
SELECT a.id AS src, b.id AS dst FROM ({SQL_CELLS}) a JOIN ({SQL_CELLS}) b
  ON abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1
"""

SQL_KNN_W = f"SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS w FROM ({SQL_KNN4}) k"


def _points(spark, base):
    return si.points(spark, base)


def _knn_w(spark, base, k=4):
    return wts.row_standardize(wts.binary(wts.knn(_points(spark, base), k=k)))


@register("spatial_knn", f"SELECT src, dst, round(d2, 12) AS d2, CAST(rank AS INTEGER) AS rank FROM ({SQL_KNN4}) k")
def q_spatial_knn(spark, base):
    """J-2 + W-1: exact 4 nearest neighbours of every point."""
    e = wts.knn(_points(spark, base), k=4)
    return e.select("src", "dst", F.round("d2", 12).alias("d2"), "rank")


@register("spatial_queen", SQL_QUEEN)
def q_spatial_queen(spark, base):
    """J-3: queen contiguity of the occupied grid cells (shared-vertex join)."""
    return wts.queen(si.grid_polygons(_points(spark, base)))


@register("spatial_rook", SQL_ROOK)
def q_spatial_rook(spark, base):
    """J-4: rook contiguity of the occupied grid cells (shared-segment join)."""
    return wts.rook(si.grid_polygons(_points(spark, base)))


SQL_MIXED = f"""
SELECT DISTINCT side, gx - CASE WHEN side = 2 THEN ((gx % 2) + 2) % 2 ELSE 0 END AS gx,
       gy - CASE WHEN side = 2 THEN ((gy % 2) + 2) % 2 ELSE 0 END AS gy
FROM (SELECT gx, gy, CASE WHEN CAST(floor(gx / 2.0) + floor(gy / 2.0) AS BIGINT) % 2 = 0 THEN 2 ELSE 1 END AS side
      FROM ({SQL_CELLS}) c) s
"""


def sql_contact(shared: str) -> str:
    """Pairs of squares with ``shared``, of the lengths ``sx`` and ``sy`` that their closed extents have in common."""
    return f"""
WITH m AS ({SQL_MIXED})
SELECT src, dst FROM (
  SELECT a.side || ':' || a.gx || ':' || a.gy AS src, b.side || ':' || b.gx || ':' || b.gy AS dst,
         least(a.gx + a.side, b.gx + b.side) - greatest(a.gx, b.gx) AS sx,
         least(a.gy + a.side, b.gy + b.side) - greatest(a.gy, b.gy) AS sy
  FROM m a JOIN m b ON (a.side, a.gx, a.gy) <> (b.side, b.gx, b.gy)) p
WHERE {shared}
"""


@register("spatial_touching", sql_contact("sx >= 0 AND sy >= 0"))
def q_spatial_touching(spark, base):
    """J-3: squares of two sizes whose boundaries share a point (T-junctions, no common vertices needed)."""
    return contact.touching(si.mixed_polygons(_points(spark, base)))


@register("spatial_bordering", sql_contact("sx >= 0 AND sy >= 0 AND sx + sy > 0"))
def q_spatial_bordering(spark, base):
    """J-4: squares of two sizes whose boundaries share a stretch of some length."""
    return contact.bordering(si.mixed_polygons(_points(spark, base)))


@register(
    "spatial_row_standardize",
    f"SELECT src, dst, round(1.0 / count(*) OVER (PARTITION BY src), 6) AS w FROM ({SQL_QUEEN}) q",
)
def q_spatial_row_standardize(spark, base):
    """X-1: row-standardised queen weights."""
    return round_doubles(wts.row_standardize(wts.binary(wts.queen(si.grid_polygons(_points(spark, base))))))


@register(
    "spatial_row_sums",
    f"SELECT src, round(sum(w), 6) AS row_sum, count(*) AS cardinality FROM ({SQL_KNN_W}) w GROUP BY src",
)
def q_spatial_row_sums(spark, base):
    """G-17: row sums of the row-standardised k-NN weights (all 1)."""
    return round_doubles(wts.row_sums(_knn_w(spark, base)))


@register(
    "spatial_lag",
    f"""
SELECT p.id, round(coalesce(sum(w.w * q.value), 0.0), 6) AS lag
FROM ({SQL_POINTS}) p LEFT JOIN ({SQL_KNN_W}) w ON w.src = p.id LEFT JOIN ({SQL_POINTS}) q ON q.id = w.dst
GROUP BY p.id
""",
)
def q_spatial_lag(spark, base):
    """J-5: spatial lag of the point value over row-standardised 4-NN weights."""
    lag = wts.spatial_lag(_knn_w(spark, base), _points(spark, base).select("id", "value"))
    return round_doubles(lag.select("id", "lag"))


# ---------------------------------------------------------------- autocorrelation
from ..functions.columns import erfc_sql  # noqa: E402
from ..functions.permutation import PRIME, ROUNDS  # noqa: E402
from ..operators import autocorr as ac  # noqa: E402

PERMS = 999
SEED = 123


def sql_z(points: str, w: str) -> str:
    return f"""
pts AS MATERIALIZED ({points}),
stats AS (SELECT count(*) AS n, avg(CASE WHEN isnan(value) THEN NULL ELSE value END) AS m FROM pts),
zt AS (SELECT p.id, coalesce(CASE WHEN isnan(p.value) THEN NULL ELSE p.value END, s.m) AS y,
              coalesce(CASE WHEN isnan(p.value) THEN NULL ELSE p.value END, s.m) - s.m AS z
       FROM pts p, stats s),
w AS MATERIALIZED ({w}),
zz AS (SELECT sum(z * z) AS zz FROM zt),
lag AS (SELECT zt.id, zt.y, zt.z, coalesce(l.lag, 0.0) AS lag FROM zt LEFT JOIN
        (SELECT w.src, sum(w.w * zt.z) AS lag FROM w JOIN zt ON zt.id = w.dst GROUP BY w.src) l ON l.src = zt.id)
"""


def sql_local(points: str, w: str) -> str:
    return f"""
WITH {sql_z(points, w)},
loc AS (SELECT id, y, z, lag, (s.n - 1) * z * lag / zz.zz AS lisa_i,
               CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN z <= 0 AND lag > 0 THEN 2
                    WHEN z <= 0 AND lag <= 0 THEN 3 ELSE 4 END AS quadrant
        FROM lag, stats s, zz)
"""


SQL_Z = sql_z(SQL_POINTS, SQL_KNN_W)
SQL_LOCAL = sql_local(SQL_POINTS, SQL_KNN_W)


@register(
    "spatial_local_moran",
    SQL_LOCAL + "SELECT id, round(y, 6) AS y, round(z, 6) AS z, round(lag, 6) AS lag, round(lisa_i, 6) AS lisa_i, quadrant FROM loc",
)
def q_spatial_local_moran(spark, base):
    """X-5 + P-12: local Moran statistic and quadrant over 4-NN weights."""
    return round_doubles(ac.local_moran(_points(spark, base), _knn_w(spark, base), transform="none"))


def sql_perm_keys() -> str:
    """(perm, k0, s0, k1, s1, ...): the round keys of the keyed bijections."""
    cols = []
    for i in range(ROUNDS):
        digest = f"md5('{SEED}:' || CAST(range AS VARCHAR) || ':{i}')"
        cols += [f"('0x' || substr({digest}, 1, 15))::BIGINT AS k{i}", f"('0x' || substr({digest}, 16, 7))::BIGINT AS s{i}"]
    return f"SELECT range AS perm, {', '.join(cols)} FROM range(0, {PERMS})"


def sql_bijection(rows: str) -> str:
    """``rows`` (.., perm, x, n) with x replaced by its image: the rounds of the shuffle unrolled."""
    out = f"SELECT r.*, keys.* EXCLUDE (perm) FROM ({rows}) r JOIN keys ON keys.perm = r.perm"
    for i in range(ROUNDS):
        t = f"((greatest(x, y) + s{i}) % {PRIME})"
        bit = f"((({t} * {t} + s{i}) % {PRIME}) >> 10) % 2"
        out = f"SELECT * EXCLUDE (y, k{i}, s{i}) REPLACE (CASE WHEN {bit} = 1 THEN y ELSE x END AS x) FROM (SELECT *, ((k{i} - x) % n + n) % n AS y FROM ({out}) a{i}) b{i}"
    return out


def sql_lisa(points: str, w: str, threshold: float = 0.05) -> str:
    return f"""
{sql_local(points, w)},
keys AS MATERIALIZED ({sql_perm_keys()}),
idx AS (SELECT id, z, row_number() OVER (ORDER BY id) - 1 AS pos FROM zt),
nbr AS (SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS r FROM w),
draws AS MATERIALIZED ({sql_bijection("SELECT p.perm, r.r, r.r AS x, s.n - 1 AS n FROM (SELECT DISTINCT r FROM nbr) r, stats s, (SELECT perm FROM keys) p")}),
sim AS (SELECT i.id, d.perm, sum(nb.w * ix.z) AS lag_sim
        FROM nbr nb JOIN idx i ON i.id = nb.src JOIN draws d ON d.r = nb.r
        JOIN idx ix ON ix.pos = CASE WHEN d.x >= i.pos THEN d.x + 1 ELSE d.x END
        GROUP BY i.id, d.perm),
cnt AS (SELECT l.id, CAST(sum(CASE WHEN (s.n - 1) * l.z * sim.lag_sim / zz.zz >= l.lisa_i THEN 1 ELSE 0 END) AS BIGINT) AS n_ge
        FROM loc l JOIN sim ON sim.id = l.id, stats s, zz GROUP BY l.id),
res AS (SELECT l.*, c.n_ge, (least(c.n_ge, {PERMS} - c.n_ge) + 1.0) / {PERMS + 1}.0 AS lisa_p_value FROM loc l LEFT JOIN cnt c USING (id)),
fin AS (SELECT *, CASE WHEN lisa_p_value < {threshold} THEN quadrant ELSE 0 END AS lisa_quad FROM res)
"""


SQL_LISA_LABEL = "CASE lisa_quad " + " ".join(f"WHEN {q} THEN '{t}'" for q, t in ac.LISA_LABELS.items()) + " END"
SQL_LISA_OUT = f"""
SELECT id, round(lisa_i, 6) AS lisa_i, quadrant, n_ge, round(lisa_p_value, 6) AS lisa_p_value, lisa_quad, {SQL_LISA_LABEL} AS lisa_label FROM fin
"""
SQL_LISA_BODY = sql_lisa(SQL_POINTS, SQL_KNN_W)
LISA_COLUMNS = ["id", "lisa_i", "quadrant", "n_ge", "lisa_p_value", "lisa_quad", "lisa_label"]


def _lisa(spark, base):
    return ac.lisa(_points(spark, base), _knn_w(spark, base), permutations=PERMS, seed=SEED, p_threshold=0.05, transform="none")


@register("spatial_lisa", SQL_LISA_BODY + SQL_LISA_OUT)
def q_spatial_lisa(spark, base):
    """X-6, X-7, P-11: local Moran with 999 conditional permutations, significance 0.05."""
    return round_doubles(_lisa(spark, base).select(*LISA_COLUMNS))


SQL_QUEEN_W = f"SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS w FROM ({SQL_QUEEN}) q"
SQL_RANK_W = f"SELECT src, dst, (1.0 / rank) / sum(1.0 / rank) OVER (PARTITION BY src) AS w FROM ({SQL_KNN4}) k"


@register("spatial_lisa_queen", sql_lisa(SQL_CELLS, SQL_QUEEN_W) + SQL_LISA_OUT)
def q_spatial_lisa_queen(spark, base):
    """P-14, X-6: LISA of the grid cells on queen weights from the dispatcher; cells without
    neighbours get no p and no label."""
    cells = stage(si.grid_polygons(_points(spark, base)), "cells")
    w = wts.create_weights(cells, "queen")
    return round_doubles(ac.lisa(cells.select("id", "value"), w, permutations=PERMS, seed=SEED, transform="none").select(*LISA_COLUMNS))


@register("spatial_lisa_weighted", sql_lisa(SQL_POINTS, SQL_RANK_W) + SQL_LISA_OUT)
def q_spatial_lisa_weighted(spark, base):
    """X-6 with unequal weights: 1 / rank of the neighbour, row-standardised."""
    pts = _points(spark, base)
    e = wts.knn(pts, k=4)
    w = wts.row_standardize(e.select("src", "dst", (F.lit(1.0) / F.col("rank")).alias("w")))
    return round_doubles(ac.lisa(pts, w, permutations=PERMS, seed=SEED, transform="none").select(*LISA_COLUMNS))


@register(
    "spatial_lisa_counts",
    SQL_LISA_BODY + f"SELECT {SQL_LISA_LABEL} AS lisa_label, count(*) AS n FROM fin GROUP BY 1 ORDER BY n DESC, lisa_label",
)
def q_spatial_lisa_counts(spark, base):
    """G-11: observations per LISA label."""
    return ac.label_counts(_lisa(spark, base))


SQL_MORAN = f"""
WITH {SQL_Z},
agg AS (SELECT sum(z * lag) AS num FROM lag),
ws AS (SELECT sum(w) AS s0 FROM w),
s1 AS (SELECT 0.5 * sum((coalesce(a.w, 0.0) + coalesce(b.w, 0.0)) * (coalesce(a.w, 0.0) + coalesce(b.w, 0.0))) AS s1
       FROM w a FULL OUTER JOIN w b ON a.src = b.dst AND a.dst = b.src),
s2 AS (SELECT sum((coalesce(r, 0.0) + coalesce(c, 0.0)) * (coalesce(r, 0.0) + coalesce(c, 0.0))) AS s2
       FROM (SELECT src AS id, sum(w) AS r FROM w GROUP BY src) rr
       FULL OUTER JOIN (SELECT dst AS id, sum(w) AS c FROM w GROUP BY dst) cc USING (id)),
res AS (SELECT s.n, s.n / ws.s0 * agg.num / zz.zz AS moran_i, -1.0 / (s.n - 1) AS expected_i,
               (s.n * s.n * s1.s1 - s.n * s2.s2 + 3.0 * ws.s0 * ws.s0) / ((s.n * s.n - 1.0) * ws.s0 * ws.s0)
                 - (1.0 / (s.n - 1)) * (1.0 / (s.n - 1)) AS vi,
               ws.s0, s1.s1, s2.s2, zz.zz
        FROM stats s, agg, ws, s1, s2, zz),
nrm AS (SELECT *, (moran_i - expected_i) / sqrt(vi) AS z_norm FROM res)
"""


@register(
    "spatial_moran",
    SQL_MORAN
    + f"""
SELECT 'value' AS variable, n, round(moran_i, 6) AS moran_i, round(expected_i, 6) AS expected_i,
       round(z_norm, 6) AS z_norm, round({erfc_sql('abs(z_norm) / sqrt(2.0)')}, 6) AS p_norm,
       round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2
FROM nrm
""",
)
def q_spatial_moran(spark, base):
    """X-2 + X-4: global Moran's I with analytic (normality) inference."""
    m = ac.moran(_points(spark, base), _knn_w(spark, base), permutations=0, transform="none")
    return round_doubles(m.select("variable", "n", "moran_i", "expected_i", "z_norm", "p_norm", "s0", "s1", "s2"))


SQL_MORAN_PERM = (
    SQL_MORAN
    + f""",
keys AS MATERIALIZED ({sql_perm_keys()}),
idx AS (SELECT id, z, row_number() OVER (ORDER BY id) - 1 AS pos FROM zt),
images AS ({sql_bijection("SELECT p.perm, i.z, i.pos AS x, s.n AS n FROM idx i, stats s, (SELECT perm FROM keys) p")}),
permuted AS MATERIALIZED (SELECT im.perm, ix.id, im.z AS zp FROM images im JOIN idx ix ON ix.pos = im.x),
lagp AS (SELECT p.perm, w.src, sum(w.w * p.zp) AS lag FROM w JOIN permuted p ON p.id = w.dst GROUP BY p.perm, w.src),
sims AS (SELECT l.perm, (SELECT n / s0 FROM res) * sum(p.zp * l.lag) / (SELECT zz FROM res) AS i_sim
         FROM lagp l JOIN permuted p ON p.perm = l.perm AND p.id = l.src GROUP BY l.perm),
sagg AS (SELECT sum(CASE WHEN i_sim >= (SELECT moran_i FROM res) THEN 1 ELSE 0 END) AS n_ge,
                avg(i_sim) AS mean_sim, stddev_pop(i_sim) AS std_sim FROM sims),
fin AS (SELECT nrm.*, (least(n_ge, {PERMS} - n_ge) + 1.0) / {PERMS + 1}.0 AS p_value,
               (moran_i - mean_sim) / std_sim AS z_score, mean_sim, std_sim FROM nrm, sagg)
SELECT 'value' AS variable, n, round(moran_i, 6) AS moran_i, round(p_value, 6) AS p_value, round(z_score, 6) AS z_score,
       round(mean_sim, 6) AS mean_sim, round(std_sim, 6) AS std_sim, {PERMS} AS permutations,
       CASE WHEN p_value < 0.05 AND moran_i > expected_i THEN '{ac.PATTERN_CLUSTERED}'
            WHEN p_value < 0.05 THEN '{ac.PATTERN_DISPERSED}' ELSE '{ac.PATTERN_RANDOM}' END AS pattern
FROM fin
"""
)


@register("spatial_moran_perm", SQL_MORAN_PERM)
def q_spatial_moran_perm(spark, base):
    """X-3, G-19, P-13: 999 deterministic permutations, pseudo p, z_sim and pattern."""
    m = ac.moran(_points(spark, base), _knn_w(spark, base), permutations=PERMS, seed=SEED, transform="none")
    return round_doubles(m.select("variable", "n", "moran_i", "p_value", "z_score", "mean_sim", "std_sim", "permutations", "pattern"))


@register(
    "spatial_moran_scatter",
    f"""
WITH pts AS (SELECT id, value FROM ({SQL_POINTS}) p),
st AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM pts),
zs AS (SELECT id, (value - st.m) / st.sd AS z FROM pts, st),
w AS ({SQL_KNN_W}),
lag AS (SELECT zs.id, zs.z, coalesce(l.lag, 0.0) AS lag FROM zs LEFT JOIN
        (SELECT w.src, sum(w.w * zs.z) AS lag FROM w JOIN zs ON zs.id = w.dst GROUP BY w.src) l ON l.src = zs.id),
fit AS (SELECT regr_slope(lag, z) AS slope, regr_intercept(lag, z) AS intercept FROM lag)
SELECT id, round(z, 6) AS z, round(lag, 6) AS lag, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
       round(intercept + slope * z, 6) AS fitted,
       CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN z <= 0 AND lag > 0 THEN 2 WHEN z <= 0 AND lag <= 0 THEN 3 ELSE 4 END AS quadrant
FROM lag, fit
""",
)
def q_spatial_moran_scatter(spark, base):
    """X-8, G-13, G-18: Moran scatter data (z, lag, regression line, quadrant)."""
    return round_doubles(ac.moran_scatter(_points(spark, base), _knn_w(spark, base), transform="none"))

