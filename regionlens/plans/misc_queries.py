"""Registered I/O, attribute-join and report queries with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null, round_doubles
from ..operators import autocorr as ac
from ..operators import graph as g
from ..operators import kpi, report
from ..operators import weights as wts
from ..session import scratch_path
from ..sources.sinks import write_delimited, write_parquet
from ..sources.tables import TABLES, lower_headers, read_delimited, read_table
from . import stand_ins as si
from .graph_queries import SQL_CO, SQL_GRAPH, _betweenness_sql_cte, _graph, communities
from .registry import SQL_LISA_BODY, SQL_POINTS, SQL_PROFILE, _knn_w, _lisa, _points, register


@register("io_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def q_io_row_counts(spark, base):
    """S-1, S-9: every input table scanned (no columns needed) and counted."""
    parts = [read_table(spark, base, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


REPORT_SCHEMA = T.StructType(
    [
        T.StructField("UF", T.StringType()),
        T.StructField("Emprego_Industrial", T.LongType()),
        T.StructField("PIB_Industrial_Milhoes", T.DoubleType()),
        T.StructField("Produtividade_R_por_Trabalhador", T.DoubleType()),
        T.StructField("Salario_Medio", T.DoubleType()),
        T.StructField("Inovacao_Pct_VA", T.DoubleType()),
        T.StructField("Score_ESG", T.DoubleType()),
    ]
)


@register(
    "io_csv_roundtrip",
    f"""SELECT uf, CAST(round(total_emprego, 0) AS BIGINT) AS emprego_industrial,
       round(total_valor_adicionado / 1000000.0, 2) AS pib_industrial_milhoes,
       round(produtividade_media_uf, 2) AS produtividade_r_por_trabalhador, round(custo_trabalho_medio_uf, 2) AS salario_medio,
       round(taxa_inovacao_uf * 100.0, 2) AS inovacao_pct_va, round(indice_esg_uf, 1) AS score_esg
FROM ({SQL_PROFILE}) p""",
)
def q_io_csv_roundtrip(spark, base):
    """S-2, S-3, S-8: KPI report written as one ';'-separated file with header to the shared
    scratch folder, read back with an explicit schema, headers lower-cased."""
    path = scratch_path(spark, "kpi_report_csv")
    write_delimited(kpi.kpi_report(kpi.territory_profile(si.sector_facts(spark, base))), path, sep=";", single_file=True)
    return lower_headers(read_delimited(spark, path, REPORT_SCHEMA, sep=";"))


@register(
    "io_parquet_roundtrip",
    """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS o_year
FROM orders WHERE o_orderstatus <> 'O'""",
)
def q_io_parquet_roundtrip(spark, base):
    """S-7: a partitioned table of one set of rows, overwritten with another one in the same partitions, and read back."""
    path = scratch_path(spark, "orders_by_year")
    orders = read_table(spark, base, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    orders = orders.withColumn("o_year", F.year("o_orderdate")).drop("o_orderdate")
    write_parquet(orders.where("o_orderstatus = 'O'"), path, ["o_year"])
    write_parquet(orders.where("o_orderstatus <> 'O'"), path, ["o_year"])
    return round_doubles(spark.read.parquet(path))


@register(
    "spatial_impute_missing",
    f"""WITH p AS (SELECT id, CASE WHEN label = 3 THEN NULL WHEN label = 5 THEN 'NaN'::DOUBLE ELSE value END AS value FROM ({SQL_POINTS}) q),
m AS (SELECT avg(CASE WHEN isnan(value) THEN NULL ELSE value END) AS m FROM p)
SELECT id, round(coalesce(CASE WHEN isnan(value) THEN NULL ELSE value END, m.m), 6) AS value,
       CASE WHEN value IS NULL OR isnan(value) THEN 1 ELSE 0 END AS imputed FROM p, m""",
)
def q_spatial_impute_missing(spark, base):
    """G-12, F-7 with missing values: one label's values are NULL and another's NaN."""
    hidden = F.when(F.col("label") == 3, F.lit(None)).when(F.col("label") == 5, F.lit(float("nan"))).otherwise(F.col("value"))
    pts = _points(spark, base).select("id", hidden.cast("double").alias("value"))
    out, _, _ = ac.impute_mean(pts.withColumn("imputed", F.when(nan_to_null("value").isNull(), 1).otherwise(0)), "value")
    return round_doubles(out)


@register(
    "spatial_attach_attributes",
    f"""SELECT n.n_name AS uf, n.n_regionkey AS region, p.total_emprego, round(p.produtividade_media_uf, 6) AS produtividade_media_uf
FROM nation n LEFT JOIN ({SQL_PROFILE}) p ON p.uf = n.n_name""",
)
def q_spatial_attach_attributes(spark, base):
    """J-1: every territory kept, its KPIs joined by key (NULL where it has none)."""
    geo = read_table(spark, base, "nation", ["n_name", "n_regionkey"]).select(F.col("n_name").alias("uf"), F.col("n_regionkey").alias("region"))
    prof = kpi.territory_profile(si.sector_facts(spark, base)).select("uf", "total_emprego", "produtividade_media_uf")
    return round_doubles(wts.attach_attributes(geo, prof, "uf"))


@register(
    "spatial_impute",
    f"""WITH p AS ({SQL_POINTS}), m AS (SELECT avg(CASE WHEN isnan(value) THEN NULL ELSE value END) AS m FROM p)
SELECT id, round(coalesce(CASE WHEN isnan(value) THEN NULL ELSE value END, m.m), 6) AS value,
       CASE WHEN value IS NULL OR isnan(value) THEN 1 ELSE 0 END AS imputed FROM p, m""",
)
def q_spatial_impute(spark, base):
    """G-12: NaN / NULL values replaced by the mean of the others."""
    pts = _points(spark, base).select("id", "value")
    flagged = pts.withColumn("imputed", F.when(nan_to_null("value").isNull(), 1).otherwise(0))
    out, _, _ = ac.impute_mean(flagged, "value")
    return round_doubles(out)


@register(
    "report_network_edges",
    f"""WITH {SQL_GRAPH}
SELECT src AS "from", dst AS "to", round(weight * 3.0, 6) AS value,
       'Fornecimento ' || src || ' → ' || dst || ': Coef. ' ||
       CAST(CAST(floor(weight * 100.0 + 0.5) AS BIGINT) // 100 AS VARCHAR) || '.' ||
       lpad(CAST(CAST(floor(weight * 100.0 + 0.5) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS title
FROM E""",
)
def q_report_network_edges(spark, base):
    """R-2: network edge view."""
    return round_doubles(report.network_edge_view(_graph(spark, base)[1]))


def _colors_sql(d: dict, expr: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {expr} = {k!r} THEN '{v}'" if isinstance(k, str) else f"WHEN {expr} = {k} THEN '{v}'" for k, v in d.items()) + f" ELSE '{default}' END"


@register(
    "report_network_nodes",
    f"""WITH {SQL_GRAPH}, {SQL_CO}, {_betweenness_sql_cte()}
SELECT n.id, round(25.0 + bt.betweenness_centrality * 70.0, 6) AS size,
       round(3000.0 * (bt.betweenness_centrality + 0.1), 6) AS static_size,
       {_colors_sql(report.COMMUNITY_COLORS, 'CO.community', report.COMMUNITY_COLOR_DEFAULT)} AS color,
       '<b>Setor:</b> ' || n.id || '<br><b>CNAE:</b> ' || n.cnae || '<br><b>Categoria:</b> ' || n.categoria ||
       '<br><b>Betweenness Centrality:</b> ' ||
       CAST(CAST(floor(bt.betweenness_centrality * 10000.0 + 0.5) AS BIGINT) // 10000 AS VARCHAR) || '.' ||
       lpad(CAST(CAST(floor(bt.betweenness_centrality * 10000.0 + 0.5) AS BIGINT) % 10000 AS VARCHAR), 4, '0') ||
       '<br><b>Comunidade:</b> Ecossistema ' || CAST(CO.community + 1 AS VARCHAR) AS title
FROM NODES n JOIN BT bt ON bt.id = n.id JOIN CO ON CO.id = n.id""",
)
def q_report_network_nodes(spark, base):
    """R-1: network node view (detected communities)."""
    nodes, edges, _, mem = communities(spark, base)
    return round_doubles(report.network_node_view(nodes, g.betweenness(nodes, edges), mem))


@register(
    "report_lisa_map",
    SQL_LISA_BODY
    + f""", lab AS (SELECT id, CASE lisa_quad {' '.join(f"WHEN {q} THEN '{t}'" for q, t in ac.LISA_LABELS.items())} END AS lisa_label FROM fin)
SELECT p.id, round(p.x, 6) AS x, round(p.y, 6) AS y, coalesce(l.lisa_label, '{ac.LISA_LABELS[0]}') AS lisa_label,
       {_colors_sql(report.LISA_COLORS, "coalesce(l.lisa_label, '" + ac.LISA_LABELS[0] + "')", report.LISA_COLOR_DEFAULT)} AS color
FROM ({SQL_POINTS}) p LEFT JOIN lab l ON l.id = p.id""",
)
def q_report_lisa_map(spark, base):
    """R-3: LISA map view (points with label and colour)."""
    return round_doubles(report.lisa_map_view(_lisa(spark, base), _points(spark, base)))


@register(
    "spatial_buffer_centroids",
    f"""WITH p AS ({SQL_POINTS}),
r AS (SELECT id, unnest(list_transform(range(0, 64), lambda i: x + 0.012 * cos(i * (2 * pi() / 64)))) AS vx,
             unnest(list_transform(range(0, 64), lambda i: y + 0.012 * sin(i * (2 * pi() / 64)))) AS vy FROM p)
SELECT id, round(avg(vx), 6) AS cx, round(avg(vy), 6) AS cy, CAST(count(*) AS INTEGER) AS n_vertices FROM r GROUP BY id""",
)
def q_spatial_buffer_centroids(spark, base):
    """F-12: 64-vertex buffer ring around every point and the ring centroid."""
    rings = wts.buffer_rings(_points(spark, base), radius=0.012, n_vertices=64)
    return round_doubles(wts.ring_centroids(rings))
