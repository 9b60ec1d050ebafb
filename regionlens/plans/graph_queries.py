"""Registered graph queries (nation trade graph) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import graph as g
from ..operators.louvain import louvain
from ..sources.edge_store import EdgeStore
from ..sources.tables import read_table
from . import stand_ins as si
from .registry import SQL_FACTS, register

SQL_GRAPH = """
per_order AS (
  SELECT l.l_orderkey AS okey, s.s_nationkey AS src_key,
         sum(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))) AS rev
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2),
flows AS (
  SELECT p.src_key, c.c_nationkey AS dst_key, sum(p.rev) AS revenue
  FROM per_order p JOIN orders o ON o.o_orderkey = p.okey JOIN customer c ON c.c_custkey = o.o_custkey
  WHERE p.src_key <> c.c_nationkey GROUP BY 1, 2),
E AS MATERIALIZED (
  SELECT a.n_name AS src, b.n_name AS dst, CAST(f.revenue AS DOUBLE) / CAST(sum(f.revenue) OVER (PARTITION BY f.dst_key) AS DOUBLE) AS weight
  FROM flows f JOIN nation a ON a.n_nationkey = f.src_key JOIN nation b ON b.n_nationkey = f.dst_key),
NODES AS (
  SELECT n.n_name AS id, CAST(n.n_nationkey AS VARCHAR) AS cnae, r.r_name AS categoria,
         1.0::DOUBLE + CAST(n.n_regionkey AS DOUBLE) / 4.0::DOUBLE AS base_weight, n.n_regionkey AS region
  FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey),
N AS (SELECT count(*) AS n FROM NODES)
"""


def _graph(spark, base):
    """The derived nation graph: the edges are written once, and the nodes derive from these."""
    edges = g.materialize(si.trade_edges(spark, base))
    nodes, edges = g.build_graph(si.nation_nodes(spark, base), edges)
    return g.materialize(nodes), edges


@register("graph_edges", f"WITH {SQL_GRAPH} SELECT src, dst, round(weight, 6) AS weight FROM E")
def q_graph_edges(spark, base):
    """N-1, U-2: the de-duplicated directed weighted edge list."""
    return round_doubles(_graph(spark, base)[1])


@register(
    "graph_nodes",
    f"""WITH {SQL_GRAPH},
facts AS ({SQL_FACTS}),
means AS (SELECT uf, avg(CAST(emprego_industrial AS DOUBLE)) AS emprego_industrial,
                 CAST(avg(valor_adicionado_brut) AS DOUBLE) AS valor_adicionado_brut,
                 CAST(avg(massa_salarial) AS DOUBLE) AS massa_salarial,
                 CAST(avg(consumo_energia_mwh) AS DOUBLE) AS consumo_energia_mwh,
                 CAST(avg(investimento_inovacao) AS DOUBLE) AS investimento_inovacao,
                 avg(indice_esg) AS indice_esg FROM facts GROUP BY uf)
SELECT n.id, n.cnae, n.categoria, round(n.base_weight, 6) AS base_weight, n.region,
       round(m.emprego_industrial, 6) AS emprego_industrial, round(m.valor_adicionado_brut, 6) AS valor_adicionado_brut,
       round(m.massa_salarial, 6) AS massa_salarial, round(m.consumo_energia_mwh, 6) AS consumo_energia_mwh,
       round(m.investimento_inovacao, 6) AS investimento_inovacao, round(m.indice_esg, 6) AS indice_esg
FROM NODES n LEFT JOIN means m ON m.uf = n.id""",
)
def q_graph_nodes(spark, base):
    """N-1 + J-6: nodes enriched with the per-territory mean of every numeric fact column."""
    facts = si.sector_facts(spark, base).drop("setor")
    out, _ = g.build_graph(si.nation_nodes(spark, base), g.materialize(si.trade_edges(spark, base)), features=facts, feature_key="uf")
    return round_doubles(out)


@register("graph_size", f"WITH {SQL_GRAPH} SELECT (SELECT count(*) FROM NODES) AS n_nodes, (SELECT count(*) FROM E) AS n_edges")
def q_graph_size(spark, base):
    """G-14: node and edge counts."""
    return g.graph_size(*_graph(spark, base))


@register(
    "graph_degrees",
    f"""WITH {SQL_GRAPH}
SELECT n.id, round(coalesce((SELECT sum(weight) FROM E WHERE E.dst = n.id), 0.0), 6) AS in_degree_weight,
       round(coalesce((SELECT sum(weight) FROM E WHERE E.src = n.id), 0.0), 6) AS out_degree_weight
FROM NODES n""",
)
def q_graph_degrees(spark, base):
    """G-15 / N-5: weighted in- and out-degree."""
    return round_doubles(g.degrees(*_graph(spark, base)))


SQL_UND = "UND AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, max(weight) AS weight FROM E GROUP BY 1, 2)"


@register("graph_undirected", f"WITH {SQL_GRAPH}, {SQL_UND} SELECT u, v, round(weight, 6) AS weight FROM UND")
def q_graph_undirected(spark, base):
    """U-1 / N-7: undirected projection keeping the larger reciprocal weight."""
    return round_doubles(g.to_undirected(_graph(spark, base)[1], reciprocal="max"))


def _sql_pagerank(alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6) -> str:
    a = f"CAST({alpha!r} AS DOUBLE)"
    parts = [
        "outw AS (SELECT src, sum(weight) AS ws FROM E GROUP BY src)",
        "P AS (SELECT e.src, e.dst, e.weight / o.ws AS p FROM E e JOIN outw o ON o.src = e.src WHERE o.ws <> 0)",
        "dang AS (SELECT id FROM NODES WHERE id NOT IN (SELECT src FROM outw WHERE ws <> 0))",
        "x0 AS (SELECT id, CAST(1.0 AS DOUBLE) / (SELECT n FROM N) AS x, 0 AS done, 0 AS it FROM NODES)",
        "dg0 AS (SELECT coalesce(sum(x), 0.0) AS ds FROM x0 WHERE id IN (SELECT id FROM dang))",
    ]
    for t in range(max_iter):
        parts.append(
            f"""c{t + 1} AS (SELECT P.dst AS id, sum(x{t}.x * P.p) AS c FROM x{t} JOIN P ON P.src = x{t}.id GROUP BY P.dst),
n{t + 1} AS (SELECT x{t}.id, x{t}.done, x{t}.it, x{t}.x AS xo,
  CASE WHEN x{t}.done = 1 THEN x{t}.x
       ELSE {a} * (coalesce(c{t + 1}.c, 0.0) + dg{t}.ds * (CAST(1.0 AS DOUBLE) / (SELECT n FROM N)))
            + (CAST(1.0 AS DOUBLE) - {a}) / (SELECT n FROM N) END AS xn
  FROM x{t} LEFT JOIN c{t + 1} ON c{t + 1}.id = x{t}.id, dg{t}),
x{t + 1} AS (SELECT id, xn AS x,
  CASE WHEN done = 1 OR sum(abs(xn - xo)) OVER () < (SELECT n FROM N) * CAST({tol!r} AS DOUBLE) THEN 1 ELSE 0 END AS done,
  CASE WHEN done = 1 THEN it ELSE {t + 1} END AS it FROM n{t + 1}),
dg{t + 1} AS (SELECT coalesce(sum(x), 0.0) AS ds FROM x{t + 1} WHERE id IN (SELECT id FROM dang))"""
        )
    return ",\n".join(parts) + f",\nPR AS (SELECT id, x AS pagerank, it AS iterations FROM x{max_iter})"


@register("graph_pagerank", f"WITH {SQL_GRAPH}, {_sql_pagerank()} SELECT id, round(pagerank, 6) AS pagerank, iterations FROM PR")
def q_graph_pagerank(spark, base):
    """N-3: weighted PageRank (alpha 0.85, tol 1e-6 x n, at most 100 rounds)."""
    return round_doubles(g.pagerank(*_graph(spark, base)))


def _sql_minplus(name: str, base_rows: str, levels: int = 6) -> str:
    parts = [f"{name}0 AS (SELECT s, t, min(d) AS d FROM ({base_rows}) b GROUP BY s, t)"]
    for i in range(levels):
        parts.append(
            f"{name}{i + 1} AS (SELECT a.s, b.t, min(a.d + b.d) AS d FROM {name}{i} a JOIN {name}{i} b ON a.t = b.s GROUP BY a.s, b.t)"
        )
    parts.append(f"{name} AS (SELECT * FROM {name}{levels})")
    return ",\n".join(parts)


SQL_HOPS = _sql_minplus("H", "SELECT id AS s, id AS t, 0 AS d FROM NODES UNION ALL SELECT src, dst, 1 FROM E")


@register(
    "graph_closeness",
    f"""WITH {SQL_GRAPH}, {SQL_HOPS},
agg AS (SELECT t AS id, count(*) AS r, sum(d) AS tot FROM H GROUP BY t)
SELECT n.id, round(CASE WHEN a.tot > 0 THEN (a.r - 1) / CAST(a.tot AS DOUBLE) * (a.r - 1) / CAST((SELECT n FROM N) - 1 AS DOUBLE)
                   ELSE 0.0 END, 6) AS closeness_centrality
FROM NODES n LEFT JOIN agg a ON a.id = n.id""",
)
def q_graph_closeness(spark, base):
    """N-4: unweighted incoming closeness (Wasserman-Faust)."""
    return round_doubles(g.closeness(*_graph(spark, base)))


MAX_HOPS = 24  # of 25 nations
SAMPLES, SAMPLE_SEED, FAILURE = 10, 123, 0.1


def _sql_betweenness(max_hops: int = MAX_HOPS, samples: int | None = None) -> str:
    """Distances added up from the source on, hop by hop; path counts by layers; dependencies by the
    pair formula (a node lies on a shortest path if the distances over it add up)."""
    ln = "LN AS MATERIALIZED (SELECT src, dst, min(weight) AS len FROM E WHERE src <> dst GROUP BY 1, 2)"
    dist = ["D0 AS (SELECT id AS s, id AS t, CAST(0 AS DOUBLE) AS d FROM NODES)"]
    for h in range(max_hops):
        dist.append(
            f"""D{h + 1} AS MATERIALIZED (SELECT s, t, min(d) AS d FROM (
  SELECT s, t, d FROM D{h} UNION ALL SELECT a.s, l.dst, a.d + l.len FROM D{h} a JOIN LN l ON l.src = a.t) u GROUP BY s, t)"""
        )
    layers = ["S0 AS (SELECT id AS s, id AS v, CAST(1 AS HUGEINT) AS c FROM NODES)"]
    for h in range(max_hops):
        layers.append(
            f"""S{h + 1} AS MATERIALIZED (SELECT a.s, l.dst AS v, sum(a.c) AS c FROM S{h} a JOIN LN l ON l.src = a.v
  JOIN D da ON da.s = a.s AND da.t = a.v JOIN D dv ON dv.s = a.s AND dv.t = l.dst
  WHERE da.d + l.len = dv.d GROUP BY a.s, l.dst)"""
        )
    union = " UNION ALL ".join(f"SELECT * FROM S{h}" for h in range(max_hops + 1))
    # the pairs' first nodes: all, or those with the smallest hashes
    chosen, times = "SIG", "1.0::DOUBLE"
    if samples:
        chosen = f"(SELECT * FROM SIG WHERE s IN (SELECT id FROM NODES ORDER BY md5('{SAMPLE_SEED}:' || id), id LIMIT {samples}))"
        times = f"(SELECT n FROM N)::DOUBLE / {samples}"
    return f"""{ln},
{", ".join(dist)},
D AS MATERIALIZED (SELECT * FROM D{max_hops}),
{", ".join(layers)},
SIG AS MATERIALIZED (SELECT s, v, CAST(sum(c) AS DOUBLE) AS sigma FROM ({union}) u GROUP BY s, v),
PAIR AS (
  SELECT a.v AS id, sum(a.sigma * b.sigma / c.sigma) AS b
  FROM {chosen} a JOIN SIG b ON b.s = a.v JOIN SIG c ON c.s = a.s AND c.v = b.v
  JOIN D d1 ON d1.s = a.s AND d1.t = a.v JOIN D d2 ON d2.s = a.v AND d2.t = b.v JOIN D d3 ON d3.s = a.s AND d3.t = b.v
  WHERE a.s <> a.v AND b.v <> a.v AND a.s <> b.v AND abs(d1.d + d2.d - d3.d) < 1e-13
  GROUP BY a.v),
BT AS MATERIALIZED (SELECT n.id, coalesce(p.b, 0.0) * {times} / CAST(((SELECT n FROM N) - 1) * ((SELECT n FROM N) - 2) AS DOUBLE) AS betweenness_centrality
       FROM NODES n LEFT JOIN PAIR p ON p.id = n.id)"""


def _betweenness_sql_cte() -> str:
    return _sql_betweenness()


def _sql_communities(mode: str, max_rounds: int = MAX_HOPS) -> str:
    """The merge rounds unrolled (at most one less than there are nodes); CO is the final partition."""
    out = [
        "MM AS (SELECT sum(weight) AS m FROM UND)",
        "K AS MATERIALIZED (SELECT n.id, coalesce(sum(x.weight), 0.0) AS k FROM NODES n LEFT JOIN (SELECT u AS id, weight FROM UND UNION ALL SELECT v, weight FROM UND) x ON x.id = n.id GROUP BY n.id)",
        "L0 AS MATERIALIZED (SELECT id, id AS c FROM NODES)",
    ]
    for t in range(max_rounds):
        out += [
            f"DG{t} AS MATERIALIZED (SELECT l.c, sum(K.k) AS D FROM L{t} l JOIN K ON K.id = l.id GROUP BY l.c)",
            f"""G{t} AS MATERIALIZED (SELECT p.a, p.b, p.w / MM.m - 2.0 * (x.D / (2 * MM.m)) * (y.D / (2 * MM.m)) AS dq
  FROM (SELECT least(i.c, j.c) AS a, greatest(i.c, j.c) AS b, sum(weight) AS w FROM UND JOIN L{t} i ON i.id = UND.u JOIN L{t} j ON j.id = UND.v
        WHERE i.c <> j.c GROUP BY 1, 2) p JOIN DG{t} x ON x.c = p.a JOIN DG{t} y ON y.c = p.b, MM)""",
        ]
        if mode == "sequential":
            out.append(f"B{t} AS MATERIALIZED (SELECT a AS keep, b AS gone FROM G{t} WHERE dq >= 0 ORDER BY dq DESC, a, b LIMIT 1)")
        else:
            out.append(
                f"""C{t} AS MATERIALIZED (SELECT x, y FROM (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY dq DESC, y) AS rk
  FROM (SELECT a AS x, b AS y, dq FROM G{t} WHERE dq >= 0 UNION ALL SELECT b, a, dq FROM G{t} WHERE dq >= 0) q) r WHERE rk = 1),
B{t} AS MATERIALIZED (SELECT p.x AS keep, p.y AS gone FROM C{t} p JOIN C{t} q ON q.x = p.y AND q.y = p.x WHERE p.x < p.y)"""
            )
        out.append(f"L{t + 1} AS MATERIALIZED (SELECT l.id, coalesce(B{t}.keep, l.c) AS c FROM L{t} l LEFT JOIN B{t} ON B{t}.gone = l.c)")
    out += [
        f"CS AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, min(id)) - 1 AS community FROM L{max_rounds} GROUP BY c)",
        f"CO AS MATERIALIZED (SELECT l.id, CAST(CS.community AS INTEGER) AS community FROM L{max_rounds} l JOIN CS ON CS.c = l.c)",
    ]
    return ",\n".join(out)


SQL_MODULARITY = """
MQ AS (SELECT sum(coalesce(i.L, 0.0) / MM.m - (d.D / (2 * MM.m)) * (d.D / (2 * MM.m))) AS modularity
  FROM (SELECT CO.community AS c, sum(K.k) AS D FROM CO JOIN K ON K.id = CO.id GROUP BY 1) d
  LEFT JOIN (SELECT a.community AS c, sum(weight) AS L FROM UND JOIN CO a ON a.id = UND.u JOIN CO b ON b.id = UND.v
             WHERE a.community = b.community GROUP BY 1) i ON i.c = d.c, MM)"""
SQL_CO = f"{SQL_UND}, {_sql_communities('sequential')}"


@register("graph_betweenness", f"WITH {SQL_GRAPH}, {_sql_betweenness()} SELECT id, round(betweenness_centrality, 6) AS betweenness_centrality FROM BT")
def q_graph_betweenness(spark, base):
    """N-2: normalised shortest-path betweenness with the weight as length."""
    return round_doubles(g.betweenness(*_graph(spark, base)))


@register(
    "graph_betweenness_sampled",
    f"""WITH {SQL_GRAPH}, {_sql_betweenness(samples=SAMPLES)}
SELECT id, round(betweenness_centrality, 6) AS betweenness_centrality,
       round((SELECT n FROM N) / ((SELECT n FROM N) - 1.0::DOUBLE) * sqrt(ln(2 * (SELECT n FROM N) / {FAILURE}::DOUBLE) / (2 * {SAMPLES})), 6) AS error_bound FROM BT""",
)
def q_graph_betweenness_sampled(spark, base):
    """N-2 estimated from ten hash-chosen sources, with the error bound that holds for all nodes at once."""
    return round_doubles(g.sampled_betweenness(*_graph(spark, base), samples=SAMPLES, seed=SAMPLE_SEED, failure=FAILURE))


@register(
    "graph_closeness_sketched",
    f"""WITH {SQL_GRAPH}, {SQL_HOPS},
agg AS (SELECT t AS id, count(*) AS r, sum(d) AS tot FROM H GROUP BY t)
SELECT n.id, round(CASE WHEN a.tot > 0 THEN (a.r - 1) / CAST(a.tot AS DOUBLE) * (a.r - 1) / CAST((SELECT n FROM N) - 1 AS DOUBLE)
                   ELSE 0.0 END, 6) AS closeness_centrality, CAST(a.r AS BIGINT) AS reached
FROM NODES n LEFT JOIN agg a ON a.id = n.id""",
)
def q_graph_closeness_sketched(spark, base):
    """N-4 by reach sketches (sets as small as these are counted exactly)."""
    return round_doubles(g.sketched_closeness(*_graph(spark, base)))


@register(
    "graph_centrality_ranking",
    f"""WITH {SQL_GRAPH}, {_sql_pagerank()}, {SQL_HOPS}, {_sql_betweenness()},
agg AS (SELECT t AS id, count(*) AS r, sum(d) AS tot FROM H GROUP BY t),
CL AS (SELECT n.id, CASE WHEN a.tot > 0 THEN (a.r - 1) / CAST(a.tot AS DOUBLE) * (a.r - 1) / CAST((SELECT n FROM N) - 1 AS DOUBLE)
                   ELSE 0.0 END AS closeness_centrality FROM NODES n LEFT JOIN agg a ON a.id = n.id)
SELECT n.id AS setor, n.categoria, n.cnae,
       round(bt.betweenness_centrality, 6) AS betweenness_centrality, round(pr.pagerank, 6) AS pagerank,
       round(cl.closeness_centrality, 6) AS closeness_centrality,
       round(coalesce((SELECT sum(weight) FROM E WHERE E.dst = n.id), 0.0), 6) AS in_degree_weight,
       round(coalesce((SELECT sum(weight) FROM E WHERE E.src = n.id), 0.0), 6) AS out_degree_weight
FROM NODES n JOIN BT bt ON bt.id = n.id JOIN PR pr ON pr.id = n.id JOIN CL cl ON cl.id = n.id
ORDER BY betweenness_centrality DESC, setor""",
)
def q_graph_centrality_ranking(spark, base):
    """N-6, J-7, L-3: the centrality table (categoria = region, cnae = nation key)."""
    return round_doubles(g.centrality_ranking(*_graph(spark, base)))


def communities(spark, base, mode: str = "sequential"):
    """(nodes, edges, undirected edges, detected membership)."""
    nodes, edges = _graph(spark, base)
    und = g.materialize(g.to_undirected(edges))
    return nodes, edges, und, g.greedy_communities(nodes, und, mode)


def _community_rows(spark, base, mode):
    nodes, _, und, mem = communities(spark, base, mode)
    return round_doubles(g.community_attributes(nodes.select("id"), mem).withColumn("modularity", g.modularity(und, mem).scalar()))


def _sql_community_rows(mode: str) -> str:
    return f"""WITH {SQL_GRAPH}, {SQL_UND}, {_sql_communities(mode)}, {SQL_MODULARITY}
SELECT CO.id, CO.community, 'Ecossistema ' || CAST(CO.community + 1 AS VARCHAR) AS community_label, round(MQ.modularity, 6) AS modularity FROM CO, MQ"""


@register("graph_communities", _sql_community_rows("sequential"))
def q_graph_communities(spark, base):
    """N-8: greedy modularity communities, best pair first, with the modularity reached."""
    return _community_rows(spark, base, "sequential")


@register("graph_communities_parallel", _sql_community_rows("parallel"))
def q_graph_communities_parallel(spark, base):
    """N-8 by mutual-best merges: fewer rounds, another order."""
    return _community_rows(spark, base, "parallel")


@register("graph_louvain")
def q_graph_louvain(spark, base):
    """N-8 by multi-level local moving, with the modularity reached (tests hold it against a plain version)."""
    nodes, edges = _graph(spark, base)
    und = g.materialize(g.to_undirected(edges))
    mem = louvain(nodes, und)
    rows = g.community_attributes(nodes.select("id"), mem).withColumn("modularity", g.modularity(und, mem).scalar())
    return round_doubles(rows)


@register("graph_modularity", f"WITH {SQL_GRAPH}, {SQL_CO}, {SQL_MODULARITY} SELECT round(modularity, 6) AS modularity FROM MQ")
def q_graph_modularity(spark, base):
    """N-9: modularity of the detected partition on the undirected projection."""
    _, _, und, mem = communities(spark, base)
    return round_doubles(g.modularity(und, mem))


@register(
    "graph_community_members",
    f"""WITH {SQL_GRAPH}, {SQL_CO}
SELECT community, count(*) AS size, CAST(0 AS INTEGER) AS part, array_to_string(list_sort(list(id)), ', ') AS members_text
FROM CO GROUP BY community""",
)
def q_graph_community_members(spark, base):
    """G-16, F-6: members of the detected communities (as joined text), largest first."""
    return g.community_members(communities(spark, base)[3])


@register(
    "graph_community_labels",
    f"""WITH {SQL_GRAPH}, {SQL_CO}
SELECT n.id, n.cnae, n.categoria, round(n.base_weight, 6) AS base_weight, n.region, CO.community,
       'Ecossistema ' || CAST(CO.community + 1 AS VARCHAR) AS community_label FROM NODES n JOIN CO ON CO.id = n.id""",
)
def q_graph_community_labels(spark, base):
    """N-10: detected community id and label attached to every node."""
    nodes, _, _, mem = communities(spark, base)
    return round_doubles(g.community_attributes(nodes, mem))


SQL_UPSERT = """SELECT src, dst, round(weight, 6) AS weight FROM (
  SELECT c.c_nationkey AS src, s.s_nationkey AS dst, l.l_extendedprice AS weight,
         row_number() OVER (PARTITION BY c.c_nationkey, s.s_nationkey ORDER BY l.l_orderkey DESC, l.l_linenumber DESC, l.l_extendedprice DESC) AS rk
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey) t WHERE rk = 1"""


def _sales(spark, base):
    """Every sale as an edge (buyer nation, seller nation, price) with its order."""
    li = read_table(spark, base, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"])
    orders = read_table(spark, base, "orders", ["o_orderkey", "o_custkey"])
    cust = read_table(spark, base, "customer", ["c_custkey", "c_nationkey"])
    sup = read_table(spark, base, "supplier", ["s_suppkey", "s_nationkey"])
    sales = li.join(orders, li.l_orderkey == orders.o_orderkey).join(cust, orders.o_custkey == cust.c_custkey).join(sup, li.l_suppkey == sup.s_suppkey)
    sales = sales.select(
        F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), F.col("l_extendedprice").alias("weight"),
        F.struct("l_orderkey", "l_linenumber").alias("ord"),
    )
    return sales


@register("graph_edge_upsert", SQL_UPSERT)
def q_graph_edge_upsert(spark, base):
    """U-2: every sale upserts its (buyer nation, seller nation) edge; the last sale's price stays."""
    sales = _sales(spark, base)
    ends = sales.select(F.col("src").alias("id"))
    return round_doubles(g.build_graph(ends.distinct(), sales, order_col="ord")[1])


@register("graph_edge_store", SQL_UPSERT)
def q_graph_edge_store(spark, base):
    """U-2 in batches: a stored table takes the sales of even orders, then those of odd ones; the last sale stays,
    whatever batch it came in."""
    sales = g.materialize(_sales(spark, base))
    store = EdgeStore(spark)
    for rest in (0, 1):
        store.upsert(sales.where(F.col("ord.l_orderkey") % 2 == rest))
    return round_doubles(store.edges())
