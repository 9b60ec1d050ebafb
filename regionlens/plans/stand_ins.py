"""Analytic inputs derived from the raw star-schema tables.

| role                       | derived from                                            |
|----------------------------|---------------------------------------------------------|
| territory x sector facts   | lineitem, part, supplier, nation (territory = nation)   |
| territory x sector panel   | orders, customer, nation (year/month of the order date) |
| points with a value        | embeddings (dims 1, 2 = x, y; dim 3 = value)            |
| grid polygons              | unit cells of 10x, 10y occupied by the points            |
| squares of two sizes       | the same, every other cell of side 2 whole               |
| directed weighted graph    | nation -> nation revenue shares, all flows               |

Each plan pushes projections into the scans and aggregates as early as the join
graph allows, so the large tables are read once, column-pruned, and shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import read_table

MONEY = "decimal(12,2)"
RATE = "decimal(4,2)"
ROWS_A_PART = 1_000_000
"""Lines and orders that a task sorts by order, on average."""


def sector_facts(spark: SparkSession, base: str) -> DataFrame:
    """Territory x sector facts (F1 contract): uf, setor + DECIMAL measures + indice_esg.

    Measures are exact DECIMAL sums so that every later roll-up is order-independent.
    Plan: lineitem join part on partkey -> partial aggregate by (supplier, sector)
    -> shuffle of at most #suppliers x #sectors rows -> join supplier, nation.
    """
    li = read_table(spark, base, "lineitem", ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    part = read_table(spark, base, "part", ["p_partkey", "p_type", "p_size"])
    sup = read_table(spark, base, "supplier", ["s_suppkey", "s_nationkey"])
    nat = read_table(spark, base, "nation", ["n_nationkey", "n_name"])

    price = F.col("l_extendedprice").cast(MONEY)
    disc = F.col("l_discount").cast(RATE)
    tax = F.col("l_tax").cast(RATE)
    per_supplier = (
        li.join(part, li.l_partkey == part.p_partkey)
        .groupBy("l_suppkey", "p_type")
        .agg(
            F.sum("l_quantity").alias("jobs"),
            F.sum(price).alias("va"),
            F.sum(price * disc).alias("wages"),
            F.sum(price * tax).alias("energy"),
            F.sum(price * disc * tax).alias("innov"),
            F.sum("p_size").alias("size_sum"),
            F.count(F.lit(1)).alias("n_lines"),
        )
    )
    # nation is a fixed 25-row dimension: broadcasting it is always bounded.
    located = per_supplier.join(sup, per_supplier.l_suppkey == sup.s_suppkey).join(
        F.broadcast(nat), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return located.groupBy(F.col("n_name").alias("uf"), F.col("p_type").alias("setor")).agg(
        F.sum("jobs").cast("long").alias("emprego_industrial"),
        F.sum("va").alias("valor_adicionado_brut"),
        F.sum("wages").alias("massa_salarial"),
        F.sum("energy").alias("consumo_energia_mwh"),
        F.sum("innov").alias("investimento_inovacao"),
        (F.sum("size_sum") / F.sum("n_lines")).cast("double").alias("indice_esg"),
    )


def labour_panel(spark: SparkSession, base: str) -> DataFrame:
    """Monthly territory x sector panel (F2 contract).

    uf = customer nation, setor = order priority, empregos = orders,
    massa_salarial = DECIMAL sum of order totals, salario_medio_nominal = mean order total.
    """
    orders = read_table(spark, base, "orders", ["o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    cust = read_table(spark, base, "customer", ["c_custkey", "c_nationkey"])
    nat = read_table(spark, base, "nation", ["n_nationkey", "n_name"])
    # The customer join comes first: a pre-aggregate per (customer, month) hardly shrinks the
    # orders, while the partial aggregate per (nation, month, priority) leaves few rows to shuffle.
    located = orders.join(cust, orders.o_custkey == cust.c_custkey).join(F.broadcast(nat), F.col("c_nationkey") == F.col("n_nationkey"))
    return located.groupBy(
        F.col("n_name").alias("uf"), F.year("o_orderdate").alias("ano"), F.month("o_orderdate").alias("mes"), F.col("o_orderpriority").alias("setor")
    ).agg(
        F.count(F.lit(1)).alias("empregos"),
        F.sum(F.col("o_totalprice").cast(MONEY)).alias("massa_salarial"),
        (F.sum(F.col("o_totalprice").cast(MONEY)).cast("double") / F.count(F.lit(1)).cast("double")).alias("salario_medio_nominal"),
    )


def points(spark: SparkSession, base: str) -> DataFrame:
    """Point layer: id, x, y, value (double) from the first three embedding dimensions."""
    emb = read_table(spark, base, "embeddings", ["vec_id", "embedding", "label"])
    return emb.select(
        F.col("vec_id").alias("id"),
        F.element_at("embedding", 1).cast("double").alias("x"),
        F.element_at("embedding", 2).cast("double").alias("y"),
        F.element_at("embedding", 3).cast("double").alias("value"),
        F.col("label"),
    )


def grid_polygons(pts: DataFrame, scale: float = 10.0) -> DataFrame:
    """Unit cells of (floor(scale*x), floor(scale*y)) occupied by points, as 4-vertex rings.

    Output: id (string "gx:gy"), gx, gy, ring array<struct<x:double,y:double>>, n_points, value (mean).
    """
    cells = pts.groupBy(
        F.floor(F.col("x") * scale).cast("long").alias("gx"),
        F.floor(F.col("y") * scale).cast("long").alias("gy"),
    ).agg(F.count(F.lit(1)).alias("n_points"), F.avg("value").alias("value"))
    gx, gy = F.col("gx").cast("double"), F.col("gy").cast("double")

    def v(dx, dy):
        return F.struct((gx + dx).alias("x"), (gy + dy).alias("y"))

    return cells.select(
        F.concat_ws(":", "gx", "gy").alias("id"),
        "gx",
        "gy",
        F.array(v(0, 0), v(1, 0), v(1, 1), v(0, 1)).alias("ring"),
        "n_points",
        "value",
    )


def mixed_polygons(pts: DataFrame, scale: float = 10.0) -> DataFrame:
    """Squares of side 2 and 1 that meet in T-junctions: occupied cells of side 2 whose coordinates' sum is even stay
    whole, of the others the occupied unit cells are taken.

    Output: id (string "side:x:y"), ring array<struct<x:double,y:double>>.
    """
    cell = pts.select(F.floor(F.col("x") * scale).cast("long").alias("gx"), F.floor(F.col("y") * scale).cast("long").alias("gy"))
    wide = F.pmod(F.floor(F.col("gx") / 2) + F.floor(F.col("gy") / 2), F.lit(2)) == 0

    def corner(c):
        return F.when(wide, F.floor(F.col(c) / 2) * 2).otherwise(F.col(c)).cast("long").alias(c)

    cells = cell.select(F.when(wide, 2).otherwise(1).alias("side"), corner("gx"), corner("gy")).distinct()
    gx, gy, side = (F.col(c).cast("double") for c in ("gx", "gy", "side"))
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((gx, gy), (gx + side, gy), (gx + side, gy + side), (gx, gy + side))])
    return cells.select(F.concat_ws(":", "side", "gx", "gy").alias("id"), ring.alias("ring"))


def trade_flows(spark: SparkSession, base: str, self_flows: bool = False) -> DataFrame:
    """Supplier-nation -> customer-nation revenue (DECIMAL); ``self_flows`` keeps those within a nation.

    Lines and orders meet in parts by order, as many as keep a part at about ROWS_A_PART rows however large the
    tables are, and the joined rows are summed up within each task to one row per pair of nations.
    """
    li = read_table(spark, base, "lineitem", ["l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"])
    sup = read_table(spark, base, "supplier", ["s_suppkey", "s_nationkey"])
    orders = read_table(spark, base, "orders", ["o_orderkey", "o_custkey"])
    cust = read_table(spark, base, "customer", ["c_custkey", "c_nationkey"])
    rev = F.col("l_extendedprice").cast(MONEY) * (F.lit(1) - F.col("l_discount").cast(RATE))
    # the parts are stated, as sizes of shuffled bytes (well compressed) would make few and large ones of them
    parts = max(spark.sparkContext.defaultParallelism, -(-(li.count() + orders.count()) // ROWS_A_PART))  # counted by the files' footers
    lines = li.join(sup, li.l_suppkey == sup.s_suppkey).select("l_orderkey", F.col("s_nationkey").alias("src_key"), rev.alias("r"))
    buyers = orders.join(cust, orders.o_custkey == cust.c_custkey).select("o_orderkey", F.col("c_nationkey").alias("dst_key"))
    flows = lines.repartition(parts, "l_orderkey").join(buyers.repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    if not self_flows:
        flows = flows.where(F.col("src_key") != F.col("dst_key"))
    return flows.groupBy("src_key", "dst_key").agg(F.sum("r").cast("decimal(38,4)").alias("revenue"))


def nation_nodes(spark: SparkSession, base: str) -> DataFrame:
    """Node table of the nation graph: region name and key as categorical attributes."""
    nat = read_table(spark, base, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    reg = read_table(spark, base, "region", ["r_regionkey", "r_name"])
    return nat.join(F.broadcast(reg), nat.n_regionkey == reg.r_regionkey).select(
        F.col("n_name").alias("id"),
        F.col("n_nationkey").cast("string").alias("cnae"),
        F.col("r_name").alias("categoria"),
        (F.lit(1.0) + F.col("n_regionkey").cast("double") / F.lit(4.0)).alias("base_weight"),
        F.col("n_regionkey").alias("region"),
    )


def trade_edges(spark: SparkSession, base: str) -> DataFrame:
    """Edge table of the nation graph: every flow, weight = share of the target's inflow."""
    nat = read_table(spark, base, "nation", ["n_nationkey", "n_name"])
    flows = trade_flows(spark, base)
    inflow = F.sum("revenue").over(Window.partitionBy("dst_key"))  # at most one row per origin nation
    shares = flows.withColumn("weight", F.col("revenue").cast("double") / inflow.cast("double"))
    src = F.broadcast(nat.select(F.col("n_nationkey").alias("src_key"), F.col("n_name").alias("src")))
    dst = F.broadcast(nat.select(F.col("n_nationkey").alias("dst_key"), F.col("n_name").alias("dst")))
    return shares.join(src, "src_key").join(dst, "dst_key").select("src", "dst", "weight")
