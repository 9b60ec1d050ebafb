"""Report datasets (R-1..R-3): the data behind the original drawings, not the drawings.

Text formatting is done with integer arithmetic on the rounded value so every engine
produces the same characters (ties round half up on the binary value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .autocorr import LISA_LABELS

# Colours of the original views.
COMMUNITY_COLORS = {0: "#e41a1c", 1: "#377eb8", 2: "#4daf4a", 3: "#984ea3"}
COMMUNITY_COLOR_DEFAULT = "#ff7f00"
LISA_COLORS = {
    LISA_LABELS[1]: "#d73027",
    LISA_LABELS[3]: "#4575b4",
    LISA_LABELS[4]: "#fdae61",
    LISA_LABELS[2]: "#abd9e9",
    LISA_LABELS[0]: "#e0e0e0",
}
LISA_COLOR_DEFAULT = "#e0e0e0"


def fixed_decimals(c: Column | str, digits: int) -> Column:
    """Text of ``c`` with exactly ``digits`` decimals, halves rounded up (0.125 gives 0.13)."""
    c = F.col(c) if isinstance(c, str) else c
    scale = 10 ** digits
    units = F.floor(F.abs(c) * F.lit(float(scale)) + F.lit(0.5)).cast("long")
    whole = (units / F.lit(scale)).cast("long").cast("string")
    frac = F.lpad(F.pmod(units, F.lit(scale)).cast("string"), digits, "0")
    sign = F.when((c < 0) & (units > 0), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, whole, F.lit("."), frac)


def _map(d: dict) -> Column:
    return F.create_map(*[x for kv in d.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])


#: Size scales and the hover text of the original network view.
NODE_SIZE = (25.0, 70.0)
NODE_STATIC = (3000.0, 0.1)


def network_node_view(nodes: DataFrame, betweenness: DataFrame, membership: DataFrame) -> DataFrame:
    """R-1: id, size = 25 + 70 b, static_size = 3000 (b + 0.1), colour by community, hover text."""
    df = (
        nodes.select("id", *[c for c in ("cnae", "categoria") if c in nodes.columns])
        .join(betweenness, "id", "left")
        .join(membership.select("id", "community"), "id", "left")
    )
    b = F.coalesce(F.col("betweenness_centrality"), F.lit(0.1))
    comm = F.coalesce(F.col("community"), F.lit(0))
    hover = F.concat(
        F.lit("<b>Setor:</b> "), F.col("id"),
        F.lit("<br><b>CNAE:</b> "), F.coalesce(F.col("cnae"), F.lit("N/A")),
        F.lit("<br><b>Categoria:</b> "), F.coalesce(F.col("categoria"), F.lit("N/A")),
        F.lit("<br><b>Betweenness Centrality:</b> "), fixed_decimals(b, 4),
        F.lit("<br><b>Comunidade:</b> Ecossistema "), (comm + 1).cast("string"),
    )
    return df.select(
        "id",
        (F.lit(NODE_SIZE[0]) + b * F.lit(NODE_SIZE[1])).alias("size"),
        (F.lit(NODE_STATIC[0]) * (b + F.lit(NODE_STATIC[1]))).alias("static_size"),
        F.coalesce(F.element_at(_map(COMMUNITY_COLORS), comm), F.lit(COMMUNITY_COLOR_DEFAULT)).alias("color"),
        hover.alias("title"),
    )


def network_edge_view(edges: DataFrame) -> DataFrame:
    """R-2: from, to, value = 3 w, title "Fornecimento u → v: Coef. w(2 decimals)"."""
    return edges.select(
        F.col("src").alias("from"),
        F.col("dst").alias("to"),
        (F.col("weight") * F.lit(3.0)).alias("value"),
        F.concat(F.lit("Fornecimento "), F.col("src"), F.lit(" → "), F.col("dst"), F.lit(": Coef. "), fixed_decimals("weight", 2)).alias("title"),
    )


def lisa_map_view(lisa_df: DataFrame, geo: DataFrame, id_col: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """R-3: id, x, y, LISA label and its colour (geometry joined by id, all ids kept)."""
    df = geo.select(F.col(id_col).alias("id"), F.col(x).alias("x"), F.col(y).alias("y")).join(
        lisa_df.select("id", "lisa_label"), "id", "left"
    )
    label = F.coalesce(F.col("lisa_label"), F.lit(LISA_LABELS[0]))
    return df.select(
        "id", "x", "y", label.alias("lisa_label"),
        F.coalesce(F.element_at(_map(LISA_COLORS), label), F.lit(LISA_COLOR_DEFAULT)).alias("color"),
    )
