"""Small built-in dimension tables (S-5, S-6) as DataFrames.

These are the default inputs of the original project: 27 Brazilian state centroids and
the 8-sector input-output graph.  Users normally pass their own tables instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Approximate centroid (longitude, latitude) of the 27 federative units, EPSG:4326.
UF_CENTROIDS = [
    ("SP", -46.6333, -23.5505), ("RJ", -43.1729, -22.9068), ("MG", -43.9378, -19.9208), ("ES", -40.3380, -20.3194),
    ("RS", -51.2177, -30.0346), ("SC", -48.5480, -27.5948), ("PR", -49.2731, -25.4284),
    ("BA", -38.5108, -12.9714), ("PE", -34.8811, -8.0542), ("CE", -38.5267, -3.7319), ("RN", -35.2094, -5.7945),
    ("PB", -34.8610, -7.1150), ("SE", -37.0731, -10.9472), ("AL", -35.7353, -9.6658), ("PI", -42.8019, -5.0892),
    ("MA", -44.3028, -2.5307), ("DF", -47.9292, -15.7801), ("GO", -49.2648, -16.6869), ("MT", -56.0967, -15.6010),
    ("MS", -54.6464, -20.4428), ("AM", -60.0217, -3.1190), ("PA", -48.4902, -1.4558), ("RO", -63.9039, -8.7619),
    ("RR", -60.6758, 2.8235), ("AP", -51.0664, 0.0355), ("AC", -67.8100, -9.9754), ("TO", -48.3336, -10.1844),
]

# The 8 industrial sectors (name, CNAE divisions, category, base weight).
SECTOR_NODES = [
    ("Indústria Extrativa", "05-09", "Primário", 1.5),
    ("Alimentos e Bebidas", "10-11", "Bens de Consumo", 1.2),
    ("Têxtil e Confecção", "13-14", "Bens de Consumo", 0.8),
    ("Celulose e Papel", "17", "Insumos Básicos", 1.0),
    ("Química e Farmacêutica", "20-21", "Alta Tecnologia / Insumos", 2.0),
    ("Metalurgia", "24", "Insumos Básicos", 1.8),
    ("Automotiva e Equipamentos", "29-30", "Bens de Capital", 2.2),
    ("Máquinas e Aparelhos Elétricos", "27-28", "Bens de Capital", 1.9),
]

# Default supply edges (supplier sector, buyer sector, technical coefficient), in order.
SECTOR_EDGES = [
    ("Indústria Extrativa", "Metalurgia", 0.75),
    ("Indústria Extrativa", "Química e Farmacêutica", 0.60),
    ("Metalurgia", "Automotiva e Equipamentos", 0.85),
    ("Metalurgia", "Máquinas e Aparelhos Elétricos", 0.80),
    ("Química e Farmacêutica", "Alimentos e Bebidas", 0.45),
    ("Química e Farmacêutica", "Têxtil e Confecção", 0.50),
    ("Química e Farmacêutica", "Automotiva e Equipamentos", 0.55),
    ("Celulose e Papel", "Alimentos e Bebidas", 0.40),
    ("Celulose e Papel", "Química e Farmacêutica", 0.35),
    ("Máquinas e Aparelhos Elétricos", "Automotiva e Equipamentos", 0.70),
    ("Máquinas e Aparelhos Elétricos", "Metalurgia", 0.40),
    ("Alimentos e Bebidas", "Têxtil e Confecção", 0.20),
    ("Automotiva e Equipamentos", "Alimentos e Bebidas", 0.30),
    ("Química e Farmacêutica", "Celulose e Papel", 0.40),
]


def uf_centroids(spark: SparkSession) -> DataFrame:
    """S-5: (uf, x = longitude, y = latitude)."""
    return spark.createDataFrame(UF_CENTROIDS, "uf string, x double, y double")


def sector_nodes(spark: SparkSession) -> DataFrame:
    """S-6: (id, cnae, categoria, base_weight, ord)."""
    rows = [(n, c, cat, w, i) for i, (n, c, cat, w) in enumerate(SECTOR_NODES)]
    return spark.createDataFrame(rows, "id string, cnae string, categoria string, base_weight double, ord int")


def sector_edges(spark: SparkSession) -> DataFrame:
    """S-6: (src, dst, weight, ord) - ``ord`` is the list position (edge upsert order)."""
    rows = [(s, d, w, i) for i, (s, d, w) in enumerate(SECTOR_EDGES)]
    return spark.createDataFrame(rows, "src string, dst string, weight double, ord int")
