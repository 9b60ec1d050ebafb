import duckdb
import pytest

import __spark_entry__ as entry_mod
from regionlens.plans.catalog import ORACLES, QUERIES
from regionlens.sources.tables import TABLES
from tools.check_oracles import rows_of

SF = "/root/testdata/sf0.001"
FITTED = {"graph_louvain", "ml_kmeans_clusters", "ml_kmeans_center_values", "ml_cluster_profiles", "ml_kmeans_elbow", "ml_pca_clusters"}


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[0] == "UF"


def test_registry_contract():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    # every query of the library itself has an oracle, but for results that SQL cannot know; these have tests of their own
    assert len(QUERIES) >= 60 and set(QUERIES) - set(ORACLES) == FITTED


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle_matches(spark, duck, name):
    df = entry_mod.queries()[name](spark, SF)
    rel = duck.sql(entry_mod.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())
