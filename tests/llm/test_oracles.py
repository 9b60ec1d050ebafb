"""The SQL of the queries that have one: on the test tables against the queries, and on the awkward texts
of the other tests against their brute-force versions."""

import hashlib

import duckdb
import pytest
import test_quotes
import test_repair
import test_secrets
import test_trie
from llm_cases import SF

from regionlens.llm.queries import ORACLES, QUERIES
from tools.check_oracles import rows_of


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, sql = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(sql.columns, sql.fetchall())


def test_quotes_in_sql():
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", test_quotes.ROWS)
    got = {(r[0], r[1], r[2], r[3], r[4], r[7], r[6]) for r in con.sql(ORACLES["op3_chat"]).fetchall()}
    assert got == set(test_quotes.brute(test_quotes.ROWS))


def test_secrets_in_sql():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [*enumerate(test_secrets.TEXTS), (99, None)])
    for r in con.sql(ORACLES["op10_secrets"]).fetchall():
        n, base = test_secrets.brute(None if r[0] == 99 else test_secrets.TEXTS[r[0]])
        assert (list(r[1:4]), r[4]) == (n, hashlib.sha256(base.encode()).hexdigest())


def _conversations(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return con


def test_trie_in_sql():
    rows = [r for r in test_trie.awkward() if r[0] not in (200, 220)]
    assert sorted(_conversations(rows).sql(ORACLES["op12_trie"]).fetchall(), key=repr) == test_trie.brute(test_trie.rebuilt(rows))


def test_repair_in_sql():
    rows = test_repair.awkward()
    assert sorted(_conversations(rows).sql(ORACLES["op13_repair"]).fetchall(), key=repr) == test_repair.brute(rows)
