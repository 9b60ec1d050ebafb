import hashlib
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import SF, awkward, documents, no_documents, rows
from pyspark.sql import functions as F

from regionlens.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text, items, window=10):
    """Every place of every document word against every window."""
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[k : k + m])].add(i)
    w, hit, found = words(text), set(), set()
    for m in {len(p) for p in windows}:
        for k in range(len(w) - m + 1):
            if ids := windows.get(tuple(w[k : k + m])):
                hit |= set(range(k, k + m))
                found |= ids
    return len(w), len(hit), {i for i in found if i is not None}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=4), st.integers(1, 5))
def test_search_is_exact(text, items, window):
    items = [(i, " ".join(t)) for i, t in enumerate(items)]
    n, spans, found = d.search(" ".join(text).encode(), d.searchers(((i, t.encode()) for i, t in items), window))
    assert (n, sum(b - a for a, b in spans), set(found)) == brute(" ".join(text), items, window)


def test_query_against_brute_force(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in d.op4_decontaminate(spark, SF).collect()}
    docs = documents(spark).collect()
    assert len(got) == len(docs)
    for r in docs:
        n, hit, found = brute(r["text"], items)
        ids = ",".join(sorted(map(str, found)))
        x = got[r["doc_id"]]
        assert (x["n_words"], x["n_hit"], x["n_items"], x["contaminated"]) == (n, hit, len(found), hit > 0)
        assert x["items_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
    assert any(x["contaminated"] for x in got.values())


@pytest.mark.parametrize("most", [1, 500_000])
def test_awkward_rows_in_one_block_and_in_many(spark, most):
    items = [(1, "no id here"), (1, "no id here"), (None, "one"), (2, None), (3, ""), (4, "Ñandú 日本語"), (5, "many words a very long text with many words a very")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = awkward(spark).withColumn("spans", F.lit(1)).withColumn("items", F.lit("x"))
    for c in ("_key", "_text", "_spans", "_items", "_Digest"):
        docs = docs.withColumn(c, F.lit("mine"))
    got = d.find_windows(docs, bench, "found", block_windows=most)
    assert got.columns == [*docs.columns, "found"] and got.count() == docs.count()
    for r in got.collect():
        n, hit, found = brute(r["text"], items)
        assert r["_key"] == r["_text"] == r["_spans"] == r["_items"] == r["_Digest"] == "mine"
        assert (r["found"]["n_words"], sum(s["end"] - s["start"] for s in r["found"]["spans"]), set(r["found"]["items"])) == (n, hit, found)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert d.find_windows(no_documents(spark), bench, "found").count() == 0
    assert d.drop_contaminated(awkward(spark), bench).count() == awkward(spark).count()


def test_drop_keeps_clean_rows_and_columns(spark):
    docs = documents(spark).withColumn("_found", F.lit(1))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = d.drop_contaminated(docs, bench)
    bad = {r["doc_id"] for r in d.op4_decontaminate(spark, SF).where("contaminated").collect()}
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id") == rows(docs.where(~F.col("doc_id").isin(list(bad))), "doc_id")
