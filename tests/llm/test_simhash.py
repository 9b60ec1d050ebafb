import re

import numpy as np
import pytest
import xxhash
from llm_cases import SF, awkward, documents, no_documents
from pyspark.sql import functions as F

from regionlens.llm import simhash as s


def brute_fingerprint(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=4):
    """Smallest member index of each fingerprint's component, by comparing all pairs."""
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= bits and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_query_against_brute_force(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in documents(spark).collect())
    fps = [brute_fingerprint(t) for _, t in docs]
    label = brute_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in s.op5_simhash(spark, SF).collect()}
    assert got == {i: (f"{fp:016x}", docs[k][0]) for (i, _), fp, k in zip(docs, fps, label, strict=True)}


def test_fingerprint_cases():
    for text in ["", "one", "One two THREE", "a b c d", "É é A", "x " * 70_000, "tab\tand\x0bspaces kept"]:
        assert s.fingerprint(text.encode()) == brute_fingerprint(text)
    assert s.fingerprint(None) == 0


def planted(n=300, seed=3):
    """Balls of fingerprints around centres: many distances around the limit, many per variant."""
    rng = np.random.default_rng(seed)
    out = set()
    for _ in range(6):
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(n // 6):
            x = centre
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            out.add(x)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("group", [4096, 16])
def test_links_connect_what_all_pairs_connect(spark, group):
    fps = planted()
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    links = s.links(df, group=group)
    for a, b in links.distinct().collect():
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 4
    comp = {r["node"]: r["component"] for r in s.components(links).collect()}
    mine = [comp.get(int(x), int(x)) for x in fps.view(np.int64)]
    label = brute_components(fps)
    assert len({*zip(mine, label, strict=True)}) == len(set(mine)) == len(set(label))


def test_forest_has_no_more_links_than_nodes():
    fps = planted(600)
    links = s.forest(fps, 4)
    assert len(links) < len(fps)
    label = brute_components(fps)
    assert len(fps) - len(links) == len(set(label))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    got = {tuple(r) for r in s.components(edges).collect()}
    assert got == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_awkward_rows(spark):
    docs = awkward(spark).withColumn("fp", F.lit("mine")).withColumn("component", F.lit(0))
    near = s.near_duplicates(docs)
    assert near.count() == docs.count()
    got = {(r["id"], r["component"]) for r in near.collect()}
    # null, empty and blank texts share fingerprint 0
    assert {(1, 1), (2, 1), (3, 1), (5, 5)} <= got
    kept = s.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect())
    assert ids == [(False, 0), (True, 1), (True, 4), (True, 5), (True, 6), (True, 7), (True, 8)]


def test_empty_table(spark):
    assert s.near_duplicates(no_documents(spark)).count() == 0
    assert s.keep_one(no_documents(spark)).count() == 0


def test_an_id_on_rows_of_several_groups(spark):
    """Choices are made per group, by id and fingerprint."""
    a, b = "one two three four five six seven eight nine", "completely other words that stand in another text here"
    rows = [(1, a, "first"), (1, b, "second"), (2, a, "third"), (3, b, "fourth"), (3, "a third text of its own with some more words", "fifth"), (3, b, "sixth")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = sorted((r["doc_id"], r["text"]) for r in s.keep_one(docs).collect())
    assert kept == sorted([(1, a), (1, b), (3, "a third text of its own with some more words")])
