"""The trie of conversations against a plain version with sequences as keys."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from regionlens.llm import trie as t

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows, share=20):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role, digest, text))
    convs = {c: [(x[1], x[3]) for x in sorted(v)] for c, v in convs.items()}
    base = lambda c: c - int(np.fmod(c, share))
    h = lambda c: zlib.crc32(str(c).encode()) % 4
    return {c: convs.get(base(c), [])[: h(c)] + own[h(c) :] for c, own in convs.items()}


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(members) - 1) * (len(WORD.findall(k[-1][1])) if k else 0)
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids.get(k, [])), leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def run(spark, rows):
    return t.trie(t.heads_shared(t.ordered(spark.createDataFrame(rows, SCHEMA))))


def test_tables(spark):
    for sf in ("0.001", "0.01"):
        df = spark.read.parquet(f"/root/testdata/sf{sf}/conversations.parquet")
        want = brute(rebuilt([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]))
        assert got(t.op12_trie(spark, f"/root/testdata/sf{sf}")) == want


def awkward():
    rows = [(c, i, "user" if i % 2 else "assistant", f"same {i} words") for c in range(0, 60) for i in range(c % 5)]
    rows += [(c, None, None, None) for c in (3, 7, 100)] + [(5, 2, "user", "twice"), (5, 2, "user", "twice"), (5, 2, "a", "tie"), (5, 2, "a", "tie b")]
    rows += [(None, 1, "user", "no conversation"), (-21, 0, "user", ""), (-20, 0, "user", ""), (61, 0, "", "grüße 日本"), (9_000_000_000, 1, "user", "long " * 50_000)]
    rows += [(200, i, "user", str(i)) for i in range(700)] + [(220, i, "user", str(i)) for i in range(650)]
    return rows


def test_awkward(spark):
    assert got(run(spark, awkward())) == brute(rebuilt(awkward()))


def test_many_at_one_node(spark, monkeypatch):
    """A third of all conversations alike, a node with very many children, ids in several pieces, hubs in parts."""
    monkeypatch.setattr(t, "IDS", 7)
    monkeypatch.setattr(t, "CHILDREN", 5)
    rows = [(c, i, "user", f"copy {i}") for c in range(0, 6000, 20) for i in range(3)]
    rows += [(c, i, "user", "copy 0" if i == 0 else f"own {c} {i}") for c in range(10_000, 14_000, 20) for i in range(3)]
    assert got(run(spark, rows)) == brute(rebuilt(rows))


def test_full_sketch(spark, monkeypatch):
    """A sketch far too small proves hardly any prefix single: more is grouped, with the same rows."""
    monkeypatch.setattr(t, "MOST_COUNTERS", 8)
    monkeypatch.setattr(t, "LEAST_COUNTERS", 8)
    assert got(run(spark, awkward())) == brute(rebuilt(awkward()))


@pytest.mark.parametrize("counters", [1 << 9, 1 << 11, 1 << 13])
def test_single_below_unproven(spark, monkeypatch, counters):
    """Prefixes that a sketch of some load cannot prove single stand below proven ones."""
    monkeypatch.setattr(t, "MOST_COUNTERS", counters)
    monkeypatch.setattr(t, "LEAST_COUNTERS", min(counters, t.LEAST_COUNTERS))
    rows = awkward() + [(c, i, "user", f"own {c} {i}") for c in range(1000, 1300) for i in range(9)]
    assert got(run(spark, rows)) == brute(rebuilt(rows))


def test_sketch_never_too_low():
    digests = pd.Series([hashlib.sha256(str(i % 700).encode()).digest()[:16] for i in range(1000)])  # 300 of them twice
    parts = [pd.DataFrame({"node": digests[a : a + 130]}) for a in range(0, 1000, 130)]
    fills = [x for p in parts for x in t._filled(4096)(iter([p]))]
    whole = pd.concat(list(t._merged(iter(fills))))
    more = np.zeros((t.SKETCH_ROWS, 512), np.uint8)
    for row, _, bits in whole.itertuples(index=False):
        more[row] = np.frombuffer(bits, np.uint8)
    single = t.Sketch(4096, more).single(digests)
    twice = digests.duplicated(keep=False).to_numpy()
    assert not single[twice].any()
    assert single[~twice].mean() > 0.9


def test_one_and_none(spark):
    assert got(run(spark, [(7, 0, "user", "a b")])) == brute(rebuilt([(7, 0, "user", "a b")]))
    assert run(spark, []).collect() == []
    assert run(spark, [(None, 0, "user", "x")]).collect() == []


def test_with_turns(spark):
    """Nodes of unrebuilt conversations with their texts spell every conversation; other columns do not matter."""
    rows = [(c, i, "user", f"t{i if i < 2 else (c, i)}", "x") for c in range(6) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA + ", digest string")
    nodes = t.trie(t.ordered(df))
    texts = {(r.conv_id, r.depth): r.text for r in t.with_turns(nodes, df).collect()}
    assert len(texts) == 1 + 2 + 6 * 2
    assert texts[0, 0] is None and texts[0, 1] == "t0" and texts[0, 2] == "t1" and texts[4, 3] == "t(4, 2)"


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_end_digests(spark, n):
    df = spark.createDataFrame([(b"n", i) for i in range(n)], "node binary, conv bigint")
    want = [(b"n", hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest())] if n else []
    assert [(bytes(r.node), r.ends_sha256) for r in t.end_digests(df).collect()] == want
