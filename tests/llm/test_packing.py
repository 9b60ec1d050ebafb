import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import SF, awkward, documents, no_documents
from tokenizers import Tokenizer

from regionlens.llm import packing as p

TOK = Tokenizer.from_file(p.tokenizer_path())


def ids_of(text):
    return np.array([*TOK.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check(rows, docs, capacity=2048):
    """Every piece once, right ids, no gap and no overflow in any sequence. Returns the sequences used."""
    want = Counter()
    for i, t in docs:
        ids = ids_of(t)
        want.update((i, k, s, len(x), zlib.crc32(x.tobytes())) for k, s in enumerate(range(0, len(ids), capacity)) for x in [ids[s : s + capacity]])
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_query_is_a_round_trip_and_near_the_bound(spark):
    rows = p.op9_packing(spark, SF).collect()
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    bound = -(-sum(r["length"] for r in rows) // 2048)
    assert check(rows, docs) <= bound + 1


def test_awkward_rows(spark):
    docs = awkward(spark, ["don't stop, it's 12,5% <b>x</b>", "a" * 5000, "ﬁne ŉ Ⅷ İstanbul ΟΔΟΣ", "é ́x a b c", "<|endoftext|> x<|startoftext|>y", "ALL CAPS!! $$$ |"])
    check(p.pack_documents(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert p.pack_documents(no_documents(spark)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), min_size=1, max_size=12))
def test_plan_places_every_piece_once(counts):
    rows = p.plan(counts, 40)
    used, fill = Counter(), defaultdict(dict)
    for length, first, last, step, start, offset in rows:
        assert first == used[length]
        used[length] = last
        for pos in range(first, last):
            b = start + (pos - first) // step
            at = offset + (pos - first) % step * length
            assert at not in fill[b]
            fill[b][at] = length
    assert used == Counter(counts)
    for b in fill.values():
        at = 0
        for offset in sorted(b):
            assert offset == at
            at += b[offset]
        assert at <= 40


def subset_sums(counts, longest, room):
    """All sums of the other lengths that fit, by brute force."""
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n - (length == longest) + 1) if s + k * length <= room}
    return sums


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=7))
def test_combination_has_the_least_slack(counts):
    left = np.zeros(31, np.int64)
    for length, n in counts.items():
        left[length] = n
    used = p.combination(left, 30)
    longest = max(counts)
    assert used[0][0] == longest and all(n <= counts[length] for length, n in used)
    assert sum(length * n for length, n in used) == longest + max(subset_sums(counts, longest, 30 - longest))
