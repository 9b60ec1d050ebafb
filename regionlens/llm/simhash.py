"""SimHash near-duplicates with deletion-variant signatures.

A 64-bit fingerprint is cut into three segments (22, 21 and 21 bits). Two fingerprints that differ in
at most 4 bits differ in at most 1 bit in one of the segments, so they agree on at least one variant
of that segment with one bit wildcarded. Every distinct fingerprint is indexed under its 64 variants;
fingerprints that meet under a variant are verified by their bit distance.

Copies share a fingerprint and are indexed once. Under one variant only a spanning forest of the
verified links is returned, never all pairs: pairs that are already connected need no test. A variant
with more than ``GROUP`` fingerprints is cut into blocks, and every pair of blocks is verified by a
task of its own, so the memory of a task is bounded and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, free_name, ship, table, utf8, written

SHINGLE = 4
MAX_BITS = 4
GROUP = 4096
_SEED = 42
_CHUNK = 1 << 15
#: Fixed: A-Z becomes a-z; bytes.split() then cuts at 0x20 and 0x09-0x0D.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Segments as (lowest bit, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a UTF-8 text, as an unsigned 64-bit number; 0 without words."""
    w = text.translate(_LOWER).split() if text else []
    if not w:
        return 0
    joined, k = b" ".join(w), min(shingle, len(w))
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, hashed = len(w) - k + 1, xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        j = min(n, i + _CHUNK)
        h = np.fromiter(
            (hashed(joined[a:b], _SEED) for a, b in zip(starts[i:j].tolist(), ends[i + k - 1 : j + k - 1].tolist(), strict=True)),
            np.uint64, j - i,
        )
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series(np.array([fingerprint(None if t is None else bytes(t)) for t in batch], np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, out: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``out``, the fingerprint as a signed long. Null and empty texts have 0."""
    ship(docs.sparkSession)
    return docs.withColumn(out, F.pandas_udf(_fingerprints, "bigint").asNondeterministic()(utf8(F.col(text_col))))


def variants(fp: str = "fp") -> list:
    """The 64 one-wildcard variants: the wildcard's place and the segment without that bit."""
    out = []
    for low, width in SEGMENTS:
        part = F.shiftrightunsigned(F.col(fp), low).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            out.append(part.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << bit))) + F.lit((low + bit) << 22))
    return out


def forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning forest (index pairs) of the graph that links fingerprints at most ``bits`` apart."""
    label, links = np.arange(len(fps)), []
    for i in range(len(fps)):
        rest = np.flatnonzero(label != label[i])
        if not len(rest):
            break
        near = rest[np.bitwise_count(fps[rest] ^ fps[i]) <= bits]
        if len(near):
            found, first = np.unique(label[near], return_index=True)
            links += [(i, int(j)) for j in near[first]]
            label[np.isin(label, found)] = label[i]
    return links


def _grouped_links(batches: Iterator[pd.DataFrame], bits: int, most: int) -> Iterator[pd.DataFrame]:
    """Links among the fingerprints of each key; batches are sorted by key. A key with more than
    ``most`` rows is passed on instead, its rows in ``over``."""
    held_key, held, over = None, [], False  # the key that may go on in the next batch

    def out(a, b, over):
        return pd.DataFrame({"a": np.asarray(a, np.int64), "b": np.asarray(b, np.int64), "over": np.asarray(over, np.int64)})

    def closed(key, parts, passed):
        fps = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        if passed:
            return out(fps.view(np.int64), fps.view(np.int64), np.full(len(fps), key))
        links = forest(fps, bits)
        a, b = [fps[[x[k] for x in links]].view(np.int64) if links else [] for k in (0, 1)]
        return out(a, b, np.full(len(links), -1))

    for batch in batches:
        key, fp = batch["key"].to_numpy(np.int64), batch["fp"].to_numpy(np.int64).view(np.uint64)
        if not len(key):
            continue
        cuts = np.flatnonzero(np.diff(key)) + 1
        start, end = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        if key[0] == held_key:
            held.append(fp[: end[0]])
            start, end = start[1:], end[1:]
            if sum(map(len, held)) > most:
                yield closed(held_key, held, True)
                held, over = [], True
        if not len(start):
            continue
        if held_key is not None:
            yield closed(held_key, held, over)
        held_key, held, over = int(key[-1]), [fp[start[-1] :]], False
        start, end = start[:-1], end[:-1]
        size = end - start
        two = start[size == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits]
        found = [out(fp[two].view(np.int64), fp[two + 1].view(np.int64), np.full(len(two), -1))]
        # of larger groups, only those with a link are looked at one by one
        s, e = start[(size > 2) & (size <= 64)], end[(size > 2) & (size <= 64)]
        linked, apart = np.zeros(len(s), bool), 1
        live = np.flatnonzero(e - s > apart)
        while len(live):
            at = s[live]
            for shift in range(int((e[live] - at).max()) - apart):
                ok = at + shift + apart < e[live]
                linked[live[ok]] |= np.bitwise_count(fp[at[ok] + shift] ^ fp[at[ok] + shift + apart]) <= bits
            apart += 1
            live = live[(e[live] - s[live] > apart) & ~linked[live]]
        large = np.flatnonzero(size > 64)
        for a, b in [*zip(s[linked], e[linked], strict=True), *zip(start[large], end[large], strict=True)]:
            found.append(closed(int(key[a]), [fp[a:b]], b - a > most))
        yield pd.concat(found)
    if held_key is not None:
        yield closed(held_key, held, over)


def links(distinct: DataFrame, bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """Enough verified links (``a``, ``b``) to connect all fingerprints ``fp`` at most ``bits`` <= 4
    apart. ``distinct`` has each fingerprint once."""
    if bits > 4:
        raise ValueError("three segments find distances up to 4 bits")
    index = distinct.select(F.explode(F.array(*variants())).alias("key"), "fp")

    def run(df: DataFrame, keys: list[str], most: int) -> DataFrame:
        dealt = df.repartition(*keys).sortWithinPartitions(*keys)
        return dealt.mapInPandas(lambda it: _grouped_links(it, bits, most), "a bigint, b bigint, over bigint")

    found = written(run(index, ["key"], group), "links")
    near, over = found.where("over < 0").select("a", "b"), found.where("over >= 0")
    if not over.isEmpty():
        blocks = over.groupBy("over").agg(F.ceil(F.count("*") / F.lit(group / 2)).alias("n"))
        rows = over.join(blocks, "over").withColumn("i", F.pmod(F.xxhash64("a"), F.col("n")))
        rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
        pair = F.xxhash64("over", F.least("i", "j"), F.greatest("i", "j"))
        # xxhash64 names the pair of blocks; two pairs under one name only verify more
        near = near.union(run(rows.select(pair.alias("key"), F.col("a").alias("fp")), ["key"], 1 << 62).select("a", "b"))
    return near


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``id``, ``fp`` (signed long), ``root`` (a fingerprint that names the
    group) and ``component`` (smallest non-null id whose fingerprint is reachable over links of at
    most ``bits`` bits).

    Null, empty and blank texts have fingerprint 0 and are linked like any other. A null id never
    names a component unless all ids of the component are null; repeated rows stay repeated.
    """
    rows = written(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "fp").select("id", "fp"), "fingerprints")
    # each of them becomes 64 rows of the index where it is read
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct", 64 * rows.count())
    comp = components(links(distinct, bits))
    named = distinct.join(comp, distinct["fp"] == comp["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    roots = named.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = written(named.join(roots, "root").select("fp", "root", "component"), "classes", distinct.count())
    return rows.join(by_fp, "fp").select("id", "fp", "root", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id (of rows of the group that share
    it, one with the smallest fingerprint). An id on rows of several groups stands for itself in each of
    them. A group whose ids are all null keeps one row."""
    near = written(near_duplicates(docs, id_col, text_col), "near")
    chosen = near.where("id is not null").groupBy("root").agg(F.min(F.struct("id", "fp")).alias("x")).select("x.id", "x.fp")
    times = near.groupBy("id").agg(F.count("*").alias("n"))
    keep = written(chosen.join(times, "id"), "kept", near.count())
    key, n = free_name(docs.columns, "_component"), free_name(docs.columns, "_rows")
    fp = free_name([*docs.columns, key, n], "_fp")
    # by shuffling at every size: the list of those kept grows with the documents
    once = keep.where("n = 1").select(F.col("id").alias(key))
    kept = docs.join(once.hint("merge"), F.col(id_col) == F.col(key)).select(*docs.columns)
    often = keep.where("n > 1").select(F.col("id").alias(key), F.col("fp").alias(n))
    if not often.isEmpty():  # ids that repeat: the fingerprint tells their rows apart
        rows = docs.join(often.select(key).distinct(), F.col(id_col) == F.col(key), "left_semi")
        rows = with_fingerprint(rows, fp, text_col).join(often, (F.col(id_col) == F.col(key)) & (F.col(fp) == F.col(n)))
        kept = kept.union(rows.dropDuplicates([key, n]).select(*docs.columns))
    nameless = near.where("component is null").select(F.col("fp").alias(key), F.col("root").alias(n)).distinct()
    if nameless.isEmpty():
        return kept
    rest = with_fingerprint(docs.where(F.col(id_col).isNull()), fp, text_col)
    rest = rest.join(nameless, F.col(fp) == F.col(key)).dropDuplicates([n])
    return kept.union(rest.select(*docs.columns))


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
