"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words, the patterns are the windows of the test items. For each pattern length a
shift table over blocks of two words says how far the search may jump; a block with shift 0 selects
a bucket of patterns that end with it (split by their first block), and comparing the words
themselves confirms an occurrence. Windows shorter than ``window`` (whole short items) have tables
of their own, so that they do not shorten the jumps of the others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, ship, table, utf8, written

WINDOW = 10
BLOCK_WINDOWS = 500_000
"""Windows per search table: the bound of what is broadcast at once."""

#: Fixed: A-Z becomes a-z, digits, letters and all bytes of non-ASCII characters stay, the rest separates words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_FOUND = "struct<n_words: bigint, spans: array<struct<start: bigint, end: bigint>>, items: array<bigint>>"


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of ASCII letters, digits and non-ASCII characters of UTF-8 text."""
    return text.translate(_WORDS).split() if text else []


class Searcher:
    """Wu-Manber tables for patterns of one length ``m`` (in words)."""

    def __init__(self, m: int, patterns: dict[tuple, list]):
        self.m, self.block = m, min(2, m)
        self.far = m - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for p, items in patterns.items():
            for j in range(self.block - 1, m):
                key = p[j - 1 : j + 1] if self.block == 2 else p[j]
                self.shift[key] = min(self.shift.get(key, self.far), m - 1 - j)
            last = p[-2:] if self.block == 2 else p[-1]
            self.bucket.setdefault(last, {}).setdefault(p[: self.block], []).append((p, items))

    def find(self, w: list[bytes]) -> Iterator[tuple[int, list]]:
        """(first word, items) of every occurrence."""
        m, n, far, shift, bucket, pair = self.m, len(w), self.far, self.shift.get, self.bucket, self.block == 2
        i = m - 1
        while i < n:
            key = (w[i - 1], w[i]) if pair else w[i]
            jump = shift(key, far)
            if jump:
                i += jump
                continue
            at = i - m + 1
            for p, items in bucket.get(key, {}).get(tuple(w[at : at + self.block]), ()):
                if tuple(w[at : i + 1]) == p:
                    yield at, items
            i += 1


def searchers(items: Iterable[tuple[int | None, bytes | None]], window: int = WINDOW) -> list[Searcher]:
    by_length: dict[int, dict[tuple, list]] = {}
    for item, text in items:
        w = words_of(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(w[i : i + m]), []).append(item)
    return [Searcher(m, p) for m, p in sorted(by_length.items())]


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search(text: bytes | None, tables: list[Searcher]) -> tuple:
    """(number of words, merged spans of hit words, ids of the items found) of one text."""
    w = words_of(text)
    spans, items = [], set()
    for s in tables:
        for at, ids in s.find(w):
            spans.append((at, at + s.m))
            items.update(ids)
    return len(w), merged(spans), sorted(i for i in items if i is not None)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> Iterator[list[Searcher]]:
    """Search tables of consecutive blocks of items with about ``most`` windows each."""
    held, n = [], 0
    rows = benchmark.select(F.col(item_col).cast("bigint"), utf8(F.col(text_col))).where(F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        text = bytes(text)
        held.append((item, text))
        n += max(1, len(words_of(text)) - window + 1)
        if n >= most:
            yield searchers(held, window)
            held, n = [], 0
    if held:
        yield searchers(held, window)


def _searched(df: DataFrame, text_col: str, tables: list[Searcher], out: str) -> DataFrame:
    shared = ship(df.sparkSession).sparkContext.broadcast(tables)

    @F.pandas_udf(_FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            rows = [search(None if t is None else bytes(t), own) for t in batch]
            yield pd.DataFrame({
                "n_words": [r[0] for r in rows],
                "spans": [[{"start": a, "end": b} for a, b in r[1]] for r in rows],
                "items": [r[2] for r in rows],
            }, columns=["n_words", "spans", "items"])

    return df.withColumn(out, found.asNondeterministic()(utf8(F.col(text_col))))


def _merge(spans: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b} for a, b in merged((x["start"], x["end"]) for x in s)] for s in spans], dtype=object)


def find_windows(
    docs: DataFrame, benchmark: DataFrame, out: str, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, spans (merged word spans ``[start, end)``
    inside occurrences of item windows) and items (ascending ids of the items with occurring windows).

    Whole texts are searched. The test set is taken in blocks of about ``block_windows`` windows; one
    block is one pass over the documents with one broadcast table, and with several blocks the hits
    of a text are joined by its digest. Null texts and texts without words: 0 words, no span. Items
    without words never occur; an item without an id marks words but is not listed; a repeated item id
    is listed once. Rows and all other columns stay, repeated rows too.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_windows)
    first = next(blocks, [])
    more = next(blocks, None)
    if more is None:
        return _searched(docs, text_col, first, out)
    key = F.sha2(utf8(F.col(text_col)), 256)
    passes = []
    for tables in [first, more]:
        passes.append(_hits(docs, key, text_col, tables))
    for tables in blocks:
        passes.append(_hits(docs, key, text_col, tables))
    hits = passes[0]
    for p in passes[1:]:
        hits = hits.union(p)
    hits = hits.groupBy("_text").agg(
        _flat("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items")
    )
    own, digest, spans, items = (free_name([*docs.columns, out], x) for x in ("_key", "_digest", "_spans", "_items"))
    merge = F.pandas_udf(_merge, "array<struct<start: bigint, end: bigint>>")
    hits = hits.select(F.col("_text").alias(digest), merge("_spans").alias(spans), F.col("_items").alias(items))
    base = _searched(docs, text_col, [], out)
    joined = base.withColumn(own, key).join(hits, F.col(own) == F.col(digest), "left")
    whole = F.struct(
        F.col(out)["n_words"].alias("n_words"), F.coalesce(F.col(spans), F.col(out)["spans"]).alias("spans"),
        F.coalesce(F.col(items), F.col(out)["items"]).alias("items"),
    )
    return joined.select(*[F.col(c) for c in docs.columns], whole.alias(out))


def _flat(name: str):
    return F.flatten(F.collect_set(name)).alias(f"_{name}")


def _hits(docs: DataFrame, key, text_col: str, tables: list[Searcher]) -> DataFrame:
    """Digest, spans and items of the texts with a hit, one row per text, written at once."""
    found = _searched(docs.select(key.alias("_text"), F.col(text_col)), text_col, tables, "_found")
    found = found.where(F.size("_found.spans") > 0).select("_text", F.col("_found.spans").alias("spans"), F.col("_found.items").alias("items"))
    return written(found.dropDuplicates(["_text"]), "decontam")


def hit_words(spans):
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Per document: words, hit words, items found, and whether any test window occurs in it."""
    found = find_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), "found")
    ids = F.array_join(F.array_sort(F.transform("found.items", lambda i: i.cast("string"))), ",")
    n_hit = hit_words(F.col("found.spans"))
    return found.select(
        "doc_id", F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of a test item occurs, with their own columns."""
    out = free_name(docs.columns, "_found")
    kept = find_windows(docs, benchmark, out).where(F.size(F.col(out)["spans"]) == 0)
    return kept.select(*docs.columns)
