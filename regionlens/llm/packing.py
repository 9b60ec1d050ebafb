"""Best-fit packing of token sequences by minimum bin slack.

Spark tokenizes the texts, cuts the long ones and counts the pieces by length. The plan needs only
that histogram (at most ``capacity`` numbers): per bin, the longest length left is fixed and a bitset
subset-sum over the available lengths finds the fullest combination; it is removed as often as the
counts allow. The n-th piece of a length then takes the n-th place that the plan gives to the length,
by a join of the pieces' positions with the plan's ranges.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import positions, ship, table, written

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
_CACHE = 400_000
_PIECES = "array<struct<start: bigint, length: bigint, ids_crc32: bigint>>"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_TAIL = ".,;:!?|%$&*#"
#: Fixed: classes of Latin-1 characters as the tokenizer splits them: letters and numbers, white space, the
#: two marks that are set apart here, separators that Python takes for white space and the tokenizer not, others.
_CLASS = bytes(
    ord("a") if chr(i).isalpha() or chr(i).isnumeric() else ord(".") if chr(i) in ".," else ord("?") if 0x1C <= i <= 0x1F else ord(" ") if chr(i).isspace() else ord("!")
    for i in range(256)
)


def _chunks(text: str) -> list[str]:
    """Pieces of a text over whose ends no pre-token of the tokenizer reaches.

    In a text of Latin-1 characters (whose accents are composed already) case is lost as the tokenizer
    does it, and full stops and commas that touch no other mark are pieces of their own.
    """
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return text.replace("\n", " ").split(" ")
    kinds = raw.translate(_CLASS)
    if b"?" in kinds:
        return text.replace("\n", " ").split(" ")
    text = text.lower()
    if b"!." not in kinds and b".!" not in kinds and b".." not in kinds:
        text = text.replace(".", " . ").replace(",", " , ")
    return text.split()


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordIds:
    """Token ids (little-endian unsigned 32-bit) of texts: those of their pieces, joined.

    The ids of a bounded number of pieces are kept, those that came up last. New pieces that are
    letters, with marks behind or not, are single pre-tokens or two; these are encoded many at a time,
    as a pre-token's last token is the one that ends a word. Other pieces are encoded one by one.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _learn(self, parts: list[str]) -> None:
        """Ids of parts that are one pre-token each."""
        for i in range(0, len(parts), 2000):
            some = parts[i : i + 2000]
            ids = np.array(self.tok.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(some) or stop[-1] != len(ids):
                self._learn_singly(some)
                continue
            raw, a = ids.tobytes(), 0
            for p, b in zip(some, (stop * 4).tolist(), strict=True):
                self.kept[p] = raw[a:b]
                a = b

    def _learn_singly(self, pieces: list[str]) -> None:
        for p, e in zip(pieces, self.tok.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            self.kept[p] = array("I", e.ids).tobytes()

    def of(self, texts: list[str | None]) -> list[bytes]:
        split = [_chunks(t) if t else [] for t in texts]
        every = set().union(*split) if split else set()
        if len(self.kept) > _CACHE:
            self.older, self.kept = self.kept, {"": b""}
        kept, older = self.kept, self.older
        plain, halves, other = [], [], []
        for c in every.difference(kept):
            if (ids := older.get(c)) is not None:
                kept[c] = ids
            elif c.isalpha() and c.islower() and (c.isascii() or _latin(c)):
                plain.append(c)
            else:
                body = c.rstrip(_TAIL)
                if (body.isalpha() or not body) and _latin(c):
                    halves.append((c, body.lower(), c[len(body) :]))
                else:
                    other.append(c)
        self._learn(plain)
        self._learn([p for p in {p for _, *both in halves for p in both} if p not in kept])
        for c, body, tail in halves:
            kept[c] = kept[body] + kept[tail]
        self._learn_singly(other)
        return [b"".join(map(kept.__getitem__, s)) for s in split]


_tokenizers: dict[str, WordIds] = {}


def token_pieces(path: str, capacity: int = CAPACITY):
    """UDF: the pieces of a text's ids and a final id 0."""

    @F.pandas_udf(_PIECES)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _tokenizers:  # once a Python worker
            _tokenizers[path] = WordIds(path)
        ids, step = _tokenizers[path], 4 * capacity
        for batch in batches:
            out = []
            texts = batch.tolist()
            for i in range(0, len(texts), 1000):
                for raw in ids.of(texts[i : i + 1000]):
                    raw += b"\0\0\0\0"
                    out.append([
                        {"start": a // 4, "length": len(p) // 4, "ids_crc32": zlib.crc32(p)}
                        for a in range(0, len(raw), step) for p in (raw[a : a + step],)
                    ])
            yield pd.Series(out, dtype=object)

    return pieces.asNondeterministic()


def combination(counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(length, how many) of the fullest bin that holds the longest length left; longer lengths first."""
    lengths = np.flatnonzero(counts)[::-1].tolist()
    longest = lengths[0]
    room = capacity - longest
    reach, mask = 1, (1 << (room + 1)) - 1
    steps = []  # what could be reached before each length
    for length in lengths:
        if length > room or reach >> room & 1:
            continue
        most = min(int(counts[length]) - (length == longest), room // length)
        took = 1
        while most > 0 and not reach >> room & 1:
            n = min(took, most)
            steps.append((length, n, reach))
            reach = (reach | reach << (length * n)) & mask
            most -= n
            took *= 2
    left = reach.bit_length() - 1
    used = {longest: 1}
    for length, n, before in reversed(steps):
        if not before >> left & 1:
            used[length] = used.get(length, 0) + n
            left -= length * n
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Minimum bin slack over a histogram of lengths. Rows (length, first, last, step, bin, offset):
    the pieces of ``length`` with positions first..last-1 go to bins ``bin + (position - first) // step``,
    at ``offset + ((position - first) % step) * length``."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    given, rows, bins = np.zeros(capacity + 1, np.int64), [], 0
    while left.any():
        used = combination(left, capacity)
        times = min(int(left[length]) // n for length, n in used)
        offset = 0
        for length, n in used:
            rows.append((length, int(given[length]), int(given[length]) + n * times, n, bins, offset))
            given[length] += n * times
            left[length] -= n * times
            offset += n * length
        bins += times
    return rows


_PLAN = "_length bigint, _first bigint, _last bigint, _step bigint, _bin bigint, _offset bigint"


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32; lengths from 1 to ``capacity``) with
    ``sequence_id`` and ``offset``. An empty table gives an empty result."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    placed = positions(pieces, ["doc_id", "piece", "start", "ids_crc32"], ["length"], "_pos")
    # the plan's ranges: a few for each length; the last range at or before a position holds it
    rows = plan(counts, capacity)
    ranges = spark.createDataFrame(rows, _PLAN)
    width = 1 << 12
    # ranges are cut where a block of positions ends, so that the join has equal keys
    cut = ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_first") / width), F.floor((F.col("_last") - 1) / width))))
    at = F.col("_pos")
    joined = placed.withColumn("_b", F.floor(at / width)).join(
        cut, (F.col("length") == F.col("_length")) & (F.col("_b") == F.col("_block")) & (at >= F.col("_first")) & (at < F.col("_last"))
    )
    rank = at - F.col("_first")
    return joined.select(
        *pieces.columns,
        (F.col("_bin") + F.floor(rank / F.col("_step"))).cast("bigint").alias("sequence_id"),
        (F.col("_offset") + rank % F.col("_step") * F.col("length")).cast("bigint").alias("offset"),
    )


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of a document. A null text is empty: one piece with the final id 0."""
    ship(docs.sparkSession)
    path = tokenizer_path(tokenizer)
    found = docs.select(
        F.col(id_col).alias("doc_id"), F.posexplode(token_pieces(path, capacity)(F.col(text_col))).alias("piece", "p")
    )
    return found.select("doc_id", "piece", "p.*")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequences. Documents with the same or no id stay apart as rows."""
    return pack(written(tokenized(docs, id_col, text_col, tokenizer, capacity), "pieces"), capacity)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
