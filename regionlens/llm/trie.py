"""A trie of conversations: one node per distinct sequence of first turns.

Every conversation becomes a chain of prefix digests, one a turn. A count-min sketch counts all prefixes: rows
of saturating counters (none, one, more) kept as two bitmaps, filled by the tasks and merged block by block.
Its estimates are never too low, so an estimate of one proves that no other conversation has the prefix. From
there on a conversation's nodes are its own, whatever the estimates of longer prefixes: their rows are made where
the prefix lies, and only prefixes that may be shared (and the first own one of each conversation, as a child of its
parent) shuffle for exact grouping. Subtree sums need no walk through the levels: what a node adds is laid on the path of its smallest
member, summed up along that conversation from its end, and then grouped per node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import positions, ship, table, written

SKETCH_ROWS = 4
MOST_COUNTERS = 1 << 24
"""Counters in a row of the sketch, at most (a bitmap of 2 MB a row); with more prefixes fewer are proven
single and more are grouped, with the same results."""
LEAST_COUNTERS = 1 << 12
BLOCK_BITS = 1 << 16
IDS = 4096
"""Conversation ids joined to one piece of text."""
CHILDREN = 1000
"""A node with more children (and more than a fourth of an even task's share) is joined to them in SALTS parts."""
SALTS = 32
SHARE = 20
"""The stated rebuilding: conversations take their first turns from the first one of each SHARE ids."""
WORD = r"[^\x20\x09-\x0D]+"
_ROOT = b"\0" * 16
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes of the SHA-256 of a role and a text."""
    named = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(named.cast("binary"), 256), 1, 32))


def ordered(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, digest, words) of every row with a conversation id: its 0-based place by turn (null first;
    equal turns by role and digest). No text crosses a shuffle."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = messages.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), role.alias("role"),
        turn_digest(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    return positions(rows, ["turn", "role", "digest"], ["conv"]).select("conv", "pos", "digest", "words")


def heads_shared(turns: DataFrame, share: int = SHARE) -> DataFrame:
    """Every conversation rebuilt: the first h turns of the first of its ``share`` ids (fewer if it has fewer),
    then its own ones after its first h, where h = crc32(id) mod 4; ids without any turn left keep a row with a
    null digest."""
    turns = written(turns, "turns")
    ids = turns.select("conv").distinct().withColumn("h", F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(4)))
    ids = written(ids, "ids")
    own = turns.join(ids, "conv").where("pos >= h").select("conv", "pos", "digest", "words")
    first = turns.where((F.col("pos") < 3) & (F.col("conv") % share == 0)).select(F.col("conv").alias("base"), "pos", "digest", "words")
    asked = ids.where("h > 0").select("conv", (F.col("conv") - F.col("conv") % share).alias("base"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("h") - 1)).alias("pos"))
    given = asked.join(first, ["base", "pos"]).select("conv", "pos", "digest", "words")
    marks = ids.select("conv", F.lit(-1).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("bigint").alias("words"))
    return own.union(given).union(marks)


_PREFIX = "conv bigint, depth bigint, node binary, parent binary, words bigint, ends boolean"


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Prefix digests of rows (conv, pos, digest, words) that come conversation by conversation. A row goes out
    when the next one shows whether the conversation ends; only the last prefix is held between rows."""
    last: list = []

    def rows(found: list) -> pd.DataFrame:
        return pd.DataFrame(found, columns=["conv", "depth", "node", "parent", "words", "ends"])

    for batch in batches:
        out = []
        for conv, digest, words in zip(batch["conv"].tolist(), batch["digest"], batch["words"].tolist(), strict=True):
            if not last or last[0] != conv:
                if last:
                    out.append((*last, True))
                last = [conv, 0, _ROOT, None, 0]
            if digest is not None:
                out.append((*last, False))
                _, depth, node, _, _ = last
                last = [conv, depth + 1, hashlib.sha256(node + digest).digest()[:16], node, words]
        yield rows(out)
    if last:
        yield rows([(*last, True)])


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, words, ends): every prefix of every conversation of ``turns`` (conv, pos,
    digest, words; a null digest is no turn), the root (depth 0) included; ``ends`` if it is all of it. A
    conversation is read as a sorted stream and never held."""
    ship(turns.sparkSession)
    dealt = turns.select("conv", "pos", "digest", "words").repartition("conv").sortWithinPartitions("conv", "pos")
    return dealt.mapInPandas(_chained, _PREFIX)


class Sketch:
    """Places of digests in the rows of the sketch, and the bitmap of counters above one."""

    def __init__(self, counters: int, more: np.ndarray | None = None):
        self.counters, self.more = counters, more  # (rows, counters / 8) bytes

    def places(self, digests: pd.Series) -> np.ndarray:
        both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        at = both[:, :1] + np.arange(SKETCH_ROWS, dtype=np.uint64) * (both[:, 1:] | np.uint64(1))
        return ((at >> np.uint64(20)) % np.uint64(self.counters)).astype(np.int64)

    def single(self, digests: pd.Series) -> np.ndarray:
        """True where some row's counter is one: the estimate proves a single prefix."""
        at = self.places(digests)
        bits = self.more[np.arange(SKETCH_ROWS), at >> 3] >> (at & 7) & 1
        return (bits == 0).any(axis=1)


def _filled(counters: int):
    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch, counts = Sketch(counters), np.zeros((SKETCH_ROWS, counters), np.uint8)
        for batch in batches:
            at = sketch.places(batch["node"]) if len(batch) else np.zeros((0, SKETCH_ROWS), np.int64)
            for r in range(SKETCH_ROWS):
                cells, n = np.unique(at[:, r], return_counts=True)
                counts[r, cells] = np.minimum(counts[r, cells] + np.minimum(n, 2), 2)
        block = min(BLOCK_BITS, counters)
        for r in range(SKETCH_ROWS):
            for b in range(0, counters, block):
                part = counts[r, b : b + block]
                if part.any():
                    yield pd.DataFrame({
                        "row": [r], "block": [b // block], "some": [np.packbits(part > 0, bitorder="little").tobytes()],
                        "more": [np.packbits(part > 1, bitorder="little").tobytes()],
                    })

    return fill


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each block of the sketch from those of all tasks, two at a time; the blocks of a partition (some of the
    sketch's, 16 KB each) are held."""
    held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for part in batches:
        for row, block, some, more in part.itertuples(index=False):
            a, b = np.frombuffer(some, np.uint8), np.frombuffer(more, np.uint8)
            if (row, block) in held:
                c, d = held[row, block]
                a, b = a | c, b | d | (a & c)
            held[row, block] = a, b
    yield pd.DataFrame([(*k, b.tobytes()) for k, (_, b) in held.items()], columns=["row", "block", "more"])


def screen(rows: DataFrame) -> Sketch:
    """The sketch of all prefixes of ``rows`` (node). Its size goes with their number up to MOST_COUNTERS a row;
    only its bitmap of counters above one (8 MB at most) comes to the driver."""
    n = max(rows.count(), 1)
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (4 * n - 1).bit_length()))
    ship(rows.sparkSession)
    parts = rows.select("node").mapInPandas(_filled(counters), "row int, block int, some binary, more binary")
    whole = parts.repartition("row", "block").mapInPandas(_merged, "row int, block int, more binary")
    more = np.zeros((SKETCH_ROWS, counters // 8), np.uint8)
    for r in whole.collect():  # at most SKETCH_ROWS x MOST_COUNTERS bits
        part = np.frombuffer(r["more"], np.uint8)
        more[r["row"], r["block"] * len(part) : (r["block"] + 1) * len(part)] = part
    return Sketch(counters, more)


def owned(rows: DataFrame, single: Column, above: Column) -> DataFrame:
    """``rows`` with ``own`` (from the first prefix that is proven single on, also where the sketch cannot prove a
    longer one) and ``first`` (the first own prefix below a shared one). ``single`` and ``above`` are the proofs of a
    prefix and its parent; only rows that are not proven by both are sorted by conversation."""
    rows = written(rows.withColumn("single", single).withColumn("edge", F.col("single") & (~above | F.col("parent").isNull())), "screened")
    before = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    open_ = rows.where("edge or not single").withColumn("_since", F.coalesce(F.max("edge").over(before), F.lit(False)))
    open_ = open_.select("*", (F.col("_since") | F.col("edge")).alias("own"), (F.col("edge") & ~F.col("_since") & F.col("parent").isNotNull()).alias("first"))
    settled = rows.where("single and not edge").select("*", F.lit(True).alias("own"), F.lit(False).alias("first"))
    return written(settled.union(open_.drop("_since")).drop("single", "edge"), "owned")


def _salted(big: DataFrame, small: DataFrame, key: str, hub: str, spread: str) -> DataFrame:
    """``big`` joined (left) to ``small`` on ``key``; keys marked ``hub`` in both are joined in SALTS parts, dealt by
    the hash of ``spread``."""
    salt = F.when(F.col(hub), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    copies = F.explode(F.when(F.col(hub), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    return big.withColumn("_salt", salt).drop(hub).join(small.withColumn("_salt", copies).drop(hub), [key, "_salt"], "left").drop("_salt")


def _joined_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of at most IDS ids of rows sorted by (node, conv): (node, first, ids)."""
    for batch in batches:
        node, conv = batch["node"].tolist(), batch["conv"].tolist()
        out, i = [], 0
        while i < len(node):
            j = i
            while j < len(node) and node[j] == node[i] and j - i < IDS:
                j += 1
            out.append((node[i], conv[i], ",".join(map(str, conv[i:j]))))
            i = j
        yield pd.DataFrame(out, columns=["node", "first", "ids"])


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the comma-joined ids of each node, from its pieces in order."""
    now, sha = None, None
    for batch in batches:
        out = []
        for node, ids in zip(batch["node"], batch["ids"], strict=True):
            if node != now:
                if now is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = node, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        yield pd.DataFrame(out, columns=["node", "ends_sha256"])
    if now is not None:
        yield pd.DataFrame({"node": [now], "ends_sha256": [sha.hexdigest()]})


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv): ids in numeric order, comma-joined. The ids are sorted by range
    and joined to pieces, so that the one task that must digest a node's ids in order reads few rows."""
    ship(ends.sparkSession)
    pieces = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInPandas(_joined_ids, "node binary, first bigint, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInPandas(_digested, "node binary, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations of ``turns`` (conv, pos, digest, words; a null digest
    stands for no turn): conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256 (see ``op12_trie``).

    The last turn of a node is turn ``depth`` of conversation ``conv_id``. Without conversations there is no node.
    """
    rows = written(prefixes(turns), "prefixes")
    sketch = screen(rows)
    counters, more = sketch.counters, sketch.more

    @F.pandas_udf("boolean")
    def single(node: pd.Series) -> pd.Series:
        return pd.Series(Sketch(counters, more).single(node) if len(node) else np.zeros(0, bool))

    rows = owned(rows, single("node"), single(F.coalesce("parent", "node")))
    none, empty = F.lit(0).cast("bigint"), F.lit(_EMPTY_SHA)
    one = F.lit(1).cast("bigint")
    tail = rows.where("own").select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("conv")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(F.col("ends"), none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(F.col("ends"), F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(empty).alias("ends_sha256"), "first", "parent",
    )
    stubs = rows.where("first").select("conv", "depth", "parent")
    shared = rows.where("not own")

    nodes = shared.groupBy("node").agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("words").alias("words")
    )
    nodes = written(nodes, "nodes")
    kids = nodes.select("parent").where("parent is not null").union(stubs.select("parent"))
    kids = kids.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", none)), "nodes")

    # what a node adds lies on the path of its smallest member; the sums run up from that one's end
    added = nodes.select(
        F.col("conv_id").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.when(F.col("n_children") == 0, one).otherwise(none).alias("leaf")
    )
    path = shared.select("conv", "depth", "node").join(added, ["conv", "depth"], "left").union(
        stubs.select("conv", "depth", F.lit(None).cast("binary"), none, one)
    )
    up = Window.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    path = path.select("node", F.sum(F.coalesce("saved", none)).over(up).alias("saved"), F.sum(F.coalesce("leaf", none)).over(up).alias("leaf"))
    below = path.where("node is not null").groupBy("node").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    ends = end_digests(shared.where("ends").select("node", "conv"))

    # the parent's smallest member; parents of very many children are joined in parts
    many = max(CHILDREN, (nodes.agg(F.sum("n_children")).first()[0] or 0) // (4 * nodes.sparkSession.sparkContext.defaultParallelism))
    hubs = F.broadcast(nodes.where(F.col("n_children") > many).select(F.col("node").alias("parent"), F.lit(True).alias("hub")))  # at most 4 a core
    mark = lambda df: df.join(hubs, "parent", "left").withColumn("hub", F.coalesce("hub", F.lit(False)))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") > many).alias("hub"))
    grouped = nodes.join(below, "node").join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
    grouped = _salted(mark(grouped), parents, "parent", "hub", "node")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    border = _salted(mark(tail.where("first").drop("parent_conv_id")), parents, "parent", "hub", "conv_id")
    inner = tail.where("not first")
    return grouped.select(*columns).union(border.select(*columns)).union(inner.select(*columns))


def with_turns(nodes: DataFrame, messages: DataFrame, **columns: str) -> DataFrame:
    """The nodes of conversations as they are (not rebuilt) with the role and text of their last turn: what a
    trainer reads to see each shared turn once. ``messages`` are the rows that ``ordered`` was given."""
    role, text = columns.get("role_col", "role"), columns.get("text_col", "text")
    conv, turn = columns.get("conv_col", "conv_id"), columns.get("turn_col", "turn")
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = messages.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"), r.alias("role"), turn_digest(r, t).alias("digest"), t.alias("text")
    )
    placed = positions(rows, ["turn", "role", "digest"], ["conv"])
    return nodes.join(placed.select(F.col("conv").alias("conv_id"), (F.col("pos") + 1).alias("depth"), "role", "text"), ["conv_id", "depth"], "left")


def op12_trie(spark, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs
    (members), n_children, n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, members
    less one times the words of the last text) and ends_sha256 (of the ids that end there).

    Null roles and texts are empty; rows with a null conv_id belong to no conversation. Rows of one
    conversation and turn stand by role and digest, repeated rows are turns of their own. Texts of any length are
    digested and counted whole. An empty table has no node.
    """
    return trie(heads_shared(ordered(table(spark, sf_dir, "conversations"))))
