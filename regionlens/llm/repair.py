"""Repair of conversations by cheapest edits: bidirectional Dijkstra over the edit lattice.

A lattice node is a place between two messages and what the kept messages before it end with: nothing yet,
system, user or assistant. Arcs keep, rerole or delete the next message or insert an empty one, so that every
path from the first node to an end after the last message spells a conversation of roles ``(s?(ua)+)?``. One
heap searches from the front, one from the end; both go on until they cannot meet more cheaply or at the same
cost, and among the cheapest paths through all meeting arcs the one with the least audit in ASCII order is taken.

Messages are symbols here (role and fault, one character); texts only pass by in order, for the result. A
conversation is cut into blocks of BLOCK messages: the costs between the ends of each block are found block
by block, folded from the end to what remains to be paid after each block, and each block is then searched
with these costs at its end. A conversation of one block, as nearly all are, is one search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import positions, ship, table, written

BLOCK = 4096
SPACES = " \t\n\x0b\x0c\r"
_STOPS = ".!?"
RERO, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_SYMBOLS = "abcdefghijklmnop"
"""Initial (s, u, a, other) plus 4 times the fault (none, truncated, duplicate, blank)."""
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
"""The state after an inserted or reroled message."""
_KEEP = ({0: _SYSTEM, 1: _USER}, {1: _USER}, {2: _ASSISTANT}, {1: _USER})
"""The states after a kept message of each initial, where it may stand."""
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}
_FAR = 1 << 60
_END = [0, _FAR, _FAR, 0]


def _arcs(symbols: str, i: int, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, place, state) of the arcs out of a node, in the order of the edits' letters."""
    out = []
    if i < len(symbols):
        fault, initial = divmod(_SYMBOLS.index(symbols[i]), 4)
        out.append(("D", DELETE, i + 1, state))
    out.append(("I", INSERT, i, _NEXT[state]))
    if i < len(symbols) and fault < 2:
        more = TRUNCATED * fault
        if initial in _KEEP[state]:
            out.append(("K", more, i + 1, _KEEP[state][initial]))
        out.append(("R", RERO + more, i + 1, _NEXT[state]))
    return out


def _arcs_in(symbols: str, i: int, state: int) -> list[tuple[int, int, int]]:
    """(cost, place, state) of the nodes with an arc into a node."""
    out = [(INSERT, i, s) for s in range(4) if _NEXT[s] == state]
    if i:
        fault, initial = divmod(_SYMBOLS.index(symbols[i - 1]), 4)
        out.append((DELETE, i - 1, state))
        if fault < 2:
            more = TRUNCATED * fault
            out += [(more, i - 1, s) for s in range(4) if _KEEP[s].get(initial) == state]
            out += [(RERO + more, i - 1, s) for s in range(4) if _NEXT[s] == state]
    return out


def cheapest(symbols: str, entry: int = _START, after: list[int] | None = None) -> tuple[int, str, int]:
    """(cost, audit, last state) of the cheapest edits of the messages ``symbols`` from the state ``entry``, where
    leaving in state x costs ``after[x]`` more (not counted in the cost returned); the least audit of these. Where
    no edits lead to any end, the cost is _FAR."""
    after, n = after or _END, len(symbols)
    front, back = {(0, entry): 0}, {(n, x): c for x, c in enumerate(after) if c < _FAR}
    heap, reverse = [(0, 0, entry)], []
    for (i, x), c in back.items():
        heappush(reverse, (c, -i, x))
    done, closed = {}, {}  # settled from the front, in order; from the end
    best = back.get((0, entry), _FAR)
    while heap and reverse and heap[0][0] + reverse[0][0] <= best:
        if heap[0][0] <= reverse[0][0]:
            d, i, s = heappop(heap)
            if (i, s) in done:
                continue
            done[i, s] = d
            for _, c, j, t in _arcs(symbols, i, s):
                if d + c < front.get((j, t), _FAR):
                    front[j, t] = d + c
                    heappush(heap, (d + c, j, t))
                best = min(best, d + c + back.get((j, t), _FAR))
        else:
            d, i, s = heappop(reverse)
            i = -i
            if (i, s) in closed:
                continue
            closed[i, s] = d
            for c, j, t in _arcs_in(symbols, i, s):
                if d + c < back.get((j, t), _FAR):
                    back[j, t] = d + c
                    heappush(reverse, (d + c, -j, t))
                best = min(best, d + c + front.get((j, t), _FAR))
    if best >= _FAR:
        return _FAR, "", entry
    # what remains to be paid from every node on a cheapest path: from the reverse search, and from there
    # back over the meeting arcs through the nodes of the front (equal costs were settled place by place)
    rest = closed | {(n, x): c for x, c in enumerate(after) if done.get((n, x), _FAR) + c == best}
    for (i, s), d in reversed(done.items()):
        if (i, s) not in rest:
            for _, c, j, t in _arcs(symbols, i, s):
                if d + c + rest.get((j, t), _FAR) == best:
                    rest[i, s] = best - d
                    break
    i, s, spent, audit = 0, entry, 0, []
    while i < n or spent + after[s] != best:
        for edit, c, j, t in _arcs(symbols, i, s):
            if spent + c + rest.get((j, t), _FAR) == best:
                audit.append(edit)
                i, s, spent = j, t, spent + c
                break
        else:
            raise AssertionError(f"no cheapest edit after {len(audit)} of {symbols!r}")
    return spent, "".join(audit), s


def damaged(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with the stated damage, by crc32(``conv_id:turn``) mod 20: 0 drops a row, 1
    empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the
    user's. A null counts as one space, in the name, the role and the text."""
    conv, turn = F.col(conv_col).cast("bigint"), F.col(turn_col).cast("bigint")
    named = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    rows = messages.select(
        conv.alias("conv_id"), turn.alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
        F.pmod(F.crc32(named.cast("binary")), F.lit(20)).alias("kind"),
    ).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("_n", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def conv_key(conv: Column) -> Column:
    """The id as text, one space for null: never null."""
    return F.coalesce(conv.cast("bigint").cast("string"), F.lit(" "))


def symbols_of(rows: DataFrame) -> DataFrame:
    """(conv, block, symbols) of placed rows (conv, pos, role, text), at most BLOCK symbols a row."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    light = written(rows.select(
        "conv", "pos", F.when(end == "", 3).when(F.instr(F.lit(_STOPS), F.right(end, F.lit(1))) > 0, 0).otherwise(1).alias("fault"),
        F.substring("role", 1, 1).alias("initial"),
        F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256).alias("digest"),
    ), "faults")
    first = light.groupBy("conv", "digest").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("new"))
    light = light.join(first, ["conv", "pos"], "left")
    fault = F.when(F.col("fault") == 3, 3).when(F.col("new").isNull(), 2).otherwise(F.col("fault"))
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    symbol = F.substring(F.lit(_SYMBOLS), initial + 4 * fault + 1, F.lit(1))
    blocks = light.select("conv", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", symbol.alias("symbol")).groupBy("conv", "block")
    placed = blocks.agg(F.array_sort(F.collect_list(F.struct("pos", "symbol"))).alias("x"))  # at most BLOCK of them
    return placed.select("conv", "block", F.array_join("x.symbol", "").alias("symbols"))


def _between(block: pd.Series, symbols: pd.Series) -> pd.Series:
    """The costs from each state before a block to each after it (16), for blocks that have one before them."""
    def costs(text: str) -> list[int]:
        return [cheapest(text, s, [0 if x == t else _FAR for x in range(4)])[0] for s in range(4) for t in range(4)]

    return pd.Series([costs(x) if b else None for b, x in zip(block, symbols, strict=True)], dtype=object)


def _remaining(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks (conv, block, symbols, costs), each conversation's from its last on, with ``after``: what
    remains to be paid after the block in each state."""
    now, after = None, _END
    for batch in batches:
        out = []
        for conv, costs in zip(batch["conv"], batch["costs"], strict=True):
            if conv != now:
                now, after = conv, _END
            out.append(after)
            if costs is not None:
                after = [min(_FAR, min(int(costs[4 * s + t]) + after[t] for t in range(4))) for s in range(4)]
        yield batch[["conv", "block", "symbols"]].assign(after=out)


_WALKS = "array<struct<cost: bigint, audit: string, state: int>>"


def _walks(block: pd.Series, symbols: pd.Series, after: pd.Series) -> pd.Series:
    """The cheapest edits of a block from each state before it (the first block: from the start)."""
    out = []
    for b, x, rest in zip(block, symbols, after, strict=True):
        out.append([dict(zip(("cost", "audit", "state"), cheapest(x, s, [int(c) for c in rest]), strict=True)) for s in range(4 if b else 1)])
    return pd.Series(out, dtype=object)


_EDITS = "conv string, block bigint, entry int, audit string, cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
_PAIRS = {"su", "ua", "au"}


def _followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edits of each block, from the state that the block before ends in, and counts of its faults."""
    now, entry, last = None, _START, ""
    for batch in batches:
        out = []
        for conv, block, symbols, walks in zip(batch["conv"], batch["block"], batch["symbols"], batch["walks"], strict=True):
            if conv != now:
                now, entry, last = conv, _START, ""
            both = [divmod(_SYMBOLS.index(x), 4) for x in symbols]
            initials = last + "".join("sua-"[i] for _, i in both)
            faults = [f for f, _ in both]
            illegal = sum(a + b not in _PAIRS for a, b in zip(initials, initials[1:], strict=False))
            walk = walks[entry]
            out.append((conv, block, entry, walk["audit"], walk["cost"], faults.count(3), faults.count(2), faults.count(1), illegal))
            entry, last = walk["state"], initials[-1:]
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _EDITS.split(", ")])


def edits(rows: DataFrame) -> DataFrame:
    """The cheapest edits of placed rows (conv, pos, role, text), a row per block of a conversation: conv, block,
    entry (state before it), audit, cost, blank, duplicate, truncated, illegal."""
    ship(rows.sparkSession)
    between, best = F.pandas_udf(_between, "array<bigint>"), F.pandas_udf(_walks, _WALKS)
    blocks = symbols_of(rows).withColumn("costs", between("block", "symbols"))
    blocks = blocks.repartition("conv").sortWithinPartitions("conv", F.desc("block"))
    blocks = blocks.mapInPandas(_remaining, "conv string, block bigint, symbols string, after array<bigint>")
    walks = blocks.repartition("conv", "block").withColumn("walks", best("block", "symbols", "after")).drop("after")
    walks = walks.repartition("conv").sortWithinPartitions("conv", "block")
    return written(walks.mapInPandas(_followed, _EDITS), "edits")


class _Editor:
    """Applies a block's audit to its messages, which come one by one."""

    def __init__(self):
        self.state, self.audit, self.at = _START, "", 0

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.state, self.at = _NEXT[self.state], self.at + 1
            yield _ROLES[self.state], ""

    def message(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = _KEEP[self.state]["sua".index(role[0])]
            yield role, text
        elif edit == "R":
            self.state = _NEXT[self.state]
            yield _ROLES[self.state], text


def _edited(batches: Iterator[pd.DataFrame], new, add, done) -> Iterator[pd.DataFrame]:
    """Rows (conv, pos, role, text, entry, audit), a block's audit before its messages, through ``new`` (a
    conversation begins), ``add`` (a message) and ``done`` (it ends; may give a row)."""
    now, editor, held = None, None, None

    def end():
        for x in editor.inserted():
            add(held, now, *x)
        return done(held, now)

    for batch in batches:
        out = []
        for conv, role, text, entry, audit in zip(batch["conv"], batch["role"], batch["text"], batch["entry"], batch["audit"], strict=True):
            if conv != now:
                if now is not None:
                    out += end()
                now, editor, held = conv, _Editor(), new()
            if audit is not None:
                for x in editor.inserted():
                    add(held, now, *x)
                editor.state, editor.audit, editor.at = int(entry), audit, 0
            else:
                for x in editor.message(role, text):
                    add(held, now, *x)
        yield out
    yield end() if now is not None else []


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each conversation's repaired ``role:text`` lines; the texts pass by."""
    def add(held: list, conv: str, role: str, text: str) -> None:
        held[0].update(f"{held[1]}{role}:{text}".encode())
        held[1] = "\n"

    for out in _edited(batches, lambda: [hashlib.sha256(), ""], add, lambda held, conv: [(conv, held[0].hexdigest())]):
        yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])


def _messages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The repaired messages with their new turns."""
    rows: list = []

    def add(held: list, conv: str, role: str, text: str) -> None:
        rows.append((conv, held[0], role, text))
        held[0] += 1

    for _ in _edited(batches, lambda: [0], add, lambda held, conv: []):
        yield pd.DataFrame(rows, columns=["conv", "turn", "role", "text"])
        rows.clear()


def _streamed(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """Messages with their block's audit before them, conversation by conversation."""
    audits = edited.select("conv", (F.col("block") * BLOCK).alias("pos"), F.lit(0).alias("k"), F.lit("").alias("role"), F.lit("").alias("text"), "entry", "audit")
    turns = rows.select("conv", "pos", F.lit(1).alias("k"), "role", "text", F.lit(0).alias("entry"), F.lit(None).cast("string").alias("audit"))
    return audits.union(turns).repartition("conv").sortWithinPartitions("conv", "pos", "k").drop("k", "pos")


def placed(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with their key ``conv`` and place ``pos`` by turn (null first), role and text."""
    rows = rows.select(conv_key(F.col("conv_id")).alias("conv"), "turn", "role", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return positions(rows, ["turn", "role", "digest"], ["conv"]).drop("digest")


def repaired(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations of ``messages`` as they are (not damaged first): conv_id, turn (0-based), role,
    text. Conversations of which nothing stays have no row; null roles and texts are one space."""
    rows = placed(messages.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    ))
    out = _streamed(rows, edits(rows)).mapInPandas(_messages, "conv string, turn bigint, role string, text string")
    return out.select(F.when(F.col("conv") != " ", F.col("conv").cast("bigint")).alias("conv_id"), "turn", "role", "text")


def audit(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """A row per conversation of ``ids`` (conv_id) on what ``rows`` (conv_id, turn, role, text) hold of it: conv_id,
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (see ``op13_repair``)."""
    rows = placed(rows)
    edited = edits(rows)
    sums = edited.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.array_sort(F.collect_list(F.struct("block", "audit"))).getField("audit"), "").alias("audit"),  # a piece per BLOCK turns
    )
    turns = rows.where("turn is not null").select("conv", "turn").distinct()
    gaps = turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    digests = _streamed(rows, edited).mapInPandas(_digests, "conv string, repaired_sha256 string")
    all_ids = ids.select(F.col("conv_id").cast("bigint")).distinct().withColumn("conv", conv_key(F.col("conv_id")))
    out = all_ids.join(sums, "conv", "left").join(gaps, "conv", "left").join(digests, "conv", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select(
        "conv_id", *[count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def op13_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation's faults and cheapest repair after the stated damage.

    gaps: turns missing between the first and the last; blank, duplicate, truncated: rows by their first fault;
    illegal: neighbouring rows whose roles may not follow each other; cost and audit of the cheapest edits;
    repaired_sha256 of the result. A null conv_id is one conversation of its own; null turns stand first and
    count for no gap; null roles and texts are one space (a blank text). Rows of equal turns stand by role and a
    digest of the text, repeated rows are duplicates. Texts of any length pass whole. A conversation without
    rows has zeros, an empty audit and the hash of nothing; an empty table gives an empty one.
    """
    messages = table(spark, sf_dir, "conversations")
    return audit(messages.select("conv_id"), damaged(messages))
