"""Repair of conversations against a plain search over all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from regionlens.llm import repair as r

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    """'b', 'd', 't' or '' of each (role, text), in order."""
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(SPACE)
        out.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def least(rows, marks):
    """(cost, audit) by the value of every place and state, from the end; least audits by comparing whole ones."""
    n = len(rows)
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    value = {}
    for i in range(n, -1, -1):
        now = {s: ((0, "") if i == n and s in ("", "a") else None) for s in step}
        if i < n:
            role, f = rows[i][0], marks[i]
            for s in step:
                ways = [(2 + value[i + 1, s][0], "D" + value[i + 1, s][1])]
                if f not in ("b", "d"):
                    more = 5 * (f == "t")
                    if role[:1] == step[s] or (s == "" and role[:1] == "s"):
                        v = value[i + 1, role[:1]]
                        ways.append((more + v[0], "K" + v[1]))
                    v = value[i + 1, step[s]]
                    ways.append((1 + more + v[0], "R" + v[1]))
                now[s] = min(ways)
        for _ in range(4):  # insertions at this place
            for s in step:
                if (v := now[step[s]]) is not None:
                    way = (5 + v[0], "I" + v[1])
                    now[s] = way if now[s] is None else min(now[s], way)
        for s in step:
            value[i, s] = now[s]
    return value[0, ""]


def apply(rows, audit):
    out, i = [], 0
    follow = lambda: "assistant" if out and out[-1][0][:1] == "u" else "user"
    for e in audit:
        if e == "I":
            out.append((follow(), ""))
            continue
        if e != "D":
            out.append(rows[i] if e == "K" else (follow(), rows[i][1]))
        i += 1
    assert i == len(rows)
    return out


def brute(rows):
    convs = {c: [] for c, *_ in rows}
    for c, t, role, text in damage(rows):
        convs[c].append((t is not None, t or 0, role, hashlib.sha256(text.encode()).hexdigest(), text))
    out = []
    for c, v in convs.items():
        v = sorted(v)
        pairs = [(x[2], x[4]) for x in v]
        marks = faults(pairs)
        cost, audit = least(pairs, marks)
        fixed = apply(pairs, audit)
        assert LEGAL.fullmatch("".join(x[0][:1] for x in fixed))
        turns = {x[1] for x in v if x[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in fixed).encode()).hexdigest()
        out.append((c, gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(x) for x in r.audit(df.select("conv_id"), r.damaged(df)).collect()), key=repr)


def test_search_finds_the_least_audit():
    """All short sequences of symbols, and long random ones."""
    roles, marks = ["s", "u", "a", "x"], ["", "t", "d", "b"]
    rng = random.Random(5)
    cases = list(itertools.product(r._SYMBOLS, repeat=2)) + [rng.choices(r._SYMBOLS, k=rng.randint(0, 9)) for _ in range(3000)]
    cases += [rng.choices("abcefgaaabbcc", k=60) for _ in range(60)]
    for case in cases:
        rows = [(roles[r._SYMBOLS.index(x) % 4], "") for x in case]
        assert r.cheapest("".join(case))[:2] == least(rows, [marks[r._SYMBOLS.index(x) // 4] for x in case]), case


def test_all_edits_tried():
    """Against an enumeration of all edits with at most two insertions."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}

    def every(rows, marks, s, ins):
        if not rows and s in ("", "a"):
            yield 0, ""
        if ins:
            for c, a in every(rows, marks, step[s], ins - 1):
                yield c + 5, "I" + a
        if rows:
            for c, a in every(rows[1:], marks[1:], s, ins):
                yield c + 2, "D" + a
            if marks[0] not in ("b", "d"):
                more = 5 * (marks[0] == "t")
                if rows[0] == step[s] or (s == "" and rows[0] == "s"):
                    for c, a in every(rows[1:], marks[1:], rows[0], ins):
                        yield c + more, "K" + a
                for c, a in every(rows[1:], marks[1:], step[s], ins):
                    yield c + more + 1, "R" + a

    rng = random.Random(1)
    for _ in range(300):
        k = rng.randint(0, 5)
        rows, marks = rng.choices("suax", k=k), rng.choices(["", "", "t", "d", "b"], k=k)
        assert least([(x, "") for x in rows], marks) == min(every(rows, marks, "", 2))


def test_tables(spark):
    for sf in ("0.001", "0.01"):
        df = spark.read.parquet(f"/root/testdata/sf{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
        got = sorted((tuple(x) for x in r.op13_repair(spark, f"/root/testdata/sf{sf}").collect()), key=repr)
        assert got == brute([tuple(x) for x in df.collect()])


def awkward(seed=3):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", " \t", "Wait!\n", "Grüße 日本?", None, "Yes.", "dot. \x0b", " ", "a. "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "usher"]
    rows = [(c, i if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts)) for c in [*range(-3, 150), None] for i in range(rng.randint(1, 12))]
    rows += [(500, t, "user", "a.") for t in (1, 2, 6)] + [(501, None, "user", "a.")] + [(502, 3, "user", "a.")] * 5
    # all rows dropped
    rows += [(c, t, "user", "a.") for c, t in [next((c, t) for c in range(900, 2000) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)]]
    return rows


def test_awkward(spark):
    assert run(spark, awkward()) == brute(awkward())


def test_long_conversations_in_blocks(spark, monkeypatch):
    """Blocks of seven messages give what one search gives."""
    monkeypatch.setattr(r, "BLOCK", 7)
    rng = random.Random(9)
    rows = [(c, i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "no", "", f"{i}.", f"{i}"])) for c in range(6) for i in range(150 - c)]
    rows += awkward(4)
    assert run(spark, rows) == brute(rows)


def test_long_text_and_empty(spark):
    rows = [(1, 0, "user", "long words. " * 60_000), (1, 1, "assistant", "x" * 500_000 + "."), (2, 0, "assistant", "a.")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_repaired_messages(spark):
    """The repaired texts, from a table with more columns and clashing names."""
    rows = [(1, 0, "system", "Be kind.", 1, "k"), (1, 1, "user", "Hello.", 2, "k"), (1, 1, "user", "Hello.", 2, "k"), (1, 3, "user", "Hi!", 3, "k"),
            (2, 0, "assistant", "", 0, "k"), (None, 0, "user", "A?", 0, "k"), (None, 1, "assistant", "B.", 0, "k")]
    df = spark.createDataFrame(rows, SCHEMA + ", pos int, Conv string")
    got = sorted((tuple(x) for x in r.repaired(df).collect()), key=repr)
    assert got == sorted([(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "assistant", "Hi!"), (None, 0, "user", "A?"), (None, 1, "assistant", "B.")], key=repr)


@pytest.mark.parametrize("role", ["user", "assistant"])
def test_one_message(spark, role):
    rows = [(c, 0, role, "One.") for c in range(40)]
    assert run(spark, rows) == brute(rows)
