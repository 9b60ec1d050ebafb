import re
from collections import defaultdict

from llm_cases import SF
from pyspark.sql import functions as F

from regionlens.llm import quotes as q

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """Row by row, with dictionaries: (conv, turn, role, text) -> parent, root, place and text."""
    def normal(t):
        return re.sub(r"\s+", " ", t.lower()).strip(" ")

    def units(t):
        parts = [t, *re.split(r"(?:\r?\n[ \t]*){2,}", t), *re.split(r"\r\n|\r|\n", t)]
        return {normal(p) for p in parts} - {""}

    def own(t):
        lines = re.split(r"\r\n|\r|\n", t)
        if not any(re.match(r"[ \t]*>", x) for x in lines):
            return t
        return re.sub(r"^\s*\n|\s+$", "", "\n".join(x for x in lines if not re.match(r"[ \t]*>", x)))

    held = defaultdict(set)
    for c, t, _, text in rows:
        for u in units(own(text)) if text is not None else ():
            held[c, u].add(t)
    parent = {}
    for c, t, _, text in rows:
        runs, last = [], None
        for line in re.split(r"\r\n|\r|\n", text or ""):
            m = re.match(r"([ \t]*>)+[ \t]?", line)
            level = m[0].count(">") if m else 0
            if level != last:
                runs.append((level, []))
            runs[-1][1].append(line[m.end() if m else 0 :])
            last = level
        for level, lines in runs:
            if level:
                best = max(((len(u), s) for u in units("\n".join(lines)) for s in held[c, u] if s < t), default=None)
                # the latest source of the longest unit
                if best:
                    parent[c, t] = max(parent.get((c, t), (-99, 0, 0)), (-level, *best))
    out = []
    for c, t, role, text in rows:
        root = t
        while (c, root) in parent:
            root = parent[c, root][2]
        out.append((c, t, role, parent.get((c, t), (0, 0, None))[2], root, None if text is None else own(text)))
    place, done = defaultdict(int), []
    for x in sorted(out, key=lambda x: (x[0], x[4], x[1], x[2] or "", x[5] or "")):
        done.append((*x, place[x[0]]))
        place[x[0]] += 1
    return done


ROWS = [
    (1, 0, "a", "Hello there.\nHow are you?"), (1, 1, "b", "> How are  YOU?\nFine, thanks."), (1, 2, "c", "An unrelated remark"),
    (1, 3, "a", ">> how are you?\n> Fine, thanks.\n\nGood to hear.\n"), (1, 4, "d", "> An unrelated\n> remark\nNot so."), (1, 5, "e", "> nobody said this\nok"),
    (1, 6, "f", "On Monday b wrote:\n> Fine, thanks.\nagain"), (2, 0, "a", "> How are you?\nonly quoted elsewhere"), (2, 1, "a", None), (2, 2, "a", ""),
    (2, 3, "a", "Fine, thanks."), (2, 4, "a", "Fine, thanks."), (2, 5, "b", " > Fine, thanks.\n >\n > \nyes"), (3, 0, "x", ">"), (3, 1, "x", "> > >deep\r\nx\r\n> y"),
]


def as_rows(df):
    return sorted((r["conv_id"], r["turn"], r["role"], r["parent"], r["root"], r["text"], r["reply_pos"]) for r in df.collect())


def test_links_and_order_against_brute_force(spark):
    got = as_rows(q.conversations(spark.createDataFrame(ROWS, SCHEMA)).fillna({"parent": -9, "text": "NULL"}))
    want = sorted((c, t, r, -9 if p is None else p, root, "NULL" if x is None else x, at) for c, t, r, p, root, x, at in brute(ROWS))
    assert got == want
    by = {(r[0], r[1]): r for r in got}
    assert by[1, 1][3] == 0 and by[1, 3][3:5] == (1, 0) and by[1, 6][3] == 1 and by[2, 5][3] == 4


def test_many_turns_in_one_conversation(spark):
    """A long thread over several blocks of turns; every message quotes the one before or a far one."""
    rows = [(7, t, "r", f"message number {t} of it" + (f"\n> message number {t - 1 if t % 7 else t // 2} of it" if t else "")) for t in range(2600)]
    got = as_rows(q.conversations(spark.createDataFrame(rows, SCHEMA)).fillna({"parent": -9}))
    assert [(r[1], r[3], r[4], r[6]) for r in got] == [(t, -9 if t == 0 else t - 1 if t % 7 else t // 2, 0, t) for t in range(2600)]


def test_common_passage_links_to_the_latest(spark):
    rows = [(1, t, "r", "thanks" if t % 2 == 0 else "> thanks\nwelcome") for t in range(4000)]
    got = q.conversations(spark.createDataFrame(rows, SCHEMA)).where("parent is not null").collect()
    assert len(got) == 2000 and all(r["parent"] == r["turn"] - 1 for r in got)


def test_query_keeps_every_message(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    got = q.op3_chat(spark, SF)
    assert sorted(tuple(r) for r in got.select("conv_id", "turn", "role", "text").collect()) == sorted(tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect())
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_awkward_rows(spark):
    rows = [(None, 0, "a", "hi"), (None, 1, "b", "> hi\nyo"), (1, None, "a", "hi"), (1, 5, None, "> hi\nyo"), (1, 5, None, "> hi\nyo"), (1, 5, None, "other"), (2, 0, "long", "word " * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("root", F.lit(1)).withColumn("conv", F.lit(2))
    got = q.conversations(df).collect()
    assert len(got) == len(rows)
    place = defaultdict(list)
    for r in got:
        place[r["conv_id"]].append(r["reply_pos"])
    assert {c: sorted(p) for c, p in place.items()} == {None: [0, 1], 1: [0, 1, 2, 3], 2: [0]}
    assert [r["parent"] for r in got if r["conv_id"] is None and r["turn"] == 1] == [0]
    assert q.conversations(spark.createDataFrame([], SCHEMA)).count() == 0
