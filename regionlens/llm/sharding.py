"""Sharding by balanced label propagation.

Documents with equal texts are linked. Every document starts in a shard that its id's hash gives;
then, in rounds of joins and aggregations, the members that a group has in one shard move together
to the shard in which the group has most members, as far as that shard's quota of rows allows, until
no move is let in. The rest, documents without links, fills the shards up so that their row counts differ by one at most.

The state is one row per (group, shard) with a count, never pairs of documents. Quotas are kept by a
small table of (shard, target, n) counts, from which the driver takes cycles of equal moves first and
then what fits into the room that departures leave. Windows run within (shard, target, n). A group larger than a shard's quota stays in several shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import positions, table, utf8, written

SHARDS = 40
CELLS = 64
"""Hash cells per shard in which parts beyond its capacity are counted."""


def _wishes(state: DataFrame, capacity: DataFrame, load: dict[int, int] | None) -> DataFrame:
    """Proposals (grp, shard, target, n, gain): a group's smaller parts go to its fullest ones.

    Usually that is one shard; a group that the room there cannot hold gets as many of its fullest
    shards as together hold it, and its other parts are dealt out to these. Room is what ``load`` leaves;
    without it, all that the group does not fill itself, and rows always go from a smaller part to a
    larger one.
    """
    if load is None:
        room = F.col("cap") - F.col("n")
    else:
        room = F.col("cap") - F.create_map(*[F.lit(x) for kv in sorted(load.items()) for x in kv])[F.col("shard")]
    part = F.struct(F.xxhash64("grp", "shard").alias("tie"), "shard", "n", room.cast("bigint").alias("room"))
    groups = state.join(F.broadcast(capacity), "shard").groupBy("grp").agg(F.collect_list(part).alias("parts"), F.sum("n").alias("total"))  # a part a shard
    # shards that can hold the whole group first, then by members
    first = lambda p: F.struct((p["n"] + p["room"] < F.col("total")).alias("small"), (-p["n"]).alias("order"), p["tie"].alias("tie"), p["shard"].alias("shard"), p["n"].alias("n"), p["room"].alias("room"))
    groups = groups.where(F.size("parts") > 1).withColumn("parts", F.array_sort(F.transform("parts", first)))
    held = lambda i: F.aggregate(F.slice("parts", 1, i), F.lit(0).cast("bigint"), lambda x, p: x + p["n"] + p["room"])
    groups = groups.withColumn("kept", F.size(F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: held(i) < F.col("total"))) + 1)
    groups = groups.where(F.col("kept") < F.size("parts"))
    moving = groups.select("grp", "parts", "kept", F.posexplode(F.expr("slice(parts, kept + 1, size(parts))")).alias("i", "p"))
    to = F.col("parts")[F.col("i") % F.col("kept")]
    n = F.least("p.n", to["room"])
    return moving.where(n > 0).select(
        "grp", F.col("p.shard").alias("shard"), to["shard"].alias("target"), n.alias("n"),
        F.floor(F.log2(to["n"] + n)).cast("int").alias("gain"),
    )


def _cycle(edges: dict[int, set[int]]) -> list[int] | None:
    """The shards of a cycle, or none; shards that lead to no cycle lose their edges."""
    path: list[int] = []
    for start in list(edges):
        path = [start]
        while path:
            if not edges.get(path[-1]):
                dead = path.pop()
                if path:
                    edges[path[-1]].discard(dead)
                continue
            x = min(edges[path[-1]])
            if x in path:
                return path[path.index(x) :]
            path.append(x)
    return None


def let_in(wanted: dict[tuple[int, int, int], tuple[int, int]], room: dict[int, int]) -> dict[tuple[int, int, int], tuple[int, int]]:
    """(whole moves, rows of one more) for each (shard, target, n) of ``wanted`` (count, gain): cycles of
    equal moves need no room; of the others, larger gains go first, and what leaves a shard is room."""
    left, some, room = {k: c for k, (c, _) in wanted.items()}, dict.fromkeys(wanted, 0), dict(room)
    for n in sorted({k[2] for k in wanted}, reverse=True):
        edges: dict[int, set[int]] = {}
        for a, b, m in wanted:
            if m == n:
                edges.setdefault(a, set()).add(b)
        while c := _cycle(edges):
            keys = [(a, b, n) for a, b in zip(c, [*c[1:], c[0]], strict=True)]
            many = min(left[k] for k in keys)
            for k in keys:
                left[k] -= many
                some[k] += many
                if not left[k]:
                    edges[k[0]].discard(k[1])
    order, rest = sorted(wanted, key=lambda k: (-wanted[k][1], k)), dict.fromkeys(wanted, 0)
    more = True
    while more:
        more = False
        for k in order:
            a, b, n = k
            rows = min(left[k] * n - rest[k], room[b])
            if rows > 0:
                whole, rest[k] = divmod(rest[k] + rows, n)
                left[k] -= whole
                some[k] += whole
                room[b] -= rows
                room[a] += rows
                more = True
    return {k: (some[k], rest[k]) for k in wanted if some[k] or rest[k]}


def _amounts(rows: DataFrame, keys: list[str], taken: dict[tuple, tuple[int, int]]) -> DataFrame:
    """``rows`` with ``m``: of each key's rows in order of their hash, n of the first ones and some of one more."""
    types = {"shard": "int", "target": "int", "cell": "int", "n": "bigint"}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", whole bigint, more bigint"
    list_ = rows.sparkSession.createDataFrame([(*k, *v) for k, v in taken.items()], schema)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("grp"), "grp"))
    ranked = rows.join(F.broadcast(list_), keys).withColumn("rank", rank)
    m = F.when(F.col("rank") <= F.col("whole"), F.col("n")).when(F.col("rank") == F.col("whole") + 1, F.col("more")).otherwise(F.lit(0))
    return ranked.withColumn("m", m.cast("bigint")).where("m > 0")


def propagate(state: DataFrame, capacity: DataFrame, rounds: int | None = None) -> DataFrame:
    """(grp, shard, n) when no move is let in any more (or after ``rounds`` rounds). ``capacity``
    (shard, cap) bounds every shard's sum of n. Groups turn to shards with room as long as the number of
    parts falls, then to their fullest shards; there the sum of the squares of n grows with every move, so
    the rounds come to an end."""
    caps = {r["shard"]: r["cap"] for r in capacity.collect()}  # one row a shard
    turn, roomy, parts = 0, True, state.count() if caps else 0
    while rounds is None or turn < rounds:
        load = {r["shard"]: r["load"] for r in state.groupBy("shard").agg(F.sum("n").alias("load")).collect()}
        wish = written(_wishes(state, capacity, load if roomy and load else None), "wishes")
        counts = wish.groupBy("shard", "target", "n").agg(F.count("*").alias("many"), F.max("gain").alias("gain")).collect()
        wanted = {(r["shard"], r["target"], r["n"]): (r["many"], r["gain"]) for r in counts}
        taken = let_in(wanted, {x: cap - load.get(x, 0) for x, cap in caps.items()})
        if not taken:
            if not roomy:
                break
            roomy = False
            continue
        moves = _amounts(wish, ["shard", "target", "n"], taken)
        both = F.array(F.struct(F.col("shard"), (-F.col("m")).alias("n")), F.struct(F.col("target").alias("shard"), F.col("m").alias("n")))
        change = moves.select("grp", F.explode(both).alias("c")).select("grp", "c.shard", "c.n")
        state = state.select("grp", "shard", "n").union(change)
        state = written(state.groupBy("grp", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "state")
        before, parts = parts, state.count()
        roomy = roomy and parts < before
        turn += 1
    return state


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """Every row with its shard: doc_id, size (UTF-8 bytes plus 16), text_crc32, shard and slot (gapless
    from 0 in each shard); law ``rows``: the shards' row counts differ by one at most.

    Null texts have no bytes and are linked with empty ones. Repeated rows, rows without an id and ties
    are rows like any other, each with its own slot. An empty table gives an empty result.
    """
    raw = F.coalesce(utf8(F.col(text_col)), F.lit(b""))
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 16).cast("bigint").alias("size"),
            F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("grp"),
        ),
        "rows",
    )
    n = rows.count()
    start = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    spark = docs.sparkSession
    capacity = spark.range(shards).select(
        F.col("id").cast("int").alias("shard"), (F.lit(n // shards) + (F.col("id") < n % shards).cast("bigint")).alias("cap")
    )
    # counted per group and shard before anything is joined, so that a group of any size is few rows
    counts = written(rows.groupBy("grp", start.alias("shard")).agg(F.count("*").alias("n")), "counts")
    linked = written(counts.groupBy("grp").agg(F.sum("n").alias("members")).where("members > 1"), "linked")
    first = counts.join(linked, "grp", "left_semi").select("grp", "shard", "n")
    # what the hashes put beyond a shard's capacity (small or empty shards only) is shed group by group
    state = written(_within(written(first, "state"), capacity), "state")
    state = propagate(state, capacity, rounds)

    # members of a group take the group's places in order of their id: ranges of positions per shard
    order = Window.partitionBy("grp").orderBy("shard")  # at most one row a shard
    upto = F.sum("n").over(order)
    places = state.withColumn("last", upto).withColumn("first", F.col("last") - F.col("n"))
    load = state.groupBy("shard").agg(F.sum("n").alias("load"))
    room = capacity.join(load, "shard", "left").select("shard", (F.col("cap") - F.coalesce("load", F.lit(0))).alias("n"))
    mine = rows.join(linked.select("grp", "members"), "grp", "left")
    keyed = mine.select("doc_id", "size", "text_crc32", F.when(F.col("members").isNotNull(), F.col("grp")).alias("grp"))
    placed = written(positions(keyed, ["doc_id", "size", "text_crc32"], ["grp"], "pos"), "placed")
    places = places.select(F.col("grp").alias("g"), "shard", "first", "last")
    groups = placed.join(places, (F.col("grp") == F.col("g")) & (F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("last")))
    # documents beyond the groups' places: those that were shed, and those without links
    free = placed.where("grp is null")
    taken = places.groupBy(F.col("g").alias("grp")).agg(F.max("last").alias("taken"))
    shed = placed.where("grp is not null").join(taken, "grp", "left").where("pos >= coalesce(taken, 0)")
    rest = free.select("doc_id", "size", "text_crc32").union(shed.select("doc_id", "size", "text_crc32"))
    rest = positions(rest, ["doc_id", "size", "text_crc32"])
    # the n-th of them goes to the shard in whose range of free places n lies
    left = sorted((r["shard"], r["n"]) for r in room.where("n > 0").collect())  # one row a shard
    ends = F.array(*[F.lit(sum(x for _, x in left[: i + 1])).cast("bigint") for i in range(len(left))]) if left else F.array().cast("array<bigint>")
    at = F.size(F.filter(ends, lambda e: e <= F.col("pos")))
    filled = rest.withColumn("shard", F.array(*[F.lit(x) for x, _ in left])[at] if left else F.lit(None).cast("int"))
    both = groups.select("doc_id", "size", "text_crc32", "shard").union(filled.select("doc_id", "size", "text_crc32", "shard"))
    return positions(both, ["doc_id", "size", "text_crc32"], ["shard"], "slot")


def _within(state: DataFrame, capacity: DataFrame) -> DataFrame:
    """Cut the counts of each shard to its capacity, by the excess rows alone and from the smallest parts;
    what is cut has no shard yet."""
    caps = {r["shard"]: r["cap"] for r in capacity.collect()}
    rows = state.withColumn("cell", F.pmod(F.xxhash64("grp", F.lit(1)), F.lit(CELLS)).cast("int"))
    counts = rows.groupBy("shard", "cell", "n").agg(F.count("*").alias("many")).collect()
    excess = {x: -cap for x, cap in caps.items()}
    for r in counts:
        excess[r["shard"]] += r["n"] * r["many"]
    shed = {}
    for r in sorted(counts, key=lambda r: (r["n"], r["cell"])):
        x, n = r["shard"], r["n"]
        if excess[x] > 0:
            many = min(r["many"], excess[x] // n)
            more = min(excess[x] - many * n, n) if many < r["many"] else 0
            shed[x, r["cell"], n] = (many, more)
            excess[x] -= many * n + more
    if not shed:
        return state
    cut = _amounts(rows, ["shard", "cell", "n"], shed).select("grp", "shard", (-F.col("m")).alias("n"))
    return state.select("grp", "shard", "n").union(cut).groupBy("grp", "shard").agg(F.sum("n").alias("n")).where("n > 0")


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law ``rows``."""
    placed = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
