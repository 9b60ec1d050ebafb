"""Multi-level local moving against a plain version, goldens and planted communities."""

import hashlib
import math
import random

import pytest

from goldens import COMMUNITIES
from regionlens.operators import graph as g
from regionlens.operators import hubs
from regionlens.operators.louvain import louvain
from regionlens.sources.builtin_dims import sector_edges, sector_nodes


def plain(ids, edges, min_gain=1e-5):
    """The same rounds with dictionaries: (partition as frozensets, rounds)."""
    def key(v, level, attempt):
        return int(hashlib.md5(f"{v}:{level}:{attempt}".encode()).hexdigest()[:7], 16)

    m = sum(w for *_, w in edges)
    adj, loop = {v: {} for v in ids}, dict.fromkeys(ids, 0.0)
    for u, v, w in edges:
        if u == v:
            loop[u] += w
        else:
            adj[u][v] = adj[u].get(v, 0.0) + w
            adj[v][u] = adj[v].get(u, 0.0) + w
    k = {v: sum(adj[v].values()) + 2 * loop[v] for v in ids}
    rounds = level = 0

    def quality(label, adj, loop, k):
        deg, inner = {}, sum(loop.values())
        for v in label:
            deg[label[v]] = deg.get(label[v], 0.0) + k[v]
            inner += sum(w for x, w in adj[v].items() if label[x] == label[v]) / 2
        return inner / m - sum(d * d for d in deg.values()) / (4 * m * m)

    def settle(label, adj, loop, k):
        nonlocal rounds, level
        parts, attempt, moved, q = 2, 0, False, quality(label, adj, loop, k)
        while True:
            deg = {}
            for v in adj:
                deg[label[v]] = deg.get(label[v], 0.0) + k[v]
            wish = {}
            for v in adj:
                to = {}
                for x, w in adj[v].items():
                    to[label[x]] = to.get(label[x], 0.0) + w
                own = label[v]
                best = min(((-((w - to.get(own, 0.0)) / m - k[v] * (deg[c] - deg[own] + k[v]) / (2 * m * m)), c) for c, w in to.items() if c != own), default=(0, None))
                if -best[0] > 1e-12:
                    wish[v] = best
            if not wish:
                break
            stop = fresh = False
            while True:
                alone = min((wish[v][0], v) for v in wish)[1] if fresh and parts > len(wish) else None
                goes = lambda v: v in wish and (v == alone if alone is not None else key(v, level, attempt) % parts == 0)
                new = {v: wish[v][1] if goes(v) else c for v, c in label.items()}
                fresh = True
                now = quality(new, adj, loop, k)
                attempt, rounds = attempt + 1, rounds + 1
                if now > q + 1e-12:
                    stop, q, label, moved = now - q < min_gain and parts == 2, now, new, True
                    parts = max(2, parts // 2)
                    break
                parts *= 2
            if stop:
                break
        level += 1
        return label, moved

    def lift(label, old, old_loop, old_k):
        adj, loop, k = {}, {}, {}
        for v, c in label.items():
            adj.setdefault(c, {})
            loop[c] = loop.get(c, 0.0) + old_loop[v]
            k[c] = k.get(c, 0.0) + old_k[v]
            for x, w in old[v].items():
                if label[x] == c:
                    loop[c] += w / 2
                else:
                    adj[c][label[x]] = adj[c].get(label[x], 0.0) + w
        return adj, loop, k

    member, again = {v: v for v in ids}, m > 0
    while again:
        member, again = settle(member, adj, loop, k)
        up, label, lifted = (adj, loop, k), member, again
        while lifted:
            up = lift(label, *up)
            label, lifted = settle({v: v for v in up[0]}, *up)
            member = {v: label[c] for v, c in member.items()}
    groups = {}
    for v, c in member.items():
        groups.setdefault(c, set()).add(v)
    return sorted(map(frozenset, groups.values()), key=sorted), rounds


def groups_of(df):
    groups = {}
    rows = df.collect()
    for r in rows:
        groups.setdefault(r["community"], set()).add(r["id"])
    sizes = [len(groups[c]) for c in sorted(groups)]
    assert sorted(groups) == list(range(len(groups))) and sizes == sorted(sizes, reverse=True)
    return sorted(map(frozenset, groups.values()), key=sorted), max((r["rounds"] for r in rows), default=0)


def test_golden_sectors(spark):
    nodes, edges = g.build_graph(sector_nodes(spark), sector_edges(spark), order_col="ord")
    und = g.materialize(g.to_undirected(edges, reciprocal="max"))
    got = louvain(nodes, und)
    assert groups_of(got)[0] == sorted(map(frozenset, COMMUNITIES), key=sorted)
    assert g.modularity(und, got).first()[0] == pytest.approx(0.2612721893, abs=1e-9)


def test_against_plain(spark, monkeypatch):
    """Random weighted graph with loops, reciprocal rows, hubs in sub-keys, isolated nodes and ends that are no nodes."""
    monkeypatch.setattr(hubs, "LEAST", 6)
    rng = random.Random(1)
    ids = [f"n{i:02d}" for i in range(60)]
    edges = [(rng.choice(ids[:50]), rng.choice(ids[:50]), rng.random() + 0.1) for _ in range(140)] + [("n00", v, 0.5 + rng.random()) for v in ids[1:40:3]]
    nodes = spark.createDataFrame([(v, "x") for v in ids] + [("n00", "y")], "id string, c string")
    und = spark.createDataFrame([*edges, ("n01", "elsewhere", 9.0)], "u string, v string, weight double")
    want, rounds = plain(ids, edges)
    got, tried = groups_of(louvain(nodes, und))
    assert got == want and tried == rounds


def test_planted_and_rounds(spark):
    """Planted groups are found but for few nodes, in rounds that grow with the logarithm (100,000 nodes: the plain
    version takes 123)."""
    rng = random.Random(7)
    n, size = 1500, 50
    edges = [(i, (i // size) * size + rng.randrange(size), 1.0) for i in range(n) for _ in range(8)] + [(rng.randrange(n), rng.randrange(n), 1.0) for _ in range(n)]
    und = spark.createDataFrame(edges, "u bigint, v bigint, weight double")
    got = g.materialize(louvain(spark.range(n), und))
    rounds = got.first()["rounds"]
    assert rounds <= 6 * math.log2(n)
    planted = spark.range(n).selectExpr("id", f"cast(id div {size} as int) as community")
    assert g.modularity(und, got).first()[0] >= 0.97 * g.modularity(und, planted).first()[0]


def test_no_edges_and_bad_weights(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    none = spark.createDataFrame([], "u string, v string, weight double")
    assert groups_of(louvain(nodes, none))[0] == [frozenset("a"), frozenset("b")]
    assert louvain(nodes.limit(0), none).count() == 0
    loop = spark.createDataFrame([("a", "a", 1.0)], "u string, v string, weight double")
    assert groups_of(louvain(nodes, loop))[0] == [frozenset("a"), frozenset("b")]
    with pytest.raises(ValueError):
        louvain(nodes, spark.createDataFrame([("a", "b", -1.0)], "u string, v string, weight double"))
