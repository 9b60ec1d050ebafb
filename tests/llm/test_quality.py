import math

import numpy as np
import pandas as pd
from llm_cases import SF, awkward, documents, no_documents
from pyspark.sql import functions as F

from regionlens.llm import quality as q


def test_em_recovers_planted_rates():
    """Votes drawn from known rates: the estimates and the posteriors come back."""
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.7
    right = np.array([0.9, 0.8, 0.7, 0.85])
    votes = np.where(rng.random((20_000, 4)) < right, good[:, None], ~good[:, None]).astype(int)
    votes[rng.random((20_000, 4)) < 0.2] = -1
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, found = q.expectation_maximisation(patterns, counts.astype(float))
    assert abs(found["prior"] - 0.7) < 0.03
    heard = found["rates"][1][:, 2] / (1 - found["rates"][1][:, 0])
    assert np.abs(heard - right).max() < 0.03
    assert ((post[at.ravel()] > 0.5) == good).mean() > 0.9


def test_em_does_not_lower_the_likelihood():
    rng = np.random.default_rng(4)
    patterns, counts = np.unique(rng.integers(-1, 2, (500, 3)), axis=0, return_counts=True)

    def likelihood(rounds):
        _, found = q.expectation_maximisation(patterns, counts.astype(float), rounds)
        p = [[np.prod([found["rates"][c][j][v + 1] for j, v in enumerate(x)]) for x in patterns] for c in (0, 1)]
        return (counts * np.log((1 - found["prior"]) * np.array(p[0]) + found["prior"] * np.array(p[1]))).sum()

    assert likelihood(20) >= likelihood(2) - 0.5


def plain_posteriors(votes, rounds):
    """The label model document by document: no patterns, no arrays."""
    n, k = len(votes), len(votes[0])
    post = []
    for v in votes:
        said = [x for x in v if x >= 0]
        post.append(min(0.98, max(0.02, sum(said) / len(said) if said else 0.5)))
    for _ in range(rounds):
        rates = []
        for c in (0, 1):
            share = [p if c else 1 - p for p in post]
            for j in range(k):
                total = {x: 1.0 + sum(w for w, v in zip(share, votes, strict=True) if v[j] == x) for x in (-1, 0, 1)}
                rates.append({x: t / sum(total.values()) for x, t in total.items()})
        prior, old = (sum(post) + 1) / (n + 2), post
        post = []
        for v in votes:
            good = prior * math.prod(rates[k + j][x] for j, x in enumerate(v))
            post.append(good / (good + (1 - prior) * math.prod(rates[j][x] for j, x in enumerate(v))))
        if max(abs(a - b) for a, b in zip(post, old, strict=True)) < 1e-9:
            break
    return post


def test_against_a_plain_version(spark):
    """Votes, posteriors and scores of every document from its text alone."""
    docs = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    got = {r["doc_id"]: r for r in q.op1_quality(spark, SF).collect()}
    assert got.keys() == docs.keys()
    votes = {i: [int(x) for x in q.heard(None if t is None else t.encode())] for i, t in docs.items()}
    post = dict(zip(votes, plain_posteriors(list(votes.values()), q.EM_ROUNDS), strict=True))
    assert all(r["votes"] == ",".join(map(str, votes[i])) and abs(r["posterior"] - post[i]) < 1e-6 for i, r in got.items())
    taught = {t: post[i] for i, t in docs.items()}  # fewer texts than the sample may have: all teach
    assert len(taught) <= q.SAMPLE
    rows = [(p, q._features(t)) for t, p in taught.items()]
    rows = pd.DataFrame({"post": [p for p, _ in rows], "at": [list(f) for _, f in rows], "n": [list(map(float, f.values())) for _, f in rows]})
    weights, bias = q.fit_linear(rows)
    for i, t in docs.items():
        if w := (t or "").split():
            z = sum(weights[q.bucket(x)] for x in w) / len(w) + bias
            assert abs(got[i]["score"] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-4
            assert got[i]["keep"] == (got[i]["score"] >= 0.5)


def test_accuracy_on_labels(spark):
    """The labels, which nothing here has seen, agree; good documents are kept."""
    got = q.op1_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert q.op1_quality(spark, SF).count() == documents(spark).count()
    good, bad = [r for r in got if r["quality"] == 1], [r for r in got if r["quality"] == 0]
    assert np.mean([r["keep"] for r in good]) > 0.97
    assert np.mean([not r["keep"] for r in bad]) > 0.6


def test_accuracy_on_more_labels(spark):
    """Ten times as many documents to learn from: most bad ones go too."""
    folder = SF.replace("0.001", "0.01")
    got = q.op1_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["keep"] for r in got if r["quality"] == 1]) > 0.97
    assert np.mean([not r["keep"] for r in got if r["quality"] == 0]) > 0.85


def test_awkward_rows(spark):
    docs = awkward(spark).union(documents(spark)).withColumn("votes", F.lit(1)).withColumn("_post", F.lit(1))
    got = q.classify(docs, "x")
    assert got.columns == [*docs.columns, "x"] and got.count() == docs.count()
    rows = [r for r in got.collect() if r["text"] is None or r["text"] == ""]
    assert all(set(r["x"]["votes"]) == {0} and not r["x"]["keep"] for r in rows) and len(rows) >= 2
    same = [r["x"] for r in got.where("doc_id = 5 and source = 's'").collect()]
    assert same[0] == same[1]


def test_tiny_and_empty_tables(spark):
    assert q.classify(no_documents(spark), "x").count() == 0
    assert q.classify(awkward(spark), "x").count() == awkward(spark).count()
