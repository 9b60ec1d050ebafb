"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (0) or abstain (-1) on every text. Spark counts
the vote patterns of all documents; expectation-maximisation over that bounded table (at most
3 ** labellers rows) estimates how often each labeller is right on good and on bad texts. The
posterior of a pattern labels its documents, and a bounded sample of them trains a linear scorer on
hashed words, which scores all documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, ship, table, utf8

BUCKETS = 1 << 16
SAMPLE = 6000
"""Documents that the scorer is trained on, at most (the votes and their statistics take all)."""
EM_ROUNDS = 200
_CACHE = 400_000
_SEED = 7


LABELLERS = ("letters", "symbols", "spaces", "upper", "stops", "words")
#: Fixed: classes of UTF-8 bytes. A character that is not ASCII counts once, by its first byte, as a letter.
_LATER = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_LETTER = _UPPER + bytes(range(97, 123)) + bytes(range(0xC0, 0x100))
_SYMBOL = b"#$%&*|!@^~<>{}=+\\"
_SPACE = b" \t\n\r\x0b\x0c"


def heard(raw: bytes | None) -> list[int]:
    """Votes of the heuristics on the UTF-8 bytes of a text, in the order of LABELLERS. Shares of
    character classes are counted; thresholds leave a gap in which a labeller abstains. A null or
    empty text gets bad votes only."""
    if not raw:
        return [0] * len(LABELLERS)
    count = lambda kind: len(raw) - len(raw.translate(None, kind))
    n = len(raw) - count(_LATER)
    letters = count(_LETTER)
    symbols, spaces, upper = count(_SYMBOL) / n, count(_SPACE) / n, count(_UPPER) / max(1, letters)
    words = raw.count(b" ") + raw.count(b"\n") + 1
    stops = raw.count(b".") / words
    letters /= n
    vote = lambda bad, good: 0 if bad else 1 if good else -1
    return [
        vote(letters < 0.7, letters > 0.78), vote(symbols > 0.06, symbols < 0.005),
        vote(spaces < 0.08 or spaces > 0.35, 0.1 <= spaces <= 0.25), vote(upper > 0.4, upper < 0.15),
        vote(stops == 0 and words > 40, 0.02 <= stops <= 0.3), vote(words < 4, words > 20),
    ]


def _votes(texts: pd.Series) -> pd.Series:
    return pd.Series([heard(None if t is None else bytes(t)) for t in texts], dtype=object)


def votes(docs: DataFrame, out: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``out``, the array of votes."""
    ship(docs.sparkSession)
    return docs.withColumn(out, F.pandas_udf(_votes, "array<int>").asNondeterministic()(utf8(F.col(text_col))))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, dict]:
    """Posterior of good per vote pattern, and the estimated rates.

    Two classes; given the class, labellers are independent and vote 1, 0 or -1 at rates of their
    own. Starts from the mean vote, so that "good" is what most labellers call good.
    """
    one_hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    heard = (patterns >= 0).sum(axis=1)
    post = np.where(heard > 0, (patterns == 1).sum(axis=1) / np.maximum(heard, 1), 0.5)
    post = np.clip(post, 0.02, 0.98)
    prior, rates = 0.5, None
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        rates = np.einsum("cp,plv->clv", weight, one_hot) + 1.0
        rates /= rates.sum(axis=2, keepdims=True)
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        score = np.einsum("clv,plv->cp", np.log(rates), one_hot) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -700, 700)))
        done, post = np.abs(new - post).max(initial=0) < 1e-9, new
        if done:
            break
    return post, {"prior": prior, "rates": rates}


def _features(text: str | None) -> Counter:
    """Counts of hashed words and shapes of a text."""
    out: Counter = Counter()
    for w, n in Counter(text.split() if text else []).items():
        out[bucket(w)] += n
    return out


def bucket(word: str) -> int:
    """Bucket of a word by its ending and shape: case, other characters, the letters' last four."""
    low = word.lower()
    core = low.strip(".,;:'\"()")
    shape = ("U" if word.isupper() and len(word) > 1 else "l") + ("a" if core.isalpha() else "x" + "".join(sorted({c for c in core if not c.isalnum()})))
    return zlib.crc32(f"{shape}{core[-4:] if core.isalpha() else ''}".encode("utf-8", "surrogatepass")) % BUCKETS


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [_features(t) for t in batch["text"]]
        yield pd.DataFrame({"post": batch["post"], "at": [list(r) for r in rows], "n": [list(map(float, r.values())) for r in rows]})


def fit_linear(rows: pd.DataFrame, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model for soft labels ``post`` over normalised counts, by
    AdaGrad over the whole sample; the classes weigh the same."""
    weights, bias = np.zeros(BUCKETS), 0.0
    rows = rows[rows["at"].map(len) > 0]
    if not len(rows):
        return weights, bias
    sizes = rows["at"].map(len).to_numpy()
    doc = np.repeat(np.arange(len(rows)), sizes)
    at = np.concatenate(rows["at"].map(lambda x: np.asarray(x, np.int64)).tolist())
    n = np.concatenate(rows["n"].map(lambda x: np.asarray(x, float)).tolist())
    x = n / np.bincount(doc, n)[doc]
    y = rows["post"].to_numpy(float)
    share = min(max(y.mean(), 0.01), 0.99)
    w = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)) / len(y)
    used, at = np.unique(at, return_inverse=True)
    v, square, square_b = np.zeros(len(used)), np.full(len(used), 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, x * v[at], len(y)) + bias, -30, 30)))
        g = w * (p - y)
        grad = np.bincount(at, x * g[doc], len(used)) + decay * v / len(y)
        square += grad**2
        v -= rate * grad / np.sqrt(square)
        square_b += g.sum() ** 2
        bias -= 0.1 * rate * g.sum() / np.sqrt(square_b)
    weights[used] = v
    return weights, bias


def _scores(shared):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value
        known: dict[str, float] = {}
        for batch in batches:
            out = []
            for t in batch:
                w = t.split() if t else []
                if len(known) > _CACHE:
                    known.clear()
                for word in set(w).difference(known):
                    known[word] = float(weights[bucket(word)])
                z = sum(map(known.__getitem__, w)) / len(w) + bias if w else -30.0
                out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
            yield pd.Series(out, dtype=float)

    return run


def classify(docs: DataFrame, out: str, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with a struct ``out``: votes, posterior (of the label model), score (of the linear
    model), keep (score of a half or more).

    All documents vote and are scored. Null and empty texts get bad votes, the score of an empty text and
    are not kept; equal texts have equal results; an empty table stays empty. Rows and other columns stay.
    """
    spark = ship(docs.sparkSession)
    counted = votes(docs.select(F.col(text_col).alias("text")), "votes").groupBy("votes").count().toPandas()  # <= 3 ** labellers rows
    patterns = np.array(counted["votes"].tolist(), dtype=int).reshape(-1, len(LABELLERS))
    post, _ = expectation_maximisation(patterns, counted["count"].to_numpy(float))
    n = int(counted["count"].sum())
    names = [free_name([*docs.columns, out], x) for x in ("_votes", "_post")]
    table_ = spark.createDataFrame(
        [([int(v) for v in p], float(q)) for p, q in zip(patterns, post, strict=True)], f"{names[0]} array<int>, {names[1]} double"
    )
    taught = docs.select(F.col(text_col).alias("text"))
    # an even sample of the texts by a hash
    part = min(1.0, sample / max(1, n))
    taught = taught.where(F.pmod(F.xxhash64("text", F.lit(_SEED)), F.lit(1 << 30)) < int(part * (1 << 30)) + 1).dropDuplicates(["text"])
    taught = votes(taught.limit(2 * sample), names[0]).join(F.broadcast(table_), names[0]).select("text", F.col(names[1]).alias("post"))
    rows = taught.mapInPandas(_counted, "post double, at array<int>, n array<double>").toPandas()
    shared = spark.sparkContext.broadcast(fit_linear(rows.sort_values(["post"], kind="stable")))
    scored = votes(docs, names[0], text_col).join(F.broadcast(table_), names[0], "left")
    score = free_name([*docs.columns, out, *names], "_score")
    scored = scored.withColumn(score, F.pandas_udf(_scores(shared), "double").asNondeterministic()(F.col(text_col)))
    whole = F.struct(
        F.col(names[0]).alias("votes"), F.col(names[1]).alias("posterior"), F.col(score).alias("score"), (F.col(score) >= 0.5).alias("keep")
    )
    return scored.select(*[F.col(c) for c in docs.columns], whole.alias(out))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Votes, label-model posterior, classifier score and decision of every document."""
    x = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), "x")
    return x.select("doc_id", F.array_join(F.transform("x.votes", lambda v: v.cast("string")), ",").alias("votes"), "x.posterior", "x.score", "x.keep")
