import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import SF, awkward, documents, no_documents
from pyspark.sql import functions as F

from regionlens.llm import langid as m

TEXTS = {"aa": ["banana bandana nab", "ban an anna", "nabana"], "bb": ["kikiriki kirk rik", "rikiki kik", "irk kirki"]}


def brute_probability(word, texts):
    """Interpolated Kneser-Ney of order 4 in plain dictionaries; bits of the word."""
    grams = Counter()
    for t in texts:
        for w in t.split():
            w = "\x02\x02\x02" + w + "\x03"
            grams.update(w[i : i + 4] for i in range(len(w) - 3))
    level, p, g = grams, {}, {}
    for order in (4, 3, 2, 1):
        n1, n2 = sum(n == 1 for n in level.values()), sum(n == 2 for n in level.values())
        d = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
        total, types = Counter(), Counter()
        for x, n in level.items():
            total[x[:-1]] += n
            types[x[:-1]] += 1
        p[order] = {x: (n - d) / total[x[:-1]] for x, n in level.items()}
        g[order] = {c: d * types[c] / total[c] for c in total}
        lower = Counter()
        for x in level:
            lower[x[1:]] += 1
        level = lower
    return p, g


def brute_bits(word, model, uniform):
    p, g = model
    w, bits = "\x02\x02\x02" + word + "\x03", 0.0
    for i in range(3, len(w)):
        q = uniform
        for order in (1, 2, 3, 4):
            x = w[i - order + 1 : i + 1]
            q = p[order].get(x, 0.0) + g[order].get(x[:-1], 1.0) * q
        bits -= np.log2(q)
    return bits


def test_model_against_brute_force(spark):
    train = spark.createDataFrame([(t, lang) for lang, ts in TEXTS.items() for t in ts], "text string, lang string")
    model = m.fit(train)
    assert model.langs == ["aa", "bb"]
    letters = {c for ts in TEXTS.values() for t in ts for c in t if c != " "}
    assert model.uniform == pytest.approx(1 / (len(letters) + 2))
    words = ["banana", "kirk", "zebra", "a", "naban"]
    got = m.Scorer(model).word_bits(words)
    for k, lang in enumerate(model.langs):
        brute = brute_probability(None, TEXTS[lang])
        assert got[:, k] == pytest.approx([brute_bits(w, brute, model.uniform) for w in words], rel=1e-4)
    assert list(got[:, -1]) == [len(w) + 1 for w in words]


def test_probabilities_sum_to_one(spark):
    train = spark.createDataFrame([(t, "aa") for t in TEXTS["aa"]], "text string, lang string")
    p, g = brute_probability(None, TEXTS["aa"])
    for context in g[4]:
        total = 0.0
        for c in [*p[1]]:
            q = 1 / len(p[1])
            for order in (1, 2, 3, 4):
                x = (context + c)[-order:]
                q = p[order].get(x, 0.0) + g[order].get(x[:-1], 1.0) * q
            total += q
        assert total == pytest.approx(1.0)
    tables = m.fit(train).tables
    assert sum(len(h) for h, _ in tables.values()) == sum(map(len, p.values())) + sum(map(len, g.values()))


def test_every_count_is_kept(spark):
    """A language of 540,000 4-grams, most of them seen once: what scoring gathers is not cut."""
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, w)) for w in (rng.integers(0, 20_000, (176_000, 3)) + 0x4E00).tolist()]
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 != 2]  # all but one text teach
    held = next(i for i in range(1000) if i not in ids)
    zh = dict(zip([held, *ids], texts, strict=False))
    rows = [(i, t, "zh") for i, t in zh.items()] + [(ids[-1 - i], t, "aa") for i, t in enumerate(TEXTS["aa"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    got = {r["doc_id"]: r["x"] for r in m.identify(df, "x").collect()}
    brute = brute_probability(None, [t for i, t in zh.items() if i != held])
    assert len(brute[0][4]) > 500_000
    letters = {c for i, t, _ in rows if i != held for c in t if c != " "}
    for i in (held, *ids[:2]):
        some = zh[i].split()
        bits = sum(brute_bits(w, brute, 1 / (len(letters) + 2)) for w in some) / (4 * len(some))
        assert (got[i]["lang"], got[i]["chars"]) == ("zh", 4 * len(some)) and got[i]["bits"] == pytest.approx(bits, rel=1e-4)


def test_joined_scores_equal_the_models(spark):
    docs = documents(spark).select("doc_id", "text", "lang")
    scorer = m.Scorer(m.fit(docs.where(m.train_rows(docs)).select("text", "lang")))
    got = m.identify(docs, "x").collect()
    sums = scorer.sums([r["text"] for r in got])
    assert [r["x"]["chars"] for r in got] == sums[:, -1].tolist()
    assert [r["x"]["bits"] for r in got] == pytest.approx(sums[:, :-1].min(axis=1) / np.maximum(sums[:, -1], 1), rel=1e-4)


def test_held_out_accuracy(spark):
    got = m.op8_language(spark, SF).join(documents(spark).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == documents(spark).count() and len(held) > 20
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)
    assert not any(r["rejected"] for r in got)


def test_foreign_texts_are_rejected(spark):
    odd = spark.createDataFrame([(10_000 + i, t, None) for i, t in enumerate(["qxzjvk wqpzx jjqkx vvwxq " * 9, "пример текста на другом языке " * 9])], "doc_id bigint, text string, lang string")
    docs = documents(spark).select("doc_id", "text", "lang").union(odd)
    got = {r["doc_id"]: r["x"]["rejected"] for r in m.identify(docs, "x").collect()}
    assert got[10_000] and got[10_001] and sum(got.values()) == 2


def test_languages_in_several_passes(spark, monkeypatch):
    """Three languages at a time, two, one: the same scores as all at once."""
    docs = documents(spark).select("doc_id", "text", "lang")
    want = {r["doc_id"]: r["x"] for r in m.identify(docs, "x").collect()}
    for n in (3, 1):
        monkeypatch.setattr(m, "LANGUAGES", n)
        for r in m.identify(docs, "x").collect():
            a, b = want[r["doc_id"]], r["x"]
            assert (a["lang"], a["chars"], a["rejected"]) == (b["lang"], b["chars"], b["rejected"])
            assert [a["score"], a["bits"], a["next"]] == pytest.approx([b["score"], b["bits"], b["next"]], rel=1e-4)


def test_a_hidden_language_is_rejected(spark):
    """Texts of a language that the training rows lack are rejected nearly all, those of the others not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    hidden = docs.withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    got = m.identify(hidden, "x", keep=["doc_id"]).join(docs, "doc_id").collect()
    unseen = [r["x"]["rejected"] for r in got if r["lang"] == "de"]
    assert len(unseen) > 50 and np.mean(unseen) > 0.95
    assert not any(r["x"]["rejected"] for r in got if r["lang"] != "de")


def test_rejected_rows_go_with_repeated_ids(spark):
    odd = [(1, "пример текста на другом языке " * 9, None, "a", 1), (1, None, "en", "a", 0)]
    docs = documents(spark)
    both = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("_hash", F.lit(1)).withColumn("_text", F.lit(2)).withColumn("_ID", F.lit(3))
    kept = m.drop_rejected(both)
    assert kept.columns == both.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_awkward_rows(spark):
    docs = awkward(spark).withColumn("score", F.lit(5)).withColumn("_lang", F.lit(5))
    got = m.identify(docs, "x")
    assert got.columns == [*docs.columns, "x"] and got.count() == docs.count()
    by = defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append(r["x"])
    assert all(by[i][0]["lang"] == "und" and by[i][0]["rejected"] and by[i][0]["score"] == 0 for i in (1, 2, 3, 6))
    assert len(by[5]) == 2 and by[5][0] == by[5][1]
    assert by[None][0]["held_out"] is False
    kept = m.drop_rejected(docs)
    assert kept.columns == docs.columns


def test_nothing_to_learn_from(spark):
    assert m.identify(no_documents(spark), "x").count() == 0
    docs = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["x"]["lang"] for r in m.identify(docs, "x").collect()} == {"und"}
