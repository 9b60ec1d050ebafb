"""The pipeline against the stages' brute-force versions, and its parts."""

import corpus_pipeline
import pytest
from llm_cases import SF, documents, no_documents
from test_decontaminate import brute as windows
from test_packing import check
from test_secrets import BASE
from test_simhash import brute_components, brute_fingerprint

import __spark_entry__ as entry
from regionlens.llm import secrets as rules


@pytest.fixture(scope="module")
def brute_pipeline(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in documents(spark).collect())
    label = brute_components([brute_fingerprint(t) for _, t in docs])
    docs = [d for k, d in enumerate(docs) if label[k] == k]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [d for d in docs if not windows(d[1], items)[1]]

    def clean(text):
        spans = [(m.start(), m.end()) for _, p, good in BASE for m in p.finditer(text) if good(m)]
        spans += [s for r in rules.RULES[3:] for s in r.spans(text, text.lower())]
        out, end = "", 0
        for a, b in sorted(spans):
            if a > end or not out and a >= end:
                out += text[end:a] + "[SECRET]"
            end = max(end, b)
        return out + text[end:]

    return [(i, clean(t)) for i, t in docs]


def test_pipeline_against_brute_force(spark, brute_pipeline):
    rows = corpus_pipeline.run(spark, SF).collect()
    bins = check(rows, brute_pipeline)
    assert bins <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_stages_keep_the_columns(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secret_scan", "packing"]
    for docs in (documents(spark), no_documents(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
