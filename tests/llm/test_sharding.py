import zlib
from collections import Counter, defaultdict

from llm_cases import SF, awkward, documents, no_documents
from pyspark.sql import functions as F

from regionlens.llm import sharding as s


def check(rows, docs, shards):
    """The law ``rows``, gapless slots, sizes and checksums. Returns the shards of each text."""
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(slots[k]) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    where = defaultdict(Counter)
    for r in rows:
        where[r["size"], r["text_crc32"]][r["shard"]] += 1
    return where


def test_query(spark):
    rows = s.op7_sharding(spark, SF).collect()
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    where = check(rows, docs, 40)
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    groups = [c for c in where.values() if sum(c.values()) > 1]
    cut = sum(len(c) > 1 for c in groups)
    assert cut <= 0.2 * len(groups)


def test_linked_documents_meet(spark):
    """A group beyond a shard's quota, groups that fit, and single documents."""
    rows = [(i, "giant") for i in range(400)] + [(1000 + i, f"group {i % 30}") for i in range(300)] + [(5000 + i, f"single {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    where = check(s.shard_documents(df, shards=10).collect(), rows, 10)
    sizes = sorted(((sum(c.values()), len(c)) for c in where.values()), reverse=True)
    assert sizes[0][0] == 400 and sizes[0][1] <= 5  # four shards of 120 can hold it
    assert sum(n > 1 for total, n in sizes if total == 10) <= 6


def test_every_document_linked(spark):
    """Pairs only, so that there is no free room beside the documents' own."""
    rows = [(i, f"pair {i % 3000}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    where = check(s.shard_documents(df, shards=10).collect(), rows, 10)
    assert sum(len(c) == 1 for c in where.values()) >= 0.9 * len(where)


def test_awkward_rows(spark):
    docs = awkward(spark).withColumn("shard", F.lit(-1)).withColumn("grp", F.lit("x"))
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(s.shard_documents(docs, shards=3).collect(), given, 3)
    check(s.shard_documents(docs, shards=40).collect(), given, 40)
    assert s.shard_documents(no_documents(spark)).count() == 0
