import hashlib
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from regionlens.functions.columns import erfc, hash_u32, normal_two_sided_p, ratio
from regionlens.functions.permutation import dense_index, pseudo_p, spread_for_fanout
from regionlens.operators.report import fixed_decimals


def test_dense_index_equals_row_number(spark):
    df = spark.range(5000, numPartitions=7).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id"))
    got = dense_index(df, "k", "id", out="pos")
    ref = df.withColumn("ref", F.row_number().over(Window.orderBy("k", "id")) - 1)
    bad = got.join(ref, ["k", "id"]).where(F.col("pos") != F.col("ref")).count()
    assert bad == 0 and got.count() == 5000


def test_erfc_and_normal_p(spark):
    xs = [-3.0, -1.0, -0.2, 0.0, 0.3, 1.0, 2.5, 5.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select("x", erfc("x").alias("e"), normal_two_sided_p("x").alias("p")).collect()
    for r in rows:
        assert r.e == pytest.approx(math.erfc(r.x), rel=2e-7, abs=1e-12)
        assert r.p == pytest.approx(math.erfc(abs(r.x) / math.sqrt(2)), rel=2e-7, abs=1e-12)


def test_hash_u32_matches_md5(spark):
    df = spark.createDataFrame([(3, 17), (0, 123456789)], "perm long, id long")
    for r in df.select("perm", "id", hash_u32(42, "perm", "id").alias("h")).collect():
        want = int(hashlib.md5(f"42:{r.perm}:{r.id}".encode()).hexdigest()[:8], 16)
        assert r.h == want


def test_pseudo_p_folds_tails(spark):
    df = spark.createDataFrame([(0,), (10,), (500,), (990,), (999,)], "n_ge int")
    got = [r.p for r in df.select(pseudo_p(F.col("n_ge"), 999).alias("p")).collect()]
    assert got == pytest.approx([1 / 1000, 11 / 1000, 500 / 1000, 10 / 1000, 1 / 1000])


def test_ratio_and_fixed_decimals(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.119047619, 1.0), (-2.5, 4.0), (0.005, 1.0)], "a double, b double")
    rows = df.select(ratio("a", "b").alias("r"), fixed_decimals("a", 2).alias("t2"), fixed_decimals("a", 4).alias("t4")).collect()
    assert rows[0].r is None
    assert [r.t4 for r in rows] == ["1.0000", "0.1190", "-2.5000", "0.0050"]
    assert rows[1].t2 == "0.12" and rows[2].t2 == "-2.50"


def test_spread_for_fanout(spark):
    one = spark.range(100, numPartitions=1)
    assert spread_for_fanout(one, 100, 1000).rdd.getNumPartitions() > 1
    many = spark.range(100, numPartitions=8)
    assert spread_for_fanout(many, 100, 1).rdd.getNumPartitions() == 8
