import os
import pathlib

import pytest
from pyspark.sql import functions as F

from regionlens.operators import ml
from regionlens.session import Scratch, local_scratch, scratch_path, stage
from regionlens.sources import lower_headers, read_delimited, read_table, write_delimited, write_parquet
from regionlens.sources.tables import require_columns, resolve_key

SF = "/root/testdata/sf0.001"


def test_parquet_overwrite_roundtrip(spark):
    path = scratch_path(spark, "nation_copy")
    nat = read_table(spark, SF, "nation")
    write_parquet(nat, path)
    write_parquet(nat.limit(3), path)  # overwrite replaces, never appends
    assert spark.read.parquet(path).count() == 3


def test_delimited_roundtrip_and_headers(spark):
    path = scratch_path(spark, "region_csv")
    write_delimited(read_table(spark, SF, "region").select(F.col("r_regionkey").alias("R_KEY"), F.col("r_name").alias("R_NAME")), path, sep=";")
    back = lower_headers(read_delimited(spark, path, "R_KEY int, R_NAME string", sep=";"))
    assert back.columns == ["r_key", "r_name"] and back.count() == 5


def test_column_checks(spark):
    df = read_table(spark, SF, "region")
    assert resolve_key(df.withColumnRenamed("r_name", "UF"), "uf", "UF") == "UF"
    try:
        require_columns(df, "missing")
        raise AssertionError("expected KeyError")
    except KeyError:
        pass


def test_drop_vector_columns(spark):
    df = ml.assemble(read_table(spark, SF, "part", ["p_partkey", "p_size"]), ["p_size"])
    assert "features_raw" in df.columns
    assert ml.drop_vector_columns(df).columns == ["p_partkey", "p_size"]


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError):
        local_scratch(master)


def test_local_master_gets_a_folder():
    assert os.path.isdir(local_scratch("local[4]")) and os.path.isdir(local_scratch("local"))


def test_loop_state_is_deleted(spark):
    with Scratch(spark) as scratch:
        kept = scratch.keep(spark.range(5))
        folder = scratch.folder.removeprefix("file:")
        assert kept.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder)
    assert stage(spark.range(5)).count() == 5


def test_single_file_is_asked_for(spark):
    path = scratch_path(spark, "csv")
    write_delimited(spark.range(0, 100, 1, 4), path)
    assert spark.read.csv(path, header=True, sep=";").count() == 100
    assert len([f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".csv")]) > 1


def test_malformed_rows(spark, tmp_path):
    """A broken row fails the job, or is kept with its text where a column for it is named."""
    (tmp_path / "t.csv").write_text("id;x\n1;2.5\n2;abc\n3\n4;5.0;6\n5;7.5\n")
    with pytest.raises(Exception, match="MALFORMED"):
        read_delimited(spark, str(tmp_path / "t.csv"), "id int, x double").collect()
    rows = read_delimited(spark, str(tmp_path / "t.csv"), "id int, x double", corrupt="broken").collect()
    assert [(r.id, r.x, r.broken) for r in rows] == [(1, 2.5, None), (2, None, "2;abc"), (3, None, "3"), (4, 5.0, "4;5.0;6"), (5, 7.5, None)]


def test_edge_store(spark, tmp_path):
    """Batches in any order leave the last rows; buckets that a batch does not touch keep their files."""
    from regionlens.sources.edge_store import EdgeStore

    schema = "src string, dst string, weight double, ord int"
    rows = [(f"s{i % 7}", f"d{i % 5}", float(i), (i * 37) % 101) for i in range(100)] + [("s0", None, 1.0, 1), ("s0", None, 2.0, 2)]
    want = {}
    for a, b, w, o in rows:
        want[a, b] = max(want.get((a, b), (-1, 0.0)), (o, w))
    for parts in ([rows], [rows[60:], rows[:60], []], [rows[::2], rows[1::2], rows[:10]]):
        store = EdgeStore(spark, str(tmp_path / f"e{len(parts)}{len(parts[0])}"), buckets=8)
        for p in parts:
            store.upsert(spark.createDataFrame(p, schema))
        assert {(r.src, r.dst): r.weight for r in store.edges().collect()} == {k: w for k, (_, w) in want.items()}
    path = store.path
    before = {str(f) for f in pathlib.Path(path).rglob("*.parquet")}
    assert EdgeStore(spark, path, buckets=8).open().upsert(spark.createDataFrame([("s1", "d1", 9.0, 500)], schema)) == 1
    after = {str(f) for f in pathlib.Path(path).rglob("*.parquet")}
    kept = {f for f in before if f in after}
    folder = lambda f: f.rsplit("/", 1)[0]
    assert len({folder(f) for f in before - kept}) == 1 and len({folder(f) for f in kept}) >= 6
    assert {(r.src, r.dst): r.weight for r in store.edges().collect()}["s1", "d1"] == 9.0
    with pytest.raises(ValueError):
        EdgeStore(spark, str(tmp_path / "none")).edges()
