"""Session helpers: a tuned local session for tests and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "regionlens") -> SparkSession:
    """Session used by tests and the bench.  On a cluster the caller's session is used instead."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when the session has none.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is; without it
    this raises, because a machine's own folder is not seen by the other machines.  Only a
    local master gets a scratch folder, which is removed when Python exits.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = local_scratch(sc.master)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def local_scratch(master: str) -> str:
    """A scratch folder of this process, for a master that runs everything in one process."""
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
    folder = tempfile.mkdtemp(prefix="regionlens-ckpt-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


class Scratch:
    """Tables written into the shared folder and read back: the plan behind them is cut and the
    rows survive the loss of any executor.  As a context manager it deletes them at the end, for
    the state of loops; a table that leaves the block is written by ``stage``."""

    def __init__(self, spark: SparkSession, name: str = "scratch"):
        self.spark, self.folder, self.n = spark, scratch_path(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def path(self) -> str:
        self.n += 1
        return f"{self.folder}/{self.n}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written once into the shared folder and read back (see ``Scratch``); it stays."""
    return Scratch(df.sparkSession, name).keep(df)
