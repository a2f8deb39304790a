"""Session helpers: sessions for tests and benches, and what a job needs from the session it is given."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cpus: int = 8, name: str = "tessera", **conf: str) -> SparkSession:
    """A single-JVM session with adaptive execution and UTC, for tests and benches."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers of this session import the package from where the driver has it.

    A cluster whose executors do not share that folder needs the package through ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder; any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt over all cores by keys, where their scan is too small to be split for all of them.

    Spark makes no split smaller than ``spark.sql.files.openCostInBytes``, and a file of one row group is read by one task,
    so a small table of texts is worked on by few cores. A scan of at least that many bytes a core is left as it is: what is
    shuffled here is bounded by that size, and large tables are not shuffled at all.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    least = spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores, *keys) if size < least * cores else rows


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, which is ``spark.checkpoint.dir``.

    Where that is unset a local session gets a temporary folder; a cluster is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
