"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Edit alignment holds one distance matrix per sentence pair, so batches stay small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "redpencil", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting gets a temporary folder; a cluster without it is an
    error, because a machine-local folder is lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="redpencil-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, cutting the lineage."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SPREAD = "redpencil.spread.scans"


def spread(scan: DataFrame) -> DataFrame:
    """With the session setting ``SPREAD``, use all cores on a scan with fewer splits than cores.

    For files of one row group on one machine; without the setting a scan stays as it is.
    """
    if scan.sparkSession.conf.get(SPREAD, "false") != "true":
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def deal(rows: DataFrame) -> DataFrame:
    """The same rows in turn over at least as many partitions as there are cores or a shuffle makes.

    For tables whose rows cost far more than their way through an exchange: a scan has no more tasks with rows than
    its files have row groups, and one file often has a single one, whatever its size.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def unnest(df: DataFrame, keep: list, array: Column | str, item: str, pos: str | None = None) -> DataFrame:
    """One row per array element. An outer explode, because a plain one makes the optimizer add a
    filter on the array's size below, which computes the array twice."""
    place = pos or f"_{item}_pos"
    rows = df.select(*keep, F.posexplode_outer(array).alias(place, item)).where(F.col(place).isNotNull())
    return rows if pos else rows.drop(place)
