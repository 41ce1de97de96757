"""The shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one machine, may go without: it gets a temporary folder,
    which is then set for the session.
    """
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"{SETTING} must name a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="orewash-")
    spark.conf.set(SETTING, folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/orewash/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Later steps start from the written files, so they neither repeat the work behind ``df`` nor depend on executors
    that may be lost.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
