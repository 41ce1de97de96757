"""Writing silver, quarantine, metrics and gold files, and checking that they are there."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from orewash.operators.columns import conform, locked, voids_to_text
from orewash.specs import DatasetSpec, gold_schema


class MissingOutputError(RuntimeError):
    """A layer lacks a table it must have, or the table has no rows."""


def write_silver(df: DataFrame, path: str, spec: DatasetSpec, stringly: bool = False) -> None:
    """Replace a silver table, laid out by ``event_date``.

    Rows are rebalanced on the date, so a date fills few files; a date that holds much of the data is split over
    several tasks at run time.
    """
    out = locked(df, spec, stringly).hint("rebalance", "event_date")
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "static")  # dates no longer there go as well
    writer.option("compression", "snappy").partitionBy("event_date").parquet(path)


def write_undated(df: DataFrame, path: str) -> None:
    """Replace an unpartitioned table; for frames that have no date to lay out by."""
    voids_to_text(df).write.mode("overwrite").option("compression", "snappy").parquet(path)


def append_quarantine(rejected: DataFrame, base: str, spec: DatasetSpec, run_id: str | None = None) -> None:
    """Add rejected rows, with their reasons, to ``base/<dataset>``.

    Rows of a run with an id have it in the column ``run_id``; a run that is repeated under its id replaces its own rows.
    """
    path = f"{base}/{spec.name}"
    mode, path = ("append", path) if run_id is None else ("overwrite", f"{path}/run_id={run_id}")
    voids_to_text(rejected).write.mode(mode).option("compression", "snappy").parquet(path)


def write_metrics(metrics: DataFrame, base: str, spec: DatasetSpec) -> None:
    """Replace the metrics CSV of a dataset, ``base/<dataset>``; one line per metric."""
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{base}/{spec.name}")


def write_gold(
    df: DataFrame, base: str, table: str, compact: bool = False, partition_by: str | None = None
) -> None:
    """Replace a gold table with its fixed schema.

    ``compact`` pays one more shuffle to even out file sizes; without it files follow the tasks of the last stage.
    ``partition_by`` lays the table out by a column (and always pays that shuffle).
    """
    out = conform(df, gold_schema(table))
    if partition_by:
        writer = out.hint("rebalance", partition_by).write.partitionBy(partition_by)
    else:
        writer = (out.hint("rebalance") if compact else out).write
    writer.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{base}/{table}")


def read_gold(spark: SparkSession, base: str, table: str) -> DataFrame:
    return spark.read.schema(gold_schema(table)).parquet(f"{base}/{table}")


def require_outputs(spark: SparkSession, paths: Iterable[str]) -> None:
    """Raise :class:`MissingOutputError` unless every path holds a Parquet table with at least one row."""
    lacking = []
    for path in paths:
        try:
            empty = spark.read.parquet(path).isEmpty()
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            empty = True
        if empty:
            lacking.append(path)
    if lacking:
        raise MissingOutputError("no rows at " + ", ".join(lacking))
