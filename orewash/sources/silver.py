"""Reading silver tables, and loose silver-like folders."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orewash.operators.columns import alias_ids, conform
from orewash.operators.dedupe import union_by_name
from orewash.sources.files import CSV_GLOB
from orewash.sources.typed import read_parquet
from orewash.specs import SPECS, DatasetSpec, struct_of


def read_silver(
    spark: SparkSession,
    path: str,
    spec: DatasetSpec,
    since: dt.date | None = None,
    until: dt.date | None = None,
    stringly: bool = False,
) -> DataFrame:
    """A silver table with its declared types. ``since`` and ``until`` (inclusive) prune its date partitions.

    ``stringly``: the files hold every canonical column as text; they are parsed on the way in.
    """
    schema = struct_of(f"{spec.ddl}, event_date date")
    if stringly:
        text = ", ".join(f"{c} string" for c in spec.columns)
        df = conform(spark.read.schema(f"{text}, event_date date").parquet(path), schema)
    else:
        df = spark.read.schema(schema).parquet(path)
    if since:
        df = df.where(F.col("event_date") >= F.lit(since))
    if until:
        df = df.where(F.col("event_date") <= F.lit(until))
    return df


def read_silver_tables(spark: SparkSession, base: str, stringly: bool = False) -> dict[str, DataFrame]:
    """The silver tables under ``base`` by dataset name."""
    return {n: read_silver(spark, f"{base}/{n}", spec, stringly=stringly) for n, spec in SPECS.items()}


def read_loose(spark: SparkSession, path: str) -> DataFrame | None:
    """Parquet, JSON and CSV files of one folder in one frame, ``id`` columns aliased; None if it has none.

    The columns are whatever the files hold, so JSON is the one place where a schema is inferred.
    """
    readers = (
        lambda: read_parquet(spark, path),
        lambda: [spark.read.option("pathGlobFilter", "*.{json,ndjson}").json(path)],
        lambda: [spark.read.option("pathGlobFilter", CSV_GLOB).option("header", True).csv(path)],
    )
    frames = []
    for read in readers:
        try:
            found = read()
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            continue
        for frame in found:
            if frame.columns:
                frames.append(frame.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in frame.columns)))
    if not frames:
        return None
    return alias_ids(union_by_name(*frames), for_transactions="transaction" in path.lower())
