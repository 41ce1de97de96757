"""Which landing files may enter, judged by name, size and a light read; as rows, not as moves."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orewash.operators.split import Split
from orewash.sources.files import listing
from orewash.sources.landing import CUT_OFF, damaged_files

# File names that mark bookkeeping files, and the accepted endings.
BOOKKEEPING = ("_success", ".crc")
ACCEPTED = (".csv", ".csv.gz", ".json", ".ndjson", ".ndjson.gz", ".txt", ".gz")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def judged(files: DataFrame) -> DataFrame:
    """Add ``format``, ``verdict`` and ``reason`` to rows of ``(path, length)``.

    Verdicts: ``valid``, ``metadata``, ``bad_extension``, ``unreadable`` (an empty file). Names compare in lower
    case; a Parquet file must be a ``part-`` file.
    """
    name = F.lower("path")
    parquet = F.endswith(name, F.lit(".parquet"))
    accepted = (parquet & F.contains(name, F.lit("part-"))) | _any([F.endswith(name, F.lit(e)) for e in ACCEPTED])
    verdict = (
        F.when(_any([F.contains(name, F.lit(b)) for b in BOOKKEEPING]), "metadata")
        .when(~accepted, "bad_extension")
        .when(F.col("length") == 0, "unreadable")
        .otherwise("valid")
    )
    reason = (
        F.when(F.col("verdict") == "metadata", "bookkeeping file")
        .when((F.col("verdict") == "bad_extension") & parquet, "parquet without part-")
        .when(F.col("verdict") == "bad_extension", "extension not accepted")
        .when(F.col("verdict") == "unreadable", "empty file")
    )
    form = F.regexp_extract(name, r"\.((?:csv|json|ndjson|txt|parquet)(?:\.gz)?|gz)$", 1)
    return files.withColumn("format", F.when(form != "", form)).withColumn("verdict", verdict).withColumn(
        "reason", reason
    )


def _canonical_uri(path: Column) -> Column:
    """Local paths come as ``file:/x`` from listings and ``file:///x`` from file metadata."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def _with_empty(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Add the files of length zero. Scans pass over those, but the frame's list of input files names them."""
    names = spark.createDataFrame([(unquote(name),) for name in files.inputFiles()], "name string")
    named = names.join(files, _canonical_uri(F.col("name")) == _canonical_uri(F.col("path")), "left")
    return named.select(
        _canonical_uri(F.col("name")).alias("path"), F.coalesce("length", F.lit(0).cast("bigint")).alias("length")
    )


def landing_audit(spark: SparkSession, folder: str, dataset: str, probe: bool = False) -> DataFrame:
    """A manifest of the files in ``folder``: ``(path, dataset, format, length, verdict, reason)``.

    Files that Spark treats as hidden (names starting with ``_`` or ``.``) are never read and not listed. ``probe``
    also reads gzip and Parquet files to their end and marks those that are cut off (``damaged``) or not sound at all.
    """
    files = listing(spark, folder)
    if files is None:
        files = spark.createDataFrame([], "path string, length bigint")
    else:
        files = _with_empty(spark, files)
    manifest = judged(files).select("path", F.lit(dataset).alias("dataset"), "format", "length", "verdict", "reason")
    return _probed(spark, manifest, folder) if probe else manifest


def _probed(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    damaged = damaged_files(spark, folder).select(_canonical_uri(F.col("path")).alias("path"), "damage")
    found = (F.col("verdict") == "valid") & F.col("damage").isNotNull()
    return (
        manifest.join(damaged, "path", "left")
        .withColumn("reason", F.when(found, F.col("damage")).otherwise(F.col("reason")))
        .withColumn("verdict", F.when(found & (F.col("damage") == CUT_OFF), "damaged").when(found, "unreadable").otherwise(F.col("verdict")))
        .drop("damage")
    )


def routed(manifest: DataFrame) -> Split:
    """The files that go on to bronze, and those that go to quarantine."""
    valid = F.col("verdict") == "valid"
    return Split(manifest.where(valid), manifest.where(~valid))
