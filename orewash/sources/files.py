"""What landing files there are, told from their names and sizes, and a way for tasks to open one without reading it whole."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

# Which file names hold which format.
PARQUET_ENDINGS = (".parquet",)
JSON_ENDINGS = (".json", ".ndjson", ".json.gz", ".ndjson.gz", ".json.txt", ".ndjson.txt")
CSV_ENDINGS = (".csv",)
LOOSE_ENDINGS = (".gz", ".txt")

Where = str | Sequence[str]  # a folder, or a list of files


def _glob(endings: Iterable[str]) -> str:
    """The names with one of the endings, in whatever case: ``*{.[cC][sS][vV]}``."""
    return "*{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in endings) + "}"


PARQUET_GLOB, JSON_GLOB, CSV_GLOB = map(_glob, (PARQUET_ENDINGS, JSON_ENDINGS, CSV_ENDINGS))
TEXT_GLOB = _glob((*CSV_ENDINGS, *LOOSE_ENDINGS))

_MISSING_PATH = ("PATH_NOT_FOUND", "PATH_NOT_EXISTS")


def reader(spark: SparkSession, glob: str | None = None) -> DataFrameReader:
    return spark.read.option("pathGlobFilter", glob) if glob else spark.read


def paths_of(where: Where) -> str | list[str]:
    return where if isinstance(where, str) else list(where)


def listing(spark: SparkSession, where: Where) -> DataFrame | None:
    """The files as ``(path, length, modificationTime, uri)``, contents unread; None if they do not exist."""
    try:
        files = spark.read.format("binaryFile").load(paths_of(where))
    except AnalysisException as error:
        if error.getCondition() in _MISSING_PATH:
            return None
        raise
    return files.select("path", "length", "modificationTime", F.col("_metadata.file_path").alias("uri"))


def file_kind(path: Column) -> Column:
    """``parquet``, ``json``, ``csv`` or ``loose`` (text to be told by its first line); null for any other name."""
    name = F.lower(path)

    def ends(endings: Iterable[str]) -> Column:
        return reduce(lambda a, b: a | b, (F.endswith(name, F.lit(e)) for e in endings))

    return (
        F.when(ends(PARQUET_ENDINGS), "parquet")
        .when(ends(JSON_ENDINGS), "json")
        .when(ends(CSV_ENDINGS), "csv")
        .when(ends(LOOSE_ENDINGS), "loose")
    )


def opened(uri: str) -> pa.NativeFile:
    """A file for reading at any place, through the file system that its address names."""
    system, path = FileSystem.from_uri(uri)
    return system.open_input_file(path)


def can_open(uri: str) -> bool:
    """Whether Python knows the file system; some are known to Spark alone."""
    try:
        system, path = FileSystem.from_uri(uri)
        return system.get_file_info(path).type == FileType.File
    except (pa.ArrowException, OSError, ValueError):
        return False


def path_of(uri: str) -> str:
    """A path that Spark's readers take, from the address that rows are told by."""
    return unquote(uri)
