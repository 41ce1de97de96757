"""Parquet files that need not agree on their types: one scan for each set of files that do."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StructField, StructType

from orewash.operators.columns import plain_names
from orewash.scratch import written
from orewash.sources.files import PARQUET_GLOB, Where, can_open, file_kind, listing, opened, path_of, paths_of, reader

_CLASH = "[CANNOT_MERGE_SCHEMAS]"  # in what Spark raises when types clash
_SHAPE = "uri string, shape string"


def widened(a: DataType, b: DataType) -> DataType | None:
    """The type that one scan can read both as without changing a value's text; None if there is none.

    Whole numbers widen to the larger type. Others do not: a float's text as double is a different one.
    """
    if a == b:
        return a
    if isinstance(a, IntegralType) and isinstance(b, IntegralType):
        return max(a, b, key=lambda t: ("tinyint", "smallint", "int", "bigint").index(t.simpleString()))
    return None


def merged(a: StructType, b: StructType) -> StructType | None:
    """Columns of either, by name in any case, each of a type that holds both; None if a column has none."""
    fields = {f.name.lower(): f for f in a.fields}
    for field in b.fields:
        held = fields.get(field.name.lower())
        wide = widened(held.dataType, field.dataType) if held else field.dataType
        if wide is None:
            return None
        fields[field.name.lower()] = StructField(held.name if held else field.name, wide)
    return StructType(list(fields.values()))


def shapes(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``(uri, shape)``: the schema of each Parquet file as text, from its footer alone.

    Footers are read by tasks. Where only Spark knows the file system, the driver asks it for one file after another.
    """
    first = files.first()
    if first is None or can_open(first["uri"]):

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                uris = batch.column("uri").to_pylist()
                found = []
                for uri in uris:
                    with opened(uri) as file:
                        schema = pq.ParquetFile(file).schema
                    found.append("\n".join(f"{c.path}\t{c.physical_type}\t{c.logical_type}\t{c.max_repetition_level}" for c in map(schema.column, range(len(schema)))))
                yield pa.RecordBatch.from_pydict({"uri": uris, "shape": found}, pa.schema([("uri", pa.string()), ("shape", pa.string())]))

        return files.select("uri").mapInArrow(look, _SHAPE)
    asked = ((uri, spark.read.parquet(path_of(uri)).schema.simpleString()) for (uri,) in files.select("uri").toLocalIterator())
    return spark.createDataFrame(list(asked), _SHAPE)


def groups(spark: SparkSession, where: Where) -> list[DataFrame]:
    """One scan for each group of files whose types can be read together.

    There are as many groups at most as the files have schemas; for each schema the driver looks at one file.
    """
    files = listing(spark, where).where(file_kind(F.col("path")) == "parquet")
    index = written(shapes(spark, files), "parquet-shapes")
    kinds = index.groupBy("shape").agg(F.count("*").alias("n"), F.min("uri").alias("uri")).orderBy(F.desc("n"), "shape").collect()
    found: list[tuple[StructType, list[str]]] = []
    for kind in kinds:
        schema = spark.read.parquet(path_of(kind["uri"])).schema
        for i, (held, members) in enumerate(found):
            both = merged(held, schema)
            if both is not None:
                found[i] = (both, [*members, kind["shape"]])
                break
        else:
            found.append((schema, [kind["shape"]]))
    frames = []
    for schema, members in found:
        uris = index.where(F.col("shape").isin(members)).select("uri").toLocalIterator()  # names, as in Spark's own file index
        frames.append(spark.read.schema(schema).parquet(*(path_of(r["uri"]) for r in uris)))
    return frames


def read_parquet(spark: SparkSession, where: Where) -> list[DataFrame]:
    """Parquet files with their own types, as one frame or, where those clash, as few as they allow.

    Columns that only some files have are kept. Spark's own merging of footers, one job, settles the common case.
    """
    paths = [where] if isinstance(where, str) else paths_of(where)
    try:
        return [plain_names(reader(spark, PARQUET_GLOB).option("mergeSchema", True).parquet(*paths))]
    except (PySparkException, Py4JJavaError) as error:
        if _CLASH not in str(error):
            raise
    return [plain_names(frame) for frame in groups(spark, where)]
