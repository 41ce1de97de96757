"""Reading a landing folder that mixes Parquet, JSON lines and delimited text, plain or gzipped.

Text is read without inference, every column a string, so formats and drifting types never clash. Parquet keeps its
types, and files whose types clash are read apart. JSON files are one scan, all other text is one scan, whatever its
headers, and Parquet is as many as its types ask for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from orewash.functions import text_of
from orewash.operators.columns import plain_names, quoted
from orewash.operators.dedupe import union_by_name
from orewash.sources.delimited import json_columns, read_text, spellings
from orewash.sources.files import CSV_GLOB, JSON_GLOB, Where, can_open, file_kind, listing, opened, paths_of, reader
from orewash.sources.typed import read_parquet
from orewash.specs import CORRUPT, DatasetSpec

CUT_OFF = "gzip cut off"
_HELD = "column string, type string, rows bigint"
_DAMAGE = pa.schema([("path", pa.string()), ("damage", pa.string())])
_STEP = 1 << 20


def damaged_files(spark: SparkSession, where: Where) -> DataFrame:
    """The gzip and Parquet files that cannot be read to their end: ``(path, damage)``.

    Each file is read to its end by one task, step by step, so nothing of a file that is cut off passes for all of it.
    Where only Spark knows the file system, a task holds the packed file. Plain text has no end of its own and cannot be
    told to be cut off.
    """
    files = listing(spark, where)
    packed = F.lower("path").rlike(r"\.(gz|parquet)$") & (F.col("length") > 0)
    files = files.where(packed)
    first = files.first()
    direct = first is None or can_open(first["uri"])
    if not direct:
        whole = spark.read.format("binaryFile").load(paths_of(where)).where(packed)
        files = whole.select("path", F.col("_metadata.file_path").alias("uri"), "content")

    def read_to_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, (path, uri) in enumerate(zip(batch.column("path").to_pylist(), batch.column("uri").to_pylist(), strict=True)):
                with opened(uri) if direct else pa.BufferReader(batch.column("content")[i].as_buffer()) as file:
                    fault = _damage(path, file)
                if fault:
                    found.append((path, fault))
            yield pa.RecordBatch.from_pydict({"path": [p for p, _ in found], "damage": [f for _, f in found]}, _DAMAGE)

    return files.mapInArrow(read_to_end, "path string, damage string")


def _damage(path: str, file: pa.NativeFile) -> str | None:
    """What keeps a file from being read to its end, if anything does."""
    if path.lower().endswith(".parquet"):
        try:
            for _ in pq.ParquetFile(file).iter_batches():
                pass
        except (pa.ArrowException, OSError) as error:
            return f"unreadable Parquet: {str(error).splitlines()[0][:80]}"
        return None
    member, data = None, file.read(_STEP)
    try:
        while data:  # one member of the file after another
            member = member or zlib.decompressobj(31)
            member.decompress(data)
            data = member.unused_data
            if member.eof:
                member = None
            data = data or file.read(_STEP)
    except zlib.error:
        return "not sound gzip"
    return CUT_OFF if member else None


def _text_schema(names: Iterable[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def read_json_lines(spark: SparkSession, where: Where, spec: DatasetSpec, glob: str | None = JSON_GLOB) -> DataFrame:
    """JSON lines as text columns; nested values stay JSON text, lines that do not parse go to the corrupt column."""
    names = {c: spellings(c) for c in spec.columns}
    schema = _text_schema([*(s for of in names.values() for s in of), CORRUPT])
    json = reader(spark, glob).schema(schema)
    json = json.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    df = json.json(paths_of(where))
    return df.select(*(F.coalesce(*map(quoted, of)).alias(c) for c, of in names.items()), CORRUPT)


def read_same_header(spark: SparkSession, where: Where, columns: list[str]) -> DataFrame:
    """``.csv`` files that all have ``columns`` in this order, as text.

    Short lines are filled with null. Lines with a value beyond the last column are kept whole in the corrupt column.
    """
    unique = [c if c not in columns[:i] else f"{c}__{i}" for i, c in enumerate(columns)]
    files = reader(spark, CSV_GLOB).schema(_text_schema([*unique, CORRUPT]))
    files = files.option("header", True).option("enforceSchema", True)
    files = files.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    files = files.option("columnPruning", False)  # a line's length shows only if all of it is parsed
    rows = files.csv(paths_of(where))
    # The parser sets aside lines of any other length; only those are looked at again, for a value too many.
    wider = ", ".join(f"c{i} string" for i in range(len(unique) + 1))
    surplus = F.from_csv(F.col(CORRUPT), F.lit(wider))[f"c{len(unique)}"]
    corrupt = F.when(F.col(CORRUPT).isNotNull() & surplus.isNotNull(), F.col(CORRUPT))
    return plain_names(rows.withColumn(CORRUPT, corrupt))


class Source(NamedTuple):
    """One reader over the landing files: its rows, and what the files themselves name and hold.

    ``names``: (column, type, rows), how many rows have a column, by the type that its values have there. It is made up of
    parts that add up.
    """

    kind: str
    rows: DataFrame
    names: DataFrame


def landing_sources(
    spark: SparkSession,
    where: Where,
    spec: DatasetSpec,
    one_header: bool = False,
    skip_damaged: bool = False,
) -> list[Source]:
    """One source for each scan that the files in ``where`` (a folder, or a list of files) need.

    Delimited files may differ in their header, so by default the first line of each is looked at first: a line
    that starts an object makes the file JSON lines, one that names the key (or nothing but columns) is a header, and
    anything else is data in canonical column order. (``.csv`` files always have a header.) ``one_header`` promises that
    all ``.csv`` files share one header and saves that look for them. ``skip_damaged`` leaves out files that cannot be
    read to their end, each of them whole, instead of failing; the landing audit lists them.
    """
    files = listing(spark, where)
    if files is None:
        return []
    if skip_damaged:
        damaged = {r["path"] for r in damaged_files(spark, where).select("path").collect()}  # names, of the faulty ones
        if damaged:
            sound = files.where(~F.col("path").isin(list(damaged))).select("path").toLocalIterator()
            where = [r["path"] for r in sound]  # names, as in Spark's own file index
            if not where:
                return []
            files = listing(spark, where)
    present = {r["kind"] for r in files.select(file_kind(F.col("path")).alias("kind")).distinct().collect()}

    def held(rows: DataFrame) -> DataFrame:
        """Columns by their type in the files, with their values counted in one aggregate."""
        of = [f for f in rows.schema.fields if f.name != CORRUPT]
        counts = rows.agg(*(F.count(quoted(f.name)).alias(f"n{i}") for i, f in enumerate(of)))
        named = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"n{i}").alias("rows")) for i, f in enumerate(of)]
        return counts.select(F.inline(F.array(*named))) if of else spark.createDataFrame([], _HELD)

    sources = []
    if "parquet" in present:
        sources += [Source("parquet", rows, held(rows)) for rows in read_parquet(spark, where)]
    if "json" in present:
        lines = reader(spark, JSON_GLOB).text(paths_of(where))
        sources.append(Source("json", read_json_lines(spark, where, spec), json_columns(lines)))
    if one_header and "csv" in present:
        names = reader(spark, CSV_GLOB).option("header", True).csv(paths_of(where)).columns
        rows = read_same_header(spark, where, names)
        sources.append(Source("delimited", rows, held(rows)))
    to_tell = present & ({"loose"} if one_header else {"csv", "loose"})
    if to_tell and (found := read_text(spark, where, spec, to_tell)):
        sources.append(Source("text", *found))
    return sources


def landing_frames(
    spark: SparkSession,
    where: Where,
    spec: DatasetSpec,
    one_header: bool = False,
    skip_damaged: bool = False,
) -> list[DataFrame]:
    """The rows of every source in ``where``, each with the types its format gives it."""
    return [source.rows for source in landing_sources(spark, where, spec, one_header, skip_damaged)]


def as_text(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """The canonical columns of ``df`` and the corrupt-line column as text, null where absent."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *(
            (text_of(F.col(c), types[c]) if c in types else F.lit(None).cast("string")).alias(c)
            for c in (*spec.columns, CORRUPT)
        )
    )


def read_landing(
    spark: SparkSession,
    where: Where,
    spec: DatasetSpec,
    one_header: bool = False,
    skip_damaged: bool = False,
) -> DataFrame:
    """Everything readable in ``where`` as one text frame of canonical columns; no rows if there is nothing."""
    frames = landing_frames(spark, where, spec, one_header, skip_damaged)
    if not frames:
        return spark.createDataFrame([], _text_schema([*spec.columns, CORRUPT]))
    return union_by_name(*(as_text(f, spec) for f in frames))


def drift_counts(spark: SparkSession, where: Where, spec: DatasetSpec) -> DataFrame:
    """What the landing files hold, against the canonical columns: ``(column, status, type, rows)``.

    ``status`` is ``known``, ``extra`` (not canonical) or ``missing`` (in no file; no type, no rows). Types are those that
    values have in the files: Parquet's own, JSON's, or string. Counts of several runs, or of parts of one, add up.
    """
    seen = spark.createDataFrame([], _HELD)
    for source in landing_sources(spark, where, spec):
        seen = seen.union(source.names)
    seen = seen.groupBy("column", "type").agg(F.sum("rows").alias("rows"))
    canonical = spark.createDataFrame([(c,) for c in spec.columns], "column string").withColumn("known", F.lit(True))
    status = F.when(F.col("known").isNull(), "extra").when(F.col("rows").isNull(), "missing").otherwise("known")
    return seen.join(canonical, "column", "full").select(
        "column", status.alias("status"), "type", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows")
    )


def drift_report(spark: SparkSession, where: Where, spec: DatasetSpec) -> DataFrame:
    """Columns the landing files lack or have beyond the canonical ones: ``(column, status)``.

    Names come from Parquet schemas and text headers, and from the keys of all JSON lines, made distinct by Spark.
    """
    return drift_counts(spark, where, spec).where("status <> 'known'").select("column", "status").distinct()
