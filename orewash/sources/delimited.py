"""Text files of whatever layout in one scan: each line is parsed by position, and positions come from its file's header."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orewash.operators.columns import plain_name
from orewash.scratch import written
from orewash.sources.files import TEXT_GLOB, Where, file_kind, listing, paths_of, reader
from orewash.specs import CORRUPT, DatasetSpec

JSON, HEADER, BARE = "json", "header", "bare"
_LAYOUT = "path string, kind string, line string, names array<string>, width int, places array<array<int>>"


def spellings(column: str) -> list[str]:
    """The column name and the raw names that :func:`plain_name` turns into it."""
    return list(dict.fromkeys([column, column.replace("_", " "), column.replace("_", "."), f"`{column}`"]))


def text_lines(spark: SparkSession, where: Where, kinds: Iterable[str]) -> DataFrame:
    """Lines that are not blank, of the files of ``kinds``: ``(value, path, block, at)``, where ``at`` orders a block's lines."""
    lines = reader(spark, TEXT_GLOB).text(paths_of(where))
    chosen = lines.where(file_kind(F.col("_metadata.file_path")).isin(*kinds))  # Spark leaves the other files unopened
    at = F.monotonically_increasing_id().alias("at")
    placed = chosen.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), at)
    return placed.where(F.trim("value") != "")


def _first(lines: DataFrame) -> DataFrame:
    # Collecting the blocks makes Spark aggregate in a hash table; text alone it would sort first.
    place = F.struct("block", "at")
    return lines.groupBy("path").agg(F.min_by("value", place).alias("line"), F.collect_set("block").alias("blocks")).select("path", "line")


def first_lines(spark: SparkSession, where: Where, kinds: Iterable[str] = ("csv", "loose")) -> DataFrame:
    """The first non-blank line of every file that has one: ``(path, line)``, a written table.

    Nearly always it is in the file's opening block, so those are looked at first, and each task reduces its own to one line
    per file. The rest of a file is looked at only if its opening block is blank.
    """
    lines = text_lines(spark, where, kinds)
    found = written(_first(lines.where("block = 0")), "first-lines")
    files = listing(spark, where).where(file_kind(F.col("path")).isin(*kinds) & (F.col("length") > 0)).select(F.col("uri").alias("path"))
    blank = written(files.join(found, "path", "left_anti"), "blank-openings")
    if blank.isEmpty():
        return found
    return written(found.unionByName(_first(lines.where("block > 0").join(blank, "path", "left_semi"))), "first-lines")


def fields_of(line: str) -> list[str]:
    return next(csv.reader([line.lstrip("﻿")]), [])


def is_header(fields: Iterable[str], spec: DatasetSpec) -> bool:
    """Whether a line names columns: the dataset's key is among them, or each is a different canonical or drift name."""
    names = [plain_name(f) for f in fields if f.strip()]
    if spec.key in names:
        return True
    canonical = [n in spec.columns for n in names]
    drift = [n.startswith("extra_") for n in names]
    return len(names) > 1 and any(canonical) and all(map(max, canonical, drift)) and len(set(names)) == len(names)


def layouts(first: DataFrame, spec: DatasetSpec) -> DataFrame:
    """What each file's lines are: JSON objects, values under a header, or values in canonical order; and at which places
    of a line each canonical column stands (more than one where a header names it more than once)."""
    columns = spec.columns
    in_order = [[i] for i in range(len(columns))]
    types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.list_(pa.list_(pa.int32()))]

    def layout(path: str, line: str) -> tuple:
        if line.lstrip().startswith("{"):
            return path, JSON, line, [], 0, []
        fields = fields_of(line)
        if not (is_header(fields, spec) or path.lower().endswith(".csv")):
            return path, BARE, line, [], len(columns), in_order
        names = [plain_name(f) for f in fields]
        return path, HEADER, line, names, len(names), [[i for i, n in enumerate(names) if n == c] for c in columns]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [layout(p, x) for p, x in zip(batch.column("path").to_pylist(), batch.column("line").to_pylist(), strict=True)]
            found = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types, strict=True)], [c.split()[0] for c in _LAYOUT.split(", ")])

    return written(first.mapInArrow(tell, _LAYOUT), "layouts")


def _values(places: Column, values: Column) -> Column:
    """The value at the first of ``places``; if it is missing, the first there is at the others."""
    others = F.filter(F.transform(places, lambda i: F.get(values, i)), lambda v: v.isNotNull())
    return F.coalesce(F.get(values, F.get(places, 0)), F.when(F.size(places) > 1, F.get(others, 0)))


def parsed(lines: DataFrame, told: DataFrame, spec: DatasetSpec, kinds: set[str], width: int) -> DataFrame:
    """Canonical columns as text, and the corrupt-line column, of lines (value, path) by their files' layouts, in one projection.

    Short lines are filled with null. Lines with a value beyond the last column of their file, and JSON that does not parse,
    are kept whole in the corrupt column. A line that repeats its file's header is no row.
    """
    rows = lines.join(told.drop("names"), "path").where((F.col("kind") != HEADER) | (F.col("value") != F.col("line")))
    columns: dict[str, Column] = {}
    if kinds - {JSON}:
        held = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(width + 1))))
        rows = rows.withColumn("_held", F.when(F.col("kind") != JSON, held))
        values = F.array(*(F.col(f"_held.c{i}") for i in range(width + 1)))
        rows = rows.withColumn("_values", values)
        columns = {c: _values(F.get("places", i), F.col("_values")) for i, c in enumerate(spec.columns)}
        columns[CORRUPT] = F.when(F.get("_values", F.col("width")).isNotNull(), F.col("value"))
    if JSON in kinds:
        names = {c: spellings(c) for c in spec.columns}
        fields = ", ".join(f"`{s.replace('`', '``')}` string" for of in names.values() for s in of)
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        held = F.from_json("value", F.lit(f"{fields}, {CORRUPT} string"), options)
        rows = rows.withColumn("_json", F.when(F.col("kind") == JSON, held))
        for c in (*spec.columns, CORRUPT):
            of_json = F.coalesce(*(F.col("_json")[s] for s in names.get(c, [c])))
            columns[c] = F.when(F.col("kind") == JSON, of_json).otherwise(columns[c]) if c in columns else of_json
    return rows.select(*(value.alias(c) for c, value in columns.items()))


def json_columns(lines: DataFrame) -> DataFrame:
    """Keys of JSON lines (``value``), by the type of their values: ``(column, type, rows)``; null values have none."""
    fields = lines.sparkSession.tvf.variant_explode(F.try_parse_json(F.col("value").outer()))
    kind = F.lower(F.regexp_extract(F.schema_of_variant(F.col("value")), r"^[A-Za-z_]+", 0))
    found = lines.select("value").lateralJoin(fields.select("key", kind.alias("type")))
    named = found.where("key is not null and type <> 'void'").select(bare_name("key"), "type")
    return named.groupBy("column", "type").agg(F.count(F.lit(1)).alias("rows"))


def read_text(spark: SparkSession, where: Where, spec: DatasetSpec, kinds: Iterable[str] = ("csv", "loose")) -> tuple[DataFrame, DataFrame] | None:
    """All delimited and loose text files of ``where`` as one frame, and the columns that they have: ``(column, type, rows)``.

    None if there is no line. Two scans whatever the number of files and headers: one for first lines, one for rows. The
    columns are those of headers, or the canonical ones where there is no header, with the number of rows under them.
    """
    told = layouts(first_lines(spark, where, kinds), spec)
    present = told.groupBy("kind").agg(F.max("width").alias("width")).collect()
    if not present:
        return None
    widest = max(r["width"] for r in present)
    rows = parsed(text_lines(spark, where, kinds).select("value", "path"), told, spec, {r["kind"] for r in present}, widest)
    lines = text_lines(spark, where, kinds).groupBy("path").agg(F.count(F.lit(1)).alias("lines"))
    canonical = F.array(*map(F.lit, spec.columns))
    columns = F.when(F.col("kind") == HEADER, F.array_distinct("names")).when(F.col("kind") == BARE, canonical)
    under = F.col("lines") - (F.col("kind") == HEADER).cast("int")
    named = told.join(lines, "path").select(F.explode(columns).alias("column"), F.lit("string").alias("type"), under.alias("rows"))
    named = named.where("column <> ''").groupBy("column", "type").agg(F.sum("rows").alias("rows"))
    if any(r["kind"] == JSON for r in present):
        loose = text_lines(spark, where, kinds).join(told.where(F.col("kind") == JSON).select("path"), "path", "left_semi")
        named = named.union(json_columns(loose))
    return rows, named


def bare_name(column: str) -> Column:
    """A JSON key as :func:`plain_name` would have it."""
    return F.trim(F.translate(F.replace(column, F.lit("`"), F.lit("")), ". ", "__")).alias("column")
