"""What the operators share: reading a table, ranks without a single task, and Arrow rows in even batches."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, none counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores put before it as it takes to be none of ``taken``."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        out.append(name)
    return out


def ranked(rows: DataFrame, group: list[str], order: list[str], total: int, rank: str) -> DataFrame:
    """``rows`` with a gapless ``rank`` from 0 within each group, however large a group is.

    A group is dealt into about sqrt(``total``) buckets by a hash of ``order``; rows are numbered inside their bucket
    and buckets are numbered by their counts, so no task gets more than about sqrt(``total``) rows of a group. Rows
    that are alike in ``order`` are ranked arbitrarily among themselves.
    """
    n = max(1, math.isqrt(max(0, total)))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)))
    keys = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*keys)
        .count()
        .select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return (
        dealt.withColumn("_inside", inside)
        .join(offsets, keys)
        .withColumn(rank, F.col("_before") + F.col("_inside"))
        .drop("_bucket", "_before", "_inside")
    )


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4 << 20, weight=lambda row: 64) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about ``size`` bytes, as ``weight`` gives a row's."""
    held, bytes_held = [], 0
    for row in rows:
        held.append(row)
        bytes_held += weight(row)
        if bytes_held >= size:
            yield batch(held, schema)
            held, bytes_held = [], 0
    if held:
        yield batch(held, schema)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
