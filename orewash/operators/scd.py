"""One current row per key from a history of partial updates.

Both forms are ``max`` over a struct that starts with the time: an aggregate with map-side combine, so a key with many
versions costs one row per map task, and ties resolve the same way on every run. Structs are aggregated by sorting, so
there is a sort on either side of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orewash.specs import UNKNOWN_DATE, DatasetSpec


def _time(spec: DatasetSpec) -> Column:
    return F.coalesce(F.col(spec.order_by), F.lit(UNKNOWN_DATE).cast("timestamp"))


def latest_snapshot(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Per key, the attributes of the newest row (null ones too) and its time; no time counts as 1900-01-01."""
    newest = F.max(F.struct(_time(spec).alias("at"), *spec.snapshot))
    return df.groupBy(spec.key).agg(newest.alias("newest")).select(
        spec.key,
        *(F.col(f"newest.{c}").alias(c) for c in spec.snapshot),
        F.col("newest.at").alias(spec.order_by),
    )


def merge_partial(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Per key, the newest *non-null* value of each attribute, and the newest time."""
    at = _time(spec)
    newest = {c: F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c)))) for c in spec.snapshot}
    return df.groupBy(spec.key).agg(
        *(agg.getField(c).alias(c) for c, agg in newest.items()),
        F.max(at).alias(spec.order_by),
    )


def with_times(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Give each attribute that has a value a time of its own, ``<attribute>_at``: the row's."""
    at = _time(spec)
    return df.withColumns({f"{c}_at": F.when(F.col(c).isNotNull(), at) for c in spec.snapshot})


def merge_histories(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """One row per key of rows ``with_times``: each attribute's newest value with its time, and the newest time of all.

    The outcome is such a row again, so histories can be merged in any order and in any parts; a row that comes late counts
    by its time.
    """
    newest = {c: F.max(F.when(F.col(c).isNotNull(), F.struct(f"{c}_at", c))) for c in spec.snapshot}
    merged = df.groupBy(spec.key).agg(*(agg.alias(c) for c, agg in newest.items()), F.max(_time(spec)).alias(spec.order_by))
    return merged.select(
        spec.key, *(F.col(c)[c].alias(c) for c in spec.snapshot), *(F.col(c)[f"{c}_at"].alias(f"{c}_at") for c in spec.snapshot), spec.order_by
    )
