"""Data-quality measures. A whole set of measures is one aggregation over its frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orewash.specs import DATE_SOURCES, DatasetSpec


class EmptyStepError(RuntimeError):
    """A step that must yield rows yielded none."""


def _nulls(column: str) -> Column:
    return F.count_if(F.col(column).isNull())


def _surplus(column: str) -> Column:
    """Rows beyond one per distinct value, null counting as a value."""
    distinct = F.count_distinct(column) + F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))
    return F.count("*") - distinct


def _untimely(column: str) -> Column:
    return F.count_if(F.col(column).try_cast("timestamp").isNull())


def _check(df: DataFrame, bad: Column) -> DataFrame:
    return df.agg(bad.cast("bigint").alias("bad")).select((F.col("bad") == 0).alias("ok"), "bad")


def check_not_null(df: DataFrame, column: str) -> DataFrame:
    """One row ``(ok, bad)``: how many rows have no value in ``column``.

    A filter, so that Parquet row groups without nulls are skipped by their statistics.
    """
    return _check(df.where(F.col(column).isNull()), F.count("*"))


def check_unique(df: DataFrame, column: str) -> DataFrame:
    """One row ``(ok, bad)``: how many rows repeat a value of ``column``."""
    return _check(df, _surplus(column))


def check_timestamp(df: DataFrame, column: str) -> DataFrame:
    """One row ``(ok, bad)``: how many rows hold no readable time in ``column``."""
    return _check(df, _untimely(column))


def null_stats(df: DataFrame) -> DataFrame:
    """One row per column: ``(column, null_count, total, null_rate)``; rates have 4 decimals, 0 without rows."""
    counts = df.agg(F.count("*").alias("_total"), *(_nulls(c).alias(c) for c in df.columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("null_count")) for c in df.columns))
    rate = F.coalesce(F.round(F.try_divide("null_count", "total"), 4), F.lit(0.0))
    return (
        counts.select(F.inline(rows), F.col("_total").alias("total"))
        .withColumn("null_rate", rate)
    )


def measures(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """All measures of a dataset in long form ``(metric, bad, total)``, from one aggregation.

    ``null_rate_<column>`` and ``dq_not_null_<column>`` for every column, ``dq_unique_<column>`` where the spec asks,
    ``dq_timestamp_<column>`` for every date source present, and ``total_rows``.
    """
    nulls = {c: f"n{i}" for i, c in enumerate(df.columns)}
    unique = {c: f"u{i}" for i, c in enumerate(spec.unique) if c in nulls}
    times = {c: f"t{i}" for i, c in enumerate(DATE_SOURCES) if c in nulls}
    counts = df.agg(
        F.count("*").alias("total"),
        *(_nulls(c).alias(a) for c, a in nulls.items()),
        *(_surplus(c).alias(a) for c, a in unique.items()),
        *(_untimely(c).alias(a) for c, a in times.items()),
    )

    def row(metric: str, source: str) -> Column:
        return F.struct(F.lit(metric).alias("metric"), F.col(source).cast("bigint").alias("bad"))

    rows = [row("total_rows", "total")]
    rows += [row(f"null_rate_{c}", a) for c, a in nulls.items()]
    rows += [row(f"dq_not_null_{c}", a) for c, a in nulls.items()]
    rows += [row(f"dq_unique_{c}", a) for c, a in unique.items()]
    rows += [row(f"dq_timestamp_{c}", a) for c, a in times.items()]
    return counts.select(F.inline(F.array(*rows)), "total")


def as_metrics(measured: DataFrame) -> DataFrame:
    """Measures as the two text columns ``(metric, value)``: rates with up to 4 decimals, counts as they are."""
    rate = F.coalesce(F.round(F.try_divide("bad", "total"), 4), F.lit(0)).cast("decimal(5,4)").cast("string")
    short = F.regexp_replace(rate, r"(\.\d+?)0+$", "$1")
    is_rate = F.col("metric").startswith("null_rate_") & (F.col("total") > 0)
    return measured.select("metric", F.when(is_rate, short).otherwise(F.col("bad").cast("string")).alias("value"))


def require_rows(steps: dict[str, int], dataset: str, order: Sequence[str] | None = None) -> None:
    """Raise :class:`EmptyStepError` naming the first step, in order, that counted no rows."""
    for step in order or steps:
        if not steps[step]:
            raise EmptyStepError(f"step {step!r} of dataset {dataset!r} yielded no rows")
