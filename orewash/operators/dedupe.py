"""Keeping one row per key, and set operations on whole rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orewash.specs import DatasetSpec


def latest_per_key(df: DataFrame, keys: str | Sequence[str], order_by: str) -> DataFrame:
    """The row with the greatest ``order_by`` per key (null last); a null key is a key like any other.

    Ties are broken by all other columns in turn, greatest first, so the outcome does not depend on how rows are
    spread over tasks. Filtering on rank 1 lets Spark drop all but one row per key *before* the shuffle (a partial
    WindowGroupLimit), so a key that holds a third of all rows sends one row per map task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    others = [f.name for f in df.schema.fields if f.name not in (*keys, order_by) and f.dataType.typeName() != "map"]
    order = [F.col(c).desc_nulls_last() for c in (order_by, *others)]
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
        "_rank = 1"
    ).drop("_rank")


def dedupe(df: DataFrame, spec: DatasetSpec | None) -> DataFrame:
    """The latest row per key of the dataset; unchanged without a spec. Falls back to ``created_at`` for order."""
    if spec is None:
        return df
    return latest_per_key(df, spec.key, spec.order_by if spec.order_by in df.columns else "created_at")


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows of ``frames``, matched by column name, null where a frame lacks a column."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def set_union(*frames: DataFrame) -> DataFrame:
    """Distinct rows of ``frames``, matched by column name."""
    return union_by_name(*frames).distinct()
