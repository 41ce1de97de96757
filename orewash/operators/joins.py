"""Joins from large fact frames to a dimension, safe against keys that hold much of the facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def heavy_keys(counts: DataFrame, key: str, columns: Sequence[str], share: float = 1 / 200) -> list:
    """The keys that hold more than ``share`` of any of ``columns``, from one row of counts per key.

    There are at most ``1 / share`` of them per column, however large the data.
    """
    total = counts.agg(*(F.sum(c).alias(c) for c in columns)).first()
    heavy = F.lit(False)
    for c in columns:
        heavy = heavy | (F.col(c) > (total[c] or 0) * share)
    return [r[0] for r in counts.where(heavy).select(key).distinct().collect()]


def is_broadcast(dimension: DataFrame) -> bool:
    """Whether Spark will broadcast a join's dimension, by its own estimate of the size and the session's threshold."""
    state = dimension.sparkSession._jsparkSession.sessionState()
    size = dimension._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= state.conf().autoBroadcastJoinThreshold()


def attach(facts: DataFrame, dimension: DataFrame, key: str, spread_by: str, heavy: Sequence = ()) -> DataFrame:
    """``facts`` left-joined to ``dimension`` on ``key``; facts without a match keep nulls.

    Spark broadcasts the dimension if its size is under the session's threshold, and facts stay where they are. Otherwise
    it shuffles both sides and splits skewed partitions at run time. Then facts without a key, which never match, are
    spread over many shuffle partitions by a hash of ``spread_by``; so are those with a ``heavy`` key, whose dimension rows
    alone are repeated.
    """
    if is_broadcast(dimension):
        return facts.join(dimension, key, "left")
    known = [k for k in heavy if k is not None]
    is_heavy: Column = F.col(key).isin(known) if known else F.lit(False)
    spread = F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")
    salt = F.when(F.col(key).isNull() | is_heavy, spread).otherwise(0)
    copies = F.when(is_heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = dimension.withColumn("_salt", F.explode(copies))
    return facts.withColumn("_salt", salt).join(repeated, [key, "_salt"], "left").drop("_salt")
