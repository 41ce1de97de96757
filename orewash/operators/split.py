"""Accepted and rejected rows, kept together so that no row vanishes between steps."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAULTS = "_faults"  # comma-separated fault codes of a row, "" for none
REFUSED = "_refused"  # 1 when a row has faults, else 0

Rules = list[tuple[str, Column]]  # fault codes and when they hold; an unknown outcome does not hold


class Split(NamedTuple):
    good: DataFrame
    rejected: DataFrame


def verdict(rules: Rules) -> tuple[Column, Column]:
    """The two columns that carry a row's fate: its fault codes and whether it is refused.

    The latter is computed from the rules, not from the codes, so that a filter on it pushes down as a plain
    condition; both stay within generated code.
    """
    any_holds = reduce(lambda a, b: a | b, (F.coalesce(holds, F.lit(False)) for _, holds in rules), F.lit(False))
    codes = F.concat_ws(",", *(F.when(holds, code) for code, holds in rules))
    return codes.alias(FAULTS), any_holds.cast("int").alias(REFUSED)


def judged(df: DataFrame, rules: Rules) -> DataFrame:
    """Add each row's fate under ``rules``."""
    return df.select("*", *verdict(rules))


def by_faults(df: DataFrame) -> Split:
    """Split judged rows. ``rejected`` keeps the codes in the column ``reason``."""
    return Split(
        good=df.where(F.col(REFUSED) == 0).drop(FAULTS, REFUSED),
        rejected=df.where(F.col(REFUSED) == 1).drop(REFUSED).withColumnRenamed(FAULTS, "reason"),
    )
