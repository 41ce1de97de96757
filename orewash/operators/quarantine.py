"""Row rules: which rows may not enter silver, and why."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orewash.operators.normalize import corrupt_rule, missing_rules
from orewash.operators.split import Rules, Split, by_faults, judged
from orewash.specs import CORRUPT, DatasetSpec


def row_rules(values: Mapping[str, Column], spec: DatasetSpec | None) -> Rules:
    """The rules of ``spec`` on clean values by column name; a column that is not there counts as null."""
    if spec is None:
        return []
    nothing = F.lit(None)
    rules = corrupt_rule() if CORRUPT in values else []
    rules += missing_rules((c, values.get(c, nothing)) for c in spec.trusted)
    rules += [(f"negative:{c}", values.get(c, nothing).try_cast("double") < 0) for c in spec.non_negative]
    return rules


def quarantine(df: DataFrame, spec: DatasetSpec | None) -> Split:
    """Rows that pass the rules of ``spec``, and rows that do not with their ``reason``."""
    return by_faults(judged(df, row_rules({c: F.col(c) for c in df.columns}, spec)))
