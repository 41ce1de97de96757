"""Bring a drifting frame to the canonical columns and types of its dataset."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from orewash.functions import blank_to_null, text_of, typed
from orewash.operators.columns import known_only, stripped_names, with_missing, without_junk
from orewash.operators.split import Rules, Split, by_faults, verdict
from orewash.specs import CORRUPT, DatasetSpec


def aligned(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """All canonical columns and the corrupt-line column, with the types they come with; nothing else."""
    df = with_missing(known_only(without_junk(stripped_names(df)), spec), spec.schema)
    corrupt = CORRUPT if CORRUPT in df.columns else F.lit(None).cast("string").alias(CORRUPT)
    return df.select(*spec.columns, corrupt)


def corrupt_rule() -> Rules:
    return [("corrupt", F.col(CORRUPT).isNotNull())]


def missing_rules(values: Iterable[tuple[str, Column]]) -> Rules:
    return [(f"missing:{name}", value.isNull()) for name, value in values]


def uncastable_rules(df: DataFrame, cast: dict[str, Column]) -> Rules:
    """A value arrived, but could not be read as its type."""
    now = {f.name: f.dataType for f in df.schema.fields}
    return [
        (f"uncastable:{c}", blank_to_null(text_of(F.col(c), now[c]), StringType()).isNotNull() & value.isNull())
        for c, value in cast.items()
    ]


def normalize(df: DataFrame, spec: DatasetSpec, flag_uncastable: bool = False) -> Split:
    """Rows that fit the canonical schema, and those that do not with the reason, from one projection.

    Faults: ``corrupt`` (a line that could not be parsed) and ``missing:<column>`` for required columns, judged on
    the value as it arrived. ``flag_uncastable`` adds ``uncastable:<column>`` where a value was there but could not
    be read as its type.
    """
    df = aligned(df, spec)
    now = {f.name: f.dataType for f in df.schema.fields}
    cast = {f.name: typed(F.col(f.name), now[f.name], f.dataType) for f in spec.schema.fields}
    rules = corrupt_rule() + missing_rules((c, F.col(c)) for c in spec.required)
    if flag_uncastable:
        rules += uncastable_rules(df, cast)
    columns = [value.alias(name) for name, value in cast.items()]
    good, rejected = by_faults(df.select(*columns, CORRUPT, *verdict(rules)))
    return Split(good.drop(CORRUPT), rejected)
