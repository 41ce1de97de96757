"""Cleaning over all columns of a frame, each function one projection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType, TimestampType

from orewash.functions import blank_to_null, double_of, text_of, timestamp_of, typed
from orewash.specs import CORRUPT, NULL_TOKENS, DatasetSpec


def null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Null in every column whose trimmed text form is one of ``tokens``; other values as they are."""
    return df.select(
        *(blank_to_null(F.col(f.name), f.dataType, tokens, trim=False).alias(f.name) for f in df.schema.fields)
    )


def trim_all(df: DataFrame) -> DataFrame:
    """Trim every string column."""
    return df.select(
        *(F.trim(f.name).alias(f.name) if isinstance(f.dataType, StringType) else f.name for f in df.schema.fields)
    )


def clean_numbers(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Read those of ``columns`` that ``df`` has as numbers, thousands commas removed."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: double_of(F.col(c), types[c]) for c in columns if c in types})


def clean_timestamps(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Read those of ``columns`` that ``df`` has as timestamps, in any accepted layout."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: timestamp_of(F.col(c), types[c]) for c in columns if c in types})


def clean_value(col: Column, now: DataType, target: DataType | None, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """One value: times and numbers read leniently, texts trimmed and rid of null tokens."""
    if isinstance(target, (NumericType, TimestampType)):
        return typed(col, now, target)
    return blank_to_null(col if target is None else text_of(col, now), now if target is None else target, tokens)


def clean(df: DataFrame, spec: DatasetSpec | None, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Null tokens, trimming, timestamps and numbers for the canonical columns of ``spec``, in one projection.

    Works on raw text and on columns that already have their type. Other columns get null tokens and trimming only,
    the corrupt-line column nothing. Without a spec the frame is returned as it is.
    """
    if spec is None:
        return df
    target = {f.name: f.dataType for f in spec.schema.fields}

    def column(field):
        if field.name == CORRUPT:
            return F.col(CORRUPT)
        return clean_value(F.col(field.name), field.dataType, target.get(field.name), tokens).alias(field.name)

    return df.select(*(column(f) for f in df.schema.fields))
