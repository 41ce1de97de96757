"""Value-level expressions: lenient casts and missing-value handling.

Each takes a column and the type it has now, so typed sources (Parquet) skip the text round trip. A value that
cannot be read becomes null; nothing here raises under ANSI mode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DateType,
    DoubleType,
    FloatType,
    IntegerType,
    IntegralType,
    MapType,
    NumericType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from orewash.specs import NULL_TOKENS, TIMESTAMP_FORMATS

_TEMPORAL = (DateType, TimestampNTZType, TimestampType)


def text_of(col: Column, dtype: DataType) -> Column:
    """Any value as text; nested values keep their JSON form."""
    if isinstance(dtype, StringType):
        return col
    if isinstance(dtype, (StructType, ArrayType, MapType)):
        return F.to_json(col)
    return col.cast("string")


def blank_to_null(col: Column, dtype: DataType, tokens: Sequence[str] = NULL_TOKENS, trim: bool = True) -> Column:
    """Null where the trimmed text form of ``col`` is one of ``tokens``; strings come back trimmed if ``trim``."""
    if isinstance(dtype, StringType):
        bare = F.trim(col)
        return F.when(~bare.isin(*tokens), bare if trim else col)
    if isinstance(dtype, (FloatType, DoubleType)):
        return F.nanvl(col, F.lit(None).cast(dtype)) if "NaN" in tokens else col
    return col


def double_of(col: Column, dtype: DataType) -> Column:
    """A number as double, thousands commas removed; NaN counts as missing."""
    if isinstance(dtype, NumericType):
        number = col.cast("double")
    else:
        number = F.replace(text_of(col, dtype), F.lit(","), F.lit("")).try_cast("double")
    return F.nanvl(number, F.lit(None).cast("double"))


def integer_of(col: Column, dtype: DataType) -> Column:
    """A number as int. Fractions are cut ("7.9" is 7), values beyond the type become null."""
    if isinstance(dtype, IntegralType):
        return col.try_cast("int")
    return double_of(col, dtype).try_cast("int")


def timestamp_of(col: Column, dtype: DataType, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    """A point in time: Spark's own reading first, then each of ``formats``.

    A failed attempt at a format is costly, so texts without a digit are not put through them. A time of day without a
    date is no point in time (Spark would take today's date).
    """
    if isinstance(dtype, _TEMPORAL):
        return col.cast("timestamp")
    text = text_of(col, dtype)
    # Most texts have their dash before any colon, or no colon; only others need the pattern.
    colon, dash = F.instr(text, ":"), F.instr(text, "-")
    text = F.when((colon == 0) | ((dash > 0) & (dash < colon)) | ~text.rlike(r"^\s*T?[0-9]{1,2}:"), text)
    attempts = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))
    return F.coalesce(text.try_cast("timestamp"), F.when(text.rlike("[0-9]"), attempts))


def typed(col: Column, now: DataType, target: DataType) -> Column:
    """``col``, which has type ``now``, read leniently as ``target``; unknown targets stay text."""
    if isinstance(target, TimestampType):
        return timestamp_of(col, now)
    if isinstance(target, IntegerType):
        return integer_of(col, now)
    if isinstance(target, DoubleType):
        return double_of(col, now)
    return text_of(col, now)
