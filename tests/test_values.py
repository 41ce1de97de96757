"""Lenient casts and missing values (ANSI mode is on)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType, TimestampNTZType

from orewash.functions import blank_to_null, double_of, integer_of, text_of, timestamp_of

TEXT = StringType()


def apply(spark, expression, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"), TEXT)).collect()]


@pytest.mark.parametrize(
    "raw, want",
    [("1,234.5", 1234.5), (" 7 ", 7.0), ("-5.0", -5.0), ("1e3", 1000.0), ("", None), ("x", None), ("NaN", None),
     ("nan", None), (None, None), ("$5", None)],
)
def test_double(spark, raw, want):
    assert apply(spark, double_of, raw) == [want]


@pytest.mark.parametrize(
    "raw, want", [("7.9", 7), ("-7.9", -7), ("1,000", 1000), ("3000000000", None), ("n/a", None), ("NaN", None)]
)
def test_integer(spark, raw, want):
    assert apply(spark, integer_of, raw) == [want]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2024-01-02T03:04:05.678Z", dt.datetime(2024, 1, 2, 3, 4, 5, 678000)),
        ("2024-01-02 03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02T03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02", dt.datetime(2024, 1, 2)),
        ("2024-13-45", None),
        ("garbage", None),
        ("", None),
    ],
)
def test_timestamp(spark, raw, want):
    rows = apply(spark, lambda c, t: timestamp_of(c, t).cast("timestamp_ntz"), raw)
    assert rows == [want]


def test_timestamp_layout_beyond_the_default_cast(spark):
    def day_first(col, dtype):
        return timestamp_of(col, dtype, ["dd/MM/yyyy"]).cast("timestamp_ntz")

    assert apply(spark, day_first, "31/12/2023") == [dt.datetime(2023, 12, 31)]


@pytest.mark.parametrize("token", ["", " ", "  ", "NaN", "nan", "NULL", "null", "None", "NONE", "N/A", "n/a", " null "])
def test_null_tokens(spark, token):
    assert apply(spark, blank_to_null, token) == [None]


def test_null_tokens_are_exact_and_a_parameter(spark):
    assert apply(spark, blank_to_null, "none", " x ") == ["none", "x"]
    assert apply(spark, lambda c, t: blank_to_null(c, t, ["none"]), "none", "null") == [None, "null"]
    assert apply(spark, lambda c, t: blank_to_null(c, t, trim=False), " x ") == [" x "]


def test_typed_values_skip_the_text_round_trip(spark):
    df = spark.sql(
        "select double('NaN') d, 5000000000L l, timestamp_ntz'2024-01-01 10:00:00' t, named_struct('a', 1) s"
    )
    row = df.select(
        blank_to_null(F.col("d"), DoubleType()).alias("no_nan"),
        double_of(F.col("d"), DoubleType()).alias("d"),
        integer_of(F.col("l"), LongType()).alias("l"),
        timestamp_of(F.col("t"), TimestampNTZType()).cast("timestamp_ntz").alias("t"),
        text_of(F.col("s"), StructType()).alias("s"),
    ).first()
    assert (row.no_nan, row.d, row.l, row.t, row.s) == (None, None, None, dt.datetime(2024, 1, 1, 10), '{"a":1}')
