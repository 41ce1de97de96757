"""Operators on small inline rows, edge cases first."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orewash import EVENTS, SPECS, TRANSACTIONS, USERS, spec_for
from orewash.operators import quality
from orewash.operators.cleaning import clean, clean_numbers, clean_timestamps, null_tokens, trim_all
from orewash.operators.columns import (
    alias_ids,
    conform,
    known_only,
    locked,
    plain_name,
    plain_names,
    schema_drift,
    stripped_names,
    voids_to_text,
    with_event_date,
    with_missing,
    without_junk,
)
from orewash.operators.dedupe import dedupe, latest_per_key, set_union, union_by_name
from orewash.operators.joins import attach, heavy_keys
from orewash.operators.normalize import normalize
from orewash.operators.quarantine import quarantine
from orewash.operators.scd import latest_snapshot, merge_partial
from orewash.specs import CORRUPT, gold_schema


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def day(n):
    return dt.datetime(2024, 1, n)


# --- specs and columns ---


def test_specs():
    assert [s.name for s in SPECS.values()] == ["events", "transactions", "users"]
    assert spec_for("EVENTS") is EVENTS
    assert EVENTS.schema["age"].dataType.simpleString() == "int"
    assert all(f.nullable for f in TRANSACTIONS.schema.fields)
    with pytest.raises(ValueError, match="orders"):
        spec_for("orders")


def test_names(spark):
    assert plain_name("`a.b c`") == "a_b_c"
    df = spark.createDataFrame([("1", None, "x")], "`user id` string, `user_id` string, `a.b` string")
    assert plain_names(df).columns == ["user_id", "a_b"]
    assert rows(plain_names(df)) == [("1", "x")]
    assert stripped_names(spark.createDataFrame([(1, 2)], "` a ` int, b int")).columns == ["a", "b"]


def test_drift_columns(spark):
    df = spark.createDataFrame([("1", "u", "j", "k", 2024)], "event_id string, user_id string, extra_1 string, odd string, year int")
    assert without_junk(df).columns == ["event_id", "user_id", "odd", "year"]
    assert known_only(df, EVENTS).columns == ["event_id", "user_id", "year"]
    full = with_missing(df, EVENTS.schema)
    assert dict(full.dtypes)["ts"] == "timestamp" and full.select("ts").first()[0] is None
    drift = schema_drift(df.columns, EVENTS)
    assert drift["extra"] == ["extra_1", "odd"] and "ts" in drift["missing"] and "year" not in drift["missing"]


def test_voids_become_text(spark):
    assert voids_to_text(spark.sql("select null a, 1 b")).dtypes == [("a", "string"), ("b", "int")]


def test_conform_casts_adds_and_orders(spark):
    df = spark.sql("select '5' amount, 'bad' created_at, 't' tx_id, 30 user_age, 1 odd")
    out = conform(df, gold_schema("fact_transactions"))
    assert out.schema.simpleString() == gold_schema("fact_transactions").simpleString()
    assert tuple(out.first())[:5] == ("t", None, 5.0, None, None) and out.first()["user_age"] == "30"


def test_event_date(spark):
    both = spark.sql("select timestamp'2024-02-01 10:00:00' created_at, timestamp'2024-03-01' updated_at")
    assert with_event_date(both).first()["event_date"] == dt.date(2024, 3, 1)
    assert with_event_date(spark.sql("select cast(null as timestamp) ts")).first()["event_date"] == dt.date(1900, 1, 1)
    assert with_event_date(spark.sql("select 'junk' ts")).first()["event_date"] == dt.date(1900, 1, 1)
    assert with_event_date(spark.sql("select 'junk' ts"), default=None).first()["event_date"] is None
    assert with_event_date(spark.sql("select 1 x")).first()["event_date"] == dt.date(1900, 1, 1)


def test_lock(spark):
    df = spark.sql("select 'u' user_id, timestamp'2024-01-05 01:00:00' updated_at, 33 age, 1 odd")
    out = locked(df, USERS)
    assert out.columns == [*USERS.columns, "event_date"] and dict(out.dtypes)["age"] == "int"
    assert out.first()["event_date"] == dt.date(2024, 1, 5) and out.first()["year"] is None
    text = locked(df, USERS, stringly=True)
    assert set(dict(text.dtypes).values()) == {"string", "date"} and text.first()["age"] == "33"


def test_alias_ids(spark):
    assert alias_ids(spark.sql("select 1 id")).columns == ["user_id"]
    assert alias_ids(spark.sql("select 1 id, 2 user_id")).columns == ["user_id"]
    tx = alias_ids(spark.sql("select 7 id"), for_transactions=True)
    assert tx.first().asDict() == {"user_id": 7, "tx_id": 7}


# --- normalising and cleaning ---


def test_normalize_keeps_every_row(spark):
    df = spark.createDataFrame(
        [("1", "u", "1,234.5", None), (None, "u", "1", None), ("2", None, "2", None), (None, None, None, "not json"),
         ("3", " null ", "x", None)],
        f"event_id string, user_id string, amount string, {CORRUPT} string",
    )
    good, rejected = normalize(df.withColumn("extra_9", F.lit(1)), EVENTS)
    assert good.columns == EVENTS.columns and good.schema == EVENTS.schema
    assert rows(good, "event_id", "user_id", "amount") == [("1", "u", 1234.5), ("3", " null ", None)]
    assert rows(rejected, "reason") == [
        ("corrupt,missing:event_id,missing:user_id",), ("missing:event_id",), ("missing:user_id",)
    ]
    assert rejected.where(f"{CORRUPT} = 'not json'").count() == 1


def test_normalize_flags_uncastable_on_request(spark):
    df = spark.createDataFrame([("1", "u", "x", "N/A"), ("2", "u", "5", "junk")], "tx_id string, user_id string, amount string, created_at string")
    assert normalize(df, TRANSACTIONS).rejected.count() == 0
    flagged = normalize(df, TRANSACTIONS, flag_uncastable=True).rejected
    assert rows(flagged, "tx_id", "reason") == [("1", "uncastable:amount"), ("2", "uncastable:created_at")]


def test_cleaning_pieces(spark):
    df = spark.sql("select ' a ' s, ' N/A ' n, '1,5' d, double('NaN') f, '2024-01-01' t")
    assert tuple(null_tokens(df).first()) == (" a ", None, "1,5", None, "2024-01-01")
    assert trim_all(df).first()["s"] == "a"
    assert clean_numbers(df, ["d", "absent"]).first()["d"] == 15.0
    assert clean_timestamps(df, ["t", "absent"]).first()["t"] == day(1)


def test_clean_each_dataset(spark):
    for spec in SPECS.values():
        raw = spark.createDataFrame([tuple(" null " for _ in spec.columns)], ", ".join(f"{c} string" for c in spec.columns))
        out = clean(raw, spec)
        assert out.schema == spec.schema and set(out.first()) == {None}
    assert clean(raw, None) is raw


# --- deduplication and sets ---


def test_latest_per_key(spark):
    df = spark.createDataFrame(
        [("a", day(1), "old"), ("a", day(2), "new"), ("b", None, "undated"), ("b", day(1), "dated"),
         ("c", day(3), "x"), ("c", day(3), "y"), ("c", day(3), None)],
        "event_id string, ts timestamp, message string",
    )
    want = [("a", "new"), ("b", "dated"), ("c", "y")]
    assert rows(dedupe(df, EVENTS), "event_id", "message") == want
    again = dedupe(dedupe(df.repartition(5), EVENTS), EVENTS)
    assert rows(again, "event_id", "message") == want
    assert dedupe(df, None) is df


def test_users_fall_back_to_created_at(spark):
    df = spark.createDataFrame([("a", day(1), 1), ("a", day(2), 2)], "user_id string, created_at timestamp, n int")
    assert rows(dedupe(df, USERS), "n") == [(2,)]


def test_hot_key_is_cut_before_the_shuffle(spark):
    key = F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("hot")
    df = spark.range(1000).select(key.alias("k"), F.col("id").alias("v"), (F.col("id") + 1).alias("w"))
    out = latest_per_key(df, "k", "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange")
    assert rows(out.where("k = 'hot'")) == [("hot", 998, 999)] and out.count() == 335


def test_unions(spark):
    a, b = spark.sql("select 1 x, 2 y"), spark.sql("select 3 z, 1 x")
    assert rows(union_by_name(a, b)) == [(1, 2, None), (1, None, 3)]
    assert rows(set_union(a, a.select("y", "x"))) == [(1, 2)]


# --- quarantine ---


def test_quarantine_rules(spark):
    tx = spark.createDataFrame(
        [("1", day(1), 5.0, None), ("2", day(1), -5.0, None), ("3", day(1), None, None), (None, None, 1.0, None),
         ("5", day(1), 1.0, "junk")],
        f"tx_id string, created_at timestamp, amount double, {CORRUPT} string",
    )
    good, bad = quarantine(tx, TRANSACTIONS)
    assert rows(good, "tx_id") == [("1",), ("3",)]
    assert rows(bad, "tx_id", "reason") == [
        ("2", "negative:amount"), ("5", "corrupt"), (None, "missing:tx_id,missing:created_at")
    ]
    events = spark.sql("select '1' event_id, 'u' user_id")  # no ts column: it counts as null
    assert rows(quarantine(events, EVENTS).rejected, "reason") == [("missing:ts",)]
    assert quarantine(tx, None).rejected.count() == 0
    text = spark.sql("select '1' tx_id, timestamp'2024-01-01' created_at, '-5.0' amount")
    assert quarantine(text, TRANSACTIONS).good.count() == 0


# --- history ---


def test_snapshot_and_partial_merge(spark):
    df = spark.createDataFrame(
        [("u", "Ann", "a@x", None, "Rome", 30, day(1)), ("u", "Ann", None, "+1", "Oslo", None, day(2)),
         ("v", "Bob", "b@x", None, None, 20, None)],
        "user_id string, name string, email string, phone string, city string, age int, updated_at timestamp",
    )
    old = dt.datetime(1900, 1, 1)
    assert rows(latest_snapshot(df, USERS)) == [
        ("u", "Ann", None, "+1", "Oslo", None, day(2)), ("v", "Bob", "b@x", None, None, 20, old)
    ]
    assert rows(merge_partial(df, USERS)) == [
        ("u", "Ann", "a@x", "+1", "Oslo", 30, day(2)), ("v", "Bob", "b@x", None, None, 20, old)
    ]


# --- joins ---


def test_attach_is_the_same_with_heavy_keys(spark):
    facts = spark.range(300).select(
        F.when(F.col("id") % 10 == 0, None).when(F.col("id") < 200, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").cast("string").alias("fact"),
    )
    dim = spark.createDataFrame([("hot", 1), ("201", 2), ("999", 3)], "k string, v int")
    plain = rows(attach(facts, dim, "k", "fact"), "fact", "k", "v")
    assert len(plain) == 300
    for heavy in (["hot"], ["hot", None], [None], ["absent", "201"]):
        assert rows(attach(facts, dim, "k", "fact", heavy), "fact", "k", "v") == plain


def test_heavy_keys(spark):
    counts = spark.createDataFrame([("a", 500, 1), ("b", 1, 1), (None, 300, 0), ("c", 2, 40)], "k string, n bigint, m bigint")
    assert set(heavy_keys(counts, "k", ["n"], share=0.3)) == {"a", None}
    assert set(heavy_keys(counts, "k", ["n", "m"], share=0.3)) == {"a", None, "c"}
    assert heavy_keys(counts.limit(0), "k", ["n"]) == []


# --- quality ---


def test_checks(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("a", "junk"), (None, None)], "k string, t string")
    assert rows(quality.check_not_null(df, "k")) == [(False, 1)]
    assert rows(quality.check_unique(df, "k")) == [(False, 1)]  # null is a value of its own
    assert rows(quality.check_timestamp(df, "t")) == [(False, 2)]
    assert rows(quality.check_not_null(df.where("k = 'a'"), "k")) == [(True, 0)]
    assert rows(quality.check_unique(df.limit(0), "k")) == [(True, 0)]


def test_null_stats(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("b", None)], "k string, v int")
    assert rows(quality.null_stats(df)) == [("k", 1, 3, 0.3333), ("v", 3, 3, 1.0)]
    assert rows(quality.null_stats(df.limit(0))) == [("k", 0, 0, 0.0), ("v", 0, 0, 0.0)]


def test_metrics_text(spark):
    df = spark.range(8).select(
        F.when(F.col("id") > 0, F.col("id").cast("string")).alias("user_id"), F.lit(None).cast("string").alias("phone"),
        F.lit("x").alias("name"), F.when(F.col("id") < 1, F.current_timestamp()).alias("updated_at"),
    )
    got = dict(rows(quality.as_metrics(quality.measures(df, USERS))))
    assert got["total_rows"] == "8" and got["null_rate_user_id"] == "0.125" and got["null_rate_phone"] == "1.0"
    assert got["null_rate_name"] == "0.0" and got["dq_not_null_phone"] == "8" and got["dq_unique_user_id"] == "0"
    assert got["dq_timestamp_updated_at"] == "7" and "dq_timestamp_ts" not in got
    empty = dict(rows(quality.as_metrics(quality.measures(df.limit(0), USERS))))
    assert set(empty.values()) == {"0"}


def test_metrics_are_one_aggregation(spark):
    df = spark.createDataFrame([("1", None)], "event_id string, ts timestamp")
    plan = quality.measures(df, EVENTS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan and "Union" not in plan


def test_empty_steps_are_named():
    quality.require_rows({"load": 3}, "events")
    with pytest.raises(quality.EmptyStepError, match="'dedupe'.*'events'"):
        quality.require_rows({"load": 3, "dedupe": 0, "quarantine": 0}, "events")


def test_skewed_fact_join_is_split_or_spread(spark, tmp_path):
    facts = spark.range(0, 200_000, 1, 8).select(
        F.when(F.col("id") % 5 < 2, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("fact"),
    )
    dim = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("v"))
    settings = {
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        seen = {}
        for heavy in ((), ("hot",)):
            joined = attach(facts, dim, "k", "fact", heavy)
            out = joined.agg(F.count("*"), F.count("v"), F.sum(F.xxhash64("k", "fact", "v").cast("decimal(38,0)")))
            seen[heavy] = (out.collect(), out._jdf.queryExecution().executedPlan().toString())
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert seen[()][0] == seen[("hot",)][0]
    assert "skew=true" in seen[()][1]  # plain: the hot partition is split at run time
    assert "_salt" in seen[("hot",)][1].split("Exchange")[1]  # spread: the shuffle key includes the salt
