"""Gold tables against explicit joins, and their null rules."""

import datetime as dt

from pyspark.sql import functions as F

from orewash.plans import gold
from orewash.specs import gold_schema

D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
T1, T2 = dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 2, 6)


def frames(spark):
    events = spark.createDataFrame(
        [("1", "u", T1, "IT"), ("2", "u", T1, None), ("3", "v", T2, "FR"), ("4", None, T2, "FR"), ("5", "v", None, "IT")],
        "event_id string, user_id string, ts timestamp, country string",
    )
    tx = spark.createDataFrame(
        [("a", "u", 10.0, "delivered", T1), ("b", "u", None, "Delivered", T1), ("c", "w", 5.0, "delivered", None),
         ("d", None, 1.0, None, T2)],
        "tx_id string, user_id string, amount double, status string, created_at timestamp",
    ).withColumn("delivered_at", F.lit(None).cast("timestamp"))
    return events, tx


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: repr([(v is None, v) for v in r]))


def test_activity_by_user_and_day(spark):
    events, tx = frames(spark)
    out = gold.fact_user_activity(events, tx)
    assert out.schema.simpleString() == gold_schema("fact_user_activity").simpleString()
    want = [
        ("u", D1, 2, 2, 10.0, 10.0), ("v", D2, 1, 0, 0.0, 0.0), ("v", None, 1, 0, 0.0, 0.0), ("w", None, 0, 1, 5.0, 5.0),
        (None, D2, 1, 0, 0.0, 0.0), (None, D2, 0, 1, 1.0, 1.0),  # null users of the two sides stay apart
    ]
    assert sorted(rows(out), key=repr) == sorted(want, key=repr)


def test_users_join_is_dropped_by_the_optimizer(spark):
    events, tx = frames(spark)
    users = spark.createDataFrame([("u",), ("u",), ("v",)], "user_id string")
    out = gold.fact_user_activity(events, tx, users)
    assert rows(out) == rows(gold.fact_user_activity(events, tx))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_one_shuffle_for_the_stacked_marts(spark):
    events, tx = frames(spark)
    for df in (gold.fact_user_activity(events, tx), gold.user_ltv(events, tx)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan


def test_ltv_equals_a_full_join(spark):
    events, tx = frames(spark)
    e = events.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    t = tx.groupBy("user_id").agg(F.count("*").alias("m"), F.sum("amount").alias("r"))
    joined = e.join(t, "user_id", "full").select("user_id", "n", "a", "b", "m", "r", F.coalesce("r", F.lit(0.0)))
    assert rows(gold.user_ltv(events, tx)) == rows(joined)
    exact = gold.user_ltv(events, tx, scale=2)
    assert rows(exact) == rows(joined)


def test_active_users(spark):
    events, tx = frames(spark)
    assert rows(gold.daily_active_users(events, tx)) == [
        (D1, 1, 1, 1), (D2, 1, 0, 1), (None, 0, 0, 2)  # unknown date: total only; unknown users are not counted
    ]


def test_revenue(spark):
    _, tx = frames(spark)
    assert rows(gold.daily_revenue(tx)) == [(D1, 2, 10.0, 10.0, 1), (D2, 1, 1.0, 1.0, 0), (None, 1, 5.0, 5.0, 1)]
    nothing = tx.where("tx_id = 'b'")
    assert rows(gold.daily_revenue(nothing, scale=2)) == rows(gold.daily_revenue(nothing)) == [(D1, 1, None, None, 0)]


def test_dims(spark):
    events, tx = frames(spark)
    assert rows(gold.dim_country(events)) == [("FR",), ("IT",)]
    assert rows(gold.dim_status(tx)) == [("Delivered",), ("delivered",)]
    dates = rows(gold.dim_date(events, tx))
    assert dates == [(D1, 2024, 1, 1, "Mon", 1, "January"), (D2, 2024, 1, 2, "Tue", 1, "January"), (None,) * 7]


def test_facts_keep_unmatched_rows(spark):
    events, tx = frames(spark)
    users = spark.createDataFrame([("u", "Rome", 30, "u@x")], "user_id string, city string, age int, email string")
    got = {r.event_id: r for r in gold.fact_events(events, users).collect()}
    assert len(got) == 5 and got["1"].user_age == "30" and got["3"].user_city is None and got["4"].user_id is None
    assert got["5"].event_date is None and got["1"].event_date == D1
    facts = gold.fact_transactions(tx, users)
    assert facts.count() == 4 and facts.schema.simpleString() == gold_schema("fact_transactions").simpleString()


def test_marts_from_user_days_are_the_same(spark):
    events, tx = frames(spark)
    for scale in (None, 2):
        days = gold.user_days(events, tx, scale)
        assert rows(gold.activity_of(days)) == rows(gold.fact_user_activity(events, tx))
        assert rows(gold.revenue_of(days)) == rows(gold.daily_revenue(tx))
        assert rows(gold.active_of(days)) == rows(gold.daily_active_users(events, tx))
        assert rows(gold.ltv_of(days)) == rows(gold.user_ltv(events, tx))
        assert rows(gold.dates_of(days)) == rows(gold.dim_date(events, tx))
