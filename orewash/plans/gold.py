"""Dimensions, facts and marts over the silver tables.

Facts and marts that combine events with transactions stack the two under a common set of columns and aggregate
once. That equals aggregating each and full-joining, with one shuffle instead of two or more and no sort-merge
join; both inputs are combined map-side first, so a hot user or date costs one row per map task. Like a join, a
null key on one side never meets a null key on the other.

Each mart can be built on its own from silver, or (the ``…_of`` functions) from :func:`user_days`, one compact
aggregate that serves them all, so that a job building everything scans silver once for it.

``scale`` sums money exactly, as decimals with that many places; by default money is summed as double.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orewash.operators.columns import conform
from orewash.operators.dedupe import latest_per_key
from orewash.operators.joins import attach
from orewash.specs import gold_schema


def _sum(amount: str, scale: int | None) -> Column:
    return F.sum(F.col(amount) if scale is None else F.col(amount).cast(f"decimal(18,{scale})"))


def _mean(total: Column, count: Column) -> Column:
    return F.try_divide(total.cast("double"), count)


def _day(column: str) -> Column:
    return F.col(column).cast("date").alias("date")


def dim_users(users: DataFrame) -> DataFrame:
    """One row per user, the latest."""
    columns = gold_schema("dim_users").fieldNames()
    return conform(latest_per_key(users.select(*columns), "user_id", "updated_at"), gold_schema("dim_users"))


def dim_country(events: DataFrame) -> DataFrame:
    return events.where("country is not null").select("country").distinct()


def dim_status(transactions: DataFrame) -> DataFrame:
    return transactions.where("status is not null").select("status").distinct()


def _calendar(dates: DataFrame) -> DataFrame:
    date = F.col("date")
    return dates.select(
        "date",
        F.year(date).alias("year"),
        F.month(date).alias("month"),
        F.dayofmonth(date).alias("day"),
        F.date_format(date, "E").alias("day_of_week"),
        F.weekofyear(date).alias("week_of_year"),
        F.date_format(date, "MMMM").alias("month_name"),
    )


def dim_date(events: DataFrame, transactions: DataFrame) -> DataFrame:
    """Every date that an event or transaction has, the unknown date included, with calendar attributes."""
    return _calendar(events.select(_day("ts")).union(transactions.select(_day("created_at"))).distinct())


def _user_columns(users: DataFrame) -> DataFrame:
    return users.select(
        "user_id",
        F.col("city").alias("user_city"),
        F.col("age").cast("string").alias("user_age"),
        F.col("email").alias("user_email"),
    )


def fact_events(events: DataFrame, users: DataFrame, heavy: Sequence = ()) -> DataFrame:
    """Every event with its user's city, age and email; nulls where the user is unknown. ``heavy``: see ``attach``."""
    facts = events.select("event_id", "user_id", "ts", F.col("ts").cast("date").alias("event_date"), "country")
    return conform(attach(facts, _user_columns(users), "user_id", "event_id", heavy), gold_schema("fact_events"))


def fact_transactions(transactions: DataFrame, users: DataFrame, heavy: Sequence = ()) -> DataFrame:
    """Every transaction with its user's city, age and email; nulls where the user is unknown. ``heavy``: see
    ``attach``."""
    facts = transactions.select(
        "tx_id", "user_id", "amount", "status", "created_at", "delivered_at",
        F.col("created_at").cast("date").alias("tx_date"),
    )
    joined = attach(facts, _user_columns(users), "user_id", "tx_id", heavy)
    return conform(joined, gold_schema("fact_transactions"))


def _stacked(events: DataFrame, transactions: DataFrame) -> DataFrame:
    """Events and transactions under common columns; Spark prunes those that are not asked for."""
    event_side = events.select(
        "user_id", _day("ts"), F.lit(True).alias("is_event"), F.col("ts").alias("event_at"),
        F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("status"),
    )
    tx_side = transactions.select(
        "user_id", _day("created_at"), F.lit(False).alias("is_event"), F.lit(None).cast("timestamp").alias("event_at"),
        "amount", "status",
    )
    return event_side.union(tx_side)


def _side(unknown: Column, side: Column) -> Column:
    """Null, or for rows with an unknown key the side they come from: the two sides stay apart there."""
    return F.when(unknown, side).alias("side")


def user_days(events: DataFrame, transactions: DataFrame, scale: int | None = None) -> DataFrame:
    """Per user and day, all that the activity fact and the marts need: counts, money and the span of events."""
    unknown = F.col("user_id").isNull() | F.col("date").isNull()
    return (
        _stacked(events, transactions)
        .groupBy("user_id", "date", _side(unknown, F.col("is_event")))
        .agg(
            F.count_if("is_event").alias("events"),
            F.min("event_at").alias("first_event"),
            F.max("event_at").alias("last_event"),
            F.count_if(~F.col("is_event")).alias("transactions"),
            F.count_if(F.col("status") == "delivered").alias("delivered"),
            F.count("amount").alias("amounts"),
            _sum("amount", scale).alias("money"),
        )
    )


def activity_of(days: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Per user and day: event count, transaction count, revenue and mean amount, 0 where there is none.

    ``users`` adds nothing to the rows; joined by its distinct ids, it is dropped from the plan by Spark.
    """
    if users is not None:
        days = days.join(users.select("user_id").distinct(), "user_id", "left")
    return conform(
        days.select(
            "user_id",
            "date",
            F.col("events").alias("events_count"),
            F.col("transactions").alias("transactions_count"),
            F.coalesce(F.col("money").cast("double"), F.lit(0.0)).alias("total_revenue"),
            F.coalesce(_mean(F.col("money"), F.col("amounts")), F.lit(0.0)).alias("avg_transaction_amount"),
        ),
        gold_schema("fact_user_activity"),
    )


def revenue_of(days: DataFrame) -> DataFrame:
    """Per day: transactions, revenue, mean amount and how many were delivered."""
    return conform(
        days.where("transactions > 0")
        .groupBy("date")
        .agg(
            F.sum("transactions").alias("transaction_count"),
            F.sum("money").cast("double").alias("total_revenue"),
            _mean(F.sum("money"), F.sum("amounts")).alias("avg_amount"),
            F.sum("delivered").alias("delivered_count"),
        ),
        gold_schema("daily_revenue"),
    )


def active_of(days: DataFrame) -> DataFrame:
    """Per day: distinct users with events, with transactions, and with either; unknown users are not counted.

    The row of the unknown date has its total, but 0 for either source.
    """
    per_user = days.groupBy("date", "user_id").agg(
        F.bool_or(F.col("events") > 0).alias("by_event"), F.bool_or(F.col("transactions") > 0).alias("by_tx")
    )
    counted = F.col("date").isNotNull() & F.col("user_id").isNotNull()
    return conform(
        per_user.groupBy("date").agg(
            F.count_if(counted & F.col("by_event")).alias("event_active_users"),
            F.count_if(counted & F.col("by_tx")).alias("tx_active_users"),
            F.count("user_id").alias("total_active_users"),
        ),
        gold_schema("daily_active_users"),
    )


def _ltv(per_user: DataFrame) -> DataFrame:
    lifetime = per_user.withColumn("total_revenue", F.col("total_revenue").cast("double")).withColumns(
        {
            "event_count": F.nullif("event_count", F.lit(0)),
            "transaction_count": F.nullif("transaction_count", F.lit(0)),
            "ltv": F.coalesce("total_revenue", F.lit(0.0)),
        }
    )
    return conform(lifetime, gold_schema("user_ltv"))


def ltv_of(days: DataFrame) -> DataFrame:
    """Per user: event count and span, transaction count and revenue, null on a side the user lacks; ``ltv`` is
    revenue, or 0."""
    return _ltv(
        days.groupBy("user_id", _side(F.col("user_id").isNull(), F.col("side"))).agg(
            F.sum("events").alias("event_count"),
            F.min("first_event").alias("first_event"),
            F.max("last_event").alias("last_event"),
            F.sum("transactions").alias("transaction_count"),
            F.sum("money").alias("total_revenue"),
        )
    )


def dates_of(days: DataFrame) -> DataFrame:
    """The date dimension of the days that have events or transactions."""
    return _calendar(days.select("date").distinct())


def fact_user_activity(
    events: DataFrame, transactions: DataFrame, users: DataFrame | None = None, scale: int | None = None
) -> DataFrame:
    """:func:`activity_of` straight from silver."""
    return activity_of(user_days(events, transactions, scale), users)


def daily_revenue(transactions: DataFrame, scale: int | None = None) -> DataFrame:
    """:func:`revenue_of` straight from silver, with one aggregation by day."""
    money = _sum("amount", scale)
    return conform(
        transactions.groupBy(_day("created_at")).agg(
            F.count("*").alias("transaction_count"),
            money.cast("double").alias("total_revenue"),
            _mean(money, F.count("amount")).alias("avg_amount"),
            F.count_if(F.col("status") == "delivered").alias("delivered_count"),
        ),
        gold_schema("daily_revenue"),
    )


def daily_active_users(events: DataFrame, transactions: DataFrame) -> DataFrame:
    """:func:`active_of` straight from silver."""
    per_user = _stacked(events, transactions).select(
        "date",
        "user_id",
        F.col("is_event").cast("int").alias("events"),
        (~F.col("is_event")).cast("int").alias("transactions"),
    )
    return active_of(per_user)


def user_ltv(events: DataFrame, transactions: DataFrame, scale: int | None = None) -> DataFrame:
    """:func:`ltv_of` straight from silver, with one aggregation by user."""
    return _ltv(
        _stacked(events, transactions)
        .groupBy("user_id", _side(F.col("user_id").isNull(), F.col("is_event")))
        .agg(
            F.count_if("is_event").alias("event_count"),
            F.min("event_at").alias("first_event"),
            F.max("event_at").alias("last_event"),
            F.count_if(~F.col("is_event")).alias("transaction_count"),
            _sum("amount", scale).alias("total_revenue"),
        )
    )
