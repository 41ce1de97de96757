"""Input frames derived from the given tables, clean and dirty. ``suite.sql`` states the same in SQL.

Every row of the tables is used. Remainders of ids only decide which rows are given which defect, so that both engines
give the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orewash.specs import CORRUPT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def every(number: str, n: int) -> Column:
    return F.col(number) % n == 0


def hide(number: str, n: int, value: Column) -> Column:
    """``value``, but null for one row in ``n``."""
    return F.when(~every(number, n), value)


def days(n: Column) -> Column:
    return F.make_dt_interval(n.cast("int"))


def text(name: str) -> Column:
    return F.col(name).cast("string")


# --- clean frames with gaps: some users, dates and amounts are null --------------------------------------------


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        text("c_custkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.concat("c_name", F.lit("@example.test")).alias("email"),
        F.lit(None).cast("string").alias("phone"),
        F.col("n_name").alias("city"),
        (18 + F.col("c_custkey") % 60).cast("int").alias("age"),
        (F.lit("2024-01-01").cast("timestamp") + days(F.col("c_custkey") % 30)).alias("updated_at"),
    )


def _events_with_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.join(customer, F.col("user_id") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )


def events(spark: SparkSession, sf_dir: str, purchases: bool = True) -> DataFrame:
    df = _events_with_country(spark, sf_dir)
    df = df if purchases else df.where("event_type <> 'purchase'")
    return df.select(
        text("event_id").alias("event_id"),
        hide("event_id", 97, text("user_id")).alias("user_id"),
        hide("event_id", 53, F.col("ts")).alias("ts"),
        hide("event_id", 31, F.col("n_name")).alias("country"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("message"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    created = F.col("o_orderdate").cast("timestamp")
    delivered = F.col("o_orderstatus") == "F"
    return orders.select(
        text("o_orderkey").alias("tx_id"),
        hide("o_orderkey", 89, text("o_custkey")).alias("user_id"),
        hide("o_orderkey", 67, F.col("o_totalprice")).alias("amount"),
        F.when(delivered, "delivered").when(F.col("o_orderstatus") == "O", "pending")
        .when(F.col("o_orderstatus") == "P", "shipped").alias("status"),
        hide("o_orderkey", 71, created).alias("created_at"),
        F.when(delivered, created + days(F.lit(3))).alias("delivered_at"),
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions that share users and dates with the events."""
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    third = F.col("event_id") % 3
    return events.select(
        text("event_id").alias("tx_id"),
        hide("event_id", 89, text("user_id")).alias("user_id"),
        hide("event_id", 67, F.col("value")).alias("amount"),
        F.when(third == 0, "delivered").when(third == 1, "pending").otherwise("shipped").alias("status"),
        hide("event_id", 71, F.col("ts").cast("timestamp")).alias("created_at"),
        F.lit(None).cast("timestamp").alias("delivered_at"),
    )


# --- dirty frames, as text, as they would land -------------------------------------------------------------------


def _comma(number: str) -> Column:
    return F.concat(F.lit("1,"), F.lpad((F.col(number) % 1000).cast("string"), 3, "0"), F.lit(".50"))


def _written_time(at: Column, number: str) -> Column:
    form = F.col(number) % 11
    return (
        F.when(form == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .when(form == 1, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .when(form == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(form == 3, F.date_format(at, "yyyy-MM-dd"))
        .otherwise(at.cast("string"))
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _events_with_country(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value", "n_name")
    later = base.where(every("event_id", 5)).withColumns(
        {"ts": F.col("ts") + F.expr("interval 1 hour"), "value": F.col("value") + 1}
    )
    number = "event_id"
    value = text("value")
    return base.union(later).select(
        text("event_id").alias("event_id"),
        F.when(every(number, 97), None).when(every(number, 43), " null ").otherwise(text("user_id")).alias("user_id"),
        F.when(every(number, 53), "N/A").when(every(number, 59), "garbage")
        .otherwise(_written_time(F.col("ts"), number)).alias("ts"),
        F.concat(((F.col("user_id") % 60) + 18).cast("string"), F.lit(".9")).alias("age"),
        F.when(every(number, 31), " null ").otherwise(F.concat(F.lit("  "), "n_name", F.lit(" "))).alias("country"),
        F.when(every(number, 19), "n/a").otherwise(F.concat(text("user_id"), F.lit("@example.test"))).alias("email"),
        F.concat(F.lit(" "), "event_type").alias("message"),
        F.when(every(number, 13), "NaN").when(every(number, 17), "").otherwise(value).alias("price"),
        F.when(every(number, 7), _comma(number)).otherwise(value).alias("amount"),
        F.lit("x").alias("extra_1"),
        F.lit("y").alias("unknown_col"),
        F.when(every(number, 101), F.concat(F.lit('{"event_id": '), text("event_id"))).alias(CORRUPT),
    )


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    number = "c_custkey"
    first = F.lit("2024-01-01").cast("timestamp") + days(F.col(number) % 30)
    mail = F.concat("c_name", F.lit("@example.test"))
    version = F.explode(F.array(F.lit(0), F.lit(1)))  # 0: first row, 1: later partial update
    rows = customer.withColumn("version", version)
    later = F.col("version") == 1
    return rows.select(
        F.when(every(number, 97), " NULL ").when(every(number, 83), None).otherwise(text(number)).alias("user_id"),
        F.concat(F.lit(" "), "c_name").alias("name"),
        F.when(later & every(number, 3), None).when(later, F.concat(F.lit("new."), mail)).otherwise(mail)
        .alias("email"),
        F.when(every(number, 2) & ~later, F.concat(F.lit("+"), text(number))).alias("phone"),
        F.when(later & every(number, 4), "N/A").otherwise(F.col("n_name")).alias("city"),
        (18 + F.col(number) % 60).cast("string").alias("age"),
        F.when(~every(number, 11), F.date_format(F.when(later, first + days(F.lit(1))).otherwise(first),
                                                 "yyyy-MM-dd HH:mm:ss")).alias("updated_at"),
    )


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    base = base.select(*columns, F.lit(0).alias("version"))
    later = base.where(every("o_orderkey", 5)).withColumns(
        {
            "o_orderdate": F.col("o_orderdate") + days(F.lit(1)),
            "o_totalprice": F.col("o_totalprice") + 1,
            "version": F.lit(1),
        }
    )
    number = "o_orderkey"
    negative = every(number, 41) | ((F.col("version") == 1) & every(number, 10))
    delivered = F.col("o_orderstatus") == "F"
    return base.union(later).select(
        text(number).alias("tx_id"),
        F.when(every(number, 97), None).when(every(number, 89), " None ").otherwise(text("o_custkey"))
        .alias("user_id"),
        F.when(negative, F.concat(F.lit("-"), text("o_totalprice"))).when(every(number, 7), _comma(number))
        .when(every(number, 23), "").otherwise(text("o_totalprice")).alias("amount"),
        F.when(delivered, " delivered").when(F.col("o_orderstatus") == "O", "pending ").otherwise("shipped")
        .alias("status"),
        F.when(every(number, 59), "garbage").otherwise(_written_time(F.col("o_orderdate"), number))
        .alias("created_at"),
        F.when(delivered, F.date_format(F.col("o_orderdate") + days(F.lit(3)), "yyyy-MM-dd")).otherwise("")
        .alias("delivered_at"),
        F.lit("x").alias("extra_1"),
    )
