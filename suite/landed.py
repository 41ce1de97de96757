"""Landing files that drift, as queries: types that clash, headers that differ, broken lines, odd names, files that change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orewash.operators.cleaning import clean
from orewash.operators.dedupe import dedupe
from orewash.operators.normalize import normalize
from orewash.operators.quarantine import quarantine
from orewash.scratch import fresh_path
from orewash.sources.landing import drift_counts, read_landing
from orewash.sources.silver import read_loose
from orewash.specs import CORRUPT, EVENTS, TRANSACTIONS, USERS
from orewash.streaming.landing import landing_stream, stored_rejects, stored_silver
from suite import inputs, sql
from suite.queries import LANDED, register, write_mixed_landing

HEADERS = 24


def ways(raw: DataFrame, n: int) -> DataFrame:
    return raw.withColumn("_way", F.pmod(F.xxhash64(*raw.columns), F.lit(n)))


@register("landing_types", f"select {sql.columns(EVENTS)} from raw_events")
def _(spark, sf_dir):
    """Parquet files that hold one column as text, as whole numbers of two sizes, and as decimals."""
    folder = fresh_path(spark, "landing") + "/events"
    dealt = ways(inputs.raw_events(spark, sf_dir).drop(CORRUPT, "extra_1", "unknown_col"), 4)
    number, age = F.col("event_id"), F.col("age")
    for way, types in enumerate(({}, {"event_id": number.cast("bigint")}, {"event_id": number.cast("int")}, {"age": age.cast("decimal(5,1)")})):
        dealt.where(F.col("_way") == way).drop("_way").withColumns(types).write.mode("append").parquet(folder)
    return read_landing(spark, folder, EVENTS).drop(CORRUPT)


def write_delimited(lines: DataFrame, heads: DataFrame, folder: str, **options) -> None:
    """Text files, one for each ``_way``, of its line in ``heads`` and then those in ``lines`` (both: _way, value)."""
    both = heads.withColumn("_at", F.lit(0)).unionByName(lines.withColumn("_at", F.lit(1)))
    dealt = both.repartition(HEADERS, "_way").sortWithinPartitions("_way", "_at")
    dealt.select("_way", "value").write.mode("append").partitionBy("_way").options(**options).text(folder)


@register("landing_headers", LANDED)
def _(spark, sf_dir):
    """Delimited files of as many headers as there are groups: columns in turn, after some that no other file has."""
    folder = fresh_path(spark, "landing") + "/events"
    raw = inputs.raw_events(spark, sf_dir).drop(CORRUPT)

    def names(group: int) -> list[str]:
        turn = group % len(raw.columns)
        return [*(f"only_{group}_{i}" for i in range(group % 3)), *raw.columns[turn:], *raw.columns[:turn]]

    def cell(name: str) -> Column:
        return F.coalesce(F.concat(F.lit('"'), F.col(name), F.lit('"')), F.lit("")) if name in raw.columns else F.lit("x")

    lines = F.coalesce(*(F.when(F.col("_way") == g, F.concat_ws(",", *map(cell, names(g)))) for g in range(HEADERS)))
    heads = spark.createDataFrame([(g, ",".join(names(g))) for g in range(HEADERS)], "_way bigint, value string")
    write_delimited(ways(raw, HEADERS).select("_way", lines.alias("value")), heads, folder, compression="gzip")
    landed = read_landing(spark, folder, EVENTS).drop(CORRUPT)
    return landed.withColumn("price", F.nullif("price", F.lit("")))


_NOTHING = ", ".join("null" for _ in EVENTS.columns[2:])


@register("landing_corrupt", f"""select {sql.columns(EVENTS)}, null as {CORRUPT} from raw_events
    union all select null, null, {_NOTHING}, {CORRUPT} from raw_events where {CORRUPT} is not null
    union all select event_id, user_id, {_NOTHING}, event_id || ',' || user_id || ',surplus' from raw_events
        where user_id not like '% %'""")  # fmt: skip
def _(spark, sf_dir):
    """Sound JSON lines, broken ones in files of their own, and delimited lines with a value too many."""
    folder = fresh_path(spark, "landing") + "/events"
    raw = inputs.raw_events(spark, sf_dir)
    raw.drop(CORRUPT).write.json(f"{folder}/_way=100")
    raw.where(F.col(CORRUPT).isNotNull()).select(CORRUPT).write.text(f"{folder}/_way=101")
    lines = ways(raw.where("user_id not like '% %'").select("event_id", "user_id"), HEADERS)
    heads = spark.range(HEADERS).select(F.col("id").alias("_way"), F.lit("event_id,user_id").alias("value"))
    write_delimited(lines.select("_way", F.concat_ws(",", "event_id", "user_id", F.lit("surplus")).alias("value")), heads, folder)
    return read_landing(spark, folder, EVENTS)


_KNOWN = [c for c in EVENTS.columns if c not in ("name", "temperature", "year", "month", "day")]


@register("drift_kept", "\nunion all ".join(
    [f"select '{c}' as \"column\", 'known' as status, 'string' as type, count({c}) as \"rows\" from raw_events" for c in _KNOWN]
    + [f"select '{c}', 'extra', 'string', count(*) from raw_events" for c in ("extra_1", "unknown_col")]
    + ["select 'price', 'known', 'decimal', count(*) from raw_events", "select 'age', 'known', 'decimal(5,1)', count(*) from raw_events"]
    + [f"select '{c}', 'missing', null, 0" for c in EVENTS.columns if c not in _KNOWN]
))
def _(spark, sf_dir):
    """What landing files hold: text in JSON, and numbers beside it in JSON and in Parquet."""
    folder = fresh_path(spark, "landing") + "/events"
    raw = inputs.raw_events(spark, sf_dir).drop(CORRUPT)
    raw.write.mode("append").json(folder)
    raw.select(F.lit(0.5).cast("double").alias("price")).write.mode("append").option("compression", "gzip").json(folder)
    raw.select(F.col("age").cast("decimal(5,1)").alias("age")).write.mode("append").parquet(folder)
    return drift_counts(spark, folder, EVENTS)


@register("odd_names", f"""select {sql.columns(EVENTS)}, nullif(reason, '') as reason from (
    select {sql.typed_columns(EVENTS, False)}, {sql.early_reasons(EVENTS)} as reason
    from (select * replace (substr(ts, 1, 4) as year, substr(ts, 6, 2) || '.0' as month, ' ' || substr(ts, 9, 2) as day) from raw_events))""")  # fmt: skip
def _(spark, sf_dir):
    """Column names with white space around them, and dates in parts."""
    raw = inputs.raw_events(spark, sf_dir)
    parts = {"year": F.substring("ts", 1, 4), "month": F.concat(F.substring("ts", 6, 2), F.lit(".0")), "day": F.concat(F.lit(" "), F.substring("ts", 9, 2))}
    odd = raw.withColumns(parts).withColumnsRenamed({"amount": " amount ", "country": "country\t", "year": " year", "day": "day "})
    good, rejected = normalize(odd, EVENTS)
    return good.select(*EVENTS.columns, F.lit(None).cast("string").alias("reason")).union(rejected.select(*EVENTS.columns, "reason"))


@register("loose_load", """select cast(c_custkey as varchar) as user_id, c_name as name, null as status, null as tx_id from customer
    union all select cast(o_custkey as varchar), null, o_orderstatus, cast(o_orderkey as varchar) from orders""")  # fmt: skip
def _(spark, sf_dir):
    """A folder of CSV and Parquet files without a schema: ids are aliased, types are text."""
    folder = fresh_path(spark, "loose") + "/mixed"
    customer, orders = inputs.table(spark, sf_dir, "customer"), inputs.table(spark, sf_dir, "orders")
    customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).write.option("header", True).csv(folder)
    orders.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("tx_id")).write.mode("append").parquet(folder)
    return read_loose(spark, folder).select("user_id", "name", "status", "tx_id")


@register("no_dataset", f"select {sql.columns(USERS)} from raw_users")
def _(spark, sf_dir):
    """A frame of no known dataset passes cleaning, deduplication and quarantine as it is."""
    raw = inputs.raw_users(spark, sf_dir).withColumns({c: F.lit(None).cast("string") for c in ("year", "month", "day")})
    return quarantine(dedupe(clean(raw, None), None), None).good.select(*USERS.columns)


@register("stream_changes", sql.silver_chain(TRANSACTIONS) + """ select 'silver' as part, * exclude (event_date), null as reason from accepted
    union all select 'rejected', * exclude (_corrupt_record) from rejected""")  # fmt: skip
def _(spark, sf_dir):
    """A stream whose files are replaced by others: what the first ones alone held is gone from the store."""
    base = fresh_path(spark, "stream")
    raw = inputs.raw_transactions(spark, sf_dir)
    later = raw.withColumns({"tx_id": F.concat("tx_id", F.lit("-x")), "created_at": F.lit("2030-01-01")})
    for rows in (raw.unionByName(later.sample(0.2, seed=1)), raw):
        rows.drop(CORRUPT).write.mode("overwrite").json(f"{base}/in")
        landing_stream(spark, f"{base}/in", f"{base}/store", f"{base}/checkpoint", TRANSACTIONS).awaitTermination()
    good = stored_silver(spark, f"{base}/store", TRANSACTIONS).drop("event_date").withColumns({"part": F.lit("silver"), "reason": F.lit(None).cast("string")})
    return good.unionByName(stored_rejects(spark, f"{base}/store", TRANSACTIONS).drop(CORRUPT).withColumn("part", F.lit("rejected")))


@register("stream_partial", f"""with cleaned as ({sql.cleaned(USERS)}), fit as (select * from cleaned where user_id is not null),
    merged as ({sql.PARTIAL.format(source="fit")})
    select user_id, name, email, phone, city, age, updated_at, cast(null as integer) as year, cast(null as integer) as month,
        cast(null as integer) as day, cast(updated_at as date) as event_date from merged""")  # fmt: skip
def _(spark, sf_dir):
    """Partial user rows in waves, the latest ones first."""
    base = fresh_path(spark, "stream")
    raw = inputs.raw_users(spark, sf_dir)
    late = F.col("email").startswith("new.") | F.col("email").isNull()
    for wave in (raw.where(late), raw.where(~late)):
        write_mixed_landing(wave, f"{base}/in", USERS)
        landing_stream(spark, f"{base}/in", f"{base}/store", f"{base}/checkpoint", USERS, partial=True).awaitTermination()
    return stored_silver(spark, f"{base}/store", USERS)
