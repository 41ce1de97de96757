"""Registered queries: name, Spark callable, and the SQL it must agree with (None where files are the subject)."""

from __future__ import annotations

import gzip
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from orewash.operators import quality
from orewash.operators.cleaning import clean, null_tokens, trim_all
from orewash.operators.columns import conform, locked, voids_to_text, with_event_date, with_missing
from orewash.operators.dedupe import dedupe, set_union, union_by_name
from orewash.operators.joins import heavy_keys
from orewash.operators.normalize import normalize
from orewash.operators.quarantine import quarantine
from orewash.operators.scd import latest_snapshot, merge_partial
from orewash.operators.split import Split
from orewash.plans import gold
from orewash.plans.silver import measured_columns, silver
from orewash.scratch import fresh_path, written
from orewash.sinks.files import append_quarantine, read_gold, require_outputs, write_gold, write_silver
from orewash.sinks.warehouse import create_tables, load_table, require_loaded
from orewash.sources.audit import landing_audit, routed
from orewash.sources.landing import read_landing
from orewash.sources.silver import read_silver
from orewash.specs import CORRUPT, EVENTS, SPECS, TRANSACTIONS, USERS, DatasetSpec, gold_schema
from orewash.streaming.landing import landing_stream, stored_silver
from suite import inputs, sql

Query = Callable[[SparkSession, str], DataFrame]
RAW = {"events": inputs.raw_events, "users": inputs.raw_users, "transactions": inputs.raw_transactions}
CENTS = 2  # money in the given tables has two decimals, so it can be summed exactly

REGISTRY: dict[str, tuple[Query, str | None]] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Times without zone, as SQL's ``timestamp`` has none."""
    return df.select(
        *(
            F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, TimestampType) else f.name
            for f in df.schema.fields
        )
    )


def register(name: str, twin: str | None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(query(spark, sf_dir))

        REGISTRY[name] = (run, sql.with_ctes(twin) if twin else None)
        return query

    return add


# --- gold -----------------------------------------------------------------------------------------------------------


@register("dim_users", f"""with cleaned as ({sql.cleaned(USERS)})
    select user_id, name, email, city, phone, cast(age as varchar) as age, updated_at from (
        select *, row_number() over (
            partition by user_id order by updated_at desc nulls last, name desc nulls last, email desc nulls last,
            city desc nulls last, phone desc nulls last, age desc nulls last) as _rank from cleaned
    ) where _rank = 1""")  # fmt: skip
def _(spark, sf_dir):
    return gold.dim_users(clean(inputs.raw_users(spark, sf_dir), USERS))


@register("dim_country", "select distinct country from ev where country is not null")
def _(spark, sf_dir):
    return gold.dim_country(inputs.events(spark, sf_dir))


@register("dim_status", "select distinct status from tx where status is not null")
def _(spark, sf_dir):
    return gold.dim_status(inputs.transactions(spark, sf_dir))


@register("dim_date", sql.DIM_DATE)
def _(spark, sf_dir):
    return gold.dim_date(inputs.events(spark, sf_dir), inputs.transactions(spark, sf_dir))


@register("fact_events", sql.FACT_EVENTS)
def _(spark, sf_dir):
    return gold.fact_events(inputs.events(spark, sf_dir), inputs.users(spark, sf_dir))


@register("fact_events_spread", sql.FACT_EVENTS)
def _(spark, sf_dir):
    events = inputs.events(spark, sf_dir)
    counts = events.groupBy("user_id").agg(F.count("*").alias("n"))
    heavy = heavy_keys(counts, "user_id", ["n"], share=1 / 2000)
    return gold.fact_events(events, inputs.users(spark, sf_dir), heavy)


@register("fact_transactions", sql.FACT_TRANSACTIONS)
def _(spark, sf_dir):
    return gold.fact_transactions(inputs.transactions(spark, sf_dir), inputs.users(spark, sf_dir))


@register("fact_user_activity", sql.ACTIVITY)
def _(spark, sf_dir):
    events = inputs.events(spark, sf_dir, purchases=False)
    return gold.fact_user_activity(
        events, inputs.purchases(spark, sf_dir), inputs.users(spark, sf_dir), scale=CENTS
    )


@register("daily_revenue", sql.REVENUE)
def _(spark, sf_dir):
    return gold.daily_revenue(inputs.transactions(spark, sf_dir), scale=CENTS)


@register("daily_active_users", sql.ACTIVE)
def _(spark, sf_dir):
    return gold.daily_active_users(
        inputs.events(spark, sf_dir, purchases=False), inputs.purchases(spark, sf_dir)
    )


def user_ltv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.user_ltv(inputs.events(spark, sf_dir), inputs.transactions(spark, sf_dir), scale=CENTS)


register("user_ltv", sql.LTV)(user_ltv)


# --- cleaning, normalising, deduplicating, quarantining: one query per dataset --------------------------------------


def _canonical(raw: DataFrame, spec: DatasetSpec) -> DataFrame:
    return with_missing(raw, spec.schema).select(*spec.columns)


def _whole(split: Split, spec: DatasetSpec) -> DataFrame:
    """Good rows without a reason, and rejected rows with theirs."""
    return union_by_name(split.good.select(*spec.columns), split.rejected.select(*spec.columns, "reason"))


def _register_steps(spec: DatasetSpec) -> None:
    raw, name = RAW[spec.name], spec.name

    @register(f"clean_{name}", sql.cleaned(spec))
    def _(spark, sf_dir):
        return clean(_canonical(raw(spark, sf_dir), spec), spec)

    @register(f"normalize_{name}", sql.normalized(spec))
    def _(spark, sf_dir):
        return _whole(normalize(raw(spark, sf_dir), spec), spec)

    @register(f"dedupe_{name}", sql.deduped(spec))
    def _(spark, sf_dir):
        return dedupe(clean(_canonical(raw(spark, sf_dir), spec), spec), spec)

    @register(f"quarantine_{name}", sql.quarantined(spec))
    def _(spark, sf_dir):
        return _whole(quarantine(clean(_canonical(raw(spark, sf_dir), spec), spec), spec), spec)

    @register(f"silver_{name}", sql.silver_chain(spec) + " select * from accepted")
    def _(spark, sf_dir):
        return silver(raw(spark, sf_dir), spec).good

    @register(f"rejected_{name}", sql.silver_chain(spec) + " select * from rejected")
    def _(spark, sf_dir):
        return silver(raw(spark, sf_dir), spec).rejected

    measured = measured_columns(spec)
    chain = sql.silver_chain(spec) + f", measured as (select {', '.join(measured)} from accepted) "

    @register(f"dq_metrics_{name}", chain + sql.metrics(spec, measured))
    def _(spark, sf_dir):
        return quality.measures(silver(raw(spark, sf_dir), spec).good.select(*measured), spec)

    @register(f"metrics_text_{name}", f"""select metric, case when metric like 'null_rate_%' then
        cast(((bad * 20000 + total) // (2 * total)) / 10000.0 as varchar) else cast(bad as varchar) end as value
        from ({chain + sql.metrics(spec, measured)})""")  # fmt: skip
    def _(spark, sf_dir):
        measured_rows = quality.measures(silver(raw(spark, sf_dir), spec).good.select(*measured), spec)
        return quality.as_metrics(measured_rows)


for _spec in SPECS.values():
    _register_steps(_spec)


@register("dq_checks", f"""with cleaned as ({sql.cleaned(TRANSACTIONS)})
    select 'not_null' as rule, count(*) = count(user_id) as ok, count(*) - count(user_id) as bad from cleaned
    union all
    select 'unique', bad = 0, bad from (
        select count(*) - count(distinct user_id) - max(case when user_id is null then 1 else 0 end) as bad from cleaned)
    union all
    select 'timestamp', count(*) = count(created_at), count(*) - count(created_at) from cleaned""")  # fmt: skip
def _(spark, sf_dir):
    df = clean(_canonical(inputs.raw_transactions(spark, sf_dir), TRANSACTIONS), TRANSACTIONS)
    checks = {
        "not_null": quality.check_not_null(df, "user_id"),
        "unique": quality.check_unique(df, "user_id"),
        "timestamp": quality.check_timestamp(df, "created_at"),
    }
    return union_by_name(*(check.select(F.lit(rule).alias("rule"), "ok", "bad") for rule, check in checks.items()))


@register("null_stats", f"with cleaned as ({sql.cleaned(EVENTS)}) " + " union all ".join(
    f"select '{c}' as \"column\", count(*) - count({c}) as null_count, count(*) as total, "
    f"(((count(*) - count({c})) * 20000 + count(*)) // (2 * count(*))) / 10000.0 as null_rate from cleaned"
    for c in EVENTS.columns
))
def _(spark, sf_dir):
    df = clean(_canonical(inputs.raw_events(spark, sf_dir), EVENTS), EVENTS)
    return quality.null_stats(df)


@register("scd_latest", f"with cleaned as ({sql.cleaned(USERS)}) " + sql.SNAPSHOT.format(source="cleaned"))
def _(spark, sf_dir):
    return latest_snapshot(clean(inputs.raw_users(spark, sf_dir), USERS), USERS)


@register("scd_merge_partial", f"with cleaned as ({sql.cleaned(USERS)}) " + sql.PARTIAL.format(source="cleaned"))
def _(spark, sf_dir):
    return merge_partial(clean(inputs.raw_users(spark, sf_dir), USERS), USERS)


# --- schema and set operators ---------------------------------------------------------------------------------------


@register("union_by_name", """select * from (select event_id, country, amount from ev)
    union all by name select event_id, message from ev_np
    union all by name select tx_id as event_id, status from tx""")  # fmt: skip
def _(spark, sf_dir):
    return union_by_name(
        inputs.events(spark, sf_dir).select("event_id", "country", "amount"),
        inputs.events(spark, sf_dir, purchases=False).select("event_id", "message"),
        inputs.transactions(spark, sf_dir).select(F.col("tx_id").alias("event_id"), "status"),
    )


@register("set_union", """select user_id, cast(ts as date) as date from ev
    union select user_id, cast(created_at as date) from tx_p""")  # fmt: skip
def _(spark, sf_dir):
    return set_union(
        inputs.events(spark, sf_dir).select("user_id", F.to_date("ts").alias("date")),
        inputs.purchases(spark, sf_dir).select("user_id", F.to_date("created_at").alias("date")),
    )


@register("null_tokens", f"""select case when trim(country) not in ({sql.TOKENS}) then country end as country,
        case when trim(email) not in ({sql.TOKENS}) then email end as email,
        case when trim(price) not in ({sql.TOKENS}) then price end as price, event_id from raw_events""")  # fmt: skip
def _(spark, sf_dir):
    return null_tokens(inputs.raw_events(spark, sf_dir).select("event_id", "country", "email", "price"))


@register("trim_all", "select event_id, trim(country) as country, trim(message) as message from raw_events")
def _(spark, sf_dir):
    return trim_all(inputs.raw_events(spark, sf_dir).select("event_id", "country", "message"))


@register("schema_lock", f"""with cleaned as ({sql.cleaned(TRANSACTIONS)})
    select {sql.columns(TRANSACTIONS)}, coalesce(cast(created_at as date), date '1900-01-01') as event_date
    from cleaned""")  # fmt: skip
def _(spark, sf_dir):
    raw = clean(inputs.raw_transactions(spark, sf_dir), TRANSACTIONS)
    return locked(voids_to_text(raw.withColumn("email", F.lit(None))), TRANSACTIONS)


@register("schema_enforced", """select event_id, user_id, ts, cast(null as date) as event_date, country,
    cast(null as varchar) as user_city, cast(null as varchar) as user_age, cast(null as varchar) as user_email
    from ev""")  # fmt: skip
def _(spark, sf_dir):
    return conform(inputs.events(spark, sf_dir), gold_schema("fact_events"))


@register("event_date_derivation", f"""with e as ({sql.cleaned(EVENTS)}), u as ({sql.cleaned(USERS)}),
    t as ({sql.cleaned(TRANSACTIONS)})
    select event_id as id, coalesce(cast(ts as date), date '1900-01-01') as event_date from e
    union all select user_id, coalesce(cast(updated_at as date), date '1900-01-01') from u
    union all select tx_id, coalesce(cast(created_at as date), date '1900-01-01') from t""")  # fmt: skip
def _(spark, sf_dir):
    return union_by_name(
        *(
            with_event_date(clean(RAW[s.name](spark, sf_dir), s)).select(F.col(s.key).alias("id"), "event_date")
            for s in (EVENTS, USERS, TRANSACTIONS)
        )
    )


# --- functions ------------------------------------------------------------------------------------------------------

_GROUPED = f"""count(*) as rows_all, count(amount) as rows_with_amount,
    count(*) filter (where amount is null) as rows_without, sum(case when status = 'delivered' then 1 else 0 end)::bigint
    as delivered, {sql.EXACT} as total, {sql.EXACT} / nullif(count(amount), 0) as mean, min(created_at) as first_at,
    max(created_at) as last_at, max_by(tx_id, cast(tx_id as bigint)) as newest,
    count(distinct user_id) + max(case when user_id is null then 1 else 0 end)::bigint as users"""


def _aggregates() -> list:
    cents = F.sum(F.col("amount").cast("decimal(18,2)")).cast("double")
    return [
        F.count("*").alias("rows_all"),
        F.count("amount").alias("rows_with_amount"),
        F.count_if(F.col("amount").isNull()).alias("rows_without"),
        F.sum(F.when(F.col("status") == "delivered", 1).otherwise(0)).alias("delivered"),
        cents.alias("total"),
        (cents / F.nullif(F.count("amount"), F.lit(0))).alias("mean"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
        F.max_by("tx_id", F.col("tx_id").cast("bigint")).alias("newest"),
        (F.count_distinct("user_id") + F.max(F.col("user_id").isNull().cast("bigint"))).alias("users"),
    ]


@register("agg_functions", f"""select cast(created_at as date) as date, {_GROUPED} from tx group by 1
    union all select null, {_GROUPED} from tx""")  # fmt: skip
def _(spark, sf_dir):
    tx = inputs.transactions(spark, sf_dir)
    grouped = tx.groupBy(F.to_date("created_at").alias("date")).agg(*_aggregates())
    return grouped.unionByName(tx.agg(*_aggregates()), allowMissingColumns=True)


@register("scalar_functions", """select event_id, trim(country) as trimmed,
    regexp_replace(country, '[A-Z]+', '#', 'g') as replaced, country in ('NATION_1', 'NATION_2') as listed,
    case when amount < 100 then 'low' else 'high' end as banded, coalesce(country, 'none') as filled,
    try_cast(country as integer) as uncastable, cast(amount as varchar) = '' as blank,
    coalesce(try_cast(cast(ts as varchar) as timestamp), timestamp '1900-01-01') as reread,
    try_strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d') as reread_day,
    cast(ts as date) as day, cast(year(ts) as integer) as y, cast(month(ts) as integer) as m,
    cast(day(ts) as integer) as d, strftime(ts, '%a') as weekday, strftime(ts, '%B') as month_name,
    cast(week(ts) as integer) as week, ts is null as no_ts, ts is not null and amount <> 1 as kept,
    not (amount < 10 or country is null) as negated, 'x' as fixed, round(cast(event_id as double) / 4, 1) as rounded,
    lower(country) as lowered, ends_with(message, 'up') as suffixed, contains(message, 'i') as contained
    from ev""")  # fmt: skip
def _(spark, sf_dir):
    c = F.col
    return inputs.events(spark, sf_dir).select(
        "event_id",
        F.trim("country").alias("trimmed"),
        F.regexp_replace("country", "[A-Z]+", "#").alias("replaced"),
        c("country").isin("NATION_1", "NATION_2").alias("listed"),
        F.when(c("amount") < 100, "low").otherwise("high").alias("banded"),
        F.coalesce("country", F.lit("none")).alias("filled"),
        c("country").try_cast("int").alias("uncastable"),
        (c("amount").cast("string") == "").alias("blank"),
        F.coalesce(F.try_to_timestamp(c("ts").cast("string")), F.lit("1900-01-01").cast("timestamp")).alias("reread"),
        F.try_to_timestamp(F.date_format("ts", "yyyy-MM-dd"), F.lit("yyyy-MM-dd")).alias("reread_day"),
        F.to_date("ts").alias("day"),
        F.year("ts").alias("y"),
        F.month("ts").alias("m"),
        F.dayofmonth("ts").alias("d"),
        F.date_format("ts", "E").alias("weekday"),
        F.date_format("ts", "MMMM").alias("month_name"),
        F.weekofyear("ts").alias("week"),
        c("ts").isNull().alias("no_ts"),
        (c("ts").isNotNull() & (c("amount") != 1)).alias("kept"),
        (~((c("amount") < 10) | c("country").isNull())).alias("negated"),
        F.lit("x").alias("fixed"),
        F.round(c("event_id").cast("double") / 4, 1).alias("rounded"),
        F.lower("country").alias("lowered"),
        F.endswith("message", F.lit("up")).alias("suffixed"),
        F.contains("message", F.lit("i")).alias("contained"),
    )


# --- files, tables and streams --------------------------------------------------------------------------------------

_MIX = 6  # ways a row may be written to the landing folder


def write_mixed_landing(raw: DataFrame, folder: str, spec: DatasetSpec) -> None:
    """Write every row of ``raw`` to ``folder`` once, spread over Parquet, JSON, CSV and text files."""
    columns = [c for c in raw.columns if c != CORRUPT]
    dealt = raw.select(*columns).withColumn("_way", F.pmod(F.xxhash64(*columns), F.lit(_MIX)))
    rows = written(dealt, "ways", "_way")  # worked out once, then each way reads its own part

    def way(n: int, *names: str) -> DataFrame:
        return rows.where(F.col("_way") == n).select(*(names or columns))

    def csv(df: DataFrame, header: bool, **options) -> None:
        writer = df.write.mode("append").option("header", header)
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        writer.options(**options).csv(folder)

    way(0).write.mode("append").parquet(folder)
    way(1).write.mode("append").json(folder)
    way(2).write.mode("append").option("compression", "gzip").json(folder)
    csv(way(3, *reversed(columns)), header=True)
    bare = with_missing(way(4), spec.schema).select(*spec.columns)
    csv(bare, header=False, compression="gzip")
    way(5).select(F.to_json(F.struct(*columns))).write.mode("append").text(folder)


LANDED = f"select {sql.columns(EVENTS)} from raw_events".replace("price", "nullif(price, '') as price")


@register("landing_formats", LANDED)
def _(spark, sf_dir):
    folder = fresh_path(spark, "landing") + "/events"
    write_mixed_landing(inputs.raw_events(spark, sf_dir), folder, EVENTS)
    landed = read_landing(spark, folder, EVENTS).drop(CORRUPT)
    return landed.withColumn("price", F.nullif("price", F.lit("")))  # CSV cannot tell an empty text from none


def put_file(spark, path: str, content: bytes) -> None:
    """One file of the given name and content, wherever Spark's own writers would put theirs."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    stream.write(bytearray(content))
    stream.close()


_FILES = 16  # files of each format
_FILE_COUNT = f"count(distinct cast(event_id as bigint) // 3 % {_FILES})"


@register("landing_audit", f"""select format, verdict, reason, cast(files as bigint) as files, "rows" from (
    select 'json' as format, 'valid' as verdict, null as reason, {_FILE_COUNT} as files, count(*) as "rows" from raw_events
        where cast(event_id as bigint) % 3 = 0
    union all select 'csv', 'valid', null, {_FILE_COUNT}, count(*) from raw_events where cast(event_id as bigint) % 3 = 1
    union all select 'parquet', 'valid', null, {_FILE_COUNT}, count(*) from raw_events where cast(event_id as bigint) % 3 = 2
    union all select 'csv', 'unreadable', 'empty file', 1, 0
    union all select 'parquet', 'bad_extension', 'parquet without part-', 1, 0
    union all select null, 'bad_extension', 'extension not accepted', 1, 0
    union all select 'json.gz', 'damaged', 'gzip cut off', 1, 0)""")  # fmt: skip
def _(spark, sf_dir):
    """Files of three formats, each row's told by its number, and faulty ones; valid files are counted, and so are their rows."""
    folder = fresh_path(spark, "landing") + "/events"
    raw = inputs.raw_events(spark, sf_dir).drop(CORRUPT)
    third = F.col("event_id").cast("bigint") % 3

    def dealt(n: int) -> DataFrame:
        return raw.where(third == n).repartitionById(_FILES, F.expr(f"cast(cast(event_id as bigint) div 3 % {_FILES} as int)"))

    dealt(0).write.mode("append").json(folder)
    dealt(1).write.mode("append").option("header", True).csv(folder)
    dealt(2).write.mode("append").parquet(folder)
    put_file(spark, f"{folder}/empty.csv", b"")
    put_file(spark, f"{folder}/notes.xml", b"<a/>")
    put_file(spark, f"{folder}/Loose.PARQUET", b"PAR1")
    put_file(spark, f"{folder}/cut.json.gz", gzip.compress(b'{"event_id":"1"}\n' * 1000)[:40])
    manifest = written(landing_audit(spark, folder, "events", probe=True), "manifest")
    valid = routed(manifest).good.where("length > 0")

    def rows(form: str) -> DataFrame:
        paths = [r["path"] for r in valid.where(F.col("format") == form).select("path").collect()]
        return read_landing(spark, paths, EVENTS).agg(F.lit(form).alias("format"), F.count("*").alias("read"))

    counts = union_by_name(*(rows(form) for form in ("json", "csv", "parquet")))
    grouped = manifest.groupBy("format", "verdict", "reason").agg(F.count("*").alias("files"))
    sound = F.col("verdict") == "valid"
    return grouped.join(counts, "format", "left").select("format", "verdict", "reason", "files", F.when(sound, F.col("read")).otherwise(0).alias("rows"))


@register("silver_write_read", sql.silver_chain(USERS) + " select * from accepted")
def _(spark, sf_dir):
    path = fresh_path(spark, "silver") + "/users"
    write_silver(silver(inputs.raw_users(spark, sf_dir), USERS).good, path, USERS)
    return read_silver(spark, path, USERS)


@register("quarantine_write_read", sql.silver_chain(TRANSACTIONS) + " select * from rejected")
def _(spark, sf_dir):
    base = fresh_path(spark, "quarantine")
    append_quarantine(silver(inputs.raw_transactions(spark, sf_dir), TRANSACTIONS).rejected, base, TRANSACTIONS)
    return spark.read.parquet(f"{base}/{TRANSACTIONS.name}")


@register("gold_write_read", sql.FACT_TRANSACTIONS)
def _(spark, sf_dir):
    base = fresh_path(spark, "gold")
    facts = gold.fact_transactions(inputs.transactions(spark, sf_dir), inputs.users(spark, sf_dir))
    write_gold(facts, base, "fact_transactions", compact=True)
    require_outputs(spark, [f"{base}/fact_transactions"])
    return read_gold(spark, base, "fact_transactions")


@register("warehouse_load", sql.REVENUE)
def _(spark, sf_dir):
    database, table = "orewash_gold", "daily_revenue"
    create_tables(spark, database, fresh_path(spark, "warehouse"), [table])
    for _ in range(2):  # loading again replaces
        load_table(gold.daily_revenue(inputs.transactions(spark, sf_dir), CENTS), database, table)
    require_loaded(spark, database, [table])
    return spark.table(f"{database}.{table}")


@register(
    "stream_landing",
    sql.silver_chain(EVENTS).replace("_corrupt_record is not null", "false") + " select * from accepted",
)
def _(spark, sf_dir):
    base = fresh_path(spark, "stream")
    raw = inputs.raw_events(spark, sf_dir)
    wave = F.pmod(F.xxhash64("ts", "amount"), F.lit(2))
    for n in (0, 1):
        write_mixed_landing(raw.where(wave == n), f"{base}/events", EVENTS)
        stream = landing_stream(spark, f"{base}/events", f"{base}/store", f"{base}/checkpoint", EVENTS)
        stream.awaitTermination()
    return stored_silver(spark, f"{base}/store", EVENTS)
