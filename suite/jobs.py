"""Whole jobs as queries: landing files of all datasets through every layer, each table told by a profile of its columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from orewash.operators.dedupe import union_by_name
from orewash.plans import gold
from orewash.plans.jobs import Layout, gold_job, run_all, silver_job
from orewash.plans.silver import measured_columns, silver
from orewash.scratch import fresh_path
from orewash.sinks.files import read_gold, require_outputs, write_gold
from orewash.sinks.warehouse import load_warehouse
from orewash.sources.silver import read_silver
from orewash.specs import GOLD_DDL, SPECS, WAREHOUSE_TABLES, DatasetSpec, gold_schema
from suite import inputs, sql
from suite.queries import RAW, register, write_mixed_landing

# --- profiles --------------------------------------------------------------------------------------------------------


def profile(df: DataFrame, layer: str, table: str) -> DataFrame:
    """For each column: rows, rows with a value, and different values (of doubles, which engines add up in their own
    order, the rounded sum instead)."""
    counts = [F.count("*").alias("rows")]
    for i, f in enumerate(df.schema.fields):
        double = isinstance(f.dataType, DoubleType)
        measure = F.round(F.sum(f.name)).cast("bigint") if double else F.count_distinct(f.name)
        counts += [F.count(f.name).alias(f"n{i}"), measure.alias(f"m{i}")]
    named = F.array(*(F.struct(F.lit(f.name).alias("column"), F.col(f"n{i}").alias("filled"), F.col(f"m{i}").alias("measure")) for i, f in enumerate(df.schema.fields)))
    return df.agg(*counts).select(F.lit(layer).alias("layer"), F.lit(table).alias("table"), "rows", F.inline(named))


def profile_sql(source: str, layer: str, table: str, kinds: dict[str, str]) -> str:
    def one(column: str, kind: str) -> str:
        measure = f"cast(round(sum({column})) as bigint)" if kind == "double" else f"count(distinct {column})"
        return (
            f"select '{layer}' as layer, '{table}' as \"table\", count(*) as \"rows\", '{column}' as \"column\", "
            f"count({column}) as filled, {measure} as measure from {source}"
        )

    return "\nunion all ".join(one(c, k) for c, k in kinds.items())


# --- the layers in SQL -----------------------------------------------------------------------------------------------

_STEPS = ("flagged", "staged", "fit", "winners", "accepted", "rejected")


def _chain(spec: DatasetSpec) -> str:
    """The dataset's steps under names of their own; landing files hold no broken lines here."""
    text = sql.silver_chain(spec).replace("_corrupt_record is not null", "false").removeprefix("with ")
    text = text.replace(", _corrupt_record, concat_ws", ", cast(null as varchar) as _corrupt_record, concat_ws", 1)
    return re.sub(rf"\b({'|'.join(_STEPS)})\b", rf"\1_{spec.name}", text)


SILVER = ",\n".join(_chain(spec) for spec in SPECS.values())


def silver_kinds(spec: DatasetSpec) -> dict[str, str]:
    return {**sql.kinds(spec), "event_date": "date"}


def rejected_kinds(spec: DatasetSpec) -> dict[str, str]:
    return {**sql.kinds(spec), "_corrupt_record": "string", "reason": "string"}


SILVER_PROFILES = "\nunion all ".join(
    profile_sql(f"accepted_{n}", "silver", n, silver_kinds(s)) + "\nunion all " + profile_sql(f"rejected_{n}", "quarantine", n, rejected_kinds(s))
    for n, s in SPECS.items()
)

_DOUBLE = "sum(amount)"


def _gold_sql(prefix: str = "") -> dict[str, str]:
    """The ten tables over ``users``, ``ev`` and ``tx``, or over expressions of those names with a prefix."""

    def over(text: str) -> str:
        for name, to in (("ev_np", "ev"), ("tx_p", "tx")):
            text = re.sub(rf"\b{name}\b", to, text)
        return re.sub(r"\b(users|ev|tx)\b", rf"{prefix}\1", text.replace(sql.EXACT, _DOUBLE))

    tables = {
        "dim_users": "select user_id, name, email, city, phone, cast(age as varchar) as age, updated_at from users",
        "dim_country": "select distinct country from ev where country is not null",
        "dim_status": "select distinct status from tx where status is not null",
        "dim_date": sql.DIM_DATE,
        "fact_events": sql.FACT_EVENTS,
        "fact_transactions": sql.FACT_TRANSACTIONS,
        "fact_user_activity": sql.ACTIVITY,
        "daily_revenue": sql.REVENUE,
        "daily_active_users": sql.ACTIVE,
        "user_ltv": sql.LTV,
    }
    return {name: over(text) for name, text in tables.items()}


def _kinds(table: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in gold_schema(table).fields}


def gold_profiles(layer: str, tables: Iterable[str], prefix: str = "") -> str:
    """Profiles of gold tables over the clean inputs, or over expressions of their names with a prefix."""
    found = _gold_sql(prefix)
    return "\nunion all ".join(profile_sql(f"({found[t]})", layer, t, _kinds(t)) for t in tables)


FROM_SILVER = f"""{SILVER},
    s_users as (select * from accepted_users), s_ev as (select event_id, user_id, ts, country from accepted_events),
    s_tx as (select tx_id, user_id, amount, status, created_at, delivered_at from accepted_transactions)"""

# --- queries ---------------------------------------------------------------------------------------------------------


def land_all(spark: SparkSession, sf_dir: str) -> Layout:
    layout = Layout.under(fresh_path(spark, "lake"))
    for name, spec in SPECS.items():
        write_mixed_landing(RAW[name](spark, sf_dir), f"{layout.landing}/{name}", spec)
    return layout


def silver_profiles(spark: SparkSession, layout: Layout) -> DataFrame:
    kept = (profile(read_silver(spark, f"{layout.silver}/{n}", s), "silver", n) for n, s in SPECS.items())
    refused = (
        profile(spark.read.parquet(f"{layout.quarantine}/{n}").select(*rejected_kinds(s)), "quarantine", n) for n, s in SPECS.items()
    )
    return union_by_name(*kept, *refused)


def gold_layer(spark: SparkSession, layout: Layout) -> DataFrame:
    return union_by_name(*(profile(read_gold(spark, layout.gold, t), "gold", t) for t in GOLD_DDL))


@register("job_silver", f"with {SILVER}\n{SILVER_PROFILES}")
def _(spark, sf_dir):
    layout = land_all(spark, sf_dir)
    silver_job(spark, layout)
    return silver_profiles(spark, layout)


_METRICS = [
    f"""select '{n}' as dataset, metric, case when metric like 'null_rate_%' then
        cast(((bad * 20000 + total) // (2 * total)) / 10000.0 as varchar) else cast(bad as varchar) end as value
        from ({re.sub(r'\bmeasured\b', f'accepted_{n}', sql.metrics(s, measured_columns(s)))})
    union all select '{n}', 'quarantined_rows', cast(count(*) as varchar) from rejected_{n}"""
    for n, s in SPECS.items()
]


@register("job_metrics", f"with {SILVER}\n" + "\nunion all ".join(_METRICS))
def _(spark, sf_dir):
    layout = land_all(spark, sf_dir)
    silver_job(spark, layout)
    text = [spark.read.option("header", True).schema("metric string, value string").csv(f"{layout.metrics}/{n}").withColumn("dataset", F.lit(n)) for n in SPECS]
    return union_by_name(*text)


@register("job_gold", f"with {FROM_SILVER}\n" + gold_profiles("gold", GOLD_DDL, "s_"))
def _(spark, sf_dir):
    """The gold job over silver tables as the silver plans make them."""
    layout = Layout.under(fresh_path(spark, "lake"))
    for name, spec in SPECS.items():
        raw = RAW[name](spark, sf_dir).drop("_corrupt_record")
        silver(raw, spec).good.write.partitionBy("event_date").parquet(f"{layout.silver}/{name}")
    gold_job(spark, layout)
    return gold_layer(spark, layout)


@register("job_all", f"with {FROM_SILVER}\n" + gold_profiles("gold", GOLD_DDL, "s_") + "\nunion all "
    + gold_profiles("warehouse", WAREHOUSE_TABLES, "s_") + f"\nunion all {SILVER_PROFILES}")
def _(spark, sf_dir):
    """Landing to warehouse with a ledger: stopped after silver, gone on with, and run again over the same files."""
    layout, database = land_all(spark, sf_dir), "orewash_all"
    ledger = f"{layout.landing}-ledger"
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
    stopped = Layout(layout.landing, layout.silver, layout.quarantine, layout.metrics, gold="nowhere://at-all")
    try:
        run_all(spark, stopped, database, ledger=ledger)
        raise AssertionError("a run without a place for gold must fail")
    except Exception as error:
        if "nowhere" not in str(error):
            raise
    for _ in range(2):
        run_all(spark, layout, database, fresh_path(spark, "warehouse"), ledger=ledger)
    loaded = (profile(spark.table(f"{database}.{t}"), "warehouse", t) for t in WAREHOUSE_TABLES)
    return union_by_name(gold_layer(spark, layout), *loaded, silver_profiles(spark, layout))


def write_all_gold(spark: SparkSession, sf_dir: str, base: str) -> None:
    events, users, transactions = inputs.events(spark, sf_dir), inputs.users(spark, sf_dir), inputs.transactions(spark, sf_dir)
    tables = {
        "dim_users": gold.dim_users(users),
        "dim_country": gold.dim_country(events),
        "dim_status": gold.dim_status(transactions),
        "dim_date": gold.dim_date(events, transactions),
        "fact_events": gold.fact_events(events, users),
        "fact_transactions": gold.fact_transactions(transactions, users),
        "fact_user_activity": gold.fact_user_activity(events, transactions, users),
        "daily_revenue": gold.daily_revenue(transactions),
        "daily_active_users": gold.daily_active_users(events, transactions),
        "user_ltv": gold.user_ltv(events, transactions),
    }
    for table, df in tables.items():
        write_gold(df, base, table, compact=table.startswith("fact"))
    require_outputs(spark, [f"{base}/{t}" for t in tables])


@register("gold_write_read_all", gold_profiles("gold", GOLD_DDL))
def _(spark, sf_dir):
    base = fresh_path(spark, "gold")
    write_all_gold(spark, sf_dir, base)
    return union_by_name(*(profile(read_gold(spark, base, t), "gold", t) for t in GOLD_DDL))


@register("warehouse_load_all", gold_profiles("warehouse", WAREHOUSE_TABLES))
def _(spark, sf_dir):
    """All seven tables, published twice; a load that fails on the sixth table in between changes nothing."""
    base, database = fresh_path(spark, "gold"), "orewash_seven"
    write_all_gold(spark, sf_dir, base)
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
    location = fresh_path(spark, "warehouse")
    load_warehouse(spark, base, database, location)
    broken = fresh_path(spark, "gold")
    for table in WAREHOUSE_TABLES[:5]:
        read_gold(spark, base, table).limit(1).write.parquet(f"{broken}/{table}")
    try:
        load_warehouse(spark, broken, database, location)
        raise AssertionError("a load without its sixth table must fail")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    load_warehouse(spark, base, database, location)
    return union_by_name(*(profile(spark.table(f"{database}.{t}"), "warehouse", t) for t in WAREHOUSE_TABLES))

