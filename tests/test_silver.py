"""The dataset pipeline: contests, conservation of rows, and the job around it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orewash import EVENTS, SPECS, TRANSACTIONS, USERS
from orewash.operators.quality import EmptyStepError
from orewash.plans.jobs import Layout, SilverCounts, gold_job, run_all, silver_dataset, silver_job
from orewash.plans.silver import contested, refused, silver, staged
from orewash.sinks.files import (
    MissingOutputError, append_quarantine, read_gold, require_outputs, write_gold, write_silver, write_undated,
)
from orewash.sinks.warehouse import create_tables, load_table, require_loaded
from orewash.sources.silver import read_silver
from orewash.specs import CORRUPT, GOLD_DDL, WAREHOUSE_TABLES, gold_schema
from suite import inputs
from suite.queries import RAW, write_mixed_landing

SF = "/root/testdata/sf0.001"


def ids(df, column):
    return sorted(r[0] for r in df.select(column).collect())


def test_faulty_latest_row_keeps_older_ones_out(spark):
    raw = spark.createDataFrame(
        [("1", "u", "5", "2024-01-01"), ("1", "u", "-5", "2024-01-02"),  # latest is negative: rejected, no way back
         ("2", "u", "-5", "2024-01-01"), ("2", "u", "5", "2024-01-02"),  # latest is fine
         ("3", "u", "5", "2024-01-01"), ("3", None, "6", "2024-01-02"),  # structural fault: never competes
         ("4", " null ", "5", "2024-01-01"),  # an unknown user is no fault in a transaction
         ("null", "u", "5", "2024-01-01"), ("N/A", "u", "5", "2024-01-01"),  # lost keys do not compete with each other
         ("6", "u", "5", "junk")],
        "tx_id string, user_id string, amount string, created_at string",
    )
    good, rejected = silver(raw, TRANSACTIONS)
    assert ids(good, "tx_id") == ["2", "3", "4"]
    assert sorted((r["tx_id"] or "", r["reason"]) for r in rejected.collect()) == [
        ("", "missing:tx_id"), ("", "missing:tx_id"), ("1", "negative:amount"), ("3", "missing:user_id"),
        ("6", "missing:created_at"),
    ]


def test_users_merge_all_versions(spark):
    raw = spark.createDataFrame(
        [("u", "a@x", "2024-01-01"), ("u", "N/A", "2024-01-03"), ("v", "b@x", "junk"), (None, "c@x", "2024-01-01")],
        "user_id string, email string, updated_at string",
    )
    good, rejected = silver(raw, USERS)
    assert sorted((r.user_id, r.email, r.event_date) for r in good.collect()) == [
        ("u", None, dt.date(2024, 1, 3)), ("v", "b@x", dt.date(1900, 1, 1))
    ]
    assert [r["reason"] for r in rejected.collect()] == ["missing:user_id"]
    partial = silver(raw, USERS, partial=True).good
    assert sorted((r.user_id, r.email) for r in partial.collect()) == [("u", "a@x"), ("v", "b@x")]


@pytest.mark.parametrize("name", list(SPECS))
def test_no_row_vanishes(spark, name):
    spec, raw = SPECS[name], RAW[name](spark, SF)
    rows = staged(raw, spec)
    winners = contested(rows, spec)
    fit = rows.where("_refused = 0").count()
    duplicates = fit - winners.count()
    accepted = winners.where("_refused = 0").count()
    rejected = refused(rows, winners, spec).count()
    assert accepted + rejected + duplicates == raw.count() and rejected > 0
    good = silver(raw, spec).good
    assert good.columns == [*spec.columns, "event_date"] and good.where("event_date is null").count() == 0
    assert good.count() == good.select(spec.key).distinct().count()


@pytest.fixture(scope="module")
def landing(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    for name, spec in SPECS.items():
        write_mixed_landing(RAW[name](spark, SF), f"{root}/landing/{name}", spec)
        with open(f"{root}/landing/{name}/zz.json", "w") as file:
            file.write("not json\n")
    return root


@pytest.fixture(scope="module")
def done(spark, landing):
    return run_all(spark, Layout.under(landing), "lake_gold", f"{landing}/warehouse")


def test_landing_to_warehouse(spark, landing, done):
    layout = Layout.under(landing)
    for name, spec in SPECS.items():
        count = done[name]
        assert isinstance(count, SilverCounts)
        assert count.loaded == RAW[name](spark, SF).count() + 1
        assert count.loaded == count.accepted + count.rejected + count.duplicates

        # Files carry no corrupt-line column, so the run compared with goes without it; the one bad line is extra.
        raw = RAW[name](spark, SF)
        raw = raw.drop(CORRUPT) if CORRUPT in raw.columns else raw
        lazy = silver(raw, spec)
        written = read_silver(spark, f"{layout.silver}/{name}", spec)
        # CSV cannot tell an empty text from none; both are null after cleaning.
        assert written.exceptAll(lazy.good).count() == 0 and lazy.good.exceptAll(written).count() == 0
        bad = spark.read.parquet(f"{layout.quarantine}/{name}")
        assert bad.count() == count.rejected == lazy.rejected.count() + 1
        assert [r[CORRUPT] for r in bad.where(f"reason like 'corrupt%'").collect()] == ["not json"]

        stored = spark.read.option("header", True).csv(f"{layout.metrics}/{name}")
        metrics = {r["metric"]: r["value"] for r in stored.collect()}
        assert metrics["total_rows"] == str(count.accepted) and metrics["quarantined_rows"] == str(count.rejected)
        assert metrics[f"dq_not_null_{spec.key}"] == "0" and ("dq_unique_user_id" in metrics) == (name == "users")

    for table in GOLD_DDL:
        out = spark.read.parquet(f"{layout.gold}/{table}")
        assert out.schema.simpleString() == gold_schema(table).simpleString() and out.count() > 0
    for table in WAREHOUSE_TABLES:
        assert spark.table(f"lake_gold.{table}").count() == read_gold(spark, layout.gold, table).count()


def test_gold_invariants(spark, landing, done):
    layout = Layout.under(landing)
    gold = {t: read_gold(spark, layout.gold, t) for t in GOLD_DDL}
    revenue = gold["daily_revenue"].agg(F.sum("total_revenue")).first()[0]
    assert gold["user_ltv"].agg(F.sum("ltv")).first()[0] == pytest.approx(revenue)
    assert gold["fact_user_activity"].agg(F.sum("total_revenue")).first()[0] == pytest.approx(revenue)
    wrong = gold["daily_active_users"].where(
        "total_active_users > event_active_users + tx_active_users"
        " or total_active_users < greatest(event_active_users, tx_active_users)"
    )
    assert wrong.count() == 0
    assert gold["fact_events"].count() == done["events"].accepted
    assert gold["fact_transactions"].count() == done["transactions"].accepted


def test_gold_again_with_heavy_users_is_the_same(spark, landing, done):
    layout = Layout.under(landing)
    before = read_gold(spark, layout.gold, "fact_transactions").collect()
    gold_job(spark, layout, tables=["fact_transactions"], heavy=[None, "7", "8"])
    after = read_gold(spark, layout.gold, "fact_transactions").collect()
    assert sorted(before, key=str) == sorted(after, key=str)


def test_pruned_silver_scan(spark, landing, done):
    path = Layout.under(landing).silver + "/events"
    some = read_silver(spark, path, EVENTS, since=dt.date(2024, 1, 10), until=dt.date(2024, 1, 12))
    assert {r[0] for r in some.select("event_date").distinct().collect()} <= {dt.date(2024, 1, d) for d in (10, 11, 12)}
    assert some.count() > 0
    assert "PartitionFilters: [isnotnull(event_date" in some._jdf.queryExecution().executedPlan().toString()


def test_stringly_and_damaged_options(spark, landing, done, tmp_path):
    root = str(tmp_path)
    write_mixed_landing(inputs.raw_users(spark, SF), f"{root}/landing/users", USERS)
    (tmp_path / "landing" / "users" / "zz.csv.gz").write_bytes(b"not gzip at all")
    count = silver_dataset(spark, Layout.under(root), USERS, skip_damaged=True, stringly=True)
    assert count.accepted == done["users"].accepted
    stored = spark.read.parquet(f"{root}/silver/users")
    assert set(dict(stored.drop("event_date").dtypes).values()) == {"string"}
    typed = read_silver(spark, f"{root}/silver/users", USERS, stringly=True)
    assert typed.exceptAll(read_silver(spark, f"{landing}/silver/users", USERS)).count() == 0
    (turned_away,) = spark.read.parquet(f"{root}/quarantine/files/users").collect()
    assert turned_away["path"].endswith("zz.csv.gz") and turned_away["verdict"] == "unreadable"


def test_files_turned_away_by_name_are_not_read(spark, tmp_path):
    folder = tmp_path / "landing" / "users"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('{"user_id":"1"}\n')
    (folder / "b.bin").write_text("junk")
    spark.sql("select '2' user_id").write.parquet(str(tmp_path / "p"))
    (file,) = (tmp_path / "p").glob("*.parquet")
    file.rename(folder / "export.parquet")
    assert silver_dataset(spark, Layout.under(str(tmp_path)), USERS).accepted == 1
    turned_away = spark.read.parquet(f"{tmp_path}/quarantine/files/users")
    assert sorted((r["path"].rsplit("/", 1)[1], r["reason"]) for r in turned_away.collect()) == [
        ("b.bin", "extension not accepted"), ("export.parquet", "parquet without part-")
    ]


def test_empty_steps_stop_the_job(spark, tmp_path):
    with pytest.raises(EmptyStepError, match="'load' of dataset 'events'"):
        silver_job(spark, Layout.under(str(tmp_path)))
    folder = tmp_path / "landing" / "events"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('{"event_id":"1"}\n')
    with pytest.raises(EmptyStepError, match="'normalize'"):
        silver_dataset(spark, Layout.under(str(tmp_path)), EVENTS)
    (folder / "a.json").write_text('{"event_id":"1","user_id":"u","ts":"junk"}\n')
    with pytest.raises(EmptyStepError, match="'quarantine'"):
        silver_dataset(spark, Layout.under(str(tmp_path)), EVENTS)
    kept = spark.read.parquet(f"{tmp_path}/quarantine/events")
    assert ids(kept, "reason") == ["missing:ts", "missing:user_id"]  # both failed runs left their rows behind
    (folder / "a.json").write_text("\n \n")
    with pytest.raises(EmptyStepError, match="'load'"):
        silver_dataset(spark, Layout.under(str(tmp_path)), EVENTS)


def test_output_checks(spark, tmp_path):
    full, empty = str(tmp_path / "full"), str(tmp_path / "empty")
    write_undated(spark.sql("select 1 a, null b"), full)
    write_undated(spark.sql("select 1 a").limit(0), empty)
    require_outputs(spark, [full])
    with pytest.raises(MissingOutputError) as error:
        require_outputs(spark, [full, empty, str(tmp_path / "absent")])
    assert "empty" in str(error.value) and "absent" in str(error.value) and "full" not in str(error.value)


def test_warehouse_reload_replaces_and_checks(spark, tmp_path):
    create_tables(spark, "small_gold", str(tmp_path / "db"), ["daily_revenue", "user_ltv"])
    create_tables(spark, "small_gold", str(tmp_path / "db"), ["daily_revenue", "user_ltv"])
    df = spark.sql("select 5 delivered_count, date'2024-01-01' date, 7 transaction_count, 1 odd")
    for _ in range(2):
        load_table(df, "small_gold", "daily_revenue")
    row = spark.table("small_gold.daily_revenue").collect()
    assert len(row) == 1 and row[0]["delivered_count"] == 5 and row[0]["total_revenue"] is None
    with pytest.raises(MissingOutputError, match="user_ltv"):
        require_loaded(spark, "small_gold", ["daily_revenue", "user_ltv"])


def test_compact_gold(spark, tmp_path):
    df = spark.range(1000).repartition(40).select(F.col("id").cast("string").alias("country"))
    write_gold(df, str(tmp_path), "dim_country", compact=True)
    assert len(list((tmp_path / "dim_country").glob("part-*"))) < 40
    days = spark.sql("select date'2024-01-01' date, id transaction_count from range(3)")
    write_gold(days, str(tmp_path), "daily_revenue", partition_by="date")
    assert [p.name for p in (tmp_path / "daily_revenue").glob("date=*")] == ["date=2024-01-01"]
    assert read_gold(spark, str(tmp_path), "daily_revenue").count() == 3


def test_sinks_replace_under_dynamic_mode_and_by_run(spark, tmp_path):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        for day in ("2024-01-01", "2024-01-02"):
            good, _ = silver(spark.sql(f"select '1' user_id, 'n' name, '{day}' updated_at"), USERS)
            write_silver(good, f"{tmp_path}/users", USERS)
            days = spark.sql(f"select date'{day}' date, 1L transaction_count")
            write_gold(days, str(tmp_path), "daily_revenue", partition_by="date")
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert read_silver(spark, f"{tmp_path}/users", USERS).count() == 1
    assert read_gold(spark, str(tmp_path), "daily_revenue").count() == 1
    for run in ("a", "b", "b"):
        append_quarantine(spark.sql("select '1' user_id, 'r' reason"), f"{tmp_path}/q", USERS, run)
    assert sorted(r["run_id"] for r in spark.read.parquet(f"{tmp_path}/q/users").collect()) == ["a", "b"]


def test_a_bare_time_is_no_date(spark):
    good, rejected = silver(spark.sql("select 'e' event_id, 'u' user_id, '12:30' ts"), EVENTS)
    assert good.count() == 0 and [r["reason"] for r in rejected.collect()] == ["missing:ts"]
