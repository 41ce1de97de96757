"""Runs that go on where they stopped, loads that are published together, drift that is kept."""

import json

import pytest
from pyspark.sql import functions as F

from orewash import EVENTS, TRANSACTIONS
from orewash.__main__ import main
from orewash.plans import jobs
from orewash.plans.jobs import Layout, run_all, silver_dataset
from orewash.plans.ledger import Ledger, fingerprint
from orewash.plans.silver import staged
from orewash.sinks import warehouse
from orewash.sinks.files import write_gold
from orewash.specs import GOLD_DDL, WAREHOUSE_TABLES
from suite import inputs

SF = "/root/testdata/sf0.001"


def put(base, dataset, name, *records):
    folder = base / "landing" / dataset
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records))


def land(base):
    put(base, "users", "a.json", {"user_id": "u", "city": "Rome", "updated_at": "2024-01-01"})
    put(base, "events", "a.json", {"event_id": "1", "user_id": "u", "ts": "2024-01-02", "country": "IT", "odd": 5})
    put(base, "transactions", "a.json", {"tx_id": "1", "user_id": "u", "created_at": "2024-01-02", "amount": "7", "status": "delivered"})
    return Layout.under(str(base))


def ltv(spark, database):
    return spark.table(f"{database}.user_ltv").first()["ltv"]


def test_a_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    layout, ledger, done = land(tmp_path), f"{tmp_path}/ledger", []
    real = {n: getattr(jobs, n) for n in ("silver_dataset", "gold_job", "load_warehouse")}
    for name, work in real.items():
        monkeypatch.setattr(jobs, name, lambda *a, _name=name, _work=work, **k: (done.append(_name if _name != "silver_dataset" else a[2].name), _work(*a, **k))[1])
    spark.sql("DROP DATABASE IF EXISTS led CASCADE")

    def run():
        done.clear()
        return run_all(spark, layout, "led", f"{tmp_path}/db", ledger=ledger)

    with monkeypatch.context() as broken:
        broken.setattr(jobs, "gold_job", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run()
    assert done == ["events", "transactions", "users"]
    counts = run()
    assert done == ["gold_job", "load_warehouse"] and counts["events"].accepted == 1 and ltv(spark, "led") == 7
    assert run() == counts and done == []
    put(tmp_path, "transactions", "b.json", {"tx_id": "2", "user_id": "u", "created_at": "2024-01-03", "amount": "3", "status": "x"})
    assert run()["transactions"].accepted == 2 and done == ["transactions", "gold_job", "load_warehouse"] and ltv(spark, "led") == 10
    for file in (tmp_path / "gold" / "user_ltv").glob("part-*"):
        file.unlink()
    run()
    assert done == ["gold_job", "load_warehouse"] and ltv(spark, "led") == 10


def test_a_step_is_done_again_for_other_options_and_files(spark, tmp_path):
    ledger, seen = Ledger(spark, f"{tmp_path}/ledger"), []
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("1")

    def once(**options):
        return ledger.once("s", [f"{tmp_path}/in"], [f"{tmp_path}/out"], options, lambda: seen.append(1) or {"n": len(seen)})

    assert [once(), once(), once(x=1), once(x=1), once()] == [{"n": 1}, {"n": 1}, {"n": 2}, {"n": 2}, {"n": 3}]
    before = fingerprint(spark, [f"{tmp_path}/in", f"{tmp_path}/absent"])
    (tmp_path / "in" / "a").write_text("22")
    assert once() == {"n": 4} and fingerprint(spark, [f"{tmp_path}/in", f"{tmp_path}/absent"]) != before


def test_a_failed_load_leaves_all_tables_as_they_were(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "gold")
    for table in GOLD_DDL:
        write_gold(spark.range(3).select(F.col("id").cast("string").alias(GOLD_DDL[table].split()[0])), base, table)
    spark.sql("DROP DATABASE IF EXISTS pub CASCADE")
    warehouse.load_warehouse(spark, base, "pub", str(tmp_path / "db"))
    for table in GOLD_DDL:
        write_gold(spark.range(5).select(F.col("id").cast("string").alias(GOLD_DDL[table].split()[0])), base, table)
    real_load, real_sql = warehouse.load_table, type(spark).sql

    def counts():
        return {spark.table(f"pub.{t}").count() for t in WAREHOUSE_TABLES}

    def sixth(df, database, table, into=None):
        if table == WAREHOUSE_TABLES[5]:
            raise RuntimeError("no such luck")
        return real_load(df, database, table, into)

    with monkeypatch.context() as broken:
        broken.setattr(warehouse, "load_table", sixth)
        with pytest.raises(RuntimeError):
            warehouse.load_warehouse(spark, base, "pub")
    assert counts() == {3}
    with monkeypatch.context() as broken:  # also when the names are being changed
        broken.setattr(type(spark), "sql", lambda self, text, *a, **k: 1 / 0 if f"{WAREHOUSE_TABLES[5]}__next RENAME" in text else real_sql(self, text, *a, **k))
        with pytest.raises(ZeroDivisionError):
            warehouse.load_warehouse(spark, base, "pub")
    assert counts() == {3}
    warehouse.load_warehouse(spark, base, "pub")
    assert counts() == {5} and spark.sql("SHOW TABLES IN pub").count() == len(WAREHOUSE_TABLES)


def test_drift_and_uncastable_values_from_the_command_line(spark, tmp_path):
    land(tmp_path)
    put(tmp_path, "transactions", "b.json", {"tx_id": "2", "user_id": "u", "created_at": "2024-01-02", "amount": "much"})
    main(["silver", "--root", str(tmp_path), "--drift", "--flag-uncastable"])
    kept = {(r["column"], r["status"], r["type"], r["rows"]) for r in spark.read.parquet(f"{tmp_path}/metrics/drift/events").collect()}
    assert {("odd", "extra", "bigint", 1), ("ts", "known", "string", 1), ("age", "missing", None, 0)} <= kept
    refused = spark.read.parquet(f"{tmp_path}/quarantine/transactions").collect()
    assert [(r["tx_id"], r["reason"]) for r in refused] == [("2", "uncastable:amount")]


def test_a_run_without_its_landing_files_fails_by_name(spark, tmp_path):
    with pytest.raises(jobs.EmptyStepError, match="'load' of dataset 'events'"):
        silver_dataset(spark, Layout.under(str(tmp_path)), EVENTS)


@pytest.mark.parametrize("spec, raw", [(EVENTS, inputs.raw_events), (TRANSACTIONS, inputs.raw_transactions)])
def test_staging_is_compiled(spark, spec, raw):
    """The JVM compiles no generated method of 8000 bytes or more."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else there is no code before the plan has run
    try:
        text = staged(raw(spark, SF), spec)._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(text.apply(i)._3().maxMethodCodeSize()) for i in range(text.size())]
    assert sizes and max(sizes) < 7500
