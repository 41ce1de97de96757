"""Every registered query against its SQL twin in another engine."""

import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

import __spark_entry__ as entry
from orewash import EVENTS
from orewash.sources.audit import landing_audit
from orewash.sources.landing import read_landing
from suite import inputs
from suite.queries import write_mixed_landing

SF = "/root/testdata/sf0.001"
QUERIES = {name: query for name, (query, _) in entry.REGISTRY.items()}
TWINS = {name: twin for name, (_, twin) in entry.REGISTRY.items() if twin}


@pytest.fixture(scope="module")
def sql():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_agrees_with_sql(spark, sql, name):
    assert difference(QUERIES[name](spark, SF), sql, TWINS[name]) is None


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_landing_audit_accepts_what_was_written(spark, tmp_path):
    write_mixed_landing(inputs.raw_events(spark, SF), str(tmp_path), EVENTS)
    rows = landing_audit(spark, str(tmp_path), "events", probe=True).collect()
    assert {r["format"] for r in rows} == {"parquet", "json", "json.gz", "csv", "csv.gz", "txt"}
    assert {r["verdict"] for r in rows} == {"valid"}


def test_landing_audit_counts_the_files_of_every_verdict(spark):
    rows = {(r["format"], r["verdict"]): r["files"] for r in QUERIES["landing_audit"](spark, SF).collect()}
    assert len(rows) == 7 and None not in rows.values()
    assert all(rows[form, "valid"] > 1 for form in ("json", "csv", "parquet"))


def test_mixed_landing_works_its_rows_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(60).select(F.col("id").cast("string").alias("event_id"), F.lit("x").alias("message"))
    write_mixed_landing(rows.mapInArrow(count, rows.schema), str(tmp_path / "events"), EVENTS)
    assert seen.value == 60
    assert read_landing(spark, str(tmp_path / "events"), EVENTS).count() == 60


def test_entry(spark):
    assert entry.entry(spark).count() > 0
