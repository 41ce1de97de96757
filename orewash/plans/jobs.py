"""The jobs: landing to silver, silver to gold, gold to warehouse."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orewash.operators.columns import voids_to_text
from orewash.operators.dedupe import union_by_name
from orewash.operators.joins import heavy_keys
from orewash.operators.quality import EmptyStepError, as_metrics, check_not_null, measures, require_rows
from orewash.operators.split import REFUSED
from orewash.plans import gold, silver
from orewash.plans.ledger import Ledger
from orewash.scratch import written
from orewash.sinks.files import (
    append_quarantine,
    read_gold,
    require_outputs,
    write_gold,
    write_metrics,
    write_silver,
)
from orewash.sinks.warehouse import load_warehouse, require_loaded
from orewash.sources.audit import landing_audit, routed
from orewash.sources.files import file_kind
from orewash.sources.landing import drift_counts, landing_frames
from orewash.sources.silver import read_silver, read_silver_tables
from orewash.specs import EVENTS, GOLD_DDL, GOLD_MUST_EXIST, SPECS, TRANSACTIONS, USERS, WAREHOUSE_TABLES, DatasetSpec

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Layout:
    """Where the layers live; each dataset or table is a folder below its layer."""

    landing: str
    silver: str
    quarantine: str
    metrics: str
    gold: str

    @classmethod
    def under(cls, root: str) -> Layout:
        return cls(*(f"{root}/{layer}" for layer in ("landing", "silver", "quarantine", "metrics", "gold")))


@dataclass(frozen=True)
class SilverCounts:
    """How many rows a silver run read, refused, replaced by later ones, and kept."""

    loaded: int
    rejected: int
    duplicates: int
    accepted: int


class UnbalancedError(RuntimeError):
    """The rows that a run read are not those that it kept, replaced and rejected."""


def _by_refused(df: DataFrame) -> dict[int, int]:
    return {r[REFUSED]: r["count"] for r in df.groupBy(REFUSED).count().collect()}


def admitted_files(spark: SparkSession, layout: Layout, spec: DatasetSpec, probe: bool = False) -> str | list[str]:
    """What to read for a dataset: its landing folder, or a list of files if some in it are not to be read.

    Files turned away by the landing audit are listed, with the reason, under ``quarantine/files/<dataset>``.
    """
    folder = f"{layout.landing}/{spec.name}"
    valid, turned_away = routed(written(landing_audit(spark, folder, spec.name, probe), f"audit-{spec.name}"))
    turned_away.write.mode("overwrite").parquet(f"{layout.quarantine}/files/{spec.name}")
    stray = turned_away.where(file_kind(F.col("path")).isNotNull() & (F.col("length") > 0))
    if stray.isEmpty():
        return folder
    return [r["path"] for r in valid.select("path").collect()]  # names, like Spark's own file index


def silver_dataset(
    spark: SparkSession,
    layout: Layout,
    spec: DatasetSpec,
    partial: bool = False,
    one_header: bool = False,
    skip_damaged: bool = False,
    stringly: bool = False,
    run_id: str | None = None,
    flag_uncastable: bool = False,
    drift: bool = False,
) -> SilverCounts:
    """One dataset from its landing folder to silver, quarantine and metrics; stops at the first empty step.

    Text is parsed once and kept as a columnar table in the shared folder, partitioned by fate; so is the outcome
    of the contest for keys. Silver, quarantine and the counts are read from those, and the metrics from silver as
    written: exact also when executors were lost on the way. ``skip_damaged`` turns away, whole, files that
    cannot be read to their end instead of failing on them. ``run_id`` names the run in quarantine (by default, anew).
    ``flag_uncastable`` also refuses rows that hold a value which cannot be read as its type. ``drift`` keeps what columns
    the files lack, or have beyond the canonical ones, under ``metrics/drift``; that reads their names once more.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    run_id = run_id or uuid.uuid4().hex
    admitted = admitted_files(spark, layout, spec, probe=skip_damaged)
    if drift:
        found = drift_counts(spark, admitted, spec)
        found.write.mode("overwrite").parquet(f"{layout.metrics}/drift/{spec.name}/run_id={run_id}")
    frames = landing_frames(spark, admitted, spec, one_header)  # what is damaged was turned away whole
    require_rows({"load": len(frames)}, spec.name)

    rows = union_by_name(*(silver.staged(frame, spec, flag_uncastable) for frame in frames))
    rows = written(rows, f"staged-{spec.name}", REFUSED)
    winners = silver.contested(rows, spec)
    if not spec.snapshot:
        winners = written(winners, f"winners-{spec.name}", REFUSED)
    before, after = _by_refused(rows), _by_refused(winners)
    loaded, fit, fine = sum(before.values()), before.get(0, 0), after.get(0, 0)
    rejected = loaded - fit + after.get(1, 0)
    contestants = sum(after.values())

    def set_aside() -> None:
        if rejected:
            append_quarantine(silver.refused(rows, winners, spec), layout.quarantine, spec, run_id)

    try:
        require_rows({"load": loaded, "normalize": fit, "dedupe": sum(after.values()), "quarantine": fine}, spec.name)
    except EmptyStepError:
        set_aside()  # the rows that explain the failure
        raise
    write_silver(silver.finished(winners, spec, partial), f"{layout.silver}/{spec.name}", spec, stringly)

    kept = read_silver(spark, f"{layout.silver}/{spec.name}", spec, stringly=stringly)
    measured = measures(kept.select(*silver.measured_columns(spec)), spec)
    extra = spark.range(1).select(F.lit("quarantined_rows").alias("metric"), F.lit(str(rejected)).alias("value"))
    write_metrics(as_metrics(measured).union(extra), layout.metrics, spec)
    set_aside()  # last, because it adds: a run that fails earlier can be repeated

    accepted = kept.count()
    require_rows({"schema_lock": accepted}, spec.name)
    # Users are merged after the contest, all others are decided by it.
    duplicates = fit - contestants + (fine - accepted if spec.snapshot else 0)
    if loaded != rejected + duplicates + accepted:
        raise UnbalancedError(f"{spec.name}: read {loaded}, rejected {rejected}, replaced {duplicates}, kept {accepted}")
    return SilverCounts(loaded, rejected, duplicates, accepted)


def silver_job(spark: SparkSession, layout: Layout, **options) -> dict[str, SilverCounts]:
    """All datasets in order; the first failure stops the job."""
    return {name: silver_dataset(spark, layout, spec, **options) for name, spec in SPECS.items()}


def gold_job(
    spark: SparkSession,
    layout: Layout,
    tables: Iterable[str] = tuple(GOLD_DDL),
    heavy: Sequence | None = None,
    stringly: bool = False,
) -> None:
    """All gold tables from silver.

    Silver is scanned once for a per-user-and-day table in the shared folder, which all the marts come from. The two
    wide facts follow, when ``user_ltv`` can tell which users are too heavy for a plain join (unless ``heavy`` does).
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    frames = {n: voids_to_text(df) for n, df in read_silver_tables(spark, layout.silver, stringly).items()}
    events, users, transactions = (frames[s.name] for s in (EVENTS, USERS, TRANSACTIONS))
    bad = check_not_null(events, EVENTS.key).first()["bad"]
    if bad:
        log.warning("%d events have no %s; gold is built all the same", bad, EVENTS.key)

    wanted = set(tables)
    from_days = {
        "dim_date": gold.dates_of,
        "fact_user_activity": lambda days: gold.activity_of(days, users),
        "daily_revenue": gold.revenue_of,
        "daily_active_users": gold.active_of,
        "user_ltv": gold.ltv_of,
    }
    if wanted & set(from_days):
        days = written(gold.user_days(events, transactions), "user-days")
        for table, build in from_days.items():
            if table in wanted:
                write_gold(build(days), layout.gold, table)

    if heavy is None and wanted & {"fact_events", "fact_transactions"}:
        if "user_ltv" in wanted:
            per_user = read_gold(spark, layout.gold, "user_ltv")
        else:
            per_user = written(gold.user_ltv(events, transactions), "user-ltv")
        heavy = heavy_keys(per_user, "user_id", ["event_count", "transaction_count"])
    others = {
        "dim_users": lambda: gold.dim_users(users),
        "dim_country": lambda: gold.dim_country(events),
        "dim_status": lambda: gold.dim_status(transactions),
        "fact_events": lambda: gold.fact_events(events, users, heavy),
        "fact_transactions": lambda: gold.fact_transactions(transactions, users, heavy),
    }
    for table, build in others.items():
        if table in wanted:
            write_gold(build(), layout.gold, table)


def run_all(
    spark: SparkSession, layout: Layout, database: str, location: str | None = None, ledger: str | None = None, **options
) -> dict[str, SilverCounts]:
    """Landing to warehouse; every layer is checked to be there before the next one starts.

    With a ``ledger`` (a folder), finished steps are noted there, and a run passes over those that are done for the files
    as they are: one that was stopped goes on where it stopped, and one that finds nothing new does nothing.
    """
    book = Ledger(spark, ledger) if ledger else None

    def step(name: str, reads: list[str], writes: list[str], work: Callable[[], dict]) -> dict:
        return book.once(name, reads, writes, options, work) if book else work()

    counts = {}
    for name, spec in SPECS.items():
        done = step(
            f"silver/{name}",
            [f"{layout.landing}/{name}"],
            [f"{layout.silver}/{name}", f"{layout.metrics}/{name}"],
            lambda spec=spec: asdict(silver_dataset(spark, layout, spec, **options)),
        )
        counts[name] = SilverCounts(**done)
    tables = [f"{layout.silver}/{name}" for name in SPECS]
    require_outputs(spark, tables)
    build = lambda: gold_job(spark, layout, stringly=options.get("stringly", False)) or {}
    step("gold", tables, [f"{layout.gold}/{table}" for table in GOLD_DDL], build)
    require_outputs(spark, [f"{layout.gold}/{table}" for table in GOLD_MUST_EXIST])
    load = lambda: load_warehouse(spark, layout.gold, database, location) or {}
    step(f"load/{database}", [f"{layout.gold}/{table}" for table in WAREHOUSE_TABLES], [], load)
    require_loaded(spark, database)
    return counts
