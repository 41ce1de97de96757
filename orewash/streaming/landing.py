"""Silver that grows with its landing folder.

The stream carries file names, not rows: each micro-batch learns which files have arrived and puts them through the
batch readers and rules. The store it maintains holds the winner of every key, faulty winners included, because a faulty
newest row must keep older ones out also when they arrive later. Silver and its rejected rows are views on the store.

What has been absorbed is known by the store itself (see ``streaming.store``), not by a stream's checkpoint. Whatever
the checkpoint says, a file counts once, and a batch that was cut short counts not at all until it is repeated. A file
that has been rewritten or deleted takes the store back to the files: all that there are now are put through the rules
again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType, TimestampType

from orewash.operators.columns import locked, with_event_date
from orewash.operators.dedupe import latest_per_key, union_by_name
from orewash.operators.quarantine import row_rules
from orewash.operators.scd import merge_histories, with_times
from orewash.operators.split import FAULTS, REFUSED, by_faults, judged
from orewash.plans.silver import staged
from orewash.scratch import written
from orewash.sources.files import listing
from orewash.sources.landing import landing_frames
from orewash.specs import CORRUPT, UNKNOWN_DATE, DatasetSpec
from orewash.streaming.store import Store, Version

_FILES = "path string, modificationTime timestamp, length bigint, content binary"
_IDENTITY = ["path", "length", "modificationTime"]


def _store_schema(spec: DatasetSpec, partial: bool = False) -> StructType:
    fate = [StructField(FAULTS, StringType()), StructField(REFUSED, IntegerType())]
    times = [StructField(f"{c}_at", TimestampType()) for c in spec.snapshot] if partial else []
    fields = [*spec.schema.fields, *times, *fate, StructField("event_date", DateType())]
    return StructType(fields)


def _contenders(rows: DataFrame, spec: DatasetSpec, partial: bool = False) -> DataFrame:
    """Staged rows that compete for their key, in the layout of the store."""
    fit = rows.where(F.col(REFUSED) == 0).drop(CORRUPT, FAULTS, REFUSED)
    if spec.snapshot:
        unknown = F.lit(UNKNOWN_DATE).cast("timestamp")
        blank = {f.name: F.lit(None).cast(f.dataType) for f in spec.schema.fields
                 if f.name not in (spec.key, spec.order_by, *spec.snapshot)}
        fit = fit.withColumns({spec.order_by: F.coalesce(spec.order_by, unknown), **blank})
    fit = with_event_date(judged(fit, row_rules({c: F.col(c) for c in fit.columns}, spec)))
    if partial:
        fit = with_times(fit, spec)
    return fit.select(*_store_schema(spec, partial).fieldNames())


def _contest(rows: DataFrame, spec: DatasetSpec, partial: bool) -> DataFrame:
    """One row per key: the newest one, or for ``partial`` the newest value of each attribute."""
    if not partial:
        return latest_per_key(rows, spec.key, spec.order_by)
    merged = merge_histories(rows, spec)
    blank = {f.name: F.lit(None).cast(f.dataType) for f in spec.schema.fields if f.name not in merged.columns}
    fate = {FAULTS: F.lit(""), REFUSED: F.lit(0)}  # faulty rows of a history take no part in it
    schema = _store_schema(spec, partial)
    return with_event_date(merged.withColumns({**blank, **fate})).select(*schema.fieldNames())


def _absorbed(store: Store, before: Version, paths: Sequence[str], spec: DatasetSpec, partial: bool = False) -> Version:
    """The version after the rows of ``paths`` have been added to those of ``before``; not published yet."""
    spark, name = store.spark, uuid.uuid4().hex
    after = replace(before, number=before.number + 1, id=name)
    frames = landing_frames(spark, paths, spec) if paths else []
    if not frames:
        return after
    rows = written(union_by_name(*(staged(f, spec) for f in frames)), f"arrived-{spec.name}", REFUSED)
    early = by_faults(rows).rejected
    if not early.isEmpty():
        after = replace(after, refused=(*after.refused, store.write_part(early, "refused")))

    new, schema = _contenders(rows, spec, partial), _store_schema(spec, partial)
    old, touched = store.winners(before, schema), []
    if old is not None:
        shared = old.join(new.select(spec.key).distinct(), spec.key, "left_semi").select("event_date")
        days = shared.union(new.select("event_date")).distinct().select(F.col("event_date").cast("string"))
        touched = [r[0] for r in days.collect() if r[0] in before.dates]  # dates, not rows
        held = store.winners(before, schema, touched)
        new = new if held is None else new.unionByName(held)
    dates = store.write_winners(_contest(new, spec, partial), name)
    kept = {d: v for d, v in before.dates.items() if d not in touched}  # a date that lost its last row is gone
    return replace(after, dates={**kept, **{d: name for d in dates}})


def _present(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """Of the files named in ``path``, those that there are (and are not empty), as they are now."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    found = [listing(spark, r[0]) for r in paths.select(folder).distinct().collect()]
    there = [f.select(*_IDENTITY) for f in found if f is not None]
    if not there:
        return paths.where("false").select("path", F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"))
    return paths.select("path").distinct().join(union_by_name(*there), "path")


def _layout(spec: DatasetSpec, partial: bool) -> str:
    if partial and not spec.snapshot:
        raise ValueError(f"{spec.name} has no histories to merge")
    return "partial" if partial else "newest"


def absorb(spark: SparkSession, paths: Sequence[str], store: str, spec: DatasetSpec, partial: bool = False) -> None:
    """Put files into the store; only the dates they touch are written anew.

    A store of a dataset with histories holds each key's newest row or, if it was begun as ``partial``, each attribute's
    newest value with the value's own time, so that rows may come in any order.

    Files that the store has, as they are now, are passed over. If it has one of them as it was before it was rewritten,
    emptied or deleted, all its files are put through the rules again, so rows that no file has any more are gone.
    """
    held, layout = Store(spark, store), _layout(spec, partial)
    asked = spark.createDataFrame([(p,) for p in paths], "path string")
    found = listing(spark, list(paths))
    arrived = written(_present(spark, asked) if found is None else found.select(*_IDENTITY), "arrived-files")
    while True:
        before = held.latest()
        if before.layout not in ("", layout):
            raise ValueError(f"the store at {store} holds {before.layout} rows, not {layout} ones")
        known, base, new = held.files(before), before, arrived
        if known is not None:
            new = written(arrived.join(known, _IDENTITY, "left_anti"), "new-files")
            if not known.join(asked, "path", "left_semi").join(arrived, _IDENTITY, "left_anti").isEmpty():
                new = written(_present(spark, known.select("path").union(asked)), "present-files")
                base = Version(before.number)
        if base is before and new.isEmpty():
            return
        names = [r["path"] for r in new.select("path").toLocalIterator()]  # names, as in Spark's own file index
        after = _absorbed(held, base, names, spec, partial)
        after = replace(after, layout=layout, files=(*after.files, held.write_part(new, "files")))
        if held.publish(held.compacted(after)):
            return


def changed_files(spark: SparkSession, folder: str, store: str) -> list[str]:
    """Files of ``folder`` that the store has as they were before they were rewritten, emptied or deleted."""
    held = Store(spark, store)
    known = held.files(held.latest())
    if known is None:
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    known, there = known.where(F.col("path").startswith(f"{whole.rstrip('/')}/")), listing(spark, folder)
    changed = known if there is None else known.join(there.select(*_IDENTITY), _IDENTITY, "left_anti")
    return [r["path"] for r in changed.select("path").distinct().collect()]  # names, of the changed ones


def landing_stream(
    spark: SparkSession,
    folder: str,
    store: str,
    checkpoint: str,
    spec: DatasetSpec,
    files_per_batch: int = 1000,
    partial: bool = False,
) -> StreamingQuery:
    """Start absorbing the files of ``folder`` that have not been absorbed yet; ends when there are no more.

    Spark's file source tells of a path once, so files that have changed since are looked for first.
    """
    changed = changed_files(spark, folder, store)
    if changed:
        absorb(spark, changed, store, spec, partial)
    arrivals = (
        spark.readStream.format("binaryFile")
        .schema(_FILES)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select("path")
    )

    def take(batch_df: DataFrame, _: int) -> None:
        paths = [r["path"] for r in batch_df.collect()]  # at most files_per_batch names
        if paths:
            absorb(batch_df.sparkSession, paths, store, spec, partial)

    return (
        arrivals.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _winners(spark: SparkSession, store: str, spec: DatasetSpec) -> DataFrame:
    held, schema = Store(spark, store), _store_schema(spec)
    rows = held.winners(held.latest(), schema)
    return spark.createDataFrame([], schema) if rows is None else rows


def stored_silver(spark: SparkSession, store: str, spec: DatasetSpec) -> DataFrame:
    """The silver table as of the last absorbed batch."""
    return locked(by_faults(_winners(spark, store, spec)).good, spec)


def stored_rejects(spark: SparkSession, store: str, spec: DatasetSpec) -> DataFrame:
    """The rejected rows as of the last absorbed batch, with their ``reason``."""
    held = Store(spark, store)
    late = by_faults(_winners(spark, store, spec).drop("event_date")).rejected.withColumn(CORRUPT, F.lit(None).cast("string"))
    early = held.refused(held.latest(), StructType([*spec.schema.fields, StructField(CORRUPT, StringType()), StructField("reason", StringType())]))
    return late if early is None else early.unionByName(late)
