"""From landing rows to one clean row per key, with every row that falls out accounted for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewash.operators.cleaning import clean_value
from orewash.operators.columns import locked, with_event_date
from orewash.operators.dedupe import latest_per_key
from orewash.operators.normalize import aligned, corrupt_rule, missing_rules, uncastable_rules
from orewash.operators.quarantine import row_rules
from orewash.operators.scd import latest_snapshot, merge_partial
from orewash.operators.split import FAULTS, REFUSED, Split, by_faults, judged, verdict
from orewash.specs import CORRUPT, DatasetSpec


def staged(raw: DataFrame, spec: DatasetSpec, flag_uncastable: bool = False) -> DataFrame:
    """Typed, clean canonical columns with the faults that bar a row from competing for its key.

    Those are structural faults, judged on the values as they arrived, and a key that turns out to be a null token.
    Datasets that merge a history have no contest for keys, so all their row rules apply here. It is one projection
    over ``raw``, and kept small: generated methods beyond 8000 bytes are never compiled by the JVM.
    """
    df = aligned(raw, spec)
    now = {f.name: f.dataType for f in df.schema.fields}
    tidy = {f.name: clean_value(F.col(f.name), now[f.name], f.dataType) for f in spec.schema.fields}
    late = row_rules(tidy, spec) if spec.snapshot else missing_rules([(spec.key, tidy[spec.key])])
    codes = {code for code, _ in late}
    early = missing_rules((c, F.col(c)) for c in spec.required)
    rules = corrupt_rule() + late + [(code, holds) for code, holds in early if code not in codes]
    if flag_uncastable:
        rules += uncastable_rules(df, tidy)
    return df.select(*(value.alias(name) for name, value in tidy.items()), CORRUPT, *verdict(rules))


def contested(rows: DataFrame, spec: DatasetSpec) -> DataFrame:
    """The winner per key among staged rows that were not refused, judged by the row rules.

    The rules are applied after the contest: a faulty latest row is rejected and does not let an older one back in.
    """
    fit = rows.where(F.col(REFUSED) == 0)
    if spec.snapshot:
        return fit
    winners = latest_per_key(fit.drop(CORRUPT, FAULTS, REFUSED), spec.key, spec.order_by)
    return judged(winners, row_rules({c: F.col(c) for c in winners.columns}, spec))


def finished(winners: DataFrame, spec: DatasetSpec, partial: bool = False, stringly: bool = False) -> DataFrame:
    """The silver table from accepted winners: histories merged, dated, in the fixed layout.

    ``partial`` merges histories by last non-null value instead of by newest row.
    """
    df = winners.where(F.col(REFUSED) == 0)
    if spec.snapshot:
        df = merge_partial(df, spec) if partial else latest_snapshot(df, spec)
    return locked(with_event_date(df), spec, stringly)


def refused(rows: DataFrame, winners: DataFrame, spec: DatasetSpec) -> DataFrame:
    """All rejected rows, before and after the contest, with their ``reason``."""
    early = by_faults(rows).rejected
    if spec.snapshot:
        return early
    late = by_faults(winners).rejected
    return early.unionByName(late, allowMissingColumns=True)


def silver(raw: DataFrame, spec: DatasetSpec, partial: bool = False) -> Split:
    """The whole dataset pipeline as one lazy plan: the silver table, and the rejected rows."""
    rows = staged(raw, spec)
    winners = contested(rows, spec)
    return Split(finished(winners, spec, partial), refused(rows, winners, spec))


def measured_columns(spec: DatasetSpec) -> list[str]:
    """The silver columns that quality metrics cover."""
    body = [spec.key, *spec.snapshot, spec.order_by] if spec.snapshot else spec.columns
    return [*body, "event_date"]
