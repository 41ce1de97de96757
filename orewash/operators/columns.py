"""Column-level schema work: names, drift and fixed schemas. Every function plans one projection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, StructType

from orewash.functions import text_of, typed
from orewash.specs import CORRUPT, DATE_PARTS, DATE_SOURCES, JUNK_PREFIX, UNKNOWN_DATE, DatasetSpec, struct_of


def plain_name(name: str) -> str:
    """A column name without backticks, with dots and blanks turned into underscores."""
    return name.replace("`", "").replace(".", "_").replace(" ", "_").strip()


def quoted(name: str) -> Column:
    """The column called exactly ``name``, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain_names(df: DataFrame) -> DataFrame:
    """Rename columns by :func:`plain_name`; columns that come to share a name are coalesced left to right."""
    groups: dict[str, list[str]] = {}
    for name in df.columns:
        groups.setdefault(plain_name(name), []).append(name)
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *(
            (
                quoted(olds[0])
                if len(olds) == 1
                else F.coalesce(*(text_of(quoted(old), types[old]) for old in olds))
            ).alias(new)
            for new, olds in groups.items()
        )
    )


def stripped_names(df: DataFrame) -> DataFrame:
    """Rename columns to drop white space around their names."""
    return df.withColumnsRenamed({c: c.strip() for c in df.columns if c != c.strip()})


def without_junk(df: DataFrame) -> DataFrame:
    """Drop columns that only mark drift (prefix ``extra_``)."""
    return df.select(*(quoted(c) for c in df.columns if not c.startswith(JUNK_PREFIX)))


def known_only(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Keep canonical columns, date parts and the corrupt-line column."""
    known = {*spec.columns, *DATE_PARTS, CORRUPT}
    return df.select(*(quoted(c) for c in df.columns if c in known))


def with_missing(df: DataFrame, schema: StructType) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks, as typed nulls."""
    have = set(df.columns)
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in have})


def schema_drift(columns: Iterable[str], spec: DatasetSpec) -> dict[str, list[str]]:
    """Canonical columns that ``columns`` lacks, and columns beyond the canonical ones."""
    seen = list(columns)
    return {
        "missing": [c for c in spec.columns if c not in seen],
        "extra": [c for c in seen if c not in spec.columns and c != CORRUPT],
    }


def voids_to_text(df: DataFrame) -> DataFrame:
    """Give columns without a type (all null literals) the type string."""
    voids = [f.name for f in df.schema.fields if isinstance(f.dataType, NullType)]
    return df.withColumns({c: F.lit(None).cast("string") for c in voids}) if voids else df


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the columns of ``schema``, in order: leniently cast, typed null where absent."""
    now = {f.name: f.dataType for f in df.schema.fields}

    def column(field):
        if field.name not in now:
            value = F.lit(None).cast(field.dataType)
        elif now[field.name] == field.dataType:
            value = F.col(field.name)
        elif field.dataType.simpleString() in ("string", "int", "double", "timestamp"):
            value = typed(F.col(field.name), now[field.name], field.dataType)
        else:
            value = F.col(field.name).try_cast(field.dataType)
        return value.alias(field.name)

    return df.select(*(column(f) for f in schema.fields))


def with_event_date(df: DataFrame, default: str | None = UNKNOWN_DATE) -> DataFrame:
    """Add ``event_date`` from the first date source ``df`` has; ``default`` where there is no date."""
    types = {f.name: f.dataType for f in df.schema.fields}
    source = next((c for c in DATE_SOURCES if c in types), None)
    fallback = F.lit(default).cast("date")
    if source is None:
        return df.withColumn("event_date", F.lit(UNKNOWN_DATE).cast("date"))
    day = F.col(source).try_cast("timestamp").cast("date")
    return df.withColumn("event_date", F.coalesce(day, fallback) if default else day)


def locked(df: DataFrame, spec: DatasetSpec, stringly: bool = False) -> DataFrame:
    """The silver layout: canonical columns in order, then ``event_date`` (never null).

    ``stringly`` stores every canonical column as text, for readers that expect that older layout.
    """
    if "event_date" not in df.columns:
        df = with_event_date(df)
    day = F.coalesce(F.col("event_date"), F.lit(UNKNOWN_DATE).cast("date")).alias("event_date")
    body = conform(df.withColumn("event_date", day), struct_of(f"{spec.ddl}, event_date date"))
    if stringly:
        return body.select(*(F.col(c).cast("string") for c in spec.columns), "event_date")
    return body


def alias_ids(df: DataFrame, for_transactions: bool = False) -> DataFrame:
    """Turn a generic ``id`` column into ``user_id`` (unless there is one) and, for transactions, fill ``tx_id``."""
    if "id" in df.columns:
        df = df.drop("id") if "user_id" in df.columns else df.withColumnRenamed("id", "user_id")
    if for_transactions and "tx_id" not in df.columns:
        df = df.withColumn("tx_id", F.col("user_id"))
    return df
