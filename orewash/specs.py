"""What the engine knows about its datasets and tables, as data.

Operators take a :class:`DatasetSpec`; none of them branches on a dataset name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_TYPES = {
    "string": StringType(),
    "int": IntegerType(),
    "bigint": LongType(),
    "double": DoubleType(),
    "timestamp": TimestampType(),
    "date": DateType(),
}


def struct_of(ddl: str) -> StructType:
    """The struct for ``name type, name type…``, where unknown types are text. Unlike Spark's parser it needs no session."""
    pairs = (part.split() for part in ddl.split(","))
    return StructType([StructField(name, _TYPES.get(kind, StringType())) for name, kind in pairs])


# Trimmed texts that stand for a missing value.
NULL_TOKENS = ("", "NaN", "nan", "NULL", "null", "None", "NONE", "N/A", "n/a")

# Timestamp layouts tried, in this order, after Spark's own cast.
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
)

# The date that stands for "unknown", and the partition columns any dataset may carry.
UNKNOWN_DATE = "1900-01-01"
DATE_PARTS = ("year", "month", "day")

# Columns that can give a row its date, best first.
DATE_SOURCES = ("ts", "event_timestamp", "updated_at", "created_at")

CORRUPT = "_corrupt_record"
JUNK_PREFIX = "extra_"


@dataclass(frozen=True)
class DatasetSpec:
    """One dataset: its canonical columns and the rules that apply to them.

    ``required``: columns that must be present before cleaning; a row without one never competes for its key.
    ``trusted``: columns that must hold a value after cleaning for a row to be accepted.
    ``non_negative``: numeric columns where a value below zero condemns the row (null passes).
    ``unique``: columns whose uniqueness is reported by the quality metrics.
    ``snapshot``: attributes carried by the one-row-per-key history merge; empty means "latest row wins".
    """

    name: str
    ddl: str
    key: str
    order_by: str
    required: tuple[str, ...]
    trusted: tuple[str, ...]
    non_negative: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    snapshot: tuple[str, ...] = ()

    @property
    def schema(self) -> StructType:
        return struct_of(self.ddl)

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()


# The three canonical schemas.
EVENTS = DatasetSpec(
    name="events",
    ddl="""event_id string, user_id string, ts timestamp, age int, country string, email string, message string,
           name string, price double, temperature double, amount double, year int, month int, day int""",
    key="event_id",
    order_by="ts",
    required=("event_id", "user_id"),
    trusted=("event_id", "user_id", "ts"),
)

USERS = DatasetSpec(
    name="users",
    ddl="""user_id string, name string, email string, phone string, city string, age int, updated_at timestamp,
           year int, month int, day int""",
    key="user_id",
    order_by="updated_at",
    required=("user_id",),
    trusted=("user_id",),
    unique=("user_id",),
    snapshot=("name", "email", "phone", "city", "age"),
)

TRANSACTIONS = DatasetSpec(
    name="transactions",
    ddl="""tx_id string, user_id string, amount double, status string, created_at timestamp, delivered_at timestamp,
           email string, name string, age int, year int, month int, day int""",
    key="tx_id",
    order_by="created_at",
    required=("tx_id", "user_id"),
    trusted=("tx_id", "created_at"),
    non_negative=("amount",),
)

SPECS = {spec.name: spec for spec in (EVENTS, TRANSACTIONS, USERS)}


def spec_for(name: str) -> DatasetSpec:
    """The spec called ``name`` in any letter case; ``ValueError`` when there is none."""
    try:
        return SPECS[name.lower()]
    except KeyError:
        raise ValueError(f"no such dataset: {name!r} (known: {', '.join(SPECS)})") from None


# The ten gold tables.
GOLD_DDL = {
    "dim_users": """user_id string, name string, email string, city string, phone string, age string,
                    updated_at timestamp""",
    "dim_country": "country string",
    "dim_status": "status string",
    "dim_date": """date date, year int, month int, day int, day_of_week string, week_of_year int,
                   month_name string""",
    "fact_events": """event_id string, user_id string, ts timestamp, event_date date, country string,
                      user_city string, user_age string, user_email string""",
    "fact_transactions": """tx_id string, user_id string, amount double, status string, created_at timestamp,
                            delivered_at timestamp, tx_date date, user_city string, user_age string,
                            user_email string""",
    "fact_user_activity": """user_id string, date date, events_count bigint, transactions_count bigint,
                             total_revenue double, avg_transaction_amount double""",
    "daily_revenue": """date date, transaction_count bigint, total_revenue double, avg_amount double,
                        delivered_count bigint""",
    "daily_active_users": """date date, event_active_users bigint, tx_active_users bigint,
                             total_active_users bigint""",
    "user_ltv": """user_id string, event_count bigint, first_event timestamp, last_event timestamp,
                   transaction_count bigint, total_revenue double, ltv double""",
}

# The gold tables the warehouse holds, and those whose absence means the gold layer is incomplete.
WAREHOUSE_TABLES = (
    "dim_users",
    "fact_events",
    "fact_transactions",
    "fact_user_activity",
    "daily_revenue",
    "daily_active_users",
    "user_ltv",
)
GOLD_MUST_EXIST = ("dim_users", "fact_events", "fact_transactions", "daily_revenue")


def gold_schema(table: str) -> StructType:
    return struct_of(GOLD_DDL[table])
