"""Catalog tables with declared types, reloaded in full from gold and published together."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from orewash.operators.columns import conform
from orewash.sinks.files import MissingOutputError, read_gold
from orewash.specs import GOLD_DDL, WAREHOUSE_TABLES, gold_schema


def create_tables(
    spark: SparkSession, database: str, location: str | None = None, tables: Iterable[str] = WAREHOUSE_TABLES
) -> None:
    """Create the database (at ``location`` if given) and its tables, unless they exist."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{where}")
    for table in tables:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{table} ({GOLD_DDL[table]}) USING parquet")


def load_table(df: DataFrame, database: str, table: str, into: str | None = None) -> None:
    """Replace all rows of ``database.table`` (or of ``into``) by ``df``; columns are matched by name to the declared ones."""
    conform(df, gold_schema(table)).write.insertInto(f"{database}.{into or table}", overwrite=True)


def require_loaded(spark: SparkSession, database: str, tables: Iterable[str] = WAREHOUSE_TABLES) -> None:
    """Raise :class:`MissingOutputError` naming every table without rows."""
    empty = [t for t in tables if spark.table(f"{database}.{t}").isEmpty()]
    if empty:
        raise MissingOutputError(f"no rows in {database}: " + ", ".join(empty))


def _swap(spark: SparkSession, database: str, tables: Sequence[str]) -> None:
    """Put every table's loaded rows in its place; names are changed, nothing is copied. All of them or none."""
    moves = [m for t in tables for m in ((t, f"{t}__old"), (f"{t}__next", t))]
    done: list[tuple[str, str]] = []
    try:
        for old, new in moves:
            spark.sql(f"ALTER TABLE {database}.{old} RENAME TO {database}.{new}")
            done.append((old, new))
    except Exception:
        for old, new in reversed(done):
            spark.sql(f"ALTER TABLE {database}.{new} RENAME TO {database}.{old}")
        raise


def load_warehouse(
    spark: SparkSession, gold: str, database: str, location: str | None = None, tables: Sequence[str] = WAREHOUSE_TABLES
) -> None:
    """Create the warehouse tables and replace their rows from the gold folder, as one publication.

    All tables are loaded beside the ones in use and checked there; only when none of them failed or is empty do they take
    their places. A load that fails leaves the warehouse as it was.
    """
    create_tables(spark, database, location, tables)
    for table in tables:
        for name in (f"{table}__next", f"{table}__old"):
            spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        spark.sql(f"CREATE TABLE {database}.{table}__next ({GOLD_DDL[table]}) USING parquet")
        load_table(read_gold(spark, gold, table), database, table, into=f"{table}__next")
    require_loaded(spark, database, [f"{table}__next" for table in tables])
    _swap(spark, database, tables)
    for table in tables:
        spark.sql(f"DROP TABLE {database}.{table}__old")
