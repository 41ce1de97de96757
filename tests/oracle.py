"""Comparing a Spark result with its SQL twin."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def rows_of_spark(df):
    columns = sorted(df.columns)
    return columns, Counter(tuple(_plain(row[c]) for c in columns) for row in df.collect())


def rows_of_sql(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, Counter(tuple(_plain(row[i]) for i in at) for row in cursor.fetchall())


def difference(df, con, sql):
    """None if both sides give the same columns and rows, else a short account of what differs."""
    spark_columns, spark_rows = rows_of_spark(df)
    sql_columns, sql_rows = rows_of_sql(con, sql)
    if spark_columns != sql_columns:
        return f"columns {spark_columns} / {sql_columns}"
    if spark_rows != sql_rows:
        only_spark = list((spark_rows - sql_rows).items())[:3]
        only_sql = list((sql_rows - spark_rows).items())[:3]
        return f"{spark_columns}\nspark: {only_spark}\nsql:   {only_sql}\n{spark_rows.total()} / {sql_rows.total()}"
    return None
