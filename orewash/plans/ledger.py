"""Which steps of a run are done, so that a run that was stopped goes on where it stopped.

A step is done for what it read: its inputs' files by name, length and time, and its options. It is done again if any of
those has changed, or if what it wrote is not there as it left it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW = "step string, inputs string, outputs string, result string, finished timestamp"
_MISSING = ("PATH_NOT_FOUND", "PATH_NOT_EXISTS", "UNABLE_TO_INFER_SCHEMA")


def fingerprint(spark: SparkSession, folders: Iterable[str]) -> str:
    """The files below ``folders``, by name, length and time; tasks add them up, so it is one row whatever their number."""
    parts = []
    for folder in folders:
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
            row = files.select(F.xxhash64("path", "length", "modificationTime").alias("h")).agg(F.count("h"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
            parts.append(f"{folder} {row[0]} {row[1]} {row[2]}")
        except AnalysisException as error:
            if error.getCondition() not in _MISSING:
                raise
            parts.append(f"{folder} none")
    return sha256("\n".join(parts).encode()).hexdigest()


class Ledger:
    """Finished steps, one row each, in a table of their own that is only ever added to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(_ROW).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() not in _MISSING:
                raise
            return self.spark.createDataFrame([], _ROW)

    def once(self, step: str, reads: Iterable[str], writes: Iterable[str], options: dict, work: Callable[[], dict]) -> dict:
        """What ``work`` returned (a dict of plain values), from now or from the run that did it before."""
        reads, writes = list(reads), list(writes)
        inputs = sha256(f"{fingerprint(self.spark, reads)} {json.dumps(options, sort_keys=True)}".encode()).hexdigest()
        last = self.rows().where(F.col("step") == step).orderBy(F.desc("finished")).first()
        if last and last["inputs"] == inputs and last["outputs"] == fingerprint(self.spark, writes):
            return json.loads(last["result"])
        result = work()
        row = self.spark.range(1).select(
            F.lit(step).alias("step"), F.lit(inputs).alias("inputs"), F.lit(fingerprint(self.spark, writes)).alias("outputs"),
            F.lit(json.dumps(result)).alias("result"), F.current_timestamp().alias("finished"),
        )
        row.write.mode("append").parquet(self.path)
        return result
