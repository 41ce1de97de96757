"""The stream's store: rows by date, and a log that says which of them count.

Nothing that is written is ever changed. A batch writes the dates that it touches to folders of its own and then adds one
row to the log; that row names, for every date, the folder that holds it, and where the list of absorbed files is. The
last version in the log is the store, so readers see a batch's outcome whole or not at all, and a batch that stops on the
way leaves nothing but folders that no version names. Each file is listed with its length and time, so a file that was
rewritten under its name is not taken for the one that was absorbed.

Two streams may work on one store: both write what they have and one adds its version first. The other finds that out
when it looks at the log, and works its batch out anew from the version that won.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FILE = "path string, length bigint, modificationTime timestamp"
_VERSION = "id string, dates map<string,string>, files array<string>, refused array<string>, layout string"
_MISSING = ("PATH_NOT_FOUND", "PATH_NOT_EXISTS", "UNABLE_TO_INFER_SCHEMA")
MOST_PARTS = 64  # folders of files or refused rows; more are written as one


@dataclass(frozen=True)
class Version:
    """What counts as of a batch: ``dates`` to the folder of each date's rows, and folders of files and of refused rows.

    ``layout`` is what kind of rows the store holds; it is chosen by the first batch.
    """

    number: int = 0
    id: str = ""
    dates: dict[str, str] = field(default_factory=dict)
    files: tuple[str, ...] = ()
    refused: tuple[str, ...] = ()
    layout: str = ""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- the log ---

    def _log(self) -> DataFrame | None:
        try:
            rows = self.spark.read.schema(f"{_VERSION}, number int").parquet(f"{self.path}/log")
        except AnalysisException as error:
            if error.getCondition() not in _MISSING:
                raise
            return None
        return rows.withColumn("at", F.col("_metadata.file_modification_time"))

    def latest(self) -> Version:
        """The last version; of rows that two streams added for one number, the first to arrive counts."""
        log = self._log()
        row = log and log.orderBy(F.desc("number"), "at", "id").first()
        if not row:
            return Version()
        return Version(row["number"], row["id"], dict(row["dates"]), tuple(row["files"]), tuple(row["refused"]), row["layout"] or "")

    def publish(self, version: Version) -> bool:
        """Add a version to the log; False if another one has its number already, which makes this one void.

        The row is one file, which Spark moves to its place in one step.
        """
        values = [(version.id, version.dates, list(version.files), list(version.refused), version.layout)]
        row = self.spark.createDataFrame(values, _VERSION).coalesce(1)
        if self.latest().number >= version.number:
            return False
        row.write.mode("append").parquet(f"{self.path}/log/number={version.number}")
        first = self._log().where(F.col("number") == version.number).orderBy("at", "id").first()
        return first["id"] == version.id

    # --- what a version names ---

    def _read(self, folders: Sequence[str], schema: StructType | str) -> DataFrame | None:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None

    def files(self, version: Version) -> DataFrame | None:
        """The files that were absorbed, as they were: ``(path, length, modificationTime)``."""
        return self._read(version.files, FILE)

    def refused(self, version: Version, schema: StructType | None = None) -> DataFrame | None:
        """The rows that were refused before the contest, by ``schema`` or whatever columns they were written with."""
        if schema is None and version.refused:
            schema = self.spark.read.parquet(f"{self.path}/{version.refused[-1]}").schema
        return self._read(version.refused, schema)

    def winners(self, version: Version, schema: StructType, dates: Sequence[str] | None = None) -> DataFrame | None:
        """The rows of all dates, or of ``dates`` (those of them that there are); no other folder is listed or read."""
        folders = [f"{self.path}/winners/event_date={d}/version={v}" for d, v in version.dates.items() if dates is None or d in dates]
        if not folders:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/winners").schema(schema).parquet(*folders)
        return rows.select(*schema.fieldNames())

    # --- writing ---

    def write_winners(self, rows: DataFrame, name: str) -> list[str]:
        """Write rows by date under a version's name; the dates that have rows."""
        out = rows.withColumn("version", F.lit(name)).hint("rebalance", "event_date")
        out.write.mode("append").partitionBy("event_date", "version").parquet(f"{self.path}/winners")
        held = rows.sparkSession.read.option("basePath", f"{self.path}/winners").parquet(f"{self.path}/winners/*/version={name}")
        return [r[0] for r in held.select(F.col("event_date").cast("string")).distinct().collect()]

    def write_part(self, rows: DataFrame, kind: str) -> str:
        folder = f"{kind}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def compacted(self, version: Version) -> Version:
        """The version with its many folders of files, or of refused rows, written as one."""
        if len(version.files) > MOST_PARTS:
            version = replace(version, files=(self.write_part(self.files(version), "files"),))
        if len(version.refused) > MOST_PARTS:
            version = replace(version, refused=(self.write_part(self.refused(version), "refused"),))
        return version

    def vacuum(self) -> int:
        """Delete the folders that the last version does not name, and the log before it; how many were deleted.

        Not to be run while a stream is writing or an older version is being read.
        """
        held = self.latest()
        named = {f"winners/event_date={d}/version={v}" for d, v in held.dates.items()}
        named |= {*held.files, *held.refused, f"log/number={held.number}"}
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = 0
        for pattern in ("winners/*/version=*", "files/*", "refused/*", "log/number=*"):
            for status in system.globStatus(hadoop.Path(root, pattern)) or []:
                path = status.getPath()
                parts = 3 if pattern.startswith("winners") else 2
                name = "/".join(str(path.toUri().getPath()).split("/")[-parts:])
                if name not in named:
                    gone += bool(system.delete(path, True))
        return gone
