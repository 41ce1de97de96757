"""The corpus pipeline: toxic documents go, then repeated lines, near copies and repeated passages; the rest is packed.

Each stage's result is written as Parquet in the shared folder and read again as the next one's documents.

Every stage takes any documents: null and empty texts, a null doc_id, very long texts (read whole), repeated rows and equal
texts. It reads the columns of documents alone, so other columns, of whatever names, are dropped by the first stage. No
documents give no rows, in the stage's columns. Rows are dropped by the toxicity and the near copy stage only; what each
does with them is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orewash.llm.common import table
from orewash.llm.lines import without_repeated_lines
from orewash.llm.nearcopies import identity, near_classes
from orewash.llm.packing import pack_documents
from orewash.llm.queries import WORD_VOCABULARY
from orewash.llm.substrings import without_repeats
from orewash.llm.toxicity import toxicity
from orewash.scratch import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def as_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; null and empty texts are not toxic unless most labels are.

    Repeated rows are kept or rejected together.
    """
    return toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; one of which nothing is left stays, empty. Null texts stay null.

    A null doc_id stands before all others; repeated rows count once and are treated alike.
    """
    return as_documents(without_repeated_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, one row: the document of smallest doc_id (null before all others).

    Null and empty texts are one class; of repeated rows one stays.
    """
    found = near_classes(docs).where("leads").select("doc", "t1", "t2").distinct()
    kept = docs.select(*COLUMNS).withColumns(identity()).join(found, ["doc", "t1", "t2"], "left_semi")
    return kept.dropDuplicates(["doc", "t1", "t2"]).select(*COLUMNS)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words or more that stand earlier, as words with a space between them.

    Null texts become empty; repeated rows count once and are treated alike.
    """
    return as_documents(without_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences of at most 2048; a null or empty text is one piece, repeated rows are pieces each."""
    return pack_documents(docs, WORD_VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("substring dedup", drop_passages),
    ("packing", pack),
]

ORACLE_SQL = None  # the classifier and the vocabulary are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents: the last one's pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
