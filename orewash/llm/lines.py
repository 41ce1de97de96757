"""Removal of repeated runs of lines, by a suffix array over line ids and distributed prefix doubling.

Every line of the corpus is a position. Round 0 ranks positions by their line; round k ranks them by the 2^k lines that
begin there, from the ranks of two halves. Only positions whose run stands elsewhere too go on to the next round: all
others have their place in the suffix array already. Positions of one rank are an interval of the suffix array with a
longest common prefix of 2^k lines or more. All but the first of an interval are later copies, and what they cover goes.

A run counts from a number of characters on. So what goes is what the shortest runs that reach it cover: the one from
each line on and the one up to each line. Those of one and two lines come from the rounds, longer ones are hashed whole.

Each round is two joins, an aggregate that counts a rank's positions before they are shuffled, and a sort of the
different pairs of ranks, by ranges; it ends in a written table. There are as many rounds as the logarithm of the
longest repeated run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewash.llm.common import text_of, unused
from orewash.llm.substrings import mixed
from orewash.scratch import written

LEAST_CHARS = 10
NO_ID = -(1 << 63)
PLACE = ["doc", "pos", "tag"]


def line_positions(docs: DataFrame) -> DataFrame:
    """(doc, tag, pos, a, b, chars): a line's place, 128 bits of its hash, its length. Repeated rows count once."""
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text_of()).alias("tag"),
        F.posexplode(F.split(text_of(), "\n", -1)).alias("pos", "line"),
    )
    return lines.select(
        "doc", "tag", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), F.length("line").alias("chars")
    ).dropDuplicates(PLACE)


def dense_ranks(pairs: DataFrame, key: list[str]) -> DataFrame:
    """``pairs`` (different keys) with ``rank``, their place in the order of the key, gapless from 0.

    The keys are sorted in ranges and written with their place in their range; the ranges' sizes, of which there are as
    many as shuffle partitions, give what to add.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartitionByRange(n, *key).sortWithinPartitions(*key)
    placed = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)), "line-ranks")
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    if not before:
        return placed.withColumn("rank", F.lit(0).cast("long")).drop("_part", "_at")
    offset = F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.col("_part"))
    return placed.withColumn("rank", offset + F.col("_at")).drop("_part", "_at")


def ranked_runs(positions: DataFrame, key: list[str]) -> DataFrame:
    """Positions whose key others have too: PLACE, rank, chars, and whether the position is a later copy."""
    shared = (
        positions.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*PLACE)).alias("_first"))
        .where(F.col("_n") > 1)
    )
    ranks = dense_ranks(shared, key)
    found = positions.join(ranks, key).select(*PLACE, "rank", "chars", (F.struct(*PLACE) != F.col("_first")).alias("later"))
    return written(found, "line-runs")


def doublings(docs: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """For 1, 2, 4, ... lines: the positions of runs of that length that stand elsewhere too, until there are none.

    ``rank`` orders runs (by the ids of their lines), equal runs have equal ranks; ``later`` tells all but the first.
    """
    runs = ranked_runs(line_positions(docs), ["a", "b"])
    length = 1
    while not runs.isEmpty():
        yield length, runs
        second = runs.select("doc", "tag", (F.col("pos") - length).alias("pos"), F.col("rank").alias("next"), F.col("chars").alias("more"))
        pairs = runs.select(*PLACE, "rank", "chars").join(second, PLACE).withColumn("chars", F.col("chars") + F.col("more"))
        runs = ranked_runs(pairs.withColumnRenamed("rank", "this"), ["this", "next"])
        length *= 2


def shortest_runs(chars: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of the runs of over two lines that reach ``least`` and are the shortest to do so
    from their first line on, or up to their last one."""
    before = np.concatenate([[0], np.cumsum(chars)])
    line = np.arange(len(chars))
    stop = np.maximum(np.searchsorted(before, before[:-1] + least, "left"), line + 1)
    start = np.minimum(np.searchsorted(before, before[1:] - least, "right") - 1, line)
    fits, holds = stop <= len(chars), start >= 0
    first, many = np.concatenate([line[fits], start[holds]]), np.concatenate([(stop - line)[fits], (line + 1 - start)[holds]])
    both = np.unique(np.stack([first, many])[:, many > 2], axis=1)
    return both[0], both[1]


def run_hashes(lines: list[str], first: np.ndarray, many: np.ndarray, full: np.ndarray) -> list[np.ndarray]:
    """128 bits for each run, of its number of lines and of its lines that are not empty (``full``) with their places.

    A shortest run has no more of these than its least number of characters, however many empty lines it has.
    """
    low, high = np.searchsorted(full, first), np.searchsorted(full, first + many)
    used = np.zeros(len(full) + 1, np.int64)
    np.add.at(used, low, 1)
    np.add.at(used, high, -1)
    own = np.zeros((2, len(full)), np.uint64)
    for j in np.flatnonzero(np.cumsum(used)[:-1]).tolist():
        digest = xxhash.xxh3_128_intdigest(lines[full[j]].encode())
        own[:, j] = digest & 0xFFFFFFFFFFFFFFFF, digest >> 64
    sums = np.stack([mixed(many.astype(np.uint64)), mixed(~many.astype(np.uint64))])
    for k in range(int((high - low).max(initial=0))):
        has = np.flatnonzero(low + k < high)
        at = low[has] + k
        sums[:, has] += mixed(own[:, at] + mixed((full[at] - first[has] + 1).astype(np.uint64)))
    return [x.view(np.int64) for x in mixed(sums)]


def longer_copies(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc, tag, pos, n): later copies among the shortest runs of over two lines that reach ``least_chars``."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                for doc, tag, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "text")), strict=True):
                    if text.count("\n") < 2:
                        continue
                    lines = text.split("\n")
                    chars = np.array([len(x) for x in lines])
                    first, many = shortest_runs(chars, least_chars)
                    if len(first):
                        a, b = run_hashes(lines, first, many, np.flatnonzero(chars))
                        columns = [np.full(len(first), doc), np.full(len(first), tag), first.astype(np.int32), many.astype(np.int32), a, b]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "tag", "pos", "n", "a", "b"])

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_of()).alias("tag"), text_of().alias("text"))
    found = written(texts.mapInArrow(runs, "doc long, tag long, pos int, n int, a long, b long"), "line-longer-runs")
    place = F.struct(*PLACE)
    shared = found.groupBy("a", "b").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where("_first < _last").drop("_last")
    later = found.join(shared, ["a", "b"]).where(place != F.col("_first")).select("doc", "tag", "pos", "n").distinct()
    return written(later, "line-longer-copies")


def without_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` without later copies of runs of lines, and with n_lines, n_removed and longest_run.

    A run is any number of consecutive lines of a document, with ``least_chars`` characters or more; it is a later copy
    if the same lines stand earlier (in a document of smaller doc_id, or further up). Every line that later copies cover
    goes, so of each maximal repeated run the first copy stays. ``longest_run`` is the largest power of two of lines
    that a later copy in the document has in a row (0: none).

    Null text has no lines and stays null; empty text is one empty line. A null doc_id comes before all others. Repeated
    rows count once and are treated alike; different texts of one doc_id are told apart, in the order of a hash. Columns
    called n_lines, n_removed or longest_run are replaced, all others kept. No documents give no rows.
    """
    docs = docs.drop("n_lines", "n_removed", "longest_run")
    marks = longer_copies(docs, least_chars)
    longest = marks.select("doc", "tag", F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("int").alias("run"))
    for length, runs in doublings(docs):
        copies = runs.where(F.col("later") & (F.col("chars") >= least_chars))
        reached = copies.groupBy("doc", "tag").agg(F.lit(length).alias("run"))
        longest = longest.unionByName(reached)
        if length <= 2:  # what longer runs cover, these and the shortest longer ones cover
            marks = marks.unionByName(copies.select("doc", "tag", "pos", F.lit(length).alias("n")))
    names = docs.columns
    doc, tag, pos, n, run = unused(names, "_doc", "_tag", "_pos", "_n", "_run")
    place = {doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), tag: F.xxhash64(text_of())}
    by_doc = marks.groupBy("doc", "tag").agg(F.collect_list("pos").alias(pos), F.collect_list("n").alias(n))
    runs = longest.groupBy("doc", "tag").agg(F.max("run").alias(run))
    by_doc = by_doc.join(runs, ["doc", "tag"]).withColumnsRenamed({"doc": doc, "tag": tag})
    joined = docs.withColumns(place).join(by_doc, [doc, tag], "left").select(*names, pos, n, run)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                left, n_lines, n_removed = [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    lines = [] if text is None else text.split("\n")
                    n_lines.append(len(lines))
                    found = batch.column(pos)[i]
                    if found.is_valid and text is not None:
                        covers = np.zeros(len(lines) + 1, np.int64)
                        at, many = found.values.to_numpy(), batch.column(n)[i].values.to_numpy()
                        np.add.at(covers, at, 1)
                        np.add.at(covers, at + many, -1)
                        lines = [lines[j] for j in np.flatnonzero(np.cumsum(covers)[:-1] == 0).tolist()]
                    n_removed.append(n_lines[-1] - len(lines))
                    left.append(None if text is None else "\n".join(lines))
                longest_run = batch.column(run).fill_null(0).cast(pa.int64())
                columns = [batch.column(c) if c != "text" else pa.array(left, pa.string()) for c in names]
                columns += [pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), longest_run]
                yield pa.RecordBatch.from_arrays(columns, [*names, "n_lines", "n_removed", "longest_run"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(remove, f"{schema}, n_lines long, n_removed long, longest_run long")
