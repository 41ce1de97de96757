"""Removal of word sequences that stand earlier in the corpus, by super-k-mer partitioning.

Windows of ``width`` consecutive words are compared by the whole corpus. Consecutive windows that share a minimiser (the
least of the hashes of their runs of ``MARK`` words) travel as one packed string to the minimiser's bucket, so equal
windows always meet, and a word travels about three times instead of ``width`` times. In its bucket, windows are sorted
by a hash, equal hashes are compared word for word, and all but the earliest of equal windows are marked.

Against hot buckets: runs that are the minimiser of too many windows are counted first and then come last in the order
of minimisers, so a frequent phrase gathers only windows that consist of nothing else; and each task sends a packed
string once, however often it has met it, and marks the later ones itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewash.llm.common import in_batches, text_of, unused
from orewash.scratch import written

WIDTH = 20
MARK = 4
CHUNK_BYTES = 4 << 20
BUCKET_ROWS = 40_000  # super-k-mers that a bucket is to hold, on average
COMMON_IN_CHUNK = 8
MOST_COMMON = 4096
NO_ID = -(1 << 63)
MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """Words to 64-bit hashes, each computed once while remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 200_000:
            self.clear()
        return np.array([self[w] for w in words], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def minimisers(hashes: np.ndarray, width: int, common: np.ndarray) -> np.ndarray:
    """The minimiser of each window of ``width`` words; ``common`` ones (sorted) come after all others."""
    n = len(hashes) - MARK + 1
    runs = mixed(hashes[:n])
    for j in range(1, MARK):
        runs = mixed(runs + hashes[j : j + n])
    runs >>= np.uint64(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, runs), len(common) - 1)
        runs |= (common[at] == runs).astype(np.uint64) << np.uint64(63)
    span, reach = width - MARK + 1, 1
    while 2 * reach <= span:
        runs, reach = np.minimum(runs[: len(runs) - reach], runs[reach:]), 2 * reach
    rest = span - reach
    return np.minimum(runs[: len(runs) - rest], runs[rest:]) if rest else runs


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(doc, tag, text) in chunks of bounded size, each in the order of documents."""
    held, size = [], 0
    for batch in batches:
        for doc, tag, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag")), batch.column("text"), strict=True):
            raw = text.as_buffer().to_pybytes()
            held.append((doc, tag, raw))
            size += len(raw)
            if size >= CHUNK_BYTES:
                yield sorted(held)
                held, size = [], 0
    if held:
        yield sorted(held)


def runs_of(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.concatenate([[0], np.flatnonzero(found[1:] != found[:-1]) + 1])
    return starts, np.diff(np.append(starts, len(found)))


def common_minimisers(rows: DataFrame, width: int, least_buckets: int) -> tuple[np.ndarray, int]:
    """Minimisers of so many super-k-mers that they would make a bucket hot, ``MOST_COMMON`` at most; and the number of buckets.

    Counts of a chunk are left out where they are below ``COMMON_IN_CHUNK``; this bears on the balance of buckets only,
    never on what is found. Buckets grow in number with the super-k-mers, so that one does not grow in size.
    """
    nothing = np.zeros(0, np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for chunk in chunks(batches):
            parts = [nothing]
            for _, _, raw in chunk:
                words = raw.split()
                if len(words) >= width:
                    found = minimisers(hashes.of(words), width, nothing)
                    parts.append(found[runs_of(found)[0]])
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            often = counts >= COMMON_IN_CHUNK
            values = np.append(values[often], np.uint64(0))  # 0 holds the chunk's total
            columns = [pa.array(values.astype(np.int64)), pa.array(np.append(counts[often], counts.sum()))]
            yield pa.RecordBatch.from_arrays(columns, ["run", "n"])

    counts = rows.mapInArrow(count, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    most = {r["run"]: r["n"] for r in counts.orderBy(F.desc("n")).limit(MOST_COMMON).collect()}
    total = most.pop(0, 0)
    buckets = max(least_buckets, -(-total // BUCKET_ROWS))
    limit = max(COMMON_IN_CHUNK, total // (16 * buckets))
    return np.sort(np.array([r for r, n in most.items() if n > limit], np.uint64)), buckets


def packed(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    return zstandard.compress(np.stack([doc, tag, start, size]).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").reshape(4, -1)


def marks(rows: DataFrame, width: int) -> DataFrame:
    """Words to remove, as (doc, tag, start, stop): those of windows that stand earlier too.

    ``rows``: (doc long, text), and a ``tag`` (long) where documents of one doc are to be told apart.
    """
    if "tag" not in rows.columns:
        rows = rows.withColumn("tag", F.lit(0).cast("long"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common, buckets = common_minimisers(rows, width, 4 * n)
    schema = pa.schema([("bucket", pa.int32()), ("places", pa.binary()), ("text", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()

        def out():
            for chunk in chunks(batches):
                yield from chunk_rows(chunk, hashes)

        yield from in_batches(out(), schema, weight=lambda r: 64 + len(r[1]) + len(r[2] or b""))

    def chunk_rows(chunk: list[tuple[int, int, bytes]], hashes: Hashes) -> Iterator[tuple]:
        first: dict[bytes, int] = {}
        place, value, again = [], [], []
        for doc, tag, raw in chunk:
            words = raw.split()
            if len(words) < width:
                continue
            found = minimisers(hashes.of(words), width, common)
            starts, lengths = runs_of(found)
            for s, k, v in zip(starts.tolist(), lengths.tolist(), found[starts].tolist(), strict=True):
                text = b" ".join(words[s : s + k + width - 1])
                at = first.setdefault(text, len(place))
                if at == len(place):
                    place.append((doc, tag, s, k + width - 1))
                    value.append(v)
                elif place[at][:3] < (doc, tag, s):
                    again.append((doc, tag, s, k + width - 1))
        if again:  # no need to meet others: spread by document
            found = np.array(again, np.int64).T
            bucket = (mixed(found[0].view(np.uint64) ^ found[1].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(bucket).tolist():
                yield (b, packed(*found[:, bucket == b]), None)
        if place:
            texts = list(first)
            places = np.array(place, np.int64).T
            bucket = (np.array(value, np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                text = b" ".join([texts[i] for i in part.tolist()])
                yield (int(bucket[part[0]]), packed(*places[:, part]), zstandard.compress(text, 3))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(0)[i].as_py() != bucket:
                    yield from intervals(held, width)
                    bucket, held = batch.column(0)[i].as_py(), []
                held.append((batch.column(1)[i].as_py(), batch.column(2)[i].as_py()))
        yield from intervals(held, width)

    sent = rows.mapInArrow(cut, "bucket int, places binary, text binary")
    return sent.repartitionById(n, "bucket").sortWithinPartitions("bucket").mapInArrow(find, "doc long, tag long, start long, stop long")


def intervals(held: list[tuple[bytes, bytes | None]], width: int) -> Iterator[pa.RecordBatch]:
    """What a bucket's super-k-mers (and a task's own finds) say to remove."""
    number: dict[bytes, int] = {}
    known = number.setdefault
    ids, places, docs, tags, starts = [], [], [], [], []
    for place, text in held:
        place = unpacked(place)
        if text is None:
            for doc, tag, start, size in place.T.tolist():
                docs.append(np.full(size - width + 1, doc))
                tags.append(np.full(size - width + 1, tag))
                starts.append(np.arange(start, start + size - width + 1))
        else:
            words = zstandard.decompress(text).split()
            ids.append(np.array([known(w, len(number)) for w in words], np.int32))
            places.append(place)
    if ids:
        found = np.concatenate(places, axis=1)
        order = np.lexsort((found[1], found[0]))
        new = np.append(False, (np.diff(found[:2, order], axis=1) != 0).any(axis=0))
        whose = np.empty(len(order), np.int64)
        whose[order] = np.cumsum(new)  # a document's place in the order of (doc, tag)
        whose_doc = found[:2, order[np.flatnonzero(np.append(True, new[1:]))]]
        own, start = repeated(np.concatenate(ids), len(number), np.stack([whose, found[2], found[3]]), width)
        docs.append(whose_doc[0, own])
        tags.append(whose_doc[1, own])
        starts.append(start)
    if docs:
        doc, tag, start = np.concatenate(docs), np.concatenate(tags), np.concatenate(starts)
        order = np.lexsort((start, tag, doc))
        doc, tag, start = doc[order], tag[order], start[order]
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + width))) if len(doc) else []
        last = np.append(new[1:], len(doc)) - 1 if len(doc) else []
        if len(doc):
            columns = [doc[new], tag[new], start[new], start[last] + width]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["doc", "tag", "start", "stop"])


def repeated(ids: np.ndarray, words: int, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the windows that are equal to an earlier one in the bucket. ``places``: doc, start, size."""
    doc, start, size = places
    windows = size - width + 1
    ends = np.cumsum(windows)
    inside = np.arange(int(ends[-1])) - np.repeat(ends - windows, windows)
    at = np.repeat(np.cumsum(size) - size, windows) + inside
    doc, start = np.repeat(doc, windows), np.repeat(start, windows) + inside
    codes = np.random.default_rng(3).integers(0, 1 << 63, words, np.uint64)
    hashes, reach = codes[ids], 1
    total, done = None, 0
    left = width
    while left:  # the hash of a window from those of its parts of 1, 2, 4, ... words
        if left & 1:
            part = hashes[at + done]
            total = part if total is None else mixed(total) + part
            done += reach
        left >>= 1
        if left:
            hashes = mixed(hashes[: len(hashes) - reach]) + hashes[reach:]
            reach *= 2
    values, group, count = np.unique(total, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count[group] > 1)
    if not len(often):
        return doc[:0], start[:0]
    group, at, doc, start = group[often], at[often], doc[often], start[often]
    order = np.lexsort((start, doc, group))
    group, at, doc, start = group[order], at[order], doc[order], start[order]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    of = np.repeat(first, np.diff(np.append(first, len(group))))
    same = np.ones(len(at), bool)
    for j in range(width):
        same &= ids[at + j] == ids[at[of] + j]
    if not same.all():  # two different windows of one hash: tell all apart by their words
        kept = np.unique(np.stack([ids[at + j] for j in range(width)]), axis=1, return_inverse=True)[1].reshape(-1)
        order = np.lexsort((start, doc, kept))
        kept, at, doc, start = kept[order], at[order], doc[order], start[order]
        first = np.flatnonzero(np.append(True, kept[1:] != kept[:-1]))
        of = np.repeat(first, np.diff(np.append(first, len(kept))))
    later = (doc > doc[of]) | (start > start[of])
    return doc[later], start[later]


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with n_words, n_removed, and as text the words that are left, joined by one space.

    A word goes if a window of ``width`` words that covers it stands earlier too: in a document of smaller doc_id, or
    earlier in its own. Windows are those of the input, not of what is left. Whole texts count, however long. Null text has
    no words; texts shorter than ``width`` words lose none. A null doc_id comes before all others. Repeated rows count once, so they do not
    remove each other's words; different texts of one doc_id are told apart, in the order of a hash. Columns called n_words or n_removed are replaced,
    all others kept. No documents give no rows.
    """
    docs = docs.drop("n_words", "n_removed")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")
    # Hashes travel with documents of several texts only: elsewhere the doc_id is enough, and packs well.
    text_hash = F.xxhash64(text_of())
    several = docs.select(doc, text_hash.alias("tag")).groupBy("doc").agg(F.min("tag").alias("low"), F.max("tag").alias("high"))
    several = written(several.where("low < high").select("doc", F.lit(True).alias("several")), "passages-shared-ids")
    names = docs.columns
    key, tag, many, begin, end = unused(names, "_doc", "_tag", "_several", "_start", "_stop")
    told = docs.withColumn(key, doc).join(several.withColumnsRenamed({"doc": key, "several": many}), key, "left")
    told = told.withColumn(tag, F.when(F.col(many), text_hash).otherwise(F.lit(0))).select(*names, key, tag)
    found = marks(told.select(F.col(key).alias("doc"), F.col(tag).alias("tag"), F.encode(text_of(), "UTF-8").alias("text")), width)
    by_doc = found.groupBy(F.col("doc").alias(key), F.col("tag").alias(tag)).agg(F.collect_list("start").alias(begin), F.collect_list("stop").alias(end))
    joined = told.join(by_doc, [key, tag], "left").select(*names, begin, end)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                left, n_words, n_removed = [], [], []
                for i, text in enumerate(batch.column("text")):
                    words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                    n_words.append(len(words))
                    start, stop = batch.column(begin)[i], batch.column(end)[i]
                    if start.is_valid:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, np.minimum(start.values.to_numpy(), len(words)), 1)
                        np.add.at(edge, np.minimum(stop.values.to_numpy(), len(words)), -1)
                        words = [words[j] for j in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
                    n_removed.append(n_words[-1] - len(words))
                    left.append(str(b" ".join(words), "utf-8"))
                columns = [batch.column(c) if c != "text" else pa.array(left, pa.string()) for c in names]
                columns += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "n_words", "n_removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(remove, f"{schema}, n_words long, n_removed long")
