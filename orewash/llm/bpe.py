"""Byte-level BPE: every distinct word of the corpus is encoded once, wherever it occurs.

1. Each task cuts its documents into words with positions. It does so by blocks: a block's words are numbered, and its
   documents become packed lists of those numbers, one for each position.
2. The blocks' words are shuffled by word. Equal words of all blocks meet, and each is encoded once.
3. The ids are joined back to the block's positions, by block, and documents are reassembled position by position.

A word is what stands between two cuts that no match of the pattern can cross: a single space between two characters
that are not white space begins a new word. The pattern is applied inside words only, with the same matches as in the
whole text. Decoding joins the table of token bytes, whose size is the vocabulary's.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewash.llm.common import text_of

BLOCK_BYTES = 24 << 20
OUT_IDS = 1 << 20
WORDS, TEXTS = 0, 1


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class PieceEncoder:
    """Ids of words: each match of the pattern merged by rank, each different match once."""

    def __init__(self, path: str, pattern: str, remembered: int = 200_000):
        # The library's own pattern takes a match whole, as it is the task here to find the matches.
        self.encoding = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks_of(path), special_tokens={})
        self.pattern = regex.compile(pattern)
        self.remembered = remembered
        self.known: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        return b"".join([known.get(p) or self.piece(p) for p in self.pattern.findall(word)])

    def piece(self, piece: str) -> bytes:
        ids = self.known[piece] = np.array(self.encoding.encode_ordinary(piece), "<u4").tobytes()
        return ids


@lru_cache(maxsize=2)
def piece_encoder(path: str, pattern: str) -> PieceEncoder:
    """One for a worker process."""
    return PieceEncoder(path, pattern)


class Uneven(Exception):
    """A single space beside other white space or an end of the text: no place for a cut."""


class Numbers(dict):
    """Words to numbers, in the order in which they are met."""

    def __init__(self):
        self.names: list[str] = []
        self.uneven: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        start = word[1:2] if word[:1] == " " else word[:1]
        if not start or (word[0] == " " and start.isspace()) or word[-1].isspace():
            raise Uneven
        self[word] = number = self.new(word)
        return number

    def new(self, word: str) -> int:
        self.names.append(word)
        return len(self.names) - 1

    def of(self, text: str) -> list[int]:
        """The text's words by number."""
        parts = text.split(" ")
        try:
            return [self[parts[0]], *[self[" " + p] for p in parts[1:]]] if text else []
        except Uneven:
            return [self.any(w) for w in carefully(parts)]

    def any(self, word: str) -> int:
        if (number := self.get(word, self.uneven.get(word))) is None:
            number = self.uneven[word] = self.new(word)
        return number


def carefully(parts: list[str]) -> list[str]:
    """Words of a text split at single spaces, some of which are no place for a cut."""
    out = [parts[0]]
    for part in parts[1:]:
        if part and not part[0].isspace() and out[-1] and not out[-1][-1].isspace():
            out.append(" " + part)
        else:
            out[-1] += " " + part
    return out


def packed(*arrays: np.ndarray, level: int = 9) -> bytes:
    """Arrays as one compressed string, each by planes of its bytes."""
    raw = [np.array([len(a) for a in arrays], "<u4").tobytes()]
    raw += [a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(raw))


def unpacked(data: bytes, n: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(raw, "<u4", n), 4 * n, []
    for size in sizes.tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size).T).view("<u4").reshape(-1))
        at += 4 * size
    return out


def joined_lists(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``which`` (list i is lengths[i] values from starts[i]) one after another; and the length of each."""
    sizes = lengths[which]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts[which] - (ends - sizes), sizes) + np.arange(total)], sizes


ROW = [("bucket", pa.int32()), ("block", pa.string()), ("kind", pa.int32()), ("data", pa.binary()), ("bytes", pa.binary())]


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the ids of each whole text, as an array, by the ranks in the file ``ranks``.

    Null and empty text have no ids. Very long texts are blocks of their own. Equal and repeated rows come out as often
    as they come in; a null id stays null; other columns are ignored. No documents give no rows. ``docs`` should be read
    from a table, so that a task that is run again sees its rows in the same order.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield block.rows(n)

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = piece_encoder(ranks, pattern), {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                yield ids_row(row, encoder, known) if row.column("kind")[0].as_py() == WORDS else without_bucket(row)

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, table = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column("block")[i].as_py()
                if name != block:
                    block, parts, table = name, [], None
                if batch.column("kind")[i].as_py() == WORDS:
                    parts.append(batch.column("data")[i].as_py())
                    continue
                table = table or id_table(parts)
                yield from documents(batch.column("ids").slice(i, 1).flatten(), batch.column("data")[i].as_py(), table, id_col)

    columns = f"block string, kind int, data binary, ids array<{id_type}>"
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(cut, f"bucket int, {columns}, bytes binary")
    met = rows.repartition(n, "bucket").mapInArrow(encode_words, columns)
    return met.repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(reassemble, f"`{id_col}` {id_type}, ids array<int>")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    block = Block()
    for batch in batches:
        for i, text in enumerate(batch.column(1)):
            raw = text.as_buffer()
            if block.size and block.size + len(raw) > BLOCK_BYTES:
                yield block
                block = Block()
            block.add(batch.column(0).slice(i, 1), raw)
    if block.ids:
        yield block


class Block:
    """Documents as numbers of words; their texts are not held."""

    def __init__(self):
        self.size, self.ids, self.lists = 0, [], []
        self.numbers, self.name = Numbers(), xxhash.xxh3_128()

    def add(self, doc_id: pa.Array, raw: pa.Buffer) -> None:
        self.ids.append(pa.array(doc_id.to_pylist(), doc_id.type))  # a copy, which does not hold on to the batch
        self.name.update(len(raw).to_bytes(8, "little"))
        self.name.update(memoryview(raw))
        self.lists.append(np.array(self.numbers.of(str(raw, "utf-8")), np.int32))
        self.size += len(raw)

    def rows(self, buckets: int) -> pa.RecordBatch:
        """A row for each bucket of the block's words, and one with its documents."""
        names, found = self.numbers.names, np.concatenate(self.lists)
        order = np.argsort(-np.bincount(found, minlength=len(names)), kind="stable")  # frequent words get small numbers
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order))
        held = pa.concat_arrays(self.ids)
        self.name.update(str(held.to_pylist()).encode())
        block = self.name.hexdigest()
        bucket = np.array([zlib.crc32(names[i].encode("utf-8")) for i in order.tolist()], np.int64) % buckets
        by_bucket = np.argsort(bucket, kind="stable")
        rows = []
        for part in np.split(by_bucket, np.flatnonzero(np.diff(bucket[by_bucket])) + 1) if len(by_bucket) else []:
            mine = [names[i].encode("utf-8") for i in order[part].tolist()]
            data = packed(np.diff(part, prepend=0), np.array([len(w) for w in mine]))
            rows.append((int(bucket[part[0]]), block, WORDS, data, zstandard.compress(b"".join(mine), 9)))
        texts = packed(number[found], np.array([len(x) for x in self.lists]))
        rows.append((zlib.crc32(block.encode()) % buckets, block, TEXTS, texts, None))
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), ROW, strict=True)]
        sizes = [0] * (len(rows) - 1) + [len(held)]
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        columns = [*columns[:4], pa.ListArray.from_arrays(offsets, held), columns[4]]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "block", "kind", "data", "ids", "bytes"])


def without_bucket(row: pa.RecordBatch) -> pa.RecordBatch:
    return row.select(["block", "kind", "data", "ids"])


def ids_row(row: pa.RecordBatch, encoder: PieceEncoder, known: dict[bytes, bytes]) -> pa.RecordBatch:
    """Words of a block replaced by their ids; ``known``: those of the words met before in this task."""
    numbers, lengths = unpacked(row.column("data")[0].as_py(), 2)
    raw, at, ids = zstandard.decompress(row.column("bytes")[0].as_py()), 0, []
    for length in lengths.tolist():
        word = raw[at : at + length]
        at += length
        if (found := known.get(word)) is None:
            found = known[word] = encoder.word(str(word, "utf-8"))
        ids.append(found)
    data = packed(numbers, np.array([len(x) // 4 for x in ids]), np.frombuffer(b"".join(ids), "<u4"))
    out = without_bucket(row)
    return out.set_column(2, "data", pa.array([data], pa.binary()))


def id_table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's words by number: all their ids, where each one's begin, how many it has."""
    found = [unpacked(p, 3) for p in parts]
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = np.concatenate([np.cumsum(f[0].astype(np.int64)) for f in found])
    length = np.concatenate([f[1] for f in found]).astype(np.int64)
    values = np.concatenate([f[2] for f in found]).astype(np.int32)
    starts, lengths = np.zeros(number.max() + 1, np.int64), np.zeros(number.max() + 1, np.int64)
    starts[number], lengths[number] = np.cumsum(length) - length, length
    return values, starts, lengths


def documents(ids: pa.Array, data: bytes, table: tuple[np.ndarray, np.ndarray, np.ndarray], id_col: str) -> Iterator[pa.RecordBatch]:
    found, sizes = unpacked(data, 2)
    ends = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    first = 0
    while first < len(ids):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + OUT_IDS // 4, side="right")) - 1)
        values, each = joined_lists(*table, found[ends[first] : ends[last]])
        upto = np.concatenate([[0], np.cumsum(each)])
        offsets = pa.array(upto[ends[first : last + 1] - ends[first]].astype(np.int32))
        yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.ListArray.from_arrays(offsets, pa.array(values))], [id_col, "ids"])
        first = last


def decode(encoded: DataFrame, ranks: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for. A null list has none; an id out of the table is an error."""

    def join_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = ranks_of(ranks)
        length = np.zeros(max(by_rank.values()) + 1, np.int64)
        for token, rank in by_rank.items():
            length[rank] = len(token)
        values = np.frombuffer(b"".join(sorted(by_rank, key=by_rank.get)), np.uint8)
        starts = np.cumsum(length) - length
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lists = batch.column(ids_col)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(length)):
                    raise ValueError("an id is not in the table of tokens")
                data, each = joined_lists(values, starts, length, ids)
                counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                upto = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
                decoded = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(upto), pa.py_buffer(data)])
                yield batch.append_column(bytes_col, decoded)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(join_bytes, f"{schema}, `{bytes_col}` binary")
