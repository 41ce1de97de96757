"""Packing documents into sequences of bounded length, shortest pack first over the histogram of lengths.

Only the histogram (as many rows as a sequence has tokens, at most) reaches the driver. There, lengths are placed from
the longest down, each into the packs that are shortest so far and still have room; packs of one kind are held as a
count, not one by one. What results is a list of slots: "pieces of length L with ranks a to b go to sequences c to d, at
offset o". Pieces find their slot by their rank among the pieces of their length.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewash.llm.common import in_batches, ranked, text_of
from orewash.llm.words import word_tokens
from orewash.scratch import written

MAX_LENGTH = 2048
END_ID = 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, max_length: int = MAX_LENGTH, tail_unit: int = 128, with_ids: bool = False) -> DataFrame:
    """Each document's ids, then ``END_ID``, cut into pieces.

    Pieces are full sequences first; what is left over is cut once more at the last multiple of ``tail_unit``, which
    gives the packing short pieces to fill gaps with.
    """
    out = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
    if with_ids:
        out = out.append(pa.field("ids", pa.list_(pa.int32())))
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)

        def rows():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    data = tokens.ids(text.as_buffer().to_pybytes()) + end
                    n, start = len(data) // 4, 0
                    while start < n:
                        length = min(max_length, n - start)
                        if tail_unit < length < max_length and length % tail_unit:
                            length -= length % tail_unit
                        part = data[4 * start : 4 * (start + length)]
                        row = (doc_id, start, length, zlib.crc32(part), n)
                        yield (*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row
                        start += length

        yield from in_batches(rows(), out, weight=lambda r: 64 + (4 * r[2] if with_ids else 0))
        tokens.forget()

    source = docs.select(F.col("doc_id").cast("long"), F.encode(text_of(), "UTF-8").alias("text"))
    return source.mapInArrow(cut, PIECE + (", ids array<int>" if with_ids else ""))


def place(histogram: dict[int, int], max_length: int = MAX_LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, count, first sequence, offset) for pieces counted by length.

    Each step uses up a length or moves a whole kind of pack on, so the list grows with the number of different
    lengths and of pieces in a pack, not with the number of pieces.
    """
    packs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room left: (count, first sequence)
    rooms: list[int] = []
    slots, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            while rooms and not packs[-rooms[0]]:
                heapq.heappop(rooms)
            room = -rooms[0] if rooms else 0
            if room >= length:
                count, first = packs[room].pop()
                if count > left:
                    packs[room].append((count - left, first + left))
                    count = left
            else:
                room, count, first = max_length, left, sequences
                sequences += left
            slots.append((length, rank, count, first, max_length - room))
            rank, left = rank + count, left - count
            if room > length:
                packs[room - length].append((count, first))
                heapq.heappush(rooms, length - room)
    return slots


def pack(parts: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """Pieces (a ``length`` from 1 to ``max_length``; doc_id, start and ids_crc32 to tell them apart) with sequence_id and offset.

    Offsets of a sequence are gapless from 0. ``parts`` is read several times: hand over a written table.
    """
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    slots = sorted(place(histogram, max_length))
    lengths, ranks, counts, firsts, offsets = (np.array(c, np.int64) for c in (zip(*slots, strict=True) if slots else [()] * 5))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A slot's number: of the last one that begins at or before (length, rank).
        starts = np.searchsorted(lengths, np.arange(max_length + 2))
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            at = np.empty(len(rank), np.int64)
            for n in np.unique(length):
                mine = length == n
                a, b = starts[n], starts[n + 1]
                at[mine] = a + np.searchsorted(ranks[a:b], rank[mine], side="right") - 1
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(firsts[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    ordered = ranked(parts, ["length"], ["doc_id", "start", "ids_crc32"], sum(histogram.values()), "_rank")
    kept = [c for c in parts.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return ordered.select(*kept, "_rank").mapInArrow(find, schema)


def pack_documents(docs: DataFrame, tokenizer: str, max_length: int = MAX_LENGTH) -> DataFrame:
    """All documents as pieces in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Text that is null or empty is one piece of one id. Very long texts give many pieces. Repeated rows are packed each
    for itself; a null doc_id stays null. Other columns are ignored. No documents give no rows.
    """
    return pack(written(pieces(docs, tokenizer, max_length), "pieces"), max_length)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed ids: sequence_id and ids, from pieces that carry their ids. A sequence's rows are bounded by its length."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
