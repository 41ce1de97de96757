"""Sharding by bytes: groups of equal texts, in the order of a hash, cut into contiguous shards of minimal capacity.

The smallest capacity is found by binary search; a capacity is checked by filling shards greedily in order, where a
group beyond the capacity has a shard to itself and does not raise that of the others. Under that capacity, cuts are then
made where what remains is shared evenly. The sizes never reach the driver whole. The largest groups, as many as there
are shards, are looked at one by one, all others are first summed over ranges of the hash; only ranges in which a cut can
still fall are summed again more finely, until every range there is one group. Each look at the data is one aggregate.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewash.llm.common import ranked, text_of
from orewash.scratch import written

KEY_BITS = 60
FIRST_BITS = 12
STEP_BITS = 6
FEW_GROUPS = 1 << 14  # so many are looked at one by one at once


@dataclass(frozen=True)
class Atoms:
    """Ranges of keys in order: first key, width in bits, bytes, groups."""

    key: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    groups: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.size)


def sized(docs: DataFrame) -> DataFrame:
    """Documents as (doc_id, size, text_crc32, key). ``key`` is 60 bits of the text's digest; equal keys stay together."""
    text = text_of()
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.conv(F.substring(F.sha2(text, 256), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
    )


def summed(groups: DataFrame, large: list[tuple[int, int]], bits: int, within: tuple[int, list[int]] | None = None) -> Atoms:
    """Groups summed over key ranges of ``bits`` bits, within the given ranges of more bits (in all, if none given).

    The ``large`` groups (key, size; sorted) are left out, and split the range that they stand in. At most 2^FIRST_BITS
    rows and one for each of these come back at first, later 2^STEP_BITS for each range that is opened, or FEW_GROUPS.
    """
    if within is not None:
        groups = groups.where(F.shiftright("key", within[0]).isin(within[1]))
    keys = [k for k, _ in large]
    behind = sum(((F.col("key") > F.lit(k)).cast("int") for k in keys), F.lit(0))
    rows = (
        groups.where(~F.col("key").isin(keys))
        .groupBy(F.shiftright("key", bits).alias("at"), behind.alias("behind"))
        .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("groups"))
        .collect()
    )
    found = [(max(r["at"] << bits, keys[r["behind"] - 1] + 1 if r["behind"] else 0), bits, r["size"], r["groups"]) for r in rows]
    return atoms_of(found)


def atoms_of(found: list[tuple[int, int, int, int]]) -> Atoms:
    return Atoms(*np.array(sorted(found), np.int64).reshape(-1, 4).T)


def whole_cuts(atoms: Atoms, ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Where greedy filling puts the ends of the shards, if atoms are not divided; a group beyond the capacity goes alone."""
    at, cuts = 0, []
    for _ in range(shards):
        j = bisect_right(ends, at + capacity)
        reach = int(ends[j - 1]) if j else 0
        if reach <= at and j < len(ends) and atoms.groups[j] == 1:
            reach = int(ends[j])
        at = max(at, reach)
        cuts.append(at)
    return cuts


def free_cuts(atoms: Atoms, ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """The furthest that greedy filling could come, if atoms of several groups could be divided anywhere."""
    at, cuts = 0, []
    for _ in range(shards):
        reach = min(at + capacity, int(ends[-1]))
        j = bisect_right(ends, reach)
        if j < len(ends) and atoms.groups[j] == 1:
            before = int(ends[j - 1]) if j else 0
            reach = before if before > at else int(ends[j])
        at = max(at, reach)
        cuts.append(at)
    return cuts


def even_cuts(atoms: Atoms, ends: np.ndarray, capacity: int, shards: int) -> tuple[list[int], np.ndarray]:
    """Ends of shards within the (least) capacity that share evenly what remains, and the atoms that bear on them.

    A shard ends at the bound nearest to its even share of what is left without the groups that go alone, not so early
    that the others would not fit, nor so late that a later shard would be empty though there are groups for it.
    """
    starts, total = ends - atoms.size, int(ends[-1])
    alone = (atoms.groups == 1) & (atoms.size > capacity)
    bears = np.zeros(len(ends), bool)
    earliest, back = [total], total
    for _ in range(shards - 1):  # from the end: where each shard has to begin at the earliest
        j = int(np.searchsorted(starts, max(0, back - capacity)))
        if j < len(starts):
            bears[max(0, j - 1) : j + 1] = True
        begin = int(starts[j]) if j < len(starts) else total
        if begin >= back:
            last = max(0, int(np.searchsorted(starts, back)) - 1)
            begin = int(starts[last]) if back and atoms.groups[last] == 1 else back
        back = min(back, begin)
        earliest.append(back)
    earliest.reverse()  # earliest[i]: the end of shard i
    at, cuts = 0, []
    behind = int(atoms.groups.sum()) - np.cumsum(atoms.groups)
    behind_alone = np.append(np.cumsum((atoms.size * alone)[::-1])[::-1], 0)
    number_alone = np.append(np.cumsum(alone[::-1])[::-1], 0)
    for i in range(shards - 1):
        a = int(np.searchsorted(starts, at))
        if a >= len(ends):
            break
        if alone[a]:
            at = int(ends[a])
            cuts.append(at)
            continue
        following = np.flatnonzero(alone[a:])
        barrier = int(starts[a + following[0]]) if len(following) else total
        share = (total - at - int(behind_alone[a])) / max(1, shards - i - int(number_alone[a]))
        target = at + share
        stretch = barrier - at
        if barrier < total:  # whole shards up to the group that goes alone
            target = at + stretch / max(1, round(stretch / share))
        furthest = bisect_right(ends, min(at + capacity, barrier))
        near = bisect_right(ends, target)
        enough = int(np.searchsorted(-behind, -(shards - i - 1), "right"))  # so many atoms leave a group for each shard behind
        for j in (near, near - 1, furthest, a, enough):
            if 0 <= j < len(ends):
                bears[j] = True
        choices = [int(ends[j]) for j in (near - 1, near) if a <= j < len(ends)]
        cut = min(choices, key=lambda e: (abs(e - target), e)) if choices else int(ends[a])
        high = int(ends[furthest - 1]) if furthest > a else int(ends[a])
        latest = min(high, int(ends[enough - 1]) if enough else 0)
        at = max(min(cut, latest), min(earliest[i], high), int(ends[a]))
        cuts.append(at)
    return cuts, bears


def least(feasible, low: int, high: int) -> int:
    """The least capacity from ``low`` to ``high`` that is feasible; ``high`` is known to be."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return low


def cut_keys(groups: DataFrame, shards: int) -> list[int]:
    """The first key of each shard but the first. ``groups``: (key, size), a row for each group."""
    # Only one of the largest groups, as many as there are shards, can be beyond the capacity.
    large = sorted((r["key"], r["size"]) for r in groups.orderBy(F.desc("size"), "key").limit(shards).collect())
    if not large:
        return []
    bits = KEY_BITS - FIRST_BITS
    coarse = summed(groups, large, bits)
    atoms = merged(coarse, np.zeros(len(coarse.key), bool), atoms_of([(k, 0, size, 1) for k, size in large]))
    low = high = None
    while True:
        ends = atoms.ends
        total = int(ends[-1])
        starts = ends - atoms.size
        if low is None or low < high:
            low = least(lambda c: free_cuts(atoms, ends, c, shards)[-1] == total, 0, total)
            high = least(lambda c: whole_cuts(atoms, ends, c, shards)[-1] == total, low, total)
            first, last = whole_cuts(atoms, ends, low, shards), free_cuts(atoms, ends, high, shards)
            open_ = np.zeros(len(ends), bool)
            for a, b in zip(first, last, strict=True):
                open_ |= (starts < b) & (ends > a)
            open_ &= (atoms.groups > 1) & (atoms.bits > 0)
        if low == high or not open_.any():
            low = high
            cuts, bears = even_cuts(atoms, ends, high, shards)
            open_ = bears & (atoms.groups > 1) & (atoms.bits > 0)
            if not open_.any():
                return [int(atoms.key[j]) for j in np.searchsorted(starts, cuts) if j < len(ends)]
        widest = int(atoms.bits[open_].max())
        # Atoms of one range that a large group splits are opened together.
        ranges = np.unique(atoms.key[open_ & (atoms.bits == widest)] >> widest)
        gone = (atoms.bits == widest) & np.isin(atoms.key >> widest, ranges)
        bits = 0 if atoms.groups[gone].sum() <= FEW_GROUPS else max(0, widest - STEP_BITS)
        atoms = merged(atoms, gone, summed(groups, large, bits, (widest, ranges.tolist())))


def merged(atoms: Atoms, gone: np.ndarray, others: Atoms) -> Atoms:
    """``atoms`` without those ``gone``, and ``others``, in order."""
    joined = [np.concatenate([getattr(atoms, c)[~gone], getattr(others, c)]) for c in ("key", "bits", "size", "groups")]
    order = np.argsort(joined[0], kind="stable")
    return Atoms(*(c[order] for c in joined))


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Documents in ``shards`` shards of nearly equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Equal texts share a shard (none counts as empty text); a shard's capacity is the smallest that contiguous filling
    in key order allows. A group beyond what the others need has a shard to itself, and they share the shards that are
    left about evenly. ``slot`` numbers a
    shard's rows from 0 without gaps. Rows with no doc_id and repeated rows each take a slot of their own; other
    columns of ``docs`` are ignored. No documents give no rows. ``grown_shard`` is always null under this law.
    """
    rows = sized(docs)
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")), "shard-groups")
    total = groups.agg(F.sum("rows")).first()[0] or 0
    shard = F.lit(0)
    for key in cut_keys(groups, shards):
        shard = shard + (F.col("key") >= F.lit(key)).cast("int")
    placed = rows.withColumn("shard", shard).drop("key")
    return ranked(placed, ["shard"], ["doc_id", "size", "text_crc32"], total, "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
