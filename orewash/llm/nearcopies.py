"""Near copies by Order MinHash, verified by banded alignment.

A text's shingles of ``WIDTH`` words are labelled by their occurrence, so a repeated shingle counts as often as it
stands there. Each of ``SKETCHES`` sketches takes the ``SAMPLED`` shingles of smallest hash and keeps them in the order
of the text; texts of one sketch share its bucket. Order and repetition bear on edits, as alignment does. The sketches
are as many as it takes for texts that differ in a fifth of their words to meet in nine cases of ten.

Before any text is moved, two texts' words are compared by counters: half of what those differ by is a lower bound of the
edits. Buckets are gone through in two rounds. In the first, over some of the sketches, each text is paired with one other
of its bucket at most, of a bucket of more than ``LARGE`` texts with one of its first texts, its leaders. What that links is
one class. In the second round, over all sketches, a text is paired with every text of its bucket that is still in another
class. A large bucket that is not of one class by then, such as a passage gathers that stands in many texts, is cut by the
texts' length, since those of very different lengths are not alike, and into parts; every two parts meet in a task of their
own, to which the words come along: what the counters leave is aligned there, and only links that join two classes leave the
task, fewer than it has texts. A pair that shares several such buckets is looked at in one of them. So no pair of a bucket is
left out, and rows grow with the members of buckets, not with their pairs; alignments do so except for texts that share a bucket
and their words but are not alike. Equal texts are one from the start.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orewash.llm.common import text_of
from orewash.llm.lines import dense_ranks
from orewash.llm.substrings import MIX, Hashes, mixed
from orewash.scratch import written

WIDTH = 5
SKETCHES = 72
SAMPLED = 2
FIRST_SKETCHES = 12  # the first round's
SIMILARITY = 0.8
LARGE = 128  # a bucket of more texts is gone through by its leaders first, then part by part
LEADERS = 16  # texts of a large bucket that all its others are compared with
PART = 2048  # texts of a large bucket in one task
GROUP = 100  # texts aligned with one leader in a task
COUNTERS = 128
TRIES = 4  # pairs of two classes that are aligned before the others of these classes
WIDE = 1024  # counters of texts in large buckets, a multiple of the others
TOGETHER = 4096  # texts of a large bucket that meet in one task
WORDS_TOGETHER = 1 << 23  # their words, if these come along; a longer text meets others all the same
NO_ID = -(1 << 63)
SEEDED = 1 << 20
SLIDE = 512  # words that a match is followed by at once


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Hashes of shingles with their occurrence: equal ones become different, in the order of the text."""
    order = np.argsort(shingles, kind="stable")
    sorted_ = shingles[order]
    first = np.append(True, sorted_[1:] != sorted_[:-1])
    at = np.arange(len(order))
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return mixed(shingles + mixed(occurrence))


SEEDS = np.random.default_rng(11).integers(0, 1 << 32, SKETCHES, np.uint32) | np.uint32(1)  # an order of shingles for each sketch


def sketches(hashes: np.ndarray, which: np.ndarray, sampled: int = SAMPLED) -> np.ndarray:
    """The Order MinHash of a text given by its words' hashes, one number for each of the sketches ``which``.

    Texts of few words count as one shingle.
    """
    width = min(WIDTH, len(hashes))
    n = len(hashes) - width + 1 if width else 1
    shingles = np.full(n, width, np.uint64)
    for j in range(width):
        shingles = shingles * MIX + hashes[j : j + n]
    shingles = labelled(mixed(shingles))
    if n > sampled:
        short, seeds = (shingles >> np.uint64(32)).astype(np.uint32), SEEDS[which]
        at_once = max(1, SEEDED // n)  # long texts go by fewer sketches at once
        least = np.concatenate([smallest(short[None, :] * seeds[i : i + at_once, None], sampled) for i in range(0, len(seeds), at_once)])
    else:
        least = np.tile(np.arange(n), (len(which), 1))
    chosen = shingles[np.sort(least, axis=1)]
    out = mixed(which.astype(np.uint64) + np.uint64(1))
    for j in range(chosen.shape[1]):
        out = mixed(out + chosen[:, j])
    return out.astype(np.int64)


def smallest(values: np.ndarray, k: int) -> np.ndarray:
    """Where each row has its ``k`` smallest values; ``values`` are overwritten."""
    if k > 2:
        return np.argpartition(values, k - 1, axis=1)[:, :k]
    rows, found = np.arange(len(values)), []
    for _ in range(k):
        found.append(values.argmin(axis=1))
        values[rows, found[-1]] = np.iinfo(values.dtype).max
    return np.stack(found, axis=1)


def counters(hashes: np.ndarray, n: int = COUNTERS) -> np.ndarray:
    """How many words fall to each counter, 255 standing for all beyond."""
    return np.minimum(np.bincount((hashes >> np.uint64(20)) % np.uint64(n), minlength=n), 255).astype(np.uint8)


def possible(words: np.ndarray, counts: np.ndarray, of: int, similarity: float) -> np.ndarray:
    """Which texts can be alike to text ``of`` as far as their lengths and counters tell.

    If so many words of one are to become those of the other, the counters differ by no more; see ``alike``.
    """
    longer = np.maximum(words, words[of])
    apart = np.abs(counts - counts[of]).sum(1, dtype=np.int64)
    common = (words + words[of] - apart) / 2
    return longer - common <= np.floor((1 - similarity) * longer + 1e-9)


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance (words put in, left out, replaced) if it is ``most`` or less, by diagonals within a band of ``most``.

    For each number of edits, the furthest point on each diagonal is kept; all diagonals go on at once. Those from which the
    end cannot be reached with the edits that are left fall away.
    """
    n, m = len(a), len(b)
    end = m - n
    if abs(end) > most:
        return None
    # Beyond its end each text goes on with a word that no text has, so no match goes further.
    a, b = np.append(a, np.zeros(SLIDE, a.dtype)), np.append(b, np.ones(SLIDE, b.dtype))

    def slid(i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How far along a the matches from (i, i + k) go."""
        i, going, ahead = i.copy(), np.arange(len(i)), 8
        while len(going):
            at, steps = i[going, None], np.arange(ahead)
            inside = np.minimum(at + steps, n), np.minimum(at + k[going, None] + steps, m)
            differ = a[inside[0]] != b[inside[1]]
            run = np.where(differ.any(1), differ.argmax(1), ahead)
            i[going] += run
            going, ahead = going[run == ahead], min(4 * ahead, SLIDE)
        return i

    furthest = np.full(2 * most + 5, -2)  # by diagonal, from -most - 2 on
    zero = most + 2
    furthest[zero] = slid(np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
    for edits in range(most + 1):
        if furthest[zero + end] >= n:
            return edits
        left = most - edits - 1
        low, high = max(-edits - 1, -n, end - left), min(edits + 1, m, end + left)
        if low > high:
            return None
        around = furthest[zero + low - 1 : zero + high + 2]
        k = np.arange(low, high + 1)
        i = np.maximum(np.maximum(around[1:-1] + 1, around[:-2]), around[2:] + 1)
        i = np.minimum(np.minimum(i, n), m - k)
        fits = i >= np.maximum(0, -k)
        following = np.full(len(k), -2)
        following[fits] = slid(i[fits], k[fits])
        furthest[:] = -2
        furthest[zero + low : zero + high + 1] = following
    return None


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether 1 - edit distance / longer length reaches ``similarity``.

    Texts of one length that differ in few places are so without a look beside the main diagonal; too few common words rule
    it out beforehand.
    """
    longer = max(len(a), len(b))
    most = int(np.floor((1 - similarity) * longer + 1e-9))
    if len(a) == len(b) and np.count_nonzero(a != b) <= most:
        return True
    values, owner = np.unique(np.concatenate([a, b]), return_inverse=True)
    common = np.minimum(np.bincount(owner[: len(a)], minlength=len(values)), np.bincount(owner[len(a) :], minlength=len(values))).sum()
    return longer - common <= most and distance(a, b, most) is not None


def identity() -> dict[str, Column]:
    """A document, and 128 bits of its text's hash."""
    return {
        "doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
        "t1": F.xxhash64(text_of()),
        "t2": F.xxhash64(F.lit(1), text_of()),
    }


def text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(*[c.alias(n) for n, c in identity().items()], F.encode(text_of(), "UTF-8").alias("text"))


def sketched(docs: DataFrame) -> DataFrame:
    """Different texts as (t1, t2, doc, rows, words, counts, keys): the first document that has the text, how many rows have
    it, its length, its counters, and its sketches."""
    which = np.arange(SKETCHES)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                keys, words, counts = [], [], []
                for text in batch.column("text"):
                    own = hashes.of(text.as_buffer().to_pybytes().split())
                    words.append(len(own))
                    counts.append(counters(own).tobytes())
                    keys.append(sketches(own, which))
                columns = [batch.column(c) for c in ("doc", "t1", "t2")]
                columns += [pa.array(words, pa.int64()), pa.array(counts, pa.binary()), lists(keys)]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "t1", "t2", "words", "counts", "keys"])

    rows = text_rows(docs).mapInArrow(sketch, "doc long, t1 long, t2 long, words long, counts binary, keys array<long>")
    same = [F.first(c).alias(c) for c in ("words", "counts", "keys")]
    return rows.groupBy("t1", "t2").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("rows"), *same)


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def in_buckets(keyed: DataFrame, depth: int = SAMPLED) -> DataFrame:
    """``keyed`` (rep, sketch, key) reduced to buckets of several texts: (bucket, sketch, rep, n)."""
    bucket = F.xxhash64("sketch", F.lit(depth), "key").alias("bucket")
    named = keyed.select(bucket, "sketch", "rep")
    shared = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return written(named.join(shared, "bucket").select("bucket", "sketch", "rep", "n"), "near-buckets")


def mixed_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with their ``class`` by ``found`` (rep, class), without the buckets that are of one class."""
    classed = members.join(found, "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    several = classed.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    return classed.join(several.select("bucket"), "bucket", "left_semi")


def no_words() -> list[Column]:
    return [F.lit("").cast("binary").alias(c) for c in ("hashes", "places")]


def by_leaders(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows for ``compared``: buckets as they are, large ones dealt into parts that all have the bucket's first texts."""
    parts = F.when(F.col("n") > LARGE, F.ceil(F.col("n") / PART)).otherwise(1).cast("int")
    split = members.select("bucket", "rep", "n", parts.alias("parts"))
    dealt = split.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("leads", F.col("n") <= LARGE)
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("rep"))
    leaders = split.where(F.col("n") > LARGE).withColumn("place", place).where(F.col("place") <= LEADERS).drop("place")
    leaders = leaders.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("leads", F.lit(True))
    seen = dealt.unionByName(leaders).join(texts, "rep")
    return seen.select("bucket", "part", "rep", F.col("rep").alias("class"), "words", "counts", "leads", *no_words())


def in_words(large: DataFrame, bodies: DataFrame) -> DataFrame:
    """(rep, counts, hashes, places) of the texts in ``large``: no counters, for their words' hashes come along, and the buckets
    that the text has there, a number for each sketch, 0 for none."""

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            own = [hashes.of(t.as_buffer().to_pybytes().split()).astype(np.uint64).tobytes() for t in batch.column("text")]
            places = np.zeros((batch.num_rows, SKETCHES), np.int64)
            of = np.repeat(np.arange(batch.num_rows), batch.column("sketch").value_lengths().to_numpy())
            places[of, batch.column("sketch").flatten().to_numpy()] = batch.column("bucket").flatten().to_numpy()
            columns = [pa.array([b""] * batch.num_rows, pa.binary()), pa.array(own, pa.binary())]
            columns.append(pa.array([row.tobytes() for row in places], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), *columns], ["rep", "counts", "hashes", "places"])

    found = large.groupBy("rep").agg(F.collect_list(F.struct("sketch", "bucket")).alias("found"))
    wanted = bodies.join(found, "rep").select("rep", "text", "found.sketch", "found.bucket")
    return wanted.mapInArrow(hash_, "rep long, counts binary, hashes binary, places binary")


def in_meetings(large: DataFrame, similarity: float) -> DataFrame:
    """``large`` (bucket, rep, class, words, counts, hashes, places, n, weight) as (bucket, part, ..., leads), so that every two
    texts of a bucket that can be alike by their length meet in a part of ``TOGETHER`` texts, or in two of half as many.

    ``weight`` is the bucket's words, 0 if they stay behind; a part has about ``WORDS_TOGETHER`` of them at most. A bucket that is
    larger, or heavier, is cut into bands of length, so wide that texts that are alike are in one band or in two that adjoin. A
    band meets itself and the next one, part by part; two parts that meet do not lead both.
    """
    base = ["rep", "class", "words", "counts", "hashes", "places"]
    fits = (F.col("n") <= TOGETHER) & (F.col("weight") <= WORDS_TOGETHER)
    whole = large.where(fits).select("bucket", F.lit(0).cast("long").alias("part"), *base, F.lit(True).alias("leads"))
    width = max(0.01, -math.log(max(similarity, 1e-9))) + 1e-6  # alike texts' lengths are no further apart, as logarithms
    band = F.when(F.col("words") > 0, F.floor(F.log("words") / width)).otherwise(-2)  # a text of no words is alike to none
    banded = large.where(~fits).withColumn("band", band.cast("long"))
    own_words = F.sum(F.when(F.col("weight") > 0, F.col("words")).otherwise(0))
    parts_of = F.greatest(F.ceil(F.count(F.lit(1)) / (TOGETHER // 2)), F.ceil(own_words / (WORDS_TOGETHER // 2)))
    sizes = banded.groupBy("bucket", "band").agg(parts_of.alias("own"))
    below = sizes.select("bucket", (F.col("band") + 1).alias("band"), F.col("own").alias("before"))
    above = sizes.select("bucket", (F.col("band") - 1).alias("band"), F.col("own").alias("after"))
    around = sizes.join(below, ["bucket", "band"], "left").join(above, ["bucket", "band"], "left")
    dealt = banded.join(around, ["bucket", "band"]).withColumn("at", F.pmod(F.xxhash64("rep"), F.col("own")))

    def parts(n: str) -> Column:
        none = F.array().cast("array<bigint>")
        return F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(none)

    def meeting(lower: Column, apart: int, one: Column, other: Column, leads: Column) -> Column:
        """The lower band, whether the other part is of the next one, both parts, and whether this is the part that leads."""
        return F.struct(F.xxhash64(lower, F.lit(apart), one, other).alias("part"), leads.alias("leads"))

    at, own = F.col("at"), F.col("band")
    meetings = F.concat(
        F.transform(parts("own"), lambda p: meeting(own, 0, F.least(at, p), F.greatest(at, p), at <= p)),
        F.transform(parts("after"), lambda p: meeting(own, 1, at, p, F.lit(True))),
        F.transform(parts("before"), lambda p: meeting(own - 1, 1, p, at, F.lit(False))),
    )
    met = dealt.withColumn("meeting", F.explode(meetings))
    return whole.unionByName(met.select("bucket", "meeting.part", *base, "meeting.leads"))


ROWS = ["bucket", "part", "rep", "class", "words", "counts", "leads", "hashes", "places"]


def in_small(members: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame:
    """``ROWS`` of the buckets that are not large. ``found``: (rep, class); buckets of one class are left out."""
    small = mixed_buckets(members.where(F.col("n") <= LARGE), found).join(texts, "rep")
    return small.select("*", F.lit(0).cast("long").alias("part"), F.lit(True).alias("leads"), *no_words()).select(*ROWS)


def in_large(members: DataFrame, texts: DataFrame, found: DataFrame, similarity: float, bodies: DataFrame | None = None) -> DataFrame | None:
    """``ROWS`` of the large buckets, in parts; none if all are of one class by ``found`` (rep, class).

    With ``bodies`` (rep, text) the words come along, and ``places``, all large buckets of a text.
    """
    known = texts.select("rep", "words").join(found, "rep", "left")  # lengths come with the classes, not by a join of their own
    large = written(mixed_buckets(members.where(F.col("n") > LARGE), known), "near-large")
    if large.isEmpty():
        return None
    if bodies is None:
        counted = large.join(texts.drop("words"), "rep").select("*", *no_words(), F.lit(0).cast("long").alias("weight"))
    else:
        weights = large.groupBy("bucket").agg(F.sum("words").alias("weight"))
        counted = large.join(weights, "bucket").join(written(in_words(large, bodies), "near-words"), "rep")
    return in_meetings(counted, similarity).select(*ROWS)


def compared(members: DataFrame, texts: DataFrame, found: DataFrame | None, similarity: float, bodies: DataFrame | None = None) -> DataFrame:
    """The different ones of ``met``."""
    return met(members, texts, found, similarity, bodies).distinct()


def met(members: DataFrame, texts: DataFrame, found: DataFrame | None, similarity: float, bodies: DataFrame | None = None) -> DataFrame:
    """Pairs (leader, member) of different classes in a bucket that can be alike, leader < member.

    Without ``found`` a text is paired with one text of a bucket at most: the first of those before it that it can be alike
    to, in a large bucket one of the bucket's first texts. With it (rep, class) every pair of different classes counts, in
    buckets of whatever size, once where it shares several large ones. ``texts``: (rep, words, counts); ``bodies``: (rep, text),
    to tell more of large buckets' texts.
    """
    if found is None:
        return pairs_in(by_leaders(members, texts), similarity, every=False)
    small, large = in_small(members, texts, found), in_large(members, texts, found, similarity, bodies)
    return pairs_in(small if large is None else small.unionByName(large), similarity)


class Part:
    """The texts of a bucket, or of a part of one, that meet in a task."""

    def __init__(self, group: pa.Table):
        self.rep, self.class_, self.words = (group.column(c).to_numpy() for c in ("rep", "class", "words"))
        self.leads = group.column("leads").to_numpy(zero_copy_only=False)
        n, places = len(self.rep), b"".join(group.column("places").to_pylist())
        self.places = np.frombuffer(places, np.int64).reshape(n, -1)
        if places:
            self.hashes = [np.frombuffer(t, np.uint64) for t in group.column("hashes").to_pylist()]
            counts = np.stack([counters(own, WIDE) for own in self.hashes])
            self.sketch = np.flatnonzero(self.places[0] == group.column("bucket")[0].as_py())[0]
        else:
            counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.uint8).reshape(n, -1)
        self.counts = counts.astype(np.int16)
        self.few = self.counts.reshape(n, -1, COUNTERS).sum(1, dtype=np.int16)

    def first_of(self, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
        """Leading texts with those that can be alike to them and to no earlier one."""
        free = np.ones(len(self.rep), bool)
        for i in np.flatnonzero(self.leads):
            if free[i]:
                fits = free & (self.rep != self.rep[i]) & possible(self.words, self.few, i, similarity)
                free[i] = False
                free &= ~fits
                yield i, np.flatnonzero(fits & (self.class_ != self.class_[i]))

    def all_of(self, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
        """Leading texts with all of other classes that can be alike, each pair once; where it shares several buckets, in one
        that the two texts' numbers tell. Two parts that meet are compared with each other, not within."""
        apart = not self.leads.all()
        for i in np.flatnonzero(self.leads):
            others = ~self.leads if apart else self.rep > self.rep[i]
            chosen = np.flatnonzero((self.class_ != self.class_[i]) & others)
            for looked in (self.few, self.counts):  # more counters for those that the first ones leave
                near = np.append(chosen, i)
                chosen = chosen[possible(self.words[near], looked[near], len(chosen), similarity)[:-1]]
            if self.places.shape[1] and len(chosen):
                shared = ((self.places[chosen] == self.places[i]) & (self.places[i] != 0)).cumsum(1)
                low, high = np.minimum(self.rep[chosen], self.rep[i]), np.maximum(self.rep[chosen], self.rep[i])
                turn = mixed(mixed(low.astype(np.uint64)) + high.astype(np.uint64)) % shared[:, -1].astype(np.uint64)
                chosen = chosen[shared[:, self.sketch] == turn.astype(np.int64) + 1]
            yield i, chosen

    def links(self, similarity: float) -> Iterator[tuple[int, int]]:
        """Pairs that are alike, without those whose classes earlier ones join: fewer than there are texts."""
        label = self.class_.copy()
        for i, chosen in self.all_of(similarity):
            for j in chosen:
                if label[i] != label[j] and alike(self.hashes[i], self.hashes[j], similarity):
                    label[label == label[j]] = label[i]
                    yield i, j


def by_parts(rows: DataFrame, of: Callable[[Part], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(leader, member), leader < member, of the pairs that ``of`` finds in each part of ``rows``."""

    def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        both = np.concatenate([np.zeros((2, 0), np.int64), *(np.stack(x) for x in of(Part(pa.Table.from_batches(held))))], axis=1)
        both = np.unique(np.sort(both, axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["leader", "member"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "part")])
            edges = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))) if batch.num_rows else []
            for start, stop in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                here = tuple(keys[:, start])
                if held and here != place:
                    yield found(held)
                    held = []
                place = here
                held.append(batch.slice(start, stop - start))
        if held:
            yield found(held)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part", F.desc("leads"), "rep")
    return ordered.mapInArrow(pair, "leader long, member long")


def pairs_in(rows: DataFrame, similarity: float, every: bool = True) -> DataFrame:
    """Pairs of ``ROWS`` that can be alike: every one, or one for each text of a part."""

    def of(part: Part) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, chosen in part.all_of(similarity) if every else part.first_of(similarity):
            yield np.full(len(chosen), part.rep[i]), part.rep[chosen]

    return by_parts(rows, of)


def links_in(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs of ``ROWS``, of texts whose words came along, that are alike: as many as join what a part joins."""

    def of(part: Part) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in part.links(similarity):
            yield part.rep[[i]], part.rep[[j]]

    return by_parts(rows, of)


def aligned(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (leader, member) with whether their texts are alike. ``texts``: (rep, text).

    Each text travels to each of its leaders; a leader's own text goes to as many groups as its members fill.
    """
    groups = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("n"))
    dealt = pairs.join(groups, "leader").select(
        F.col("member").alias("rep"), "leader", F.pmod(F.xxhash64("member"), F.col("n")).cast("int").alias("group"), F.lit(1).alias("role")
    )
    leading = groups.select(
        F.col("leader").alias("rep"), "leader", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("group"), F.lit(0).alias("role")
    )
    sent = dealt.unionByName(leading).join(texts, "rep")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, leader, words = Hashes(), None, None
        for batch in batches:
            found = []
            names = zip(*(batch.column(c).to_pylist() for c in ("leader", "rep", "role")), batch.column("text"), strict=True)
            for of, rep, role, text in names:
                own = hashes.of(text.as_buffer().to_pybytes().split())
                if role == 0:
                    leader, words = of, own
                elif leader == of:
                    found.append((of, rep, alike(words, own, similarity)))
                else:
                    raise ValueError("a leader's text is missing")
            columns = list(zip(*found, strict=True)) if found else [(), (), ()]
            types = (pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["leader", "member", "alike"])

    ordered = sent.select("leader", "group", "role", "rep", "text").repartition(n, "leader", "group")
    return ordered.sortWithinPartitions("leader", "group", "role").mapInArrow(compare, "leader long, member long, alike boolean")


def rough_classes(links: DataFrame) -> DataFrame:
    """(rep, class) of members: a text that links lead to, not always the smallest. Two steps along smallest leaders."""
    up = links.groupBy(F.col("member").alias("rep")).agg(F.min("leader").alias("class"))
    for _ in range(2):
        next_ = up.select(F.col("rep").alias("class"), F.col("class").alias("further"))
        up = up.join(next_, "class", "left").select("rep", F.coalesce("further", "class").alias("class"))
    return written(up, "near-rough")


def classes(links: DataFrame, rough: DataFrame) -> DataFrame:
    """(rep, class) for the ends of ``links`` (leader, member): the smallest end that links lead to.

    What is one class by ``rough`` is one from the start, so few links are left. Labels are lowered along those and then
    replaced by their own labels, until nothing changes; a round's labels are written, and no task gets more than counts of
    a popular text's links.
    """
    known = links.select("leader", "member")
    for end in ("leader", "member"):
        to = rough.withColumnsRenamed({"rep": end, "class": "to"})
        known = known.join(to, end, "left").withColumn(end, F.coalesce("to", end)).select("leader", "member")
    known = known.where("leader <> member")
    both = written(known.unionByName(known.select(F.col("member").alias("leader"), F.col("leader").alias("member"))).distinct(), "near-links")
    if both.isEmpty():
        return rough
    labels = written(both.groupBy(F.col("leader").alias("rep")).agg(F.least(F.first("leader"), F.min("member")).alias("class")), "near-labels")
    while True:
        lowered = (
            both.join(labels.withColumnRenamed("rep", "member"), "member")
            .groupBy(F.col("leader").alias("rep"))
            .agg(F.min("class").alias("by_links"))
            .join(labels, "rep")
            .select("rep", F.col("class").alias("was"), F.least("class", "by_links").alias("class"))
        )
        jumped = lowered.join(labels.select(F.col("rep").alias("class"), F.col("class").alias("further")), "class", "left").select(
            "rep", "was", F.least("class", "further").alias("class")
        )
        following = written(jumped, "near-labels")
        labels = following.select("rep", "class")
        if following.where(F.col("was") != F.col("class")).isEmpty():
            break
    to = labels.select(F.col("rep").alias("class"), F.col("class").alias("to"))
    inside = rough.join(to, "class", "left").select("rep", F.coalesce("to", "class").alias("class"))
    return written(inside.unionByName(labels.join(rough.select("rep"), "rep", "left_anti")), "near-classes")


def between(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``pairs`` (leader, member) that are of different classes by ``found`` (rep, class): with ``low`` and ``high``, these."""
    for end in ("leader", "member"):
        of_end = found.withColumnsRenamed({"rep": end, "class": f"{end}_class"})
        pairs = pairs.join(of_end, end, "left").withColumn(f"{end}_class", F.coalesce(f"{end}_class", end))
    both = pairs.where("leader_class <> member_class")
    ends = F.least("leader_class", "member_class").alias("low"), F.greatest("leader_class", "member_class").alias("high")
    return both.select("leader", "member", *ends)


def joined(bodies: DataFrame, pairs: DataFrame, found: DataFrame, similarity: float, links: DataFrame | None = None) -> DataFrame:
    """Classes ``found`` (rep, class) joined by ``links``, if any, and by those of ``pairs`` (both leader, member) that are alike.

    Of two classes a few pairs are aligned first; if one of them is alike, the others need not be.
    """
    turn = F.row_number().over(Window.partitionBy("low", "high").orderBy(F.xxhash64("leader", "member"), "leader", "member"))
    ranked = written(between(pairs, found).withColumn("turn", turn), "near-turns")
    for now in (F.col("turn") <= TRIES, F.col("turn") > TRIES):
        due = written(between(ranked.where(now).select("leader", "member"), found), "near-pairs")
        if not due.isEmpty():
            judged = written(aligned(bodies, due.select("leader", "member"), similarity), "near-judged").where("alike").select("leader", "member")
            links = judged if links is None else links.unionByName(judged)
        if links is not None:
            found, links = classes(links, found), None
    return found


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc, t1, t2, class, copies, leads): each document with the smallest doc of its class of near copies, the class's
    size, and whether it is the class's first text in that document (as often as its row is repeated).

    Texts are linked if they share a bucket and their alignment is ``similarity`` or more; a class is what links join. Two
    texts of shingle resemblance r share a bucket with a probability of 1 - (1 - r^2)^72: over 0.9 if a fifth of the words
    is replaced here and there (r = 0.2), 0.9999 from r = 0.4 on. Whole texts are compared, however long. Null text
    counts as empty; empty texts are one class. Repeated rows are in one class. A null doc_id stands before all others. Different
    texts of one doc_id are compared as any others; classes that begin in one doc_id have the same ``class``, told apart by
    the text that leads.
    Other columns are ignored; no documents give no rows.
    """
    # A text's number, in the order of its first document; texts of one doc_id have each their own.
    numbered = dense_ranks(written(sketched(docs), "near-sketches"), ["doc", "t1", "t2"]).withColumnRenamed("rank", "rep")
    texts = written(numbered.drop("keys"), "near-numbered")  # plans that read this anew are short
    members = in_buckets(numbered.select("rep", F.posexplode("keys").alias("sketch", "key")))
    involved = texts.select("rep", "doc", "t1", "t2").join(members.select("rep"), "rep", "left_semi")
    key = ["doc", "t1", "t2"]
    bodies = written(text_rows(docs).join(involved, key).dropDuplicates(key).select("rep", "text"), "near-texts")
    seen = texts.select("rep", "words", "counts")
    pairs = written(compared(members.where(F.col("sketch") < FIRST_SKETCHES), seen, None, similarity), "near-pairs")
    links = written(aligned(bodies, pairs, similarity), "near-judged").where("alike").select("leader", "member")
    linked = classes(links, rough_classes(links))
    large = in_large(members, seen, linked, similarity, bodies)
    sure = None if large is None else written(links_in(large, similarity), "near-links")
    left = pairs_in(in_small(members, seen, linked), similarity).distinct()
    found = joined(bodies, left.join(pairs, ["leader", "member"], "left_anti"), linked, similarity, sure)
    of_text = texts.join(found, "rep", "left").select("t1", "t2", "rep", "rows", F.coalesce("class", "rep").alias("number"))
    leaders = texts.select(F.col("rep").alias("number"), F.col("doc").alias("class"))
    sizes = of_text.groupBy("number").agg(F.sum("rows").alias("copies")).join(leaders, "number")
    classed = written(of_text.join(sizes, "number").select("t1", "t2", "rep", "number", "class", "copies"), "near-found")
    rows = docs.select(*[c.alias(n) for n, c in identity().items()]).join(classed, ["t1", "t2"])
    leads = ((F.col("rep") == F.col("number")) & (F.col("doc") == F.col("class"))).alias("leads")
    return rows.select("doc", "t1", "t2", "class", "copies", leads)
