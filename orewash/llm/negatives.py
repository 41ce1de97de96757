"""Hard negatives by an R-tree that is packed by sort-tile-recursion, over inner products of whole numbers.

Vectors of one label are sorted by one coordinate into slabs, and each slab by another into tiles; a tile is a shard, and
its task packs it further, into leaves and nodes. Every node has its least box. Against an anchor, a box's coordinates
bound each product of coordinates, so their sums bound the inner products of all that lies in it. A search takes nodes
from a queue, the largest bound first, and passes over boxes that lie outside the window of scores that is asked for, or
strictly below the k-th best score held.

The shards' boxes are the tree's upper part. An anchor first asks one shard: its own one for positives, the most promising
one for negatives. Its k-th best score there is the floor by which boxes of other shards are left out; it goes on to
those that remain. Shards that many anchors ask are searched in several tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orewash.llm.lines import dense_ranks
from orewash.llm.whitening import matrix, whole_numbers
from orewash.scratch import written

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score
SHARD_ENTRIES = 1 << 19  # numbers in a shard: 8,192 vectors of 64
LEAF, FANOUT = 64, 16
SORTED_BY = 4  # coordinates that a shard is sorted and tiled by, those of largest variance
ASKED = 4096  # anchors that ask a shard in one task
BOXES = 1024  # shards' boxes that a task holds
NO_LIMIT = 1 << 62
EXACT = 1 << 53


# --- the tree of one shard -----------------------------------------------------------------------------------------


def tiled(x: np.ndarray, rows: np.ndarray, coordinates: list[int], leaf: int) -> list[np.ndarray]:
    """``rows`` in an order in which each next ``leaf`` of them lie together: sorted by a coordinate, cut into slabs, and so on."""
    if len(rows) <= leaf or not coordinates:
        return [rows]
    leaves = -(-len(rows) // leaf)
    slab = leaf * -(-leaves // int(np.ceil(leaves ** (1 / len(coordinates)))))
    ordered = rows[np.argsort(x[rows, coordinates[0]], kind="stable")]
    return [part for k in range(0, len(ordered), slab) for part in tiled(x, ordered[k : k + slab], coordinates[1:], leaf)]


def numbers(x: np.ndarray, largest: int) -> np.ndarray:
    """As floating point where inner products with entries up to ``largest`` are exact in it, else as Python's numbers."""
    most = int(np.abs(x).max(initial=0)) * largest * max(1, x.shape[1])
    return x.astype(float) if most < EXACT else x.astype(object)


class Tree:
    """A packed R-tree: rows in leaf order, and for each node its box. Leaves are numbered first, the root is last."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT, in_order: bool = False):
        if not in_order:
            coordinates = np.argsort(-x.var(0), kind="stable")[:SORTED_BY].tolist()
            order = np.concatenate(tiled(x, np.argsort(ids, kind="stable"), coordinates, leaf))
            ids, x = ids[order], x[order]
        self.ids, self.whole = ids, x
        starts = np.arange(0, len(ids), leaf)
        low, high = [np.minimum.reduceat(self.whole, starts)], [np.maximum.reduceat(self.whole, starts)]
        self.leaf, self.leaves = leaf, len(starts)
        self.children: dict[int, range] = {}
        first, count = 0, len(starts)
        while count > 1:
            groups = np.arange(0, count, fanout)
            for j, g in enumerate(groups.tolist()):
                self.children[first + count + j] = range(first + g, first + min(g + fanout, count))
            low.append(np.minimum.reduceat(low[-1], groups))
            high.append(np.maximum.reduceat(high[-1], groups))
            first, count = first + count, len(groups)
        self.low, self.high = np.concatenate(low), np.concatenate(high)
        self.root = len(self.low) - 1

    def best(self, query: np.ndarray, points: np.ndarray, own: int, windows: list, k: int, upper, lower) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each window (number, low, cap): ids and scores of the ``k`` best rows in it but for ``own``, ties to the smaller id."""
        scored: dict[int, np.ndarray] = {}
        for number, low, cap in windows:
            ids, scores = np.zeros(0, np.int64), points[:0, 0]
            queue = [(-min(upper[self.root], cap), self.root)] if lower[self.root] <= cap else []
            while queue:
                bound, node = heapq.heappop(queue)
                least = max(low, scores[-1]) if len(scores) == k else low
                if -bound < least:
                    break
                if node >= self.leaves:
                    for child in self.children[node]:
                        if upper[child] >= least and lower[child] <= cap:
                            heapq.heappush(queue, (-min(upper[child], cap), child))
                    continue
                rows = slice(node * self.leaf, (node + 1) * self.leaf)
                if node not in scored:
                    scored[node] = points[rows] @ query
                found = scored[node]
                fine = ((found >= least) & (found <= cap) & (self.ids[rows] != own)).astype(bool)
                if fine.any():
                    ids, scores = np.concatenate([ids, self.ids[rows][fine]]), np.concatenate([scores, found[fine]])
                    order = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[order], scores[order]
            yield number, ids, scores


def bounds(low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each query (row) with what lies in each box (column)."""
    largest = int(np.abs(queries).max(initial=0))
    low, high, queries = numbers(low, largest), numbers(high, largest), numbers(queries, int(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))))
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


# --- tables --------------------------------------------------------------------------------------------------------


def usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, x): different rows with an id, a label and a finite vector, whose entries c count as floor(256*c)."""
    named = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector")
    )
    return whole_numbers(named, "vector", "x", SCALE, 0).select("id", "label", "x").distinct()


def sharded(points: DataFrame, entries: int) -> DataFrame:
    """``points`` with ``at``, a number of its own for each, and ``shard``: tiles of one label, of about ``entries`` numbers.

    Two sorts by ranges, each within the order of the one before; no task gets more than its range.
    """
    spread = points.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.variance("v").alias("spread"))
    widest = [r["i"] for r in spread.orderBy(F.desc("spread"), "i").limit(2).collect()]
    first, second = (F.get("x", widest[min(k, len(widest) - 1)] if widest else 0) for k in (0, 1))
    keys = points.select("id", "label", F.xxhash64("x").alias("tie"), F.xxhash64(F.lit(1), "x").alias("tie2"), first.alias("v1"), second.alias("v2"), F.size("x").alias("d"))
    one = ["id", "tie", "tie2"]
    by_first = dense_ranks(keys, ["label", "v1", *one]).withColumnRenamed("rank", "r1")
    of_label = by_first.groupBy("label").agg(F.min("r1").alias("start"), F.count(F.lit(1)).alias("n"), F.max("d").alias("d"))
    shards = F.ceil(F.col("n") * F.col("d") / entries)
    slabs = F.ceil(F.sqrt(shards))
    of_label = of_label.select("label", "start", "n", slabs.alias("slabs"), F.ceil(shards / slabs).alias("tiles"))
    in_slabs = by_first.drop("d").join(of_label, "label").withColumn("slab", F.floor((F.col("r1") - F.col("start")) * F.col("slabs") / F.col("n")))
    by_second = dense_ranks(in_slabs.drop("r1", "start", "n", "slabs", "v1"), ["label", "slab", "v2", *one]).withColumnRenamed("rank", "at")
    of_slab = by_second.groupBy("label", "slab").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    tile = F.floor((F.col("at") - F.col("start")) * F.col("tiles") / F.col("n"))
    # A tile begins at the first rank for which the division gives its number; that rank is the shard's number.
    shard = F.col("start") + F.ceil(F.col("tile") * F.col("n") / F.col("tiles"))
    placed = by_second.join(of_slab, ["label", "slab"]).withColumn("tile", tile).select(*one, "at", shard.alias("shard"))
    named = points.withColumns({"tie": F.xxhash64("x"), "tie2": F.xxhash64(F.lit(1), "x")})
    return named.join(placed, one).select("id", "label", "x", "at", "shard")


def packed(points: DataFrame) -> DataFrame:
    """One row for each shard: (shard, label, ids, x, kind, low, high), its vectors in leaf order and its box."""
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, label = [], None, None

        def row() -> pa.RecordBatch:
            ids, x = (np.concatenate(part) for part in zip(*held, strict=True))
            tree = Tree(ids, x)
            kind = next(k for k in ("<i2", "<i4", "<i8") if np.abs(x).max(initial=0) < np.iinfo(k).max)
            values = [shard, label, tree.ids.astype("<i8").tobytes(), tree.whole.astype(kind).tobytes(), kind, tree.low[-1].tolist(), tree.high[-1].tolist()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            of = batch.column("shard").to_numpy()
            edges = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
            for start, stop in zip(edges, [*edges[1:], len(of)], strict=True):
                if held and of[start] != shard:
                    yield row()
                    held = []
                part = batch.slice(start, stop - start)
                shard, label = int(of[start]), part.column("label")[0].as_py()
                held.append((part.column("id").to_numpy(), matrix(part.column("x"))))
        if held:
            yield row()

    names = ["shard", "label", "ids", "x", "kind", "low", "high"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    ddl = "shard long, label long, ids binary, x binary, kind string, low array<long>, high array<long>"
    dealt = points.select("shard", "label", "id", "x").repartition(n, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(pack, ddl)


def asked(row_batch: pa.RecordBatch, at: int) -> list[tuple[int, int, int]]:
    """An anchor's windows as (number, low, cap), a floor counting as the low end."""
    columns = (row_batch.column(c)[at].as_py() for c in ("low", "cap", "floor"))
    return [(w, max(low, floor), cap) for w, (low, cap, floor) in enumerate(zip(*columns, strict=True))]


def searched(trees: DataFrame, visits: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(at, w, id, score): of each shard that an anchor visits (at, shard), the ``k`` best rows in each of its windows."""
    n = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("parts"))
    blank = {c: F.lit(None).cast(t) for c, t in (("at", "long"), ("own", "long"), ("q", "array<long>"), ("low", "array<long>"), ("cap", "array<long>"), ("floor", "array<long>"))}
    copies = trees.join(parts, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "ids", "x", "kind", *[v.alias(c) for c, v in blank.items()]
    )
    asking = visits.join(parts, "shard").join(anchors, "at").select(
        "shard", F.pmod(F.xxhash64("at"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("ids", "binary"), ("x", "binary"), ("kind", "string"))],
        "at", F.col("id").alias("own"), F.col("x").alias("q"), "low", "cap", "floor",
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            role = batch.column("role").to_numpy()
            edges = np.flatnonzero(np.append(True, (role[1:] != role[:-1]) | (role[1:] == 0))) if len(role) else []
            for start, stop in zip(edges, [*edges[1:], len(role)], strict=True):
                if role[start] == 0:
                    ids = np.frombuffer(batch.column("ids")[start].as_py(), "<i8")
                    x = np.frombuffer(batch.column("x")[start].as_py(), batch.column("kind")[start].as_py()).astype(np.int64)
                    tree = Tree(ids, x.reshape(len(ids), -1), in_order=True)
                    continue
                for begin in range(start, stop, 256):
                    part = batch.slice(begin, min(256, stop - begin))
                    queries = matrix(part.column("q"))
                    lower, upper = bounds(tree.low, tree.high, queries)
                    points = numbers(tree.whole, int(np.abs(queries).max(initial=0)))
                    found = [
                        (at, w, ids, scores)
                        for i, (at, own) in enumerate(zip(part.column("at").to_pylist(), part.column("own").to_pylist(), strict=True))
                        for w, ids, scores in tree.best(queries[i].astype(points.dtype), points, own, asked(part, i), k, upper[i].tolist(), lower[i].tolist())
                        if len(ids)
                    ]
                    if found:
                        times = [len(f[2]) for f in found]
                        columns = [np.repeat([f[0] for f in found], times), np.repeat(np.array([f[1] for f in found], np.int32), times)]
                        columns += [np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found]).astype(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["at", "w", "id", "score"])

    both = copies.unionByName(asking).repartition(n, "shard", "part").sortWithinPartitions("shard", "part", "role")
    return both.mapInArrow(search, "at long, w int, id long, score long")


def routed(trees: DataFrame, anchors: DataFrame, same: bool, probe: bool) -> DataFrame:
    """(at, shard): the shards whose box can hold what an anchor asks for, of its own label (``same``) or of all others.

    Boxes are dealt into blocks that a task can hold, anchors stream past all blocks. A ``probe`` is one shard of those:
    the one whose box has its middle closest below an anchor's highest cap, or nearest to it. Without it, the shard in the
    anchors' column ``seen`` is left out.
    """
    spark = trees.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-trees.count() // BOXES))
    parts = max(1, -(-anchors.count() // ASKED))
    block = F.pmod(F.xxhash64("shard"), F.lit(blocks)).cast("int").alias("block")
    boxes = trees.select(
        block, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("role"), F.col("shard").alias("at"), "label", F.col("low").alias("x"), F.col("high").alias("floor"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("seen", "long"), ("low", "array<long>"), ("cap", "array<long>"))],
    )
    asking = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("at"), F.lit(parts)).cast("int").alias("part"),
        F.lit(1).alias("role"), "at", "label", "x", "floor", "seen", "low", "cap",
    )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, boxes_of = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "part", "role")])
            edges = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))) if batch.num_rows else []
            for start, stop in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                here = tuple(keys[:2, start])
                if here != place:
                    place, held, boxes_of = here, [], None
                part = batch.slice(start, stop - start)
                if keys[2, start] == 0:
                    held.append((part.column("at").to_numpy(), part.column("label").to_numpy(), matrix(part.column("x")), matrix(part.column("floor"))))
                    continue
                if boxes_of is None and held:
                    boxes_of = [np.concatenate(c) for c in zip(*held, strict=True)]
                if boxes_of is None:
                    continue
                for begin in range(0, part.num_rows, 256):
                    found = chosen(part.slice(begin, 256), *boxes_of)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["at", "shard", "worth"])

    def chosen(part: pa.RecordBatch, shards: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, float]]:
        lower, upper = bounds(low, high, matrix(part.column("x")))
        found = []
        for i, (at, label, seen) in enumerate(zip(*(part.column(c).to_pylist() for c in ("at", "label", "seen")), strict=True)):
            allowed = (labels == label) if same else (labels != label)
            if seen is not None:
                allowed &= shards != seen
            windows = asked(part, i)
            reached = np.zeros(len(shards), bool)
            for _, least, cap in windows:
                reached |= ((upper[i] >= least) & (lower[i] <= cap)).astype(bool)
            fit = np.flatnonzero(allowed & reached)
            if probe and len(fit):
                cap = max(cap for _, _, cap in windows)
                beyond = ((upper[i][fit] + lower[i][fit]) / 2 - cap).astype(float)
                worth = np.where(beyond <= 0, -beyond, 1e300 + beyond)
                fit, worth = fit[[worth.argmin()]], worth[[worth.argmin()]]
            else:
                worth = np.zeros(len(fit))
            found += [(at, s, w) for s, w in zip(shards[fit].tolist(), worth.tolist(), strict=True)]
        return found

    both = boxes.unionByName(asking).repartition(n, "block", "part").sortWithinPartitions("block", "part", "role")
    visits = both.mapInArrow(route, "at long, shard long, worth double")
    return visits.groupBy("at").agg(F.min_by("shard", F.struct("worth", "shard")).alias("shard")) if probe else visits.select("at", "shard")


def first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each anchor's window, with their ``rank`` from 1."""
    place = F.row_number().over(Window.partitionBy("at", "w").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def both_ways(trees: DataFrame, anchors: DataFrame, probes: DataFrame, k: int, same: bool, label: str) -> DataFrame:
    """The best of each window (at, w, id, score, rank): the probed shard first, then all others that can still matter."""
    near = written(searched(trees, probes, anchors, k), f"{label}-probed")
    kth = first(near, k).where(F.col("rank") == k).groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
    known = F.coalesce(F.col("kth"), F.create_map().cast("map<int,bigint>"))
    floors = F.transform("floor", lambda f, w: F.coalesce(F.try_element_at(known, w), f))
    seen = probes.withColumnRenamed("shard", "seen")
    others = written(anchors.drop("seen").join(seen, "at", "left").join(kth, "at", "left").withColumn("floor", floors).drop("kth"), f"{label}-floors")
    visits = written(routed(trees, others, same, probe=False), f"{label}-visits")
    far = searched(trees, visits, others, k)
    return first(near.unionByName(far), k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", shard_entries: int = SHARD_ENTRIES,
) -> DataFrame:
    """For each anchor and positive, the ``negatives`` best rows of other labels whose score is ``low`` to ``high`` per cent of the positive's.

    Columns: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. A score is the inner
    product with the anchor, of entries c as whole numbers floor(256*c); higher scores come first, ties go to the smaller
    id. Anchors are the rows for which ``is_anchor`` (of the id, as ``id``) holds; an anchor's positives are the
    ``positives`` best other rows of its label. All are taken where there are fewer. The search is exact.

    Rows with a null id or label, or a vector that is null, empty or not finite throughout, take no part; vectors of
    different lengths are an error. Equal rows count once, so an anchor that is repeated is not its own positive; different
    rows of one id are rows each for itself, but none is a positive or negative of an anchor of the same id. Other columns
    are ignored. Without anchors, positives or negatives there are no rows.
    """
    points = written(usable(vectors, id_col, label_col, vector_col), "negatives-points")
    placed = written(sharded(points, shard_entries), "negatives-placed")
    trees = written(packed(placed), "negatives-trees")
    limit = F.lit(NO_LIMIT)
    anchors = written(
        placed.where(is_anchor).withColumns({"low": F.array(-limit), "cap": F.array(limit), "floor": F.array(-limit)}), "negatives-anchors"
    )
    near = both_ways(trees, anchors.drop("shard"), anchors.select("at", "shard"), positives, True, "positives")
    pairs = written(near.select("at", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")), "positives")
    score = F.col("positive_score")
    windows = pairs.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("place", (score * low).alias("low"), (score * high).alias("cap")))).alias("windows"))
    # 100 * score of the negative lies from low to cap: hundredths in whole numbers, rounded up and down.
    hundred = F.lit(100).cast("long")
    up = F.transform("windows", lambda w: F.call_function("div", w["low"] + F.pmod(-w["low"], hundred), hundred))
    down = F.transform("windows", lambda w: F.call_function("div", w["cap"] - F.pmod(w["cap"], hundred), hundred))
    asking = anchors.select("at", "id", "label", "x").join(windows, "at").select(
        "at", "id", "label", "x", up.alias("low"), down.alias("cap"), F.transform("windows", lambda w: -limit).alias("floor"), F.lit(None).cast("long").alias("seen")
    )
    asking = written(asking, "negatives-asking")
    probes = written(routed(trees, asking, False, probe=True), "negatives-probes")
    found = both_ways(trees, asking, probes, negatives, False, "negatives").withColumn("place", F.col("w") + 1)
    named = anchors.select("at", F.col("id").alias("anchor_id"))
    return found.join(pairs, ["at", "place"]).join(named, "at").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
