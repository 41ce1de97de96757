"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

A tree splits its vectors by their distance from a vantage point: nearer half, further half. A search may skip a half if
the triangle inequality says that nothing there can be nearer than the worst neighbour held so far. The inequality is
relaxed by a factor: a half is skipped if its bound, times the factor, exceeds that worst distance. Factor 1 is exact;
larger factors skip more. Queries travel to every shard, where they stream past its tree by batches, and each shard sends
back its nearest ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF = 256
SHARD_ROWS = 20_000


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part: an id, and a vector that is not null, not zero, and finite throughout."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    zero = F.forall(vector, lambda x: x == 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where(
        F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & ~zero
    )


def distances(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from the differences themselves."""
    difference = points - query
    return np.sqrt(np.einsum("ij,ij->i", difference, difference))


class Tree:
    """A vantage-point tree over vectors (double) and their ids."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points, self.leaf = ids[order], points[order], leaf
        self.root = self.build(np.arange(len(ids)), np.random.default_rng(1))

    def build(self, rows: np.ndarray, random: np.random.Generator):
        """A leaf is its rows; a node is (vantage row, nearer half, its nearest and furthest, further half, the same)."""
        if len(rows) <= self.leaf:
            return rows
        at = rows[random.integers(len(rows))]
        far = distances(self.points[rows], self.points[at])
        order = np.argsort(far, kind="stable")
        half = len(rows) // 2
        inner, outer = order[:half], order[half:]
        return (
            at,
            self.build(rows[inner], random), far[inner[0]], far[inner[-1]],
            self.build(rows[outer], random), far[outer[0]], far[outer[-1]],
        )

    def search(self, query_id: int, query: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest but for the query's own row, ties to the smaller id."""
        ids, found = np.zeros(0, np.int64), np.zeros(0)
        todo = [(0.0, self.root)]
        while todo:
            bound, node = todo.pop()
            if len(found) == k and bound * factor > found[-1]:
                continue
            if isinstance(node, tuple):
                at, inner, low, high, outer, low_out, high_out = node
                far = float(distances(self.points[at : at + 1], query)[0])
                halves = [(max(bound, low - far, far - high), inner), (max(bound, low_out - far, far - high_out), outer)]
                halves.sort(key=lambda half: -half[0])  # the more promising half comes off the stack first
                todo += halves
                continue
            far = distances(self.points[node], query)
            mine = self.ids[node] != query_id
            if len(found) == k:
                mine &= far <= found[-1]
            if mine.any():
                ids = np.concatenate([ids, self.ids[node][mine]])
                found = np.concatenate([found, far[mine]])
                order = np.lexsort((ids, found))[:k]
                ids, found = ids[order], found[order]
        return ids, found


def as_arrays(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    vectors = table.column("vector")
    flat = (vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors).flatten()
    return ids, flat.to_numpy().reshape(len(ids), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` nearest vectors: query_id, rank (from 1), ``id_col``, score (the Euclidean distance).

    Rows that are null, zero or not finite take no part on either side, nor does a query's own row; vectors must be of
    one length. Repeated rows of an id are candidates each for itself. Repeated queries count once; different vectors of
    one id are queries each for itself, with ``k`` ranks each under the same query_id. If there are fewer candidates than ``k`` all are
    returned; without queries or candidates there are no rows. Every vector is in one shard's tree, of about
    ``SHARD_ROWS`` vectors by a hash of its id and itself, so even one id that many rows share is spread.
    """
    points = usable(vectors, id_col, vector_col)
    shards = max(1, math.ceil(points.count() / SHARD_ROWS))
    asked = usable(queries, id_col, vector_col).distinct().withColumns({"q1": F.xxhash64("vector"), "q2": F.xxhash64(F.lit(1), "vector")})
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("role"), "id", "vector", "q1", "q2")
    none = F.lit(None).cast("long")
    dealt = points.select(
        F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("role"), "id", "vector", none.alias("q1"), none.alias("q2")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's vectors come first (role 0) and make its tree, its queries follow and are not held."""
        shard, held, tree = None, [], None
        for batch in batches:
            shard_of, role = batch.column("shard").to_numpy(), batch.column("role").to_numpy()
            edges = np.flatnonzero(np.append(True, (shard_of[1:] != shard_of[:-1]) | (role[1:] != role[:-1]))) if len(role) else []
            for start, stop in zip(edges, [*edges[1:], len(role)], strict=True):
                part = batch.slice(start, stop - start)
                if shard_of[start] != shard:
                    shard, held, tree = shard_of[start], [], None
                ids, vectors = as_arrays(part)
                if role[start] == 0:
                    held.append((ids, vectors))
                    continue
                if held:
                    tree, held = Tree(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                if tree is None:
                    continue
                found = [tree.search(i, v, k, factor) for i, v in zip(ids, vectors, strict=True)]
                times = np.repeat(np.arange(len(ids)), [len(x) for x, _ in found])
                columns = [ids[times], *(part.column(c).to_numpy()[times] for c in ("q1", "q2")), *(np.concatenate(x) for x in zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "q1", "q2", "id", "score"])

    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_shard = dealt.unionByName(sent).repartition(n, "shard").sortWithinPartitions("shard", "role")
    per_shard = by_shard.mapInArrow(search, "query_id long, q1 long, q2 long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id", "q1", "q2").orderBy("score", "id"))
    return (
        per_shard.withColumn("rank", place)
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
