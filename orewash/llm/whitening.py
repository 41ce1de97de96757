"""Whitening of embeddings; the components come from QDWH spectral divide and conquer of the covariance.

Vectors become whole numbers, so sums and deviations are exact. The covariance of the different vectors is gathered in
two jobs: sums first, then products of what is centred. Tasks add up their rows and send one row of the matrix at a time
to where it is added; what reaches the driver is the matrix, whose size is the dimension's square whatever the rows.

There, the polar factor of the covariance less a shift (by dynamically weighted Halley steps) is the sign of each
eigenvalue against the shift. It gives the projector on the eigenvectors above the shift; a basis of its range and one of
the rest split the matrix in two blocks, which are split in turn until each block is one component. The components are
then sent to all tasks, which project their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewash.llm.common import unused
from orewash.scratch import written

SCALE = 64
SHIFT = 1_000_000
MOST = 1 << 52  # entries beyond this would not be exact
COMPONENTS = 16
EPS = float(np.finfo(float).eps)
NO_VARIANCE = 1e-13  # components with less than this share of all variance have none that numbers can tell


# --- the driver's part: a symmetric matrix into components -------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix, by dynamically weighted Halley steps (QDWH).

    Steps go by a QR factorisation as long as the weights are large, and by a Cholesky factorisation afterwards.
    """
    n = len(a)
    norm = np.linalg.norm(a)
    if not norm:
        return np.eye(n)
    x, least = a / norm, EPS / np.sqrt(n)  # a lower bound of the singular values that matter; six steps reach 1 from it
    one = np.eye(n)
    for _ in range(60):
        square = least * least
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        w = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root))) / 2
        b = (w - 1) ** 2 / 4
        c = w + b - 1
        if c > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(c) * x, one]))[0]
            following = (b / c) * x + (w - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        else:
            lower = np.linalg.cholesky(one + c * (x.T @ x))
            inner = np.linalg.solve(lower, x.T)
            following = (b / c) * x + (w - b / c) * np.linalg.solve(lower.T, inner).T
        following = (following + following.T) / 2
        moved = np.linalg.norm(following - x)
        x, least = following, min(1.0, least * (w + b * square) / (1 + c * square))
        if moved < np.cbrt(5 * EPS) and least > 1 - 10 * EPS:
            return x
    return x


def split(a: np.ndarray, shift: float, random: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span the eigenvectors above ``shift``, and k; None if that shift will not do."""
    n = len(a)
    above = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = round(float(np.trace(above)))
    if not 0 < k < n or np.linalg.norm(above @ above - above) > 1e-8 * n:
        return None  # an eigenvalue lies at the shift
    probe = random.standard_normal((n, n))
    for _ in range(3):
        first = above @ probe[:, :k]
        rest = probe[:, k:] - above @ probe[:, k:]
        basis = np.linalg.qr(np.hstack([first, rest]))[0]
        if np.linalg.norm(basis[:, :k].T @ a @ basis[:, k:]) <= 100 * n * EPS * np.linalg.norm(a):
            return basis, k
        probe = basis  # once more, from a basis that is nearly right
    return basis, k


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, by splitting it at shifts."""
    n = len(covariance)
    covariance = (covariance + covariance.T) / 2
    values, vectors = np.zeros(n), np.eye(n)
    random = np.random.default_rng(5)
    size = np.linalg.norm(covariance)
    todo = [(0, n, covariance)]
    while todo:
        start, stop, block = todo.pop()
        length = stop - start
        mean = float(np.trace(block)) / length
        if length == 1 or np.linalg.norm(block - mean * np.eye(length)) <= 4 * length * EPS * size:
            values[start:stop] = np.diag(block)
            continue
        diagonal = np.diag(block)
        middle = float(np.median(diagonal))
        # The mean lies between the ends of the spectrum; so does the median, where the diagonal has values on both sides.
        shifts = [s for s in (middle, mean) if diagonal.min() < s < diagonal.max()] or [mean]
        spread = float(np.linalg.norm(block - mean * np.eye(length))) / np.sqrt(length)
        shifts += [mean + spread * x for x in (1e-3, -1e-3, 0.1, -0.1, 0.3, -0.3)]
        found = next((s for s in (split(block, x, random) for x in shifts) if s), None)
        if found is None:  # nothing to tell apart within rounding
            values[start:stop] = diagonal
            continue
        basis, k = found
        turned = basis.T @ block @ basis
        vectors[:, start:stop] = vectors[:, start:stop] @ basis
        todo += [(start, start + k, (turned[:k, :k] + turned[:k, :k].T) / 2), (start + k, stop, (turned[k:, k:] + turned[k:, k:].T) / 2)]
    vectors = np.linalg.qr(vectors)[0]  # rounding of many turns
    values = np.einsum("ij,ij->j", vectors, covariance @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# --- the tables' part --------------------------------------------------------------------------------------------


def whole_numbers(vectors: DataFrame, vector_col: str, x: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vectors`` with ``x``, the entries c as whole numbers floor(scale*c) + shift, without the rows whose vector is null or has a null or non-finite entry.

    Empty vectors have nothing to whiten and go as well. An entry too large for an exact whole number is an error.
    """
    entry = F.col(vector_col).cast("array<double>")
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fine = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & finite)
    error = F.raise_error(F.lit("an embedding's entry is too large")).cast("double")
    return fine.withColumn(x, F.transform(entry, lambda c: F.floor(F.when(F.abs(c) < MOST / scale, c * scale).otherwise(error)) + shift))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long vectors as rows."""
    flat, n = column.flatten().to_numpy(), len(column)
    if n and len(flat) % n or (n and not (np.diff(column.offsets.to_numpy()) == len(flat) // n).all()):
        raise ValueError("vectors must be of one length")
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def added(parts: DataFrame) -> DataFrame:
    """Rows (i, row) of matrices, added up by i: each i is added in one task, as its rows stream by."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = matrix(batch.column("row"))
            for i, row in zip(batch.column("i").to_pylist(), rows, strict=True):
                total[i] = total[i] + row if i in total else row.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["i", "row"])

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "i").mapInArrow(add, "i int, row array<double>")


def covariance(rows: DataFrame, column: str, mean: np.ndarray, n: int, rotation: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of ``rows``, centred on ``mean`` (and SHIFT) and then turned by ``rotation``, before products are taken."""
    sent = rows.sparkSession.sparkContext.broadcast((mean, rotation))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (centre, turn), total = sent.value, 0.0
        for batch in batches:
            if batch.num_rows:
                d = matrix(batch.column(column)) - SHIFT - centre
                d = d if turn is None else d @ turn
                total = total + d.T @ d
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    found = added(rows.select(column).mapInArrow(products, "i int, row array<double>")).collect()  # one row for each dimension
    sent.destroy()
    return np.array([r["row"] for r in sorted(found, key=lambda r: r["i"])]) / n


@dataclass(frozen=True)
class Whitening:
    """What is learnt from the different vectors: how many, their sums, and components that have variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(fitted: DataFrame, column: str, most: int = COMPONENTS) -> Whitening | None:
    """Components of the rows of ``fitted``, which are different vectors of whole numbers; None without any."""
    entries = fitted.select(F.posexplode(column).alias("i", "x"))
    sums = entries.groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
    if not sums:
        return None
    n = sums[0]["n"]
    if any(r["n"] != n for r in sums):
        raise ValueError("vectors must be of one length")
    exact = [int(r["s"]) for r in sums]
    mean = np.array([(s - n * SHIFT) / n for s in exact])
    found = covariance(fitted, column, mean, n)
    values, vectors = components(found)
    trace = float(np.trace(found))
    kept = np.flatnonzero(values[:most] > NO_VARIANCE * trace) if trace > 0 else np.zeros(0, int)
    values, vectors = values[kept], vectors[:, kept]
    error = 0.0
    if len(kept):
        white = covariance(fitted, column, mean, n, vectors / np.sqrt(values))
        error = float(np.abs(white - np.eye(len(kept))).max())
    return Whitening(n, exact, values, vectors, values / trace if len(kept) else values, error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """n*x - S as numbers, and for each row the sum of its squares, exactly."""
    near = x - SHIFT  # what both have in common goes first: n*x - S is the same for both
    rest = [s - n * SHIFT for s in sums]
    most = n * int(np.abs(near).max(initial=0)) + max((abs(s) for s in rest), default=0)
    kind = np.int64 if most * most * max(1, len(sums)) < 1 << 62 else object
    d = near.astype(kind) * n - np.array(rest, kind)
    return d.astype(float), (d * d).sum(1).tolist()


def whiten(vectors: DataFrame, vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """``vectors`` with ``white`` (array, up to ``most`` components) and what it comes from: ``n`` (different vectors),
    ``deviation`` (decimal: the exact squared length of n*x - S), ``explained`` (array) and ``identity_error``.

    An entry c counts as the whole number floor(64*c) + 1000000. Components are those of the covariance of the different
    vectors, by falling variance; those without variance have no unit to whiten by and are left out, so ``white`` may be
    shorter than ``most``, or empty. Rows whose vector is null, empty or not finite throughout are left out; vectors of
    different lengths are an error. Repeated rows come out as often as they come in and are learnt from once. Other
    columns are kept, those with one of the new names replaced. No rows give no rows.
    """
    new = ["white", "n", "deviation", "explained", "identity_error"]
    kept = vectors.drop(*new)
    names = kept.columns
    (x,) = unused(names, "_x")
    scaled = whole_numbers(kept, vector_col, x)
    fitted = written(scaled.select(F.col(x).alias("x")).distinct(), "whitening-vectors")
    model = fit(fitted, "x", most)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    schema += ", white array<double>, n long, deviation decimal(38,0), explained array<double>, identity_error double"
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            d, squares = deviations(matrix(batch.column(x)), m.n, m.sums)
            white = (d / m.n) @ (m.vectors / np.sqrt(m.values))
            rows = batch.num_rows
            columns = [batch.column(c) for c in names] + [
                pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * white.shape[1], pa.array(white.ravel())),
                pa.array(np.full(rows, m.n)),
                pa.array(squares, pa.decimal128(38, 0)),
                pa.array([m.explained] * rows, pa.list_(pa.float64())),
                pa.array(np.full(rows, m.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*names, *new])

    return scaled.select(*names, x).mapInArrow(project, schema)
