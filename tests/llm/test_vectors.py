"""Whitening and hard negatives, against numpy's own eigenvectors and plain loops over whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orewash.llm.negatives import Tree, bounds, hard_negatives
from orewash.llm.queries import op12_whitening, op13_negatives
from orewash.llm.whitening import SHIFT, components, deviations, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")
ODD = [(900, None, 1), (901, [1.0, None, 2.0], 1), (902, [NAN, 1.0, 1.0], 2), (903, [1.0, -INF, 1.0], 2), (904, [], 3), (905, [1.0, 2.0, 3.0], None)]


def clustered(n, d=3, seed=1, labels=4):
    random = np.random.default_rng(seed)
    centres = random.normal(0, 1, (labels, d))
    label = random.integers(0, labels, n)
    points = (centres[label] + random.normal(0, 0.5, (n, d))).astype(np.float32).round(2)  # rounded, so scores tie
    return [(i, p.tolist(), int(x)) for i, (p, x) in enumerate(zip(points, label))]


def whole(vector, scale, shift=0):
    return [math.floor(scale * float(np.float32(c))) + shift for c in vector]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 33, 100])
def test_components_are_eigenvectors(n):
    random = np.random.default_rng(n)
    a = random.standard_normal((n, n)) * 10.0 ** random.uniform(-3, 3, (n, 1))
    matrix = a @ a.T
    values, vectors = components(matrix)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1], rtol=1e-9, atol=1e-13 * values[0])
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13
    assert np.linalg.norm(matrix @ vectors - vectors * values) < 1e-12 * np.linalg.norm(matrix)


@pytest.mark.parametrize("matrix", [np.zeros((3, 3)), np.eye(4), np.ones((5, 5)), np.diag([3.0, 1, 1, 2, 2, 0]), np.kron(np.eye(3), np.ones((2, 2))), np.diag([1.0, 1 + 1e-12, 1 - 1e-12])])
def test_components_of_equal_eigenvalues(matrix):
    values, vectors = components(matrix)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1], atol=1e-12)
    assert np.linalg.norm(matrix @ vectors - vectors * values) < 1e-11
    assert np.abs(vectors.T @ vectors - np.eye(len(matrix))).max() < 1e-13


def test_deviations_are_exact_beyond_long():
    x = np.array([[SHIFT + 10**9, SHIFT - 3], [SHIFT, SHIFT]])
    n, sums = 10**9, [7 * 10**18, 10**15]
    assert deviations(x, n, sums)[1] == [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]


def expected_whitening(rows, most):
    fine = [(i, whole(v, 64, SHIFT)) for i, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fitted = np.array(sorted({tuple(x) for _, x in fine}))
    n, sums = len(fitted), [int(s) for s in fitted.sum(0)]
    centred = (fitted * n - np.array(sums)) / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    out = {}
    for i, x in fine:
        d = [n * a - s for a, s in zip(x, sums)]
        out.setdefault(i, (n, sum(v * v for v in d), np.array(d) / n @ vectors / np.sqrt(values), values / np.trace(covariance)))
    return out


def test_whitening_against_numpy(spark):
    base = clustered(300, 6, 3)
    rows = base + base[:40] + [(o, v, l) for o, v, l in ODD if not v or len(v) != 3] + [(950, [1.0] * 5 + [NAN], 0)]
    expected = expected_whitening(rows, 4)
    found = whiten(spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")), most=4).collect()
    assert len(found) == 340 and {r["vec_id"] for r in found} == set(expected)
    signs = np.sign([r["white"] for r in found if r["vec_id"] == 0][0] / expected[0][2])
    for r in found:
        n, deviation, white, explained = expected[r["vec_id"]]
        assert (r["n"], int(r["deviation"])) == (n, deviation)
        assert np.allclose(r["white"], white * signs, rtol=1e-9, atol=1e-9) and np.allclose(r["explained"], explained, rtol=1e-9)
        assert r["identity_error"] < 1e-10


def test_whitening_of_little(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None, 1), (2, [NAN], 1)], SCHEMA)).collect() == []
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)], SCHEMA)).collect()
    assert [(r["n"], int(r["deviation"]), r["white"], r["identity_error"]) for r in one] == [(1, 0, [], 0.0)] * 2
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], 1) for i in range(9)], SCHEMA)).collect()
    assert all(len(r["white"]) == 1 for r in line) and np.isclose(np.var([r["white"][0] for r in line]), 1)
    with pytest.raises(Exception, match="one length"):
        whiten(spark.createDataFrame([(1, [1.0], 1), (2, [1.0, 2.0], 1)], SCHEMA)).collect()


def test_whitening_query(spark):
    out = op12_whitening(spark, "/root/testdata/sf0.001").toPandas()
    assert (out.groupby("vec_id").size() == 16).all() and out["identity_error"].max() < 1e-9
    assert np.allclose(out.groupby("component")["whitened"].var(ddof=0), 1, atol=1e-6)


def plain_negatives(rows, anchor, positives=5, negatives=10):
    fine = list(dict.fromkeys((i, l, tuple(whole(v, 256))) for i, v, l in rows if i is not None and l is not None and v and all(c is not None and math.isfinite(c) for c in v)))
    out = []
    for i, label, q in [r for r in fine if anchor(r[0])]:
        scored = sorted((-sum(a * b for a, b in zip(q, x)), j, l) for j, l, x in fine if j != i)
        for p, j, l in [s for s in scored if s[2] == label][:positives]:
            inside = [(n, m) for n, m, k in scored if k != label and 30 * -p <= 100 * -n <= 90 * -p]
            out += [(i, j, rank, m, -p, -n) for rank, (n, m) in enumerate(inside[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("entries", [1 << 19, 90])
def test_negatives_against_loops(spark, entries):
    rows = clustered(400) + clustered(20)[:5] + ODD + [(None, [1.0, 1.0, 1.0], 1)] + [(500 + i, [0.5, 0.5, 0.5], 2) for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("clash"), "x": F.lit(1), "shard": F.lit(0)}).repartition(3)
    found = hard_negatives(frame, F.col("id") % 10 == 0, shard_entries=entries)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = plain_negatives(rows, lambda i: i % 10 == 0)
    assert sorted(map(tuple, found.collect())) == expected and len(expected) > 500


def test_negatives_of_little(spark):
    def run(rows):
        return hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") == 0).collect()

    assert run([]) == [] and run([(0, [1.0], 1)]) == [] and run([(0, [1.0], 1), (1, [1.0], 1)]) == []
    assert [tuple(r) for r in run([(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)])] == [(0, 1, 1, 2, 65536, 32768)]
    big = [(0, [2.0**40], 1), (1, [1.0], 1), (2, [0.5], 2)]  # scores are exact beyond 2^53
    assert [tuple(r)[4:] for r in run(big)] == [(2**48 * 256, 2**48 * 128)]


def test_tree_prunes_and_finds(spark):
    random = np.random.default_rng(0)
    x = random.integers(-50, 50, (500, 4))
    tree = Tree(np.arange(500), x, leaf=8, fanout=4)
    queries = random.integers(-50, 50, (20, 4))
    lower, upper = bounds(tree.low, tree.high, queries)
    for q, low, up in zip(queries, lower, upper):
        scores = x @ q
        assert low[tree.root] <= scores.min() and up[tree.root] >= scores.max()
        for window in [(0, -(1 << 62), 1 << 62), (1, -100, 700), (2, 10**6, 10**7)]:
            ((_, ids, found),) = tree.best(q.astype(float), tree.whole.astype(float), 3, [window], 6, up.tolist(), low.tolist())
            inside = [i for i in np.lexsort((np.arange(500), -scores)) if i != 3 and window[1] <= scores[i] <= window[2]][:6]
            assert ids.tolist() == inside and found.tolist() == scores[inside].tolist()


def test_negatives_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(i, v, (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, op13_negatives(spark, sf).collect())) == plain_negatives(rows, lambda i: i % 100 == 0)
