"""Near copies: recall at the threshold against all pairs, and work that does not grow with pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import orewash.llm.nearcopies as near
from orewash.llm.nearcopies import alike, classes, compared, counters, in_buckets, met, near_classes, possible, rough_classes, sketched, sketches
from orewash.llm.substrings import Hashes

SCHEMA = "doc_id long, text string"


def replaced(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(words)), int(share * len(words))):
        out[i] = f"r{rng.randrange(10**9)}"
    return out


def test_pairs_at_the_threshold_share_a_bucket():
    rng, which, hashes = random.Random(3), np.arange(near.SKETCHES), Hashes()
    for share in (0.05, 0.1, 0.15, 0.2):
        met = 0
        for _ in range(150):
            a = [f"w{rng.randrange(10**6)}".encode() for _ in range(rng.randrange(80, 400))]
            b = [w.encode() if isinstance(w, str) else w for w in replaced(rng, a, share)]
            x, y = hashes.of(a), hashes.of(b)
            assert alike(x, y, 0.8)
            met += bool((sketches(x, which) == sketches(y, which)).any())
        assert met >= 0.9 * 150, share


def test_counters_never_rule_out_what_is_alike():
    rng, hashes = random.Random(4), Hashes()
    for _ in range(200):
        a = [f"w{rng.randrange(60)}".encode() for _ in range(rng.randrange(0, 60))]
        b = [w.encode() if isinstance(w, str) else w for w in replaced(rng, a, rng.choice([0, 0.1, 0.2, 0.3]))][rng.randrange(4) :]
        x, y = hashes.of(a), hashes.of(b)
        counts = np.stack([counters(x), counters(y)]).astype(np.int16)
        if alike(x, y, 0.8):
            assert possible(np.array([len(x), len(y)]), counts, 0, 0.8).all()
    long = np.arange(10**5, dtype=np.uint64) << np.uint64(20)
    assert counters(long).max() == 255


def all_pairs_classes(texts, similarity=0.8):
    hashes, root = Hashes(), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    own = [hashes.of(t.encode().split()) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and alike(own[i], own[j], similarity):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_classes_against_all_pairs(spark):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(25):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(30, 120))]
        base = base + passage if i % 3 == 0 else base
        texts += [" ".join(replaced(rng, base, rng.choice([0.02, 0.05, 0.1, 0.12]))) for _ in range(rng.choice([1, 2, 5]))]
    want = all_pairs_classes(texts)
    got = {r["doc"]: r["class"] for r in near_classes(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    missed = sum(got[i] != want[i] for i in range(len(texts)))
    assert missed <= 0.05 * len(texts) and len(set(want)) < len(texts)


def test_large_buckets_of_unlike_texts_and_of_copies(spark, monkeypatch):
    """A passage in every text, and a group of copies: pairs stay below a few for each text, and all copies are found."""
    monkeypatch.setattr(near, "LARGE", 40)
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([*(f"o{rng.randrange(10**9)}" for _ in range(40)), *passage]) for _ in range(400)]
    base = [f"b{i}" for i in range(100)]
    texts += [" ".join(replaced(rng, base, 0.03)) for _ in range(200)]
    seen = []
    real = near.aligned
    monkeypatch.setattr(near, "aligned", lambda bodies, pairs, similarity: (seen.append(pairs.count()), real(bodies, pairs, similarity))[1])
    got = {r["doc"]: r["class"] for r in near_classes(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert got == {i: i if i < 400 else 400 for i in range(600)}
    assert sum(seen) < 8 * len(texts)


def test_no_pair_within_a_class_and_one_for_each_text(spark):
    texts = sketched(spark.createDataFrame([(i, " ".join(["same"] * 30 + [f"x{i}"])) for i in range(30)], SCHEMA)).withColumn("rep", F.col("doc")).cache()
    members = in_buckets(texts.select("rep", F.posexplode("keys").alias("sketch", "key")), near.SAMPLED)
    seen = texts.select("rep", "words", "counts")
    pairs = compared(members, seen, None, 0.8)
    assert pairs.groupBy("member").count().where("count > 3").isEmpty() and pairs.where("leader >= member").isEmpty()
    one = texts.select("rep", F.lit(0).cast("long").alias("class"))
    assert compared(members, seen, one, 0.8).isEmpty()


def test_classes_are_components(spark):
    """Long chains, stars and loose ends, from rough classes of some of the links."""
    rng = random.Random(11)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(29 + 100, 200), (300, 301)]
    links += [tuple(sorted(rng.sample(range(400, 480), 2))) for _ in range(60)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    want = {x: find(x) for x in root}
    for share in (0.0, 0.5, 1.0):
        first = [x for x in links if rng.random() < share]
        schema = "leader long, member long"
        rough = rough_classes(spark.createDataFrame(first, schema))
        assert all(want[r["rep"]] == want[r["class"]] for r in rough.collect())
        got = {r["rep"]: r["class"] for r in classes(spark.createDataFrame(links, schema), rough).collect()}
        assert {x: got.get(x, x) for x in want} == want


@pytest.mark.parametrize("together", [4096, 64])
def test_every_pair_of_a_large_bucket_is_looked_at(spark, monkeypatch, together):
    """Two texts alike that stand behind a large bucket's first texts, and are of different lengths."""
    monkeypatch.setattr(near, "LARGE", 20)
    monkeypatch.setattr(near, "TOGETHER", together)
    rng = random.Random(5)
    texts = [[f"o{rng.randrange(10**9)}" for _ in range(rng.randrange(50, 400))] for _ in range(300)]
    alike_ = {(150, 280): 0.85, (70, 200): 1.2, (120, 121): 0.95}
    for (a, b), length in alike_.items():
        texts[b] = (texts[a] + [f"new{a}-{i}" for i in range(100)])[: int(len(texts[a]) * length)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], SCHEMA)
    seen = sketched(docs).withColumn("rep", F.col("doc")).select("rep", "words", "counts").cache()
    members = seen.select(F.lit(1).cast("long").alias("bucket"), F.lit(0).alias("sketch"), "rep", F.lit(300).cast("long").alias("n"))
    apart = seen.select("rep", F.col("rep").alias("class"))
    bodies = docs.select(F.col("doc_id").alias("rep"), F.encode("text", "UTF-8").alias("text"))
    for given in ((), (bodies,)):
        pairs = {(r["leader"], r["member"]) for r in compared(members, seen, apart, 0.8, *given).collect()}
        assert set(alike_) <= pairs and len(pairs) < 300


def test_pairs_of_several_large_buckets_are_met_once(spark, monkeypatch):
    """A passage gathers the same texts in many buckets, of which some words more are the same: one row for each pair."""
    monkeypatch.setattr(near, "LARGE", 20)
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(200)]
    texts = [" ".join([*(f"o{rng.randrange(10**9)}" for _ in range(rng.randrange(10, 25))), *passage]) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    seen = sketched(docs).withColumn("rep", F.col("doc")).cache()
    members = in_buckets(seen.select("rep", F.posexplode("keys").alias("sketch", "key")))
    large = members.where("n > 20")
    assert large.count() > 10 * 60
    bodies = docs.select(F.col("doc_id").alias("rep"), F.encode("text", "UTF-8").alias("text"))
    apart, plain = seen.select("rep", F.col("rep").alias("class")), seen.select("rep", "words", "counts")
    rows = [tuple(r) for r in met(large, plain, apart, 0.8, bodies).collect()]
    assert len(rows) == len(set(rows)) > 500
    assert set(rows) == {tuple(r) for r in met(large, plain, apart, 0.8).collect()}
    assert set(rows) <= {tuple(r) for r in compared(members, plain, apart, 0.8, bodies).collect()}


def test_classes_and_numbers_are_tables_to_read(spark):
    """What is read again and again is not worked out again and again: the plans that read it stay short."""
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (3, 9)], "leader long, member long")
    found = classes(links, rough_classes(spark.createDataFrame([(1, 2), (7, 9)], "leader long, member long")))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    docs = spark.createDataFrame([(i, f"a text of number {i % 4}") for i in range(8)], SCHEMA)
    plan = near_classes(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 0


def unlike_texts(rng, n):
    """Texts of the same words in another order, behind a phrase that gathers them: counters tell none from another."""
    phrase, own = ["is", "one"] * 50, [f"w{i}" for i in range(60)]
    return [phrase + rng.sample(own, len(own)) for _ in range(n)]


def test_rows_of_large_buckets_grow_with_texts_not_pairs(spark, monkeypatch):
    """Texts that share buckets and words but are not alike, and a few that are: what leaves the tasks is fewer than texts."""
    monkeypatch.setattr(near, "LARGE", 8)
    rng = random.Random(13)
    texts = unlike_texts(rng, 160)
    texts[70] = [*texts[5][:-3], "x", "y", "z"]
    texts[71] = [*texts[70][:-3], "a", "b", "c"]
    handed = []
    real = near.joined

    def counted(bodies, pairs, found, similarity, links=None):
        handed.append(pairs.count() + (0 if links is None else links.count()))
        return real(bodies, pairs, found, similarity, *([] if links is None else [links]))

    monkeypatch.setattr(near, "joined", counted)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc"]: r["class"] for r in near_classes(docs).collect()}
    assert got == {i: 5 if i in (70, 71) else i for i in range(160)}
    assert sum(handed) < len(texts)


@pytest.mark.parametrize(("together", "words"), [(4096, 1 << 23), (64, 1 << 23), (4096, 4000), (4096, 100)])
def test_links_of_large_buckets_join_what_all_pairs_join(spark, monkeypatch, together, words):
    """Whole, in parts, and in parts cut by their words: chains across lengths, in several buckets at once."""
    monkeypatch.setattr(near, "LARGE", 20)
    monkeypatch.setattr(near, "TOGETHER", together)
    monkeypatch.setattr(near, "WORDS_TOGETHER", words)
    rng = random.Random(14)
    texts = unlike_texts(rng, 60)
    texts += [t + [f"new{i}-{k}" for k in range(length)] for i, t in enumerate(texts[:20]) for length in (15, 40)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], SCHEMA)
    seen = sketched(docs).withColumn("rep", F.col("doc")).cache()
    members = in_buckets(seen.select("rep", F.posexplode("keys").alias("sketch", "key")))
    large, plain = members.where("n > 20"), seen.select("rep", "words", "counts")
    apart = seen.select("rep", F.col("rep").alias("class"))
    bodies = docs.select(F.col("doc_id").alias("rep"), F.encode("text", "UTF-8").alias("text"))
    links = near.links_in(near.in_large(large, plain, apart, 0.8, bodies), 0.8).collect()
    pairs = near.aligned(bodies, met(large, plain, apart, 0.8).distinct(), 0.8).where("alike").collect()
    assert {(r["leader"], r["member"]) for r in links} <= {(r["leader"], r["member"]) for r in pairs}

    def joins(rows):
        root = list(range(len(texts)))
        for a, b in rows:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
        return root

    want = joins([(r["leader"], r["member"]) for r in pairs])
    assert joins([(r["leader"], r["member"]) for r in links]) == want and len(set(want)) < len(texts)
