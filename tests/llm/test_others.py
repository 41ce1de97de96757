"""Sharding, toxicity, fingerprints, conversations and neighbours against plain versions."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import awkward, none

from orewash.llm.common import ranked
from orewash.llm.conversations import reply_ordered
from orewash.llm.fingerprints import fingerprint_documents, merge_sketches, resemblance, sketch, word_hashes
from orewash.llm.neighbours import nearest
from orewash.llm.sharding import cut_keys, shard_by_bytes
from orewash.llm.toxicity import held_out, toxicity


def fewest(sizes, shards):
    """The smallest capacity for contiguous filling, tried out."""
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        used, room = 1, middle
        for s in sizes:
            if s > room:
                used, room = used + 1, middle
            room -= s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("seed,n,hot", [(1, 9000, 0), (2, 5000, 40_000), (3, 10, 0), (4, 3000, 900_000)])
def test_cuts_are_minimax(spark, seed, n, hot):
    rng = random.Random(seed)
    groups = {rng.randrange(1 << 60): rng.randrange(1, 300) for _ in range(n)}
    if hot:
        groups[rng.randrange(1 << 60)] = hot
    keys = cut_keys(spark.createDataFrame(list(groups.items()), "key long, size long"), 16)
    loads = Counter()
    for k, size in groups.items():
        loads[sum(k >= c for c in keys)] += size
    assert max(loads.values()) == fewest([groups[k] for k in sorted(groups)], 16) and max(loads) < 16


@pytest.mark.parametrize("at", [0.02, 0.3, 0.5, 0.97])
def test_a_hot_group_leaves_no_shard_empty(spark, at):
    rng = random.Random(8)
    groups = {rng.randrange(1 << 60): rng.randrange(1, 300) for _ in range(4000)}
    small = sum(groups.values())
    hot = int(at * (1 << 60))
    groups[hot] = small // 2
    keys = cut_keys(spark.createDataFrame(list(groups.items()), "key long, size long"), 16)
    loads = Counter()
    for k, size in groups.items():
        loads[sum(k >= c for c in keys)] += size
    own = sum(hot >= c for c in keys)
    others = [loads[i] for i in range(16) if i != own]
    assert len(loads) == 16 and loads[own] == small // 2
    stretches = [sum(s for k, s in groups.items() if k != hot and (k < hot) == before) for before in (True, False)]
    best = min(max(stretches[0] / n, stretches[1] / (15 - n)) for n in range(1, 15))
    assert max(others) <= best + 300 and min(others) >= min(0.8 * best, min(stretches)) - 300


def test_equal_groups_fill_every_shard(spark):
    keys = cut_keys(spark.createDataFrame([(i << 50, 100) for i in range(17)], "key long, size long"), 16)
    loads = Counter(sum(i << 50 >= c for c in keys) for i in range(17))
    assert len(loads) == 16 and max(loads.values()) == 2


def test_shards_of_awkward_documents(spark):
    docs = awkward(spark, [(100 + i, f"text {i}") for i in range(200)])
    rows = shard_by_bytes(docs.withColumn("shard", F.lit("clash")).withColumn("size", F.lit(1))).collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in texts.elements())
    by_text, slots = defaultdict(set), defaultdict(list)
    lookup = {d: t for d, t in texts}
    for r in rows:
        raw = lookup[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by_text[raw].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_by_bytes(none(spark)).count() == 0


def test_ranks_are_gapless_in_a_hot_group(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 7).alias("g"))
    found = defaultdict(list)
    for r in ranked(rows, ["g"], ["id"], 5000, "rank").collect():
        found[r["g"]].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in found.values())


def test_toxicity_is_learnt_and_reaches_misspellings(spark):
    rng = random.Random(1)
    calm = [f"{a}{b}" for a in ("lor", "mip", "dol", "sit", "ame") for b in ("em", "sum", "or", "ta", "net", "co")]
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(calm) for _ in range(rng.randrange(20, 60))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["blockhead", "nincompoop"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(5000, " ".join(["lorem"] * 20 + ["blockheaad", "nincompooop"] * 2)), (5001, None), (5002, ""), (None, "lorem mipsum"), (5003, "lorem " * 40_000)]
    labels += [(0, 1), (7, None), (None, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    scored = toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).withColumn("held_out", held_out()).collect()
    got = {r["doc_id"]: r for r in scored}
    assert len(scored) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in scored)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(900))
    right = [got[i]["predicted"] == int(i % 3 == 0) for i in range(900) if got[i]["held_out"]]
    assert sum(right) >= 0.95 * len(right) and got[5000]["predicted"] == 1
    assert got[5001]["score"] == got[5002]["score"] < 0.5 and got[5003]["predicted"] == 0
    nothing = toxicity(df.limit(3), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert all(r["score"] < 0.01 for r in nothing)
    assert toxicity(none(spark), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_whole_sets(spark):
    rng = random.Random(3)
    texts = {i * 3: " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60))) for i in range(60)}
    texts |= {7: "", 8: "ünï ©ödé 🙂 x", 10: texts[30]}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").withColumn("bucket", F.lit("clash"))
    got = {r["doc_id"]: r for r in fingerprint_documents(docs).collect()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        text, following = texts[d], texts[order[(i + 1) % len(order)]]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[d]["n_chars"] == len(text)
        assert got[d]["near_edited"] == pytest.approx(likeness(shingles(text), shingles(edited)))
        assert got[d]["near_next"] == pytest.approx(likeness(shingles(text), shingles(following)))
    assert got[10]["sketch"] == got[30]["sketch"]


def test_fingerprints_of_awkward_documents_and_merging(spark):
    docs = awkward(spark)
    rows = fingerprint_documents(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    assert fingerprint_documents(none(spark)).count() == 0
    (one,) = fingerprint_documents(docs.where("doc_id = 1")).collect()
    assert one["near_next"] == 1.0
    parts = docs.select("doc_id", word_hashes(F.coalesce("text", F.lit(""))).alias("w")).select("doc_id", (F.coalesce("doc_id", F.lit(0)) % 2).alias("part"), sketch(F.col("w")).alias("sketch"))
    merged = merge_sketches(merge_sketches(parts, ["part"]).withColumn("all", F.lit(1)), ["all"]).first()["sketch"]
    at_once = merge_sketches(parts.withColumn("all", F.lit(1)), ["all"]).first()["sketch"]
    hashes = sorted({h for r in parts.collect() for h in r["sketch"]})[:128]
    assert merged == at_once == hashes


def test_large_sketches_estimate(spark):
    a = " ".join(f"x{i}" for i in range(3000))
    b = " ".join(f"x{i}" for i in range(600, 3600))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(word_hashes(F.col("a")).alias("a"), word_hashes(F.col("b")).alias("b"))
    df = df.select(sketch(F.col("a")).alias("a"), sketch(F.col("b")).alias("b"))
    assert df.select(resemblance(F.col("a"), F.col("b"))).first()[0] == pytest.approx(2396 / 3596, abs=0.15)


def test_replies_follow_what_they_quote(spark):
    said = [
        (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "> How are you?\nFine, thanks."),
        (1, 2, "user", "> > how  ARE you?\n> Fine, thanks.\n\nGood to hear"), (1, 3, "user", "new topic"),
        (1, 4, "assistant", ">good to hear\nyes"), (2, 0, "user", "> new topic\nfrom elsewhere"), (2, 1, "user", None),
        (None, 1, "user", "> new topic"), (2, 2, "user", "> unknown words\nhm"), (2, 3, "user", ""), (2, 3, "user", ""),
    ]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash"))
    rows = reply_ordered(df).collect()
    got = {(r["conv_id"], r["turn"]): r for r in rows}
    assert len(rows) == len(said)
    parents = {k: (r["parent_conv"], r["parent_turn"]) for k, r in got.items() if r["parent_turn"] is not None}
    assert parents == {(1, 1): (1, 0), (1, 2): (1, 1), (1, 4): (1, 2), (2, 0): (1, 3)}
    assert {k: r["depth"] for k, r in got.items() if r["depth"]} == {(1, 1): 1, (1, 2): 2, (1, 4): 3, (2, 0): 1}
    assert {(r["root_conv"], r["root_turn"]) for k, r in got.items() if k in ((1, 1), (1, 2), (1, 4))} == {(1, 0)}
    assert got[1, 2]["text"] == "Good to hear" and got[2, 1]["text"] is None and got[2, 2]["n_quotes"] == 1
    assert reply_ordered(df.limit(0)).count() == 0


def test_neighbours_exact_and_relaxed(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    points = np.repeat(centres, 60, axis=0) + rng.normal(scale=0.3, size=(1200, 16))
    points[700] = points[3]
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0] * 15 + [None]), (None, [1.0] * 16), (5400, [float("inf")] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash"))
    asked = vectors.where("vec_id % 100 = 0")
    got = defaultdict(list)
    for r in nearest(vectors, asked).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1200, 100))
    for q, found in got.items():
        far = np.sqrt(((points - points[q]) ** 2).sum(1))
        far[q] = np.inf
        best = np.lexsort((np.arange(1200), far))[:10]
        assert [(r, v) for r, v, _ in found] == list(zip(range(1, 11), best.tolist()))
        assert [s for _, _, s in found] == pytest.approx(far[best].tolist())
    relaxed = {(r["query_id"], r["vec_id"]) for r in nearest(vectors, asked, factor=1.3).collect()}
    assert sum((q, v) in relaxed for q, found in got.items() for _, v, _ in found) >= 0.9 * 120
    assert nearest(vectors.limit(0), asked).count() == 0 and nearest(vectors, asked.limit(0)).count() == 0
    assert nearest(vectors.where("vec_id < 4"), asked.where("vec_id = 0")).count() == 3


def test_repeated_queries_count_once(spark):
    rng = np.random.default_rng(4)
    rows = [(i, p.tolist()) for i, p in enumerate(rng.normal(size=(300, 8)))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    once = vectors.where("vec_id in (5, 6)")
    want = sorted(map(tuple, nearest(vectors, once).collect()))
    many = once.crossJoin(spark.range(12)).drop("id")
    assert sorted(map(tuple, nearest(vectors, many).collect())) == want and len(want) == 20
    other = vectors.where("vec_id = 7").withColumn("vec_id", F.lit(5).cast("long"))
    got = [tuple(r) for r in nearest(vectors, many.unionByName(other)).collect()]
    assert len(got) == 30 and set(want) < set(got) and sum(q == 5 and v == 7 and s == 0 for q, _, v, s in got) == 1
