"""Languages: sums over segmentations against listing them all, learning against a plain version, and held-out documents."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
from helpers import awkward, none
from pyspark.sql import functions as F

from orewash.llm.language import BYTE_SYMBOLS, WORD_START, Chances, Lattice, Model, expected_counts, fit, held_out, identify, languages, log_summed, probabilities, words_of

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
BYTES = {chr(BYTE_SYMBOLS + b): b for b in range(256)}


def small():
    texts = [WORD_START, *"abcdé", WORD_START + "a", "ab", "abc", "bc", "cd", "da", WORD_START + "ab", "bcda"]
    return Lattice({**BYTES, **{t: 256 + i for i, t in enumerate(texts)}}, 256 + len(texts)), {**BYTES, **{t: 256 + i for i, t in enumerate(texts)}}


def segmentations(symbols, pieces):
    if not symbols:
        return [[]]
    return [[pieces[symbols[:n]], *rest] for n in range(1, len(symbols) + 1) if symbols[:n] in pieces for rest in segmentations(symbols[n:], pieces)]


def random_model(size, languages=3, low=-9):
    logs = np.random.default_rng(2).uniform(low, 0, (languages, size))
    return Model([f"l{i}" for i in range(languages)], np.log(np.full(languages, 1 / languages)), logs - np.log(np.exp(logs).sum(1, keepdims=True)))


def some_words():
    rng = random.Random(1)
    return ["", *("".join(rng.choice("abcdéxñ") for _ in range(rng.randrange(1, 9))) for _ in range(60))]


def test_chance_of_a_word_sums_all_segmentations():
    lattice, pieces = small()
    words = some_words()
    for low in (-9, -400):  # the second runs out of plain numbers
        model = random_model(lattice.size, low=low)
        seen = set()
        for rows, found in lattice.batches(words):
            for row, values in zip(rows.tolist(), Chances(model).words(found)):
                ways = segmentations(WORD_START + lattice.in_bytes(words[row]), pieces)
                each = np.array([[model.pieces[k, w].sum() for w in ways] for k in range(3)])
                assert np.allclose(values, np.logaddexp.reduce(each, axis=1), rtol=1e-9)
                seen.add(row)
        assert seen == set(range(len(words)))


def test_expected_counts_against_listing(spark):
    lattice, pieces = small()
    words = some_words()
    rows = [(i % 3, w, 1 + i % 4) for i, w in enumerate(words)]
    for low in (-9, -400):
        model = random_model(lattice.size, low=low)
        expected = np.zeros(model.pieces.shape)
        for language, word, n in rows:
            ways = segmentations(WORD_START + lattice.in_bytes(word), pieces)
            logs = np.array([model.pieces[language, w].sum() for w in ways])
            for way, share in zip(ways, np.exp(logs - np.logaddexp.reduce(logs))):
                for piece in way:
                    expected[language, piece] += n * share
        found = expected_counts(spark.createDataFrame(rows, "language int, word string, n long").repartition(3), model, lattice)
        assert np.allclose(found, expected, atol=1e-4)


def test_long_words_and_texts():
    lattice = Lattice.of(VOCABULARY)
    model = random_model(lattice.size)
    words = ["a" * 5000, "中" * 40 + "\U00010348", "x" * 31, "x" * 32, "x" * 33]
    values = {i: v for rows, found in lattice.batches(words) for i, v in zip(rows.tolist(), Chances(model).words(found))}
    assert len(values) == 5 and all(np.isfinite(v).all() for v in values.values())
    for rows, found in lattice.batches(words[1:]):  # shorter and longer than what plain numbers are tried for
        logs = log_summed(Chances(model).logs[found.transpose(1, 2, 0)], False)[-1]
        assert all(np.allclose(values[i + 1], v, rtol=1e-9) for i, v in zip(rows.tolist(), logs))


def test_words_are_runs_of_letters():
    assert words_of("it's") == ["it", "s"] and words_of("***") == [] and words_of("12a3") == ["a"] and words_of("naïve.") == ["naïve"]
    assert words_of("ét") == ["ét"] and words_of("हिन्दी") == ["हिन्दी"]


def test_probabilities_are_lent_from_all():
    p = np.exp(probabilities(np.array([[10.0, 0, 0], [0, 5, 5]]), 3.0))
    assert np.allclose(p.sum(1), 1) and p[0, 1] > 0 and p[0, 0] > p[1, 0] and p[1, 2] > p[0, 2]


def test_held_out_documents_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = languages(docs, VOCABULARY).select("held_out", "lang", "lang_pred", "score").collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == docs.count() and 150 < len(held) < 400
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_labels_do_not_leak(spark):
    """Labels of held-out documents, and lang itself, change no prediction."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    wrong = docs.withColumn("lang", F.when(held_out(), "xx").otherwise(F.col("lang")))
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in languages(d, VOCABULARY).collect()} for d in (docs, wrong))
    assert a == b


def test_awkward_documents(spark):
    docs = awkward(spark, [(20, "1234 !!! ***", "en", None, 0)[:2]]).withColumns({"lang_pred": F.lit("clash"), "held_out": F.lit(7)})
    out = languages(docs, VOCABULARY).collect()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert len(out) == docs.count() and got[3] == got[4] == got[5] == got[20] == ("und", 0.0) and got[7] == got[8] == ("en", 1.0)
    assert languages(none(spark), VOCABULARY).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in languages(unlabelled, VOCABULARY).collect()} == {"und"}


def test_und_ties_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "aaa bbb", "zz"), (4, "aaa bbb", "aa"), (5, "ccc", None)], "doc_id long, text string, lang string")
    lattice = Lattice.of(VOCABULARY)
    model = fit(docs, lattice)
    assert model.languages == ["aa", "zz"] and math.isclose(float(np.exp(model.shares).sum()), 1)
    out = identify(docs, model, lattice, "text2", "lang").collect()
    assert {r["text2"] for r in out} == {"aa"} and all(abs(r["lang"] - 0.5) < 1e-9 for r in out if r["doc_id"] != 5)
    assert Counter(r["doc_id"] for r in out) == {1: 1, 4: 1, 5: 1}
