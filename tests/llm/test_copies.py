"""Line, passage and near-copy removal against plain versions."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import LONG, awkward, none

import corpus_pipeline
from orewash.llm.lines import doublings, without_repeated_lines
from orewash.llm.nearcopies import alike, distance, near_classes
from orewash.llm.substrings import marks, minimisers, repeated, without_repeats


def with_clashes(docs, *names):
    for n in names:
        docs = docs.withColumn(n, F.lit("clash"))
    return docs


def random_texts(seed, n, vocabulary, size, lines=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(size))]
        if out and rng.random() < 0.5:
            other = rng.choice(out).split(" ")
            at = rng.randrange(len(other) + 1)
            words[len(words) // 2 : len(words) // 2] = other[at : at + rng.randrange(40)]
        out.append((("\n" if lines else " ").join(words)) if lines else " ".join(words))
    return out


def plain_passages(docs, width):
    """Kept words by document, for documents of different doc_id."""
    seen, out = {}, {}
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            if seen.setdefault(tuple(words[i : i + width]), (doc, i)) != (doc, i):
                gone[i : i + width] = [True] * width
        out[doc] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def test_passages_against_a_plain_version(spark):
    texts = random_texts(1, 120, ["a", "b", "c"], 60) + random_texts(2, 120, [f"v{i}" for i in range(50)], 200)
    docs = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in without_repeats(df).collect()}
    assert got == plain_passages(docs, 20)
    assert sum(v[1] for v in got.values()) > 500


def test_passages_of_awkward_documents(spark):
    docs = with_clashes(awkward(spark), "n_words", "_start", "doc")
    rows = without_repeats(docs).collect()
    assert len(rows) == docs.count() and set(without_repeats(docs).columns) == set(docs.columns) | {"n_removed"}
    got = {r["doc_id"]: r for r in rows}
    assert (got[1]["n_removed"], got[2]["n_removed"], got[2]["text"]) == (0, 22, "")
    assert got[8]["n_removed"] == 60_000 and got[7]["n_removed"] == plain_passages([(7, LONG)], 20)[7][1]
    assert got[3]["n_words"] == got[4]["n_words"] == got[5]["n_words"] == 0 and got[None]["n_removed"] == 0
    assert without_repeats(none(spark)).count() == 0


def test_common_minimisers_come_last_and_change_nothing():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 300, np.uint64)
    plain = minimisers(hashes, 20, np.zeros(0, np.uint64))
    common = np.sort(np.unique(plain)[:10])
    assert len(plain) == 281 and not np.isin(minimisers(hashes, 20, common), common).any()


def test_windows_are_compared_word_for_word():
    ids = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3, 5], np.int32)
    doc, start = repeated(ids, 6, np.array([[7, 8], [0, 0], [6, 4]]), 2)
    assert sorted(zip(doc.tolist(), start.tolist())) == [(7, 3), (8, 0), (8, 1)]


def test_marks_are_intervals(spark):
    docs = spark.createDataFrame([(1, " ".join("abcdefghijklmnopqrstuvwxyz")), (2, " ".join("zabcdefghijklmnopqrstuvwxyz"))], "doc long, text string")
    found = marks(docs.select("doc", F.encode("text", "UTF-8").alias("text")), 20).collect()
    covered = {(r["doc"], i) for r in found for i in range(r["start"], r["stop"])}
    assert covered == {(2, i) for i in range(1, 27)}


def all_line_runs(docs, least=10):
    """Every run of any length is tried; with the longest run as a power of two."""
    seen, out = {}, {}
    for doc, text in sorted(docs):
        lines = text.split("\n")
        gone, longest = [False] * len(lines), 0
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if seen.setdefault(tuple(lines[i:j]), (doc, i)) != (doc, i) and len("".join(lines[i:j])) >= least:
                    gone[i:j] = [True] * (j - i)
                    longest = max(longest, 1 << ((j - i).bit_length() - 1))
        out[doc] = (len(lines), sum(gone), longest, "\n".join(x for x, g in zip(lines, gone) if not g))
    return out


def test_lines_against_a_plain_version(spark):
    texts = [t.replace(" ", "\n") for t in random_texts(3, 150, ["short", "", "a line long enough".replace(" ", "_"), "another_long_line", "tiny", "x_y_z_x_y_z_w"], 30)]
    docs = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["longest_run"], r["text"]) for r in without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == all_line_runs(docs)


def test_runs_of_many_short_lines_go(spark):
    tokens = [f"{i:x}" for i in range(60)]
    docs = [(i, "\n".join([f"a title of its own {i}", *tokens, f"an end of its own {i}"])) for i in range(5)]
    docs += [(10 + i, f"own {i}\nabcd\nefgh\nijkl\nown {-i}") for i in range(3)] + [(20 + i, f"{i}\na long line here\nx\n\n\ny\n{i}{i}") for i in range(3)]
    docs += [(100 + i, t.replace(" ", "\n")) for i, t in enumerate(random_texts(9, 80, ["", "", "x", "yz", "tiny", "short", "a_line_long_enough"], 25))]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["longest_run"], r["text"]) for r in without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == all_line_runs(docs)
    assert [got[d][1] for d in (0, 4, 10, 12, 20, 22)] == [0, 60, 0, 3, 0, 5]


def test_runs_are_ranked_in_order(spark):
    docs = [(1, "b\na\nc\nd\ne"), (2, "a\nc\nd\ne\nz"), (3, "q\nb\na")]
    rounds = {n: runs.collect() for n, runs in doublings(spark.createDataFrame(docs, "doc_id long, text string"))}
    lines = {d: t.split("\n") for d, t in docs}
    assert sorted(rounds) == [1, 2, 4]
    for n, runs in rounds.items():
        found = Counter(tuple(lines[d][i : i + n]) for d in lines for i in range(len(lines[d]) - n + 1))
        held = [tuple(lines[r["doc"]][r["pos"] : r["pos"] + n]) for r in runs]
        assert Counter(held) == Counter({k: v for k, v in found.items() if v > 1})
        ranks = {}
        for r, run in zip(runs, held):
            assert ranks.setdefault(r["rank"], run) == run
        assert sorted(ranks) == list(range(len(ranks)))
    order = {run[0]: r["rank"] for r in rounds[1] for run in [lines[r["doc"]][r["pos"]]]}
    pairs = {tuple(lines[r["doc"]][r["pos"] : r["pos"] + 2]): r["rank"] for r in rounds[2]}
    assert sorted(pairs, key=pairs.get) == sorted(pairs, key=lambda p: (order[p[0]], order[p[1]]))


def test_lines_of_awkward_documents(spark):
    docs = with_clashes(awkward(spark), "n_lines", "_pos", "rank")
    rows = without_repeated_lines(docs).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count() and (got[2]["n_removed"], got[2]["longest_run"], got[2]["text"]) == (2, 2, "")
    assert got[3]["text"] is None and got[3]["n_lines"] == 0 and got[4]["n_lines"] == 1 and got[6]["n_removed"] == 0
    assert got[8]["text"] == "" and got[7]["n_removed"] == 0
    assert without_repeated_lines(none(spark)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_alignment_against_the_full_table():
    rng = random.Random(4)
    for _ in range(400):
        a = [rng.randrange(6) for _ in range(rng.randrange(25))]
        b = list(a)
        for _ in range(rng.randrange(7)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(6)] * rng.randrange(2)
        most, true = rng.randrange(12), edit_distance(a, b)
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert distance(x, y, most) == (true if true <= most else None)
        if a or b:
            assert alike(x, y, 0.8) == (1 - true / max(len(a), len(b)) >= 0.8 - 1e-12)


def test_near_copies_and_a_large_group(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.randrange(80, 200))] for _ in range(60)]
    docs, truth = [], {}
    for i, words in enumerate(base):
        for j in range(40 if i == 0 else rng.randrange(1, 4)):
            copy = list(words)
            for _ in range(j and len(words) // 60):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            truth[len(docs)] = i
            docs.append((len(docs), " ".join(copy)))
    got = {r["doc"]: r["class"] for r in near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    first = {}
    for d, i in truth.items():
        first.setdefault(i, d)
    assert got == {d: first[i] for d, i in truth.items()}


def test_classes_of_awkward_documents(spark):
    docs = with_clashes(awkward(spark), "class", "leader")
    rows = near_classes(docs).collect()
    got = {r["doc"]: (r["class"], r["copies"]) for r in rows}
    assert len(rows) == docs.count() and got[2] == (1, 2) and got[8] == (7, 2) and got[6] == (6, 2)
    assert got[3][0] == got[4][0] == got[10][0] == 3 and got[9] == (9, 1)
    assert near_classes(none(spark)).count() == 0


def test_texts_of_one_doc_id_are_told_apart(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(25))
    texts = [" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(60)) for c in "abcd"]
    with_passage = [" ".join([*t.split()[:10], passage, *t.split()[35:]]) for t in texts[:2]]
    docs = [(None, with_passage[0]), (None, with_passage[1]), (None, texts[2]), (None, texts[2]), (7, texts[3]), (7, texts[3])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r["n_removed"], r["text"]) for r in without_repeats(df).collect())
    assert [n for n, _ in got] == [0, 0, 0, 0, 0, 25] and got[-1][1] in [" ".join([*t.split()[:10], *t.split()[35:]]) for t in texts[:2]]
    assert {t for n, t in got if not n} < {*with_passage, *texts[2:]}

    near = [(None, " ".join(["changed", *t.split()[1:]])) for t in texts[:2]] + [(None, t) for t in texts[:3]] + [(None, texts[2])]
    df = spark.createDataFrame([(*d, "en", None, 0) for d in near], "doc_id long, text string, lang string, source string, n_chars long")
    rows = near_classes(df).collect()
    assert sorted(r["copies"] for r in rows) == [2] * 6 and sum(r["leads"] for r in rows) == 4
    kept = [r["text"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert sorted(t.split()[-1] for t in kept) == sorted(t.split()[-1] for t in texts[:3])
