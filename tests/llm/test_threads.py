"""Quotation links against a plain version, and documents that are repeated among the labelled ones."""

import random
import re
import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from orewash.llm import toxicity as tox
from orewash.llm.conversations import reply_links, reply_ordered


def norm(text):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip().lower()


def plain_passages(text):
    """Level and words of each quoted passage, and what stands outside them."""
    quoted, own, at = [], [], None
    for line in text.split("\n"):
        marks = re.match(r"(?:[ \t]*>)*", line).group()
        level = marks.count(">")
        body = re.sub(r"^(?:[ \t]*>)+[ \t]?", "", line)
        if level and at == level:
            quoted[-1][1].append(body)
        elif level:
            quoted.append((level, [body]))
        else:
            own.append(line)
        at = level
    return [(level, "\n".join(body)) for level, body in quoted if norm("\n".join(body))], "\n".join(own)


def plain_links(messages):
    """The earliest message, of the conversation first, that holds a passage whole, as a paragraph, or as lines in a row."""
    said = []
    for conv, turn, text in sorted(messages):
        own = plain_passages(text)[1]
        lines = [norm(x) for x in own.split("\n") if norm(x)]
        runs = {" ".join(lines[i:j]) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1)}
        said.append(((conv, turn), runs | {norm(p) for p in re.split(r"\n[ \t]*\n", own)} | {norm(own)}))
    out = {}
    for conv, turn, text in messages:
        found = []
        for at, (level, body) in enumerate(plain_passages(text)[0]):
            holders = [place for place, keys in said if norm(body) in keys]
            here = [p for p in holders if p[0] == conv]
            best = here[0] if here and here[0] < (conv, turn) else holders[0] if holders and holders[0] < (conv, turn) else None
            found.append((level, at, best))
        if found:
            linked = [f for f in found if f[2]]
            out[conv, turn] = (len(found), len(linked), min(linked, key=lambda f: f[:2])[2] if linked else None)
    return out


def test_links_against_a_plain_version(spark):
    rng = random.Random(7)
    sentences = [f"{a} {b} {c}" for a in ("We", "they", "Nobody") for b in ("saw", "like", "need") for c in ("it", "THE house", "rain today")]
    messages = []
    for conv in range(12):
        for turn in range(rng.randrange(2, 7)):
            lines = []
            for _ in range(rng.randrange(3)):
                if messages:
                    _, _, other = rng.choice(messages[-12:])
                    body = [x for x in other.split("\n")]
                    start = rng.randrange(len(body))
                    lines += [">" + rng.choice(["", " "]) + x for x in body[start : start + rng.randrange(1, 4)]]
                lines += rng.sample(sentences, rng.randrange(3)) + rng.choice([[], [""]])
            lines += rng.sample(sentences, rng.randrange(1, 5))
            messages.append((conv, turn, "\n".join(lines)))
    df = spark.createDataFrame(messages, "conv_id long, turn long, text string")
    got = {(r["conv_id"], r["turn"]): (r["n_quotes"], r["n_linked"], (r["parent_conv"], r["parent_turn"]) if r["n_linked"] else None) for r in reply_links(df).collect()}
    want = plain_links(messages)
    assert got == want and sum(v[1] for v in want.values()) > 20
    assert any(body.count("\n") for _, _, t in messages for _, body in plain_passages(t)[0])


def test_quotations_of_several_lines(spark):
    said = [
        (1, 0, "u", "L1\nL2\nL3"), (1, 1, "a", "> L1\n> l2\nyes"), (1, 2, "u", "A1\n\nB1a\nB1b\nB2"),
        (1, 3, "a", "> B1a\n> B1b\n> > A1\n> B2\nso"), (1, 4, "u", "> B2\n> B1a\nno such order"), (1, 5, "u", "x " * 50_000 + "\n> L2\n> L3"),
    ]
    rows = reply_ordered(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).collect()
    got = {r["turn"]: (r["n_quotes"], r["n_linked"], r["parent_turn"]) for r in rows}
    assert got == {0: (0, 0, None), 1: (1, 1, 0), 2: (0, 0, None), 3: (3, 3, 2), 4: (1, 0, None), 5: (1, 1, 0)}


def test_a_repeated_labelled_document_is_learnt_from_once(spark, monkeypatch):
    docs = [(i, f"words of {i} here") for i in range(1, 40)] + [(1, "words of 1 here")] * 500 + [(2, "another text of two")]
    labels = [(i, i % 2) for i in range(1, 40)]
    seen = []
    monkeypatch.setattr(tox, "train", lambda labelled, prior: seen.extend(labelled) or tox.Model(tox.np.zeros(tox.BUCKETS, tox.np.float32), 0.0))
    tox.fit(spark.createDataFrame(docs, "doc_id long, text string").withColumn("x", F.lit(1)), spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = [t for t, _ in seen]
    assert len(texts) == len(set(texts)) and sum(t.startswith("words of 1 ") for t in texts) <= 1
    known = {i for i in range(1, 40) if tox.zlib.crc32(str(i).encode()) % 5}
    assert len(texts) == len(known)
