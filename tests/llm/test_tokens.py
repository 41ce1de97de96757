"""Byte-level BPE and packing against the tokenizers' own results."""

import base64
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from helpers import awkward, none

from orewash.llm.bpe import Numbers, Uneven, carefully, decode, encode, piece_encoder
from orewash.llm.packing import pack, pack_documents, pieces, place, sequences
from orewash.llm.words import WordTokens

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_and_decode_as_the_library(spark, library):
    docs = awkward(spark, [(20, " a  b\t c \n d"), (21, "'s it's  'll"), (22, "<|endoftext|> 12 ½"), (23, "x  ")])
    encoded = encode(docs.withColumn("ids", F.lit("clash")), RANKS, public_tokenizers.PATTERN)
    got = Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in decode(encoded, RANKS).collect())
    want = Counter((r["doc_id"], tuple(library.encode_ordinary(r["text"] or "")), (r["text"] or "").encode()) for r in docs.collect())
    assert got == want
    assert encode(none(spark), RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \t\n ab1'.s日é"), max_size=40))
def test_words_never_cut_a_match(text):
    encoder = piece_encoder(RANKS, public_tokenizers.PATTERN)
    numbers = Numbers()
    words = [numbers.names[i] for i in numbers.of(text)]
    assert "".join(words) == text
    matches = [m for w in words for m in encoder.pattern.findall(w)]
    assert matches == encoder.pattern.findall(text)


def test_unknown_id_is_an_error(spark):
    with pytest.raises(Exception, match="not in the table"):
        decode(spark.createDataFrame([(1, [50_300])], "doc_id long, ids array<int>"), RANKS).collect()


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(" \n abAΣÉ́1'.sİ日\x00\x85"), max_size=30))
def test_word_ids_as_the_library(text):
    assert np.frombuffer(TOKENS.ids(text.encode()), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "endoftext", "|>", " ", "\n", "a", "É", "É", "Σ", "1", "\x85", "日"]), max_size=12).map("".join))
def test_added_tokens_as_the_library(text):
    assert np.frombuffer(TOKENS.ids(text.encode()), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_an_added_token_is_one_id():
    assert np.frombuffer(TOKENS.ids(b"a <|endoftext|> b"), "<u4").tolist() == [320, 49407, 321]


TOKENS, LIBRARY = WordTokens(WORDS), Tokenizer.from_file(WORDS)


def test_packing_keeps_every_id_once(spark):
    docs = awkward(spark, [(100 + i, " ".join(["word"] * i)) for i in range(60)])
    parts = pieces(docs, WORDS, max_length=64, tail_unit=16, with_ids=True).cache()
    placed = pack(parts, 64).collect()
    for row in placed:
        assert row["ids_crc32"] == zlib.crc32(np.array(row["ids"], "<u4").tobytes()) and 0 < row["length"] <= 64
    by_sequence = {}
    for row in placed:
        by_sequence.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert sum(64 - sum(n for _, n in s) for s in by_sequence.values()) < 0.05 * 64 * len(by_sequence)
    texts = Counter()
    for r in docs.collect():
        texts[(r["doc_id"], tuple([*LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids, 1]))] += 1
    whole = {}
    for row in sorted(placed, key=lambda r: r["start"]):
        if row["doc_id"] != 6:  # given twice
            whole.setdefault(row["doc_id"], []).extend(row["ids"])
    assert {(k, tuple(v)) for k, v in whole.items()} == {k for k in texts if k[0] != 6}
    assert sorted(len(r["ids"]) for r in sequences(pack(parts, 64)).collect()) == sorted(sum(n for _, n in s) for s in by_sequence.values())
    assert pack_documents(none(spark), WORDS).count() == 0


def test_slots_cover_each_length_once():
    histogram = {64: 5, 40: 7, 24: 3, 20: 11, 3: 100, 1: 2}
    seen, room = Counter(), Counter()
    for length, rank, count, first, offset in place(histogram, 64):
        for i in range(count):
            seen[(length, rank + i)] += 1
            assert room[first + i] == offset
            room[first + i] += length
    assert seen == Counter((n, i) for n, c in histogram.items() for i in range(c)) and max(room.values()) <= 64


def test_careful_words():
    with pytest.raises(Uneven):
        Numbers()["a "]
    assert carefully("a  b c ".split(" ")) == ["a  b", " c "]
