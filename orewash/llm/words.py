"""Ids of words by a word-level BPE vocabulary, each distinct word of a task looked up once."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer, pre_tokenizers

REMEMBERED = 200_000


def lower(text: str) -> str:
    """Lower case character by character (a final sigma is no exception)."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class WordTokens:
    """Texts to ids as little-endian unsigned 32-bit numbers, as the tokenizer's own ``encode`` would give them.

    The vocabulary drops white space, and none of its steps looks across it. So a text is cut at ASCII white space, and
    each distinct cutting goes through the tokenizer's steps once: normal form, lower case, pattern, merges. Cuttings
    that hold an added token go through ``encode`` itself.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.to_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.model = self.tokenizer.model
        ids = np.arange(max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1, dtype="<u4").tobytes()
        self.coded = [ids[i : i + 4] for i in range(0, len(ids), 4)]
        added = described.get("added_tokens", [])
        if any(t["content"].split() != [t["content"]] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that hold or take in white space are not supported")
        self.added = [t["content"] for t in added]
        self.remembered = remembered
        self.cuttings: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def forget(self) -> None:
        """Let go of all words, so that memory is not held from task to task."""
        self.cuttings.clear()
        self.words.clear()

    def ids(self, text: bytes) -> bytes:
        known, parts = self.cuttings, text.split()
        if len(known) > self.remembered:
            known.clear()
        return b"".join([known.get(p) or self.cutting(p) for p in parts])

    def cutting(self, part: bytes) -> bytes:
        raw = text = part.decode("utf-8")
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = lower(text)
        if any(a in raw or a in text for a in self.added):
            coded = self.coded
            self.cuttings[part] = ids = b"".join([coded[i] for i in self.tokenizer.encode(raw, add_special_tokens=False).ids])
            return ids
        known = self.words
        # Most cuttings are a word, or a word and a mark: no need of the pattern.
        if text.isalpha():
            ids = known.get(text) or self.word(text)
        elif text[:-1].isalpha() and text[-1] in ".,!?;:":
            ids = (known.get(text[:-1]) or self.word(text[:-1])) + (known.get(text[-1]) or self.word(text[-1]))
        else:
            ids = b"".join([known.get(w) or self.word(w) for w in self.pattern.findall(text)])
        self.cuttings[part] = ids
        return ids

    def word(self, word: str) -> bytes:
        if len(self.words) > self.remembered:
            self.words.clear()
        letters = word if word.isascii() and word.isprintable() else self.to_letters.pre_tokenize_str(word)[0][0]
        coded = self.coded
        ids = b"".join([coded[t.id] for t in self.model.tokenize(letters)])
        self.words[word] = ids
        return ids


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One for a worker process, as the file takes long to read; a task that is done should have it ``forget``."""
    return WordTokens(path)
