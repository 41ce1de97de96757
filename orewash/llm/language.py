"""Language by unigram pieces, summed over every way to cut a word.

The pieces are those of a fixed public vocabulary; a character it lacks is cut into its byte pieces. A language has a
probability for each piece, and a word's probability is the sum, over all segmentations into pieces, of the products of
their probabilities; a forward pass over the word's lattice gives it without listing them. A text's is the product over
its words, so a word is looked at once however often it stands there.

Probabilities are learnt by expectation maximisation over the counts of all words of the documents learnt from: Spark
counts words by language, then each round is one job over that table, in which tasks run forward and backward passes and
add up expected piece counts. What reaches the driver is one number for each piece and language.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from orewash.llm.common import text_of
from orewash.scratch import written

FOLDS, HELD_OUT = 4, 2
ROUNDS = 2
PRIOR = 200.0  # piece counts that every language is lent, spread as the pieces of all languages together
UNKNOWN = "und"
WORD_START = "▁"
BYTE_SYMBOLS = 0xF0000  # the symbol of byte 0 in a lattice; those characters are for private use
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
REMEMBERED = 300_000  # cuttings whose value a task keeps
LONGEST_REMEMBERED = 64
CHUNK_CHARS = 4 << 20
CELLS = 1 << 18  # lattice cells worked on at once
PLAIN_SYMBOLS, LEAST_CHANCE = 32, 1e-250  # longer or less likely words are summed in logarithms
COUNT_UNIT = 1 << 20  # expected counts are added as whole numbers of this part, so their sum has no order


class Lattice:
    """The vocabulary as a tree of symbols, and words as arrays of the pieces that begin at each of their symbols."""

    def __init__(self, pieces: dict[str, int], size: int):
        self.size, self.known = size, frozenset("".join(pieces))
        if not self.known.issuperset([WORD_START, *map(chr, range(BYTE_SYMBOLS, BYTE_SYMBOLS + 256))]):
            raise ValueError("the vocabulary needs a word start and a piece for each byte")
        self.longest = max(map(len, pieces), default=1)
        symbols = sorted(map(ord, self.known))
        self.number = np.full(max(symbols, default=0) + 2, -1, np.int32)  # the last one stands for all that follow
        self.number[symbols] = np.arange(len(symbols))
        children, ends = {}, [-1]
        for text, piece in pieces.items():
            node = 0
            for c in text:
                node = children.setdefault(node * len(symbols) + int(self.number[ord(c)]), len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = piece
        self.steps = np.array(sorted(children), np.int64)
        self.child = np.array([children[k] for k in self.steps.tolist()], np.int32)
        self.piece, self.width = np.array(ends, np.int32), len(symbols)

    @classmethod
    def of(cls, path: str) -> Lattice:
        """From a sentencepiece model; its byte pieces stand for characters that no other piece has."""
        model = SentencePieceProcessor(model_file=path)
        pieces = {}
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                pieces[chr(BYTE_SYMBOLS + int(model.id_to_piece(i)[1:-1], 16))] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[model.id_to_piece(i)] = i
        return cls(pieces, model.get_piece_size())

    def in_bytes(self, word: str) -> str:
        """The word, with byte symbols in place of characters outside the vocabulary."""
        return "".join(c if c in self.known else "".join(chr(BYTE_SYMBOLS + b) for b in c.encode()) for c in word)

    def batches(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which of ``words``, pieces): words of one length each, ``pieces[w, i, n]`` the piece of n + 1 symbols from i on, or -1."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(lengths).tolist():
            members = np.flatnonzero(lengths == length)
            step = max(1, CELLS // ((length + 1) * min(length + 1, self.longest)))
            for k in range(0, len(members), step):
                rows = members[k : k + step]
                codes = np.frombuffer("".join([WORD_START + words[i] for i in rows.tolist()]).encode("utf-32-le"), np.uint32)
                numbers = self.number[np.minimum(codes, len(self.number) - 1)].reshape(len(rows), length + 1)
                whole = (numbers >= 0).all(1)
                if whole.any():
                    yield rows[whole], self.found(numbers[whole])
                others = rows[~whole].tolist()
                if others:
                    for which, found in self.batches([self.in_bytes(words[i]) for i in others]):
                        yield np.array(others)[which], found

    def found(self, numbers: np.ndarray) -> np.ndarray:
        """The pieces from each symbol on: all places walk down the tree together, until it has no such child."""
        words, length = numbers.shape
        out = np.full((words, length, min(length, self.longest)), -1, np.int32)
        w, i = (x.ravel() for x in np.indices(numbers.shape))
        node = np.zeros(len(w), np.int64)
        for n in range(out.shape[2]):
            inside = i + n < length
            w, i, node = w[inside], i[inside], node[inside]
            step = node * self.width + numbers[w, i + n]
            at = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            there = self.steps[at] == step
            w, i, node = w[there], i[there], self.child[at[there]].astype(np.int64)
            out[w, i, n] = self.piece[node]
        return out


def summed(chances: np.ndarray, back: bool) -> np.ndarray:
    """Sums over all segmentations of the first i symbols (or of what follows them, ``back``), by i first.

    ``chances[i, n]``: probabilities of the piece of n + 1 symbols from i on, 0 where there is none; further axes are kept.
    """
    length, reach = chances.shape[:2]
    out = np.zeros((length + 1, *chances.shape[2:]))
    out[length if back else 0] = 1
    for i in range(length - 1, -1, -1) if back else range(length):
        for n in range(min(reach, length - i)):
            if back:
                out[i] += out[i + n + 1] * chances[i, n]
            else:
                out[i + n + 1] += out[i] * chances[i, n]
    return out


def log_summed(costs: np.ndarray, back: bool) -> np.ndarray:
    """The same in logarithms, for words whose chance is too small for a number."""
    length, reach = costs.shape[:2]
    out = np.full((length + 1, *costs.shape[2:]), -np.inf)
    out[length if back else 0] = 0
    for i in range(length - 1, -1, -1) if back else range(length):
        for n in range(min(reach, length - i)):
            if back:
                out[i] = np.logaddexp(out[i], out[i + n + 1] + costs[i, n])
            else:
                out[i + n + 1] = np.logaddexp(out[i + n + 1], out[i] + costs[i, n])
    return out


@dataclass(frozen=True)
class Model:
    """Languages in order, the log of their share of the documents, and the log probabilities ``pieces[language, piece]``."""

    languages: list[str]
    shares: np.ndarray
    pieces: np.ndarray


def table(pieces: np.ndarray, none: float) -> np.ndarray:
    """The values of each piece by language, with ``none`` as the last (-1) for what is no piece: (piece, language)."""
    return np.ascontiguousarray(np.append(pieces, np.full((len(pieces), 1), none), axis=1).T)


class Chances:
    """Sums over segmentations under a model; plain numbers where they do not run out, else logarithms."""

    def __init__(self, model: Model):
        self.logs = table(model.pieces, -np.inf)
        self.plain = np.exp(self.logs)

    def words(self, found: np.ndarray) -> np.ndarray:
        """Log probability of each word by language: (word, language)."""
        cells = found.transpose(1, 2, 0)
        total = summed(self.plain[cells], False)[-1] if len(cells) <= PLAIN_SYMBOLS else np.zeros((len(found), self.logs.shape[1]))
        with np.errstate(divide="ignore"):
            out = np.log(total)
        small = np.flatnonzero((total < LEAST_CHANCE).any(1))
        if len(small):
            out[small] = log_summed(self.logs[cells[:, :, small]], False)[-1]
        return out

    def shares(self, found: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Each piece's share of its word's probability in the word's language: how often it is expected there."""
        cells = found.transpose(1, 2, 0)
        length, reach = cells.shape[:2]
        chances = self.plain[cells, language]
        before = summed(chances, False) if length <= PLAIN_SYMBOLS else np.zeros((length + 1, len(found)))
        out = np.zeros(cells.shape)
        fine = np.flatnonzero(before[-1] >= LEAST_CHANCE)
        if len(fine):
            after = summed(chances[..., fine], True) / before[-1, fine]
            for n in range(reach):
                spans = length - n
                out[:spans, n, fine] = before[:spans, fine] * chances[:spans, n][:, fine] * after[n + 1 :]
        small = np.flatnonzero(before[-1] < LEAST_CHANCE)
        if len(small):
            costs = self.logs[cells[:, :, small], language[small]]
            before, after = log_summed(costs, False), log_summed(costs, True)
            for n in range(reach):
                spans = length - n
                out[:spans, n, small] = np.exp(before[:spans] + costs[:spans, n] + after[n + 1 :] - before[-1])
        return out.transpose(2, 0, 1)


def words_of(cutting: str) -> list[str]:
    """Runs of letters (with their marks) in composed form; digits and signs say nothing."""
    if not cutting.isascii():
        cutting = unicodedata.normalize("NFC", cutting)
    if cutting.isalpha():
        return [cutting]
    if cutting[:-1].isalpha() and cutting[-1] in ".,;:!?":
        return [cutting[:-1]]
    return LETTERS.findall(cutting)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): how often each language's documents have a word. Tasks count before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, cuttings in held.items():
                words: Counter = Counter()
                for cutting, n in cuttings.items():
                    for word in words_of(cutting):
                        words[word] += n
                columns = [pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                held[lang].update(text.as_py().lower().split())
                if sum(map(len, held.values())) > REMEMBERED:
                    yield from emptied()
        yield from emptied()

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected_counts(words: DataFrame, model: Model, lattice: Lattice) -> np.ndarray:
    """How often each language is expected to use each piece, under the model. ``words``: (language, word, n), languages as numbers."""
    sent = words.sparkSession.sparkContext.broadcast((model, lattice))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lattice = sent.value
        chances, total = Chances(model), np.zeros(model.pieces.size)
        for batch in batches:
            language, n = batch.column("language").to_numpy(), batch.column("n").to_numpy()
            for rows, found in lattice.batches(batch.column("word").to_pylist()):
                share = chances.shares(found, language[rows])
                at = np.nonzero(found >= 0)
                cell = language[rows][at[0]].astype(np.int64) * lattice.size + found[at]
                total += np.bincount(cell, share[at] * n[rows][at[0]], len(total))
        total = total.reshape(model.pieces.shape)
        whole_counts = np.rint(total * COUNT_UNIT).astype(np.int64)
        of, piece = np.nonzero(whole_counts)
        columns = [pa.array(of.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(whole_counts[of, piece])]
        yield pa.RecordBatch.from_arrays(columns, ["language", "piece", "n"])

    parts = words.mapInArrow(count, "language int, piece int, n long")
    rows = parts.groupBy("language", "piece").agg(F.sum(F.col("n").cast("decimal(38,0)")).cast("double").alias("n")).toArrow()
    found = np.zeros(model.pieces.shape)  # at most one row for each piece of the vocabulary and language
    found[rows.column("language").to_numpy(), rows.column("piece").to_numpy()] = rows.column("n").to_numpy() / COUNT_UNIT
    sent.destroy()
    return found


def probabilities(counts: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Logs of piece probabilities by language, each language lent ``prior`` counts as all together use them."""
    together = counts.sum(0) + 1e-3
    lent = counts + prior * together / together.sum()
    return np.log(lent / lent.sum(1, keepdims=True))


def held_out() -> Column:
    """Whether a document is kept from learning. A null doc_id counts as the empty text, which is not."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def fit(docs: DataFrame, lattice: Lattice, rounds: int = ROUNDS) -> Model:
    """A model of all of ``docs`` (lang, text). Languages are as many as ``lang`` has values, so those should be few."""
    learnt = docs.where(F.col("lang").isNotNull()).select("lang", text_of().alias("text"))
    shares = {r["lang"]: r["count"] for r in learnt.groupBy("lang").count().collect()}
    languages = sorted(shares)
    uniform = np.full((len(languages), lattice.size), -np.log(lattice.size))
    prior = np.log(np.array([shares[x] for x in languages], float) / max(1, sum(shares.values())))
    model = Model(languages, prior, uniform)
    if not languages:
        return model
    number = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).cast("int") - 1
    words = written(word_counts(learnt).select(number.alias("language"), "word", "n"), "language-words")
    for _ in range(rounds):
        model = Model(languages, prior, probabilities(expected_counts(words, model, lattice)))
    return model


class Scorer:
    """Scores texts in a task, remembering a bounded number of cuttings (what stands between white space)."""

    def __init__(self, model: Model, lattice: Lattice):
        self.model, self.lattice, self.chances = model, lattice, Chances(model)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.values = np.zeros((1024, len(self.model.languages) + 1))

    def learn(self, cuttings: list[str]) -> None:
        """Log probabilities of cuttings by language, and how many words each has."""
        number: dict[str, int] = {}
        owner, word = [], []
        for at, cutting in enumerate(cuttings):
            for w in words_of(cutting):
                owner.append(at)
                word.append(number.setdefault(w, len(number)))
        value = np.ones((len(number), self.values.shape[1]))
        for rows, found in self.lattice.batches(list(number)):
            value[rows, :-1] = self.chances.words(found)
        first = len(self.place)
        if first + len(cuttings) > len(self.values):
            larger = np.zeros((max(first + len(cuttings), 2 * len(self.values)), self.values.shape[1]))
            larger[:first] = self.values[:first]
            self.values = larger
        self.place.update(zip(cuttings, range(first, first + len(cuttings)), strict=True))
        for column in range(value.shape[1]):
            self.values[first : first + len(cuttings), column] = np.bincount(owner, value[word, column], len(cuttings)) if word else 0

    def texts(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its probability; ties go to the first name."""
        counted = [Counter(t.lower().split()) for t in texts]
        if len(self.place) > REMEMBERED:
            self.forget()
        self.learn(list({c for counts in counted for c in counts if c not in self.place}))
        names, scores = [], []
        for counts in counted:
            rows = np.fromiter(map(self.place.__getitem__, counts), np.int64, len(counts))
            total = np.fromiter(counts.values(), np.float64, len(counts)) @ self.values[rows]
            if not total[-1] or not self.model.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            logs = self.model.shares + total[:-1]
            best = int(logs.argmax())
            names.append(self.model.languages[best])
            scores.append(float(1 / np.exp(logs - logs[best]).sum()))
        if any(len(c) > LONGEST_REMEMBERED for counts in counted for c in counts):
            self.forget()
        return names, scores


def chunked(texts: pa.Array) -> Iterator[list[str]]:
    """Texts in lists of bounded size, nulls as empty."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def identify(docs: DataFrame, model: Model, lattice: Lattice, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the likeliest language of each whole text and its probability among the model's languages.

    Null texts and those without a letter are ``und`` with a score of 0, as all are if the model has no language. All
    columns are kept but for those called ``lang`` or ``score``, which are replaced. Tasks get the model, whose size is
    that of the vocabulary times the languages.
    """
    kept = docs.drop(lang, score)
    sent = docs.sparkSession.sparkContext.broadcast((model, lattice))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Scorer(*sent.value)
        for batch in batches:
            names, scores = [], []
            for texts in chunked(batch.column("text")):
                found = by.texts(texts)
                names += found[0]
                scores += found[1]
            yield batch.append_column(lang, pa.array(names, pa.string())).append_column(score, pa.array(scores, pa.float64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(add, f"{schema}, `{lang}` string, `{score}` double")


def languages(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``, by a model of the documents that are not held out.

    Learning takes text and lang of the rows whose doc_id is outside the held-out fold and whose lang is not null; lang,
    source and doc_id have no part in a prediction. Repeated rows are learnt from as often as they stand there and are
    predicted alike. Whole texts are read, however long. No documents give no rows.
    """
    lattice = Lattice.of(vocabulary)
    model = fit(docs.where(~held_out()), lattice, rounds)
    return identify(docs, model, lattice).withColumn("held_out", held_out())
