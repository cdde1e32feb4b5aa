"""Problem 9: reading level of each document."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .texts import Memo, arrow_map, folded_words, hash64, is_latin, joined, keyed, words

#: Corpus frequencies are kept in so many hashed counters: one size for every corpus.
COUNTERS = 1 << 20
#: Words that are modelled one by one; the others are modelled by their surprisal in the corpus, in bits.
COMMON, EDGES = 30, (7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 18)
#: Latin documents from so many words on are given a level; surprisal per word is weighed as if each text had as many.
SHORTEST = 60
#: Orders that are interpolated: trigrams, bigrams, unigrams and an even distribution. Rounds of estimating their shares.
ORDERS, ROUNDS, FOLDS = 4, 25, 10
STOP, PAUSE, START = 0, 1, 2
#: Codes of stops and pauses in a stored text, in which words are numbers of counters.
STORED_STOP, STORED_PAUSE = -1, -2


def folded_words_and_marks(text: str) -> list[str]:
    """Folded words, with stops and pauses between them."""
    marked = re.sub(r"[.!?:]+", " qqstopqq ", re.sub(r"[,;]+", " qqpauseqq ", text)) if re.search(r"[.,;:!?]", text) else text
    return ["." if w == "qqstopqq" else "," if w == "qqpauseqq" else w for w in folded_words(marked)]


def _stored(token: str) -> tuple[int, ...]:
    return tuple(STORED_STOP if w == "." else STORED_PAUSE if w == "," else hash64(w) & (COUNTERS - 1) for w in folded_words_and_marks(token))


def stored(text: str, memo: Memo) -> np.ndarray:
    """The text as counters of its words, with stops and pauses."""
    return np.array([c for w in joined(text) for c in memo[w]], np.int32)


def coded(docs: DataFrame) -> DataFrame:
    """(key, n_words, codes) of every Latin text; texts are folded once, here."""
    memo, kind = Memo(_stored), dict(docs.dtypes)["key"]

    def per_batch(batch):
        at, n, codes = [], [], []
        for i, t in enumerate(batch.column("text").to_pylist()):
            ws = words(t)
            if is_latin(ws):
                at.append(i)
                n.append(len(ws))
                codes.append(stored(t, memo))
        return {"key": batch.column("key").take(pa.array(at)), "n_words": n, "codes": codes} if at else None

    return arrow_map(docs, f"key {kind}, n_words int, codes array<int>", per_batch)


def corpus_frequencies(codes: DataFrame) -> np.ndarray:
    """Occurrences of words over all coded texts, in COUNTERS hashed counters."""

    def per_batch(batch):
        flat = batch.column("codes").flatten().to_numpy()
        n = np.bincount(flat[flat >= 0], minlength=1)
        at = np.flatnonzero(n)
        return {"c": at, "n": n[at]} if len(at) else None

    rows = arrow_map(codes.select("codes"), "c int, n bigint", per_batch).groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[rows["c"].to_numpy()] = rows["n"].to_numpy()
    return out


class Ngrams:
    """Trigram, bigram and unigram shares of sequences of codes."""

    def __init__(self, sequences: list[np.ndarray], size: int):
        one, two, three = np.full(size, 0.1), np.zeros((size, size)), np.zeros((size, size, size), np.float32)
        for s in sequences:
            c = np.concatenate(([START, START], s))
            np.add.at(one, c[2:], 1)
            np.add.at(two, (c[1:-1], c[2:]), 1)
            np.add.at(three, (c[:-2], c[1:-1], c[2:]), 1)
        n2, n3 = two.sum(1, keepdims=True), three.sum(2, keepdims=True)
        self.one = one / one.sum()
        self.two = np.where(n2 > 0, two / np.maximum(n2, 1), self.one)
        self.three = np.where(n3 > 0, three / np.maximum(n3, 1), self.two[None])
        self.size = size

    def of(self, s: np.ndarray) -> np.ndarray:
        """The share of each of its codes in each order (rows)."""
        c = np.concatenate(([START, START], s))
        return np.stack([self.three[c[:-2], c[1:-1], c[2:]], self.two[c[1:-1], c[2:]], self.one[c[2:]], np.full(len(s), 1 / self.size)])

    def bits(self, shares: np.ndarray) -> np.ndarray:
        return -np.log2(shares[0] * self.three + shares[1] * self.two[None] + shares[2] * self.one + shares[3] / self.size).astype(np.float32)


def interpolation(sequences: list[np.ndarray], size: int, folds: int = 5) -> np.ndarray:
    """Shares of the orders: those under which sequences are most likely given the others (expectation and maximisation)."""
    held = []
    for f in range(folds):
        known, new = [s for i, s in enumerate(sequences) if i % folds != f], sequences[f::folds]
        if known and new:
            held += list(map(Ngrams(known, size).of, new))
    shares = np.full(ORDERS, 1 / ORDERS)
    each = np.concatenate(held, 1) if held else np.zeros((ORDERS, 0))
    for _ in range(ROUNDS if each.shape[1] else 0):
        part = shares[:, None] * each
        shares = (part / part.sum(0)).mean(1)
    return shares


class Difficulty:
    """Interpolated trigram models, one a level, over common words, surprisal classes of the others, stops and pauses.

    A text's surprisal per word under each model, over the whole text, gives an expected level; that
    is mapped to the grades by isotonic regression on held-out passages. For texts without stops there
    is a second set of models that never saw one. The shares of the orders come from held-out passages too.
    """

    def __init__(self, frequencies: np.ndarray, passages: list[tuple[int, str]], folds: int = FOLDS):
        surprisal = np.log2(max(int(frequencies.sum()), 1) / np.maximum(frequencies, 0.5))
        self.levels = sorted({g for g, _ in passages})
        seen: dict[str, int] = {}
        for _, t in passages:
            for w in folded_words(t):
                seen[w] = seen.get(w, 0) + 1
        common = sorted(seen, key=lambda w: (-seen[w], w))[:COMMON]
        self.size = 3 + len(common) + len(EDGES) + 1
        self.code = (3 + len(common) + np.searchsorted(EDGES, surprisal)).astype(np.int16)
        for i, w in enumerate(common):
            self.code[hash64(w) & (COUNTERS - 1)] = 3 + i
        memo = Memo(_stored)
        given = [(g, stored(t, memo)) for g, t in passages]
        self.models = [self._train(given, stops) for stops in (True, False)]
        # expected levels of passages by models that haven't seen them
        self.held: list[list[tuple[float, int]]] = [[], []]
        for f in range(folds):
            rest = [x for i, x in enumerate(given) if i % folds != f]
            for which, stops in enumerate((True, False)):
                models = self._train(rest, stops)
                self.held[which] += [(self._expected(models, self._stream(c, stops)), g) for g, c in given[f::folds]]
        self.steps = [isotonic(h) for h in self.held]

    def _stream(self, codes: np.ndarray, stops: bool) -> np.ndarray:
        """Stored codes as those of the models."""
        own = np.where(codes >= 0, self.code[codes], np.where(codes == STORED_STOP, STOP, PAUSE))
        return own if stops else own[codes >= 0]

    def _train(self, given, stops: bool) -> np.ndarray:
        """Bits of c after (a, b), for each level."""
        out = []
        for level in self.levels:
            own = [self._stream(c, stops) for g, c in given if g == level]
            out.append(Ngrams(own, self.size).bits(interpolation(own, self.size)))
        return np.stack(out)

    def _expected(self, models: np.ndarray, s: np.ndarray) -> float:
        c = np.concatenate(([START, START], s))
        bits = models[:, c[:-2], c[1:-1], c[2:]].mean(1) * SHORTEST if len(s) else np.zeros(len(self.levels))
        p = np.exp2(bits.min() - bits)
        return float(p @ np.arange(len(self.levels)) / p.sum())

    def level(self, codes: np.ndarray) -> tuple[int, float]:
        """(level, expected level) of a stored text; stops count if it has one in a hundred words."""
        stops = bool((codes == STORED_STOP).sum() * 100 >= (codes >= 0).sum())
        x = self._expected(self.models[0 if stops else 1], self._stream(codes, stops))
        return self.levels[int(np.searchsorted(self.steps[0 if stops else 1], x, side="right"))], x


def isotonic(pairs: list[tuple[float, int]]) -> np.ndarray:
    """Thresholds at which the isotonic regression of grades on values passes from one grade to the next."""
    grades = sorted({g for _, g in pairs})
    rank = {g: i for i, g in enumerate(grades)}
    xs = np.array(sorted(x for x, _ in pairs))
    blocks: list[list[float]] = []
    for x, g in sorted(pairs):
        blocks.append([float(rank[g]), 1.0])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, n = blocks.pop()
            a, m = blocks.pop()
            blocks.append([(a * m + b * n) / (m + n), m + n])
    fitted = np.repeat([b[0] for b in blocks], [int(b[1]) for b in blocks])
    out = []
    for i in range(len(grades) - 1):
        above = np.flatnonzero(fitted >= i + 0.5)
        at = int(above[0]) if len(above) else len(xs)
        out.append(xs[0] if at == 0 else xs[-1] + 1e-9 if at == len(xs) else (xs[at - 1] + xs[at]) / 2)
    return np.array(out)


def reading_levels(docs: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text", most: int = 20_000) -> DataFrame:
    """(key, level, expected, n_words) of every Latin document of SHORTEST words or more.

    At most `most` graded passages are read: a bounded, labelled sample. Without passages of two levels
    there is no result. Word frequencies are of all Latin documents. Rows without key or text are left
    out; repeated rows give repeated results.
    """
    base = keyed(docs, key, text)
    kind = dict(docs.dtypes)[key]
    schema = f"key {kind}, level int, expected double, n_words int"
    graded = passages.where("reading_level is not null and text is not null").orderBy("reading_level", F.xxhash64("text")).limit(most).collect()
    graded = [(r.reading_level, r.text) for r in graded if folded_words(r.text)]
    graded.sort(key=lambda x: hash64(x[1]))
    if len({g for g, _ in graded}) < 2:
        return docs.sparkSession.createDataFrame([], schema)
    codes = materialize(coded(base))
    shared = docs.sparkSession.sparkContext.broadcast(Difficulty(corpus_frequencies(codes), graded))

    def per_batch(batch):
        found = [shared.value.level(np.asarray(c, np.int32)) for c in (x.values.to_numpy() for x in batch.column("codes"))]
        level, x = zip(*found)
        return {"key": batch.column("key"), "level": list(level), "expected": list(x), "n_words": batch.column("n_words")}

    return arrow_map(codes.where(F.col("n_words") >= SHORTEST), schema, per_batch)
