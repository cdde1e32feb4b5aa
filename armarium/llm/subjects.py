"""Problem 2: subject area of each document."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .scans import file_name
from .texts import Memo, arrow_map, folded_words, hash64, is_latin, words

#: Inflections that are cut off before a word is hashed; at least three letters stay.
ENDINGS = tuple(sorted("orum arum ibus endo isset atur ibat erat ere ens ant unt ae am em um us is as os at it a e i o".split(), key=len, reverse=True))
#: A document treats a subject if it has this share of the words that belong to any; it must be SHORTEST words long.
SHARE, SHORTEST = 0.25, 40
#: Weak labels: so many words of one subject, with what section and path add, this share of all its subject words and of the text.
LABEL_WORDS, LABEL_SHARE, LABEL_RATE = 6.0, 0.5, 0.08
#: The weight of a feature passes a half where it is this many times as frequent in a subject as in the middle of the others, and
#: rises from 0 to 1 around it with this steepness; features hold LEAST_RATE of the words of a subject, so each has 1 / LEAST_RATE of a kind at most.
RATIO, STEEP, LEAST_RATE = 20.0, 4.0, 2e-4
#: Values of sections and paths are counted in so many hashed places, pairs of words in so many.
PLACES, PAIRS = 1 << 12, 1 << 22
#: Biases that calibration tries, in words.
BIASES = np.arange(-1, 2.01, 0.25)


def stem(word: str) -> str:
    for e in ENDINGS:
        if word.endswith(e) and len(word) - len(e) >= 3:
            return word[: -len(e)]
    return word


def feature(word: str) -> int:
    """Hashed word without its ending, in 31 bits."""
    return hash64(stem(word)) & 0x7FFFFFFF


class Model:
    """Weights of hashed words and pairs of words, one column a subject: linear in a text's counts of features."""

    def __init__(self, weights: dict[int, np.ndarray], pairs: dict[int, np.ndarray], k: int):
        self.words, self.pairs = ((np.array(sorted(w), np.int64), np.array([w[f] for f in sorted(w)], np.float32).reshape(len(w), k)) for w in (weights, pairs))
        self.k = k

    def sums(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(per subject, of any subject): sums of the weights of each text's features."""
        n = len(lengths)
        per, any_ = np.zeros((n, self.k)), np.zeros(n)
        of = np.repeat(np.arange(n), lengths)
        streams = [(self.words, flat, of)]
        if len(self.pairs[0]):
            whole = of[:-1] == of[1:]
            streams.append((self.pairs, pair_hashes(flat)[whole], of[:-1][whole]))
        for (ids, weights), codes, owner in streams:
            if len(ids) and len(codes):
                at = np.searchsorted(ids, codes)
                hit = np.flatnonzero(ids[np.minimum(at, len(ids) - 1)] == codes)
                found, owner = weights[at[hit]], owner[hit]
                any_ += np.bincount(owner, found.max(1), n)
                for s in range(self.k):
                    per[:, s] += np.bincount(owner, found[:, s], n)
        return per, any_


def pair_hashes(flat: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((flat[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + flat[1:].astype(np.uint64)) >> np.uint64(20)).astype(np.int64) & (PAIRS - 1)


def flattened(batch) -> tuple[np.ndarray, np.ndarray]:
    codes = batch.column("codes")
    return codes.flatten().to_numpy(), np.diff(codes.offsets.to_numpy())


def coded(df: DataFrame, key: str, text: str, path: str, section: str) -> DataFrame:
    """(key, n_words, section, head, codes) of every Latin text of SHORTEST words or more: texts are folded once, here.

    section and head are hashed places of the section and of the first word of the file's name, null without them.
    """
    place = lambda c: F.pmod(F.xxhash64(F.lower(c)), F.lit(PLACES)).cast("int")
    none = F.lit(None).cast("string")
    where = F.col(path) if path in df.columns else none
    first = F.regexp_extract(file_name(where), r"^(?:Pagina_)?([^\s_.]+)", 1)
    base = df.select(
        F.col(key).alias("key"), F.col(text).alias("text"), place(F.col(section) if section in df.columns else none).alias("section"), place(F.when(where.isNotNull(), first)).alias("head")
    ).where("key is not null and text is not null")
    memo = Memo(feature)

    def per_batch(batch):
        at, n, codes = [], [], []
        for i, t in enumerate(batch.column("text").to_pylist()):
            ws = words(t)
            if len(ws) >= SHORTEST and is_latin(ws):
                at.append(i)
                n.append(len(ws))
                codes.append([memo[w] for w in folded_words(t)])
        if not at:
            return None
        at = pa.array(at)
        return {"key": batch.column("key").take(at), "n_words": n, "section": batch.column("section").take(at), "head": batch.column("head").take(at), "codes": codes}

    return arrow_map(base, f"key {dict(df.dtypes)[key]}, n_words int, section int, head int, codes array<int>", per_batch)


def seed_model(terms: DataFrame, examples: DataFrame, most: int = 100_000) -> tuple[list[str], Model, list[tuple[set[int], np.ndarray]]]:
    """(subjects, their first words, the examples as features with their subjects) from listed terms and labelled examples.

    At most `most` rows of each are read: they are a bounded, labelled sample.
    """
    listed = terms.where("subject is not null and term is not null").select("subject", "term").distinct().limit(most).collect()
    texts = examples.where("subject is not null and text is not null").select("subject", "text").distinct().limit(most).collect()
    subjects = sorted({r.subject for r in listed} | {r.subject for r in texts})
    number = {s: i for i, s in enumerate(subjects)}
    k = len(subjects)
    out: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(k, np.float32))
    for r in listed:
        for w in folded_words(r.term):
            out[feature(w)][number[r.subject]] = 1
    given: dict[str, set[int]] = defaultdict(set)
    counts = [Counter() for _ in subjects]
    for r in texts:
        given[r.text].add(number[r.subject])
        counts[number[r.subject]].update(map(feature, folded_words(r.text)))
    for f in {f for c in counts for f in c}:
        n = np.array([c[f] for c in counts], float)
        for i in np.flatnonzero((n >= 4) & ((n + 0.5) / (np.median(n) + 0.5) >= 5)):
            out[f][int(i)] = 1
    return subjects, Model(dict(out), {}, k), [(s, np.array(list(map(feature, folded_words(t))), np.int64)) for t, s in sorted(given.items())]


def strengths(seeds: Model, lifts: np.ndarray | None, batch) -> np.ndarray:
    """The weak label of each text, -1 for none: the subject whose seed words, with what section and path speak for it, are strong enough."""
    flat, lengths = flattened(batch)
    per, any_ = seeds.sums(flat, lengths)
    strong = per.copy()
    if lifts is not None:
        for d, name in enumerate(("section", "head")):
            strong += lifts[d][batch.column(name).fill_null(PLACES).to_numpy()]
    top = strong.argmax(1)
    own = np.take_along_axis(per, top[:, None], 1)[:, 0]
    sure = (np.take_along_axis(strong, top[:, None], 1)[:, 0] >= LABEL_WORDS) & (own > LABEL_SHARE * any_) & (own > LABEL_RATE * lengths)
    return np.where(sure, top, -1)


def metadata_lifts(texts: DataFrame, seeds) -> np.ndarray:
    """Logarithms of how much likelier a subject's label is with a section or a path's first word, [section or head, place, subject].

    Counted over all texts that the seed words alone label; places seen seldom say little, texts without say nothing.
    """
    k = seeds.value.k

    def per_batch(batch):
        label = strengths(seeds.value, None, batch)
        out = {"d": [], "place": [], "label": [], "n": []}
        for d, name in enumerate(("section", "head")):
            place = batch.column(name).fill_null(PLACES).to_numpy()
            use = (label >= 0) & (place < PLACES)
            at, n = np.unique(place[use].astype(np.int64) * k + label[use], return_counts=True)
            for c, v in zip(out, (np.full(len(at), d), at // k, at % k, n)):
                out[c] += v.tolist()
        return out if out["d"] else None

    rows = arrow_map(texts, "d int, place int, label int, n bigint", per_batch).groupBy("d", "place", "label").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # 2 x PLACES x subjects at most
    n = np.zeros((2, PLACES + 1, k))
    n[rows["d"], rows["place"], rows["label"]] = rows["n"]
    prior = (n.sum(1, keepdims=True) + 1) / (n.sum((1, 2), keepdims=True) + k)
    out = np.log((n + 10 * prior) / ((n.sum(2, keepdims=True) + 10) * prior))
    out[:, PLACES] = 0
    return out


def _weights(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One-versus-rest weights of features from their counts by label (features x subjects)."""
    rates = (n + 0.5) / size
    middle = np.maximum(np.median(rates, 1, keepdims=True), 1 / size)
    return np.where(rates >= LEAST_RATE, 1 / (1 + (RATIO * middle / rates) ** STEEP), 0.0)


def train(texts: DataFrame, seeds, lifts) -> Model:
    """Weights of all words and pairs of words, from all texts that seeds, sections and paths label.

    Pairs are counted whose words each hold LEAST_RATE of a subject's words, as no other pair can; of these
    the ones count whose words don't count themselves.
    """
    k = seeds.value.k

    def counts(pairs_of):
        def per_batch(batch):
            label = strengths(seeds.value, lifts.value, batch)
            flat, lengths = flattened(batch)
            of = np.repeat(label, lengths)
            if pairs_of is None:
                use, codes = of >= 0, flat.astype(np.int64)
            else:
                own = np.repeat(np.arange(len(lengths)), lengths)
                ids, able = pairs_of.value
                at = np.minimum(np.searchsorted(ids, flat), max(0, len(ids) - 1))
                fit = (of >= 0) & (ids[at] == flat) & able[at, of] if len(ids) else np.zeros(len(flat), bool)
                use, codes, of = fit[:-1] & fit[1:] & (own[:-1] == own[1:]), pair_hashes(flat), of[:-1]
            keys, n = np.unique(codes[use] * k + of[use], return_counts=True)
            return {"feature": keys // k, "label": keys % k, "n": n} if len(keys) else None

        return arrow_map(texts, "feature bigint, label int, n bigint", per_batch).groupBy("feature", "label").agg(F.sum("n").alias("n"))

    counted = materialize(counts(None))
    totals = {r.label: r.n for r in counted.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    size = np.array([max(totals.get(i, 0), 1) for i in range(k)], float)
    if len(totals) < 2:
        return seeds.value

    def frequent(rows):
        sums = rows.groupBy("feature").agg(*[F.coalesce(F.sum(F.when(F.col("label") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(k)])
        most = F.greatest(*[(F.col(f"n{i}") + 0.5) / float(size[i]) for i in range(k)])
        got = sums.where(most >= LEAST_RATE).toArrow().to_pandas()  # k / LEAST_RATE rows at most
        got = got.sort_values("feature")
        return got["feature"].to_numpy(np.int64), got[[f"n{i}" for i in range(k)]].to_numpy(float)

    ids, n = frequent(counted)
    w = _weights(n, size)
    sparse = lambda ids, w: {int(f): x.astype(np.float32) for f, x in zip(ids, w) if x.max() >= 0.01}
    plain = w.max(1) < 0.01
    held = texts.sparkSession.sparkContext.broadcast((ids[plain], ((n + 0.5) / size >= LEAST_RATE)[plain]))
    pair_ids, pair_n = frequent(counts(held))
    found = sparse(ids, w)
    # a subject of which too few texts were labelled keeps its seeds
    few = [i for i in range(k) if sum(x[i] >= 0.5 for x in found.values()) < (seeds.value.words[1][:, i] > 0).sum() / 4]
    for f, x in zip(seeds.value.words[0].tolist(), seeds.value.words[1]):
        for i in few:
            if x[i]:
                found.setdefault(f, np.zeros(k, np.float32))[i] = 1
    return Model(found, sparse(pair_ids, _weights(pair_n, size)) if len(pair_ids) else {}, k)


def biases(model: Model, examples: list[tuple[set[int], np.ndarray]]) -> np.ndarray:
    """Per subject the bias, in words, with the best balance of precision and recall on the examples: its own, and all subjects' at the weight of one."""
    k = model.k
    if not examples:
        return np.zeros(k)
    flat, lengths = np.concatenate([c for _, c in examples]), np.array([len(c) for _, c in examples])
    per, any_ = model.sums(flat, lengths)
    truth = np.zeros((len(examples), k), bool)
    for i, (s, _) in enumerate(examples):
        truth[i, list(s)] = True
    said = per[None] - SHARE * any_[None, :, None] >= BIASES[:, None, None]
    hit, told, real = (said & truth).sum(1), said.sum(1), truth.sum(0)
    f = 2 * (hit + hit.sum(1, keepdims=True) / k) / np.maximum(told + told.sum(1, keepdims=True) / k + real + real.sum() / k, 1)
    # of equals the nearest to none
    order = np.argsort(np.abs(BIASES), kind="stable")
    return BIASES[order[np.argmax(f[order], 0)]]


def substance(counts: DataFrame, model: Model, examples: list[tuple[set[int], np.ndarray]]) -> float:
    """The share of subject words that parts texts that treat a subject from those that have some words by chance.

    It is the lowest place of the smoothed histogram over all texts between its peak near none and what nineteen in twenty examples have.
    """
    bars = {r.b: r.n for r in counts.groupBy(F.least(F.floor(200 * F.col("n_any") / F.col("n_words")), F.lit(199)).alias("b")).agg(F.count("*").alias("n")).collect()}
    h = np.array([bars.get(i, 0) for i in range(200)], float)
    wide = 2 * max(1.0, (2000 / max(h.sum(), 1)) ** 0.2)
    at = np.arange(200)
    smooth = np.exp(-((at[:, None] - at[None]) ** 2) / (2 * wide**2)) @ h
    high = LABEL_RATE
    if examples:
        _, any_ = model.sums(np.concatenate([c for _, c in examples]), np.array([len(c) for _, c in examples]))
        high = float(np.quantile(any_ / np.maximum([len(c) for _, c in examples], 1), 0.05))
    top = max(2, int(200 * high))
    low = int(np.argmax(smooth[: max(1, top // 2)]))
    between = smooth[low : top + 1]
    flat = np.flatnonzero(between <= between.min() * 1.05 + 1e-9) + low
    return float((flat.mean() + 0.5) / 200)


def subjects_of(df: DataFrame, terms: DataFrame, examples: DataFrame, key: str = "doc_id", text: str = "_text", path: str = "path", section: str = "genre") -> DataFrame:
    """(key, subject, share, words): every subject that a Latin document of SHORTEST words or more treats in substance.

    Terms, examples, sections and paths label documents weakly; one-versus-rest linear classifiers over hashed words and pairs
    of words are trained on all of these. A document treats a subject if its weights for it exceed SHARE of those for any by
    the subject's bias, which the examples calibrate, and if those for any exceed what texts have by chance.
    Rows without key or text are left out, an empty text treats nothing, repeated rows count as often as they stand and give one
    result. Tables without path or section are labelled by words alone.
    """
    subjects, seeds, given = seed_model(terms, examples)
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    if not subjects:
        return spark.createDataFrame([], f"key {kind}, subject string, share double, words double")
    texts = materialize(coded(df, key, text, path, section))
    shared = spark.sparkContext.broadcast
    held = shared(seeds)
    model = train(texts, held, shared(metadata_lifts(texts, held)))
    own = shared(model)

    def per_batch(batch):
        per, any_ = own.value.sums(*flattened(batch))
        return {"key": batch.column("key"), "n_words": batch.column("n_words"), "n_any": any_, "by_subject": list(per)}

    counts = materialize(arrow_map(texts, f"key {kind}, n_words int, n_any double, by_subject array<double>", per_batch).dropDuplicates(["key"]))
    least, bias = substance(counts, model, given), biases(model, given).tolist()
    return (
        counts.where((F.col("n_any") > 0) & (F.col("n_any") >= least * F.col("n_words")))
        .select("key", "n_any", F.posexplode("by_subject").alias("i", "words"))
        .where((F.col("words") > 0) & (F.col("words") - SHARE * F.col("n_any") >= F.array(*map(F.lit, bias))[F.col("i")]))
        .select("key", F.array(*map(F.lit, subjects))[F.col("i")].alias("subject"), (F.col("words") / F.col("n_any")).alias("share"), "words")
    )
