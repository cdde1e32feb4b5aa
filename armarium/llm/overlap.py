"""Problem 5: same or near-same records across splits."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, salted_join, small
from .scans import is_furniture, title_words
from .texts import Memo, arrow_map, flat_hashes, folded_words, hash64, lcs, signatures

#: Share of both records' words that must agree in the same order.
AGREE = 0.7
#: Terms are runs of words, each as short as it can be to stand less than CHANCE times in the whole corpus if
#: words came in any order; so terms grow with the corpus, and few records share one by chance. Texts of up to SHORT words
#: have their single words as terms besides.
CHANCE, LONGEST, SHORT = 0.1, 8, 11
#: Least cosine of the term vectors of a pair. Of runs of three words a third stay whole if three words in
#: ten are new here and there, of runs of two half of them.
COSINE = 0.25
#: Share of a held-out vector's length that its lightest terms may have together and not be posted.
RESIDUAL = 0.15
#: Word frequencies and greatest weights are kept in so many hashed places, whatever the corpus; the posted terms of the smaller side in
#: a bitmap of LEAST_BITS to MOST_BITS, sixteen a term while they fit.
COUNTERS, LEAST_BITS, MOST_BITS, BLOCK = 1 << 20, 1 << 20, 1 << 28, 1 << 16

def bare_words(text: str, name: str = "") -> list[str]:
    """Folded words of a text without its page furniture: numbers, signatures, and heads that repeat the file's title."""
    if "\n" in text:
        title = title_words(name) if name else []
        most = 2 * len(name) + 24
        text = "\n".join([line for line in text.split("\n") if len(line) > most or not is_furniture(line, title)])
    return folded_words(text)


def coded(docs: DataFrame) -> DataFrame:
    """(key, held, class, codes) of documents with words: texts are read and folded once, here.

    docs: (key, text, name, held). codes are the folded words' hashes in 32 bits, a class is the hash of all words in order.
    """
    memo, kind = Memo(hash64), dict(docs.dtypes)["key"]

    def per_batch(batch):
        flat, lengths = flat_hashes([bare_words(t, n or "") for t, n in zip(batch.column("text").to_pylist(), batch.column("name").to_pylist())], memo)
        at = pa.array(np.flatnonzero(lengths))
        if not len(at):
            return None
        codes = pa.ListArray.from_arrays(np.append(0, np.cumsum(lengths)).astype(np.int32), flat.astype(np.int32)).take(at)
        return {"key": batch.column("key").take(at), "held": batch.column("held").take(at), "class": signatures(flat, lengths)[lengths > 0], "codes": codes}

    return arrow_map(docs, f"key {kind}, held boolean, class bigint, codes array<int>", per_batch)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy().astype(np.int64), np.diff(column.offsets.to_numpy())


def frequencies(texts: DataFrame) -> np.ndarray:
    """Occurrences of words over all documents in COUNTERS hashed counters."""

    def per_batch(batch):
        n = np.bincount(_flat(batch.column("codes"))[0] & (COUNTERS - 1), minlength=1)
        at = np.flatnonzero(n)
        return {"c": at, "n": n[at]}

    sums = arrow_map(texts.select("codes"), "c int, n bigint", per_batch).groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[sums["c"].to_numpy()] = sums["n"].to_numpy()
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def vectors(flat: np.ndarray, lengths: np.ndarray, logp: np.ndarray, log_n: float, residual: float = RESIDUAL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, terms, weights, residuals): the posted parts of unit vectors over runs of words, of a batch of texts.

    A run's weight is its information, the sum of its words'. A run that meets the end of the text
    while it is still too likely is no term. Texts of up to SHORT words have a second unit vector, over single words, whose terms
    no run shares. What is left out of a text's vector, its lightest terms, has the length `residual` at most.
    """
    if not len(flat):
        return np.empty(0, int), np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, np.float32)
    of = np.repeat(np.arange(len(lengths)), lengths)
    room = np.cumsum(lengths)[of] - np.arange(len(flat))
    with np.errstate(over="ignore"):
        hashes, info = _mix(flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), -logp[flat & (COUNTERS - 1)]
        todo, whole = np.ones(len(flat), bool), np.zeros(len(flat), bool)
        terms, weight = hashes.copy(), info.copy()
        for n in range(2, LONGEST + 1):
            k = len(flat) - n + 1
            if k <= 0:
                break
            at = np.flatnonzero(todo[:k] & (room[:k] >= n))
            terms[at] = terms[at] * np.uint64(0x9E3779B97F4A7C15) + hashes[at + n - 1]
            weight[at] += info[at + n - 1]
            enough = at if n == LONGEST else at[weight[at] - log_n >= -np.log(CHANCE)]
            todo[enough] = False
            whole[enough] = True
        single = np.flatnonzero((lengths <= SHORT)[of])
        # a text's two vectors are apart: 2 x text for runs, 2 x text + 1 for words
        vector = np.concatenate((2 * of[whole], 2 * of[single] + 1))
        terms = np.concatenate((_mix(terms[whole]), _mix(hashes[single] + np.uint64(7))))
        weight = np.concatenate((weight[whole], info[single]))
        _, first, tf = np.unique(terms ^ (vector.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    terms, vector, weight = terms[first].view(np.int64), vector[first], weight[first] * np.sqrt(tf)
    order = np.lexsort((-weight, vector))
    terms, vector, square = terms[order], vector[order], np.maximum(weight[order], 1e-9) ** 2
    if not len(terms):
        return vector, terms, np.empty(0, np.float32), np.empty(0, np.float32)
    starts = np.flatnonzero(np.concatenate(([True], vector[1:] != vector[:-1])))
    count = np.diff(np.append(starts, len(vector)))
    square /= np.repeat(np.add.reduceat(square, starts), count)
    run = np.cumsum(square)
    before = run - square - np.repeat(run[starts] - square[starts], count)
    keep = 1 - before > residual**2 if residual else np.ones(len(terms), bool)
    last = np.add.reduceat(keep.astype(np.int64), starts) + starts - 1
    left = np.sqrt(np.maximum(0, 1 - before[last] - square[last])) if residual else np.zeros(len(starts))
    return vector[keep] // 2, terms[keep], np.sqrt(square[keep]).astype(np.float32), np.repeat(left, count)[keep].astype(np.float32)


def _place(terms: np.ndarray) -> np.ndarray:
    return (terms >> 40) & (COUNTERS - 1)


def postings(texts: DataFrame, words, held=None) -> DataFrame:
    """(term, class, w, res) of every text: inverted lists of the terms that are posted.

    Without `held` all but the lightest terms of each vector are. With it (the other side's bitmap of terms and greatest weights
    by place) the whole vectors, of which only terms are posted that the other side has, and only of texts
    whose weights times the other side's greatest could reach COSINE less what that side has not posted.
    """

    def per_batch(batch):
        flat, lengths = _flat(batch.column("codes"))
        of, terms, w, left = vectors(flat, lengths, *words.value, RESIDUAL if held is None else 0.0)
        if held is not None:
            bits, most = held.value
            at = terms & (8 * len(bits) - 1)
            has = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            of, terms, w, left = of[has], terms[has], w[has], left[has]
            reach = np.bincount(of, w * most[_place(terms)], len(lengths)) >= COSINE - RESIDUAL - 1e-6
            use = reach[of]
            of, terms, w, left = of[use], terms[use], w[use], left[use]
        return {"term": terms, "class": batch.column("class").to_numpy()[of], "w": w, "res": left} if len(terms) else None

    return arrow_map(texts.select("class", "codes"), "term bigint, class bigint, w float, res float", per_batch)


def greatest(posted: DataFrame) -> np.ndarray:
    """The greatest posted weight by place of the term: COUNTERS values."""
    rows = posted.groupBy(F.shiftright("term", 40).bitwiseAND(F.lit(COUNTERS - 1)).cast("int").alias("c")).agg(F.max("w").alias("w")).toArrow()
    out = np.zeros(COUNTERS, np.float32)
    out[rows["c"].to_numpy()] = rows["w"].to_numpy()
    return out


def bitmap(terms: DataFrame, size: int) -> np.ndarray:
    """The terms as a bitmap of `size` bits, put together block by block."""
    import pandas as pd

    def per_batch(frames):
        bits = np.zeros(size >> 3, np.uint8)
        for f in frames:
            at = f["term"].to_numpy() & (size - 1)
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        for b in range(0, len(bits), BLOCK):
            if bits[b : b + BLOCK].any():
                yield pd.DataFrame({"block": [b], "bits": [bits[b : b + BLOCK].tobytes()]})

    def merged(f):
        return pd.DataFrame({"block": f["block"][:1], "bits": [reduce(np.bitwise_or, [np.frombuffer(x, np.uint8) for x in f["bits"]]).tobytes()]})

    out = np.zeros(size >> 3, np.uint8)
    for r in terms.select("term").mapInPandas(per_batch, "block int, bits binary").groupBy("block").applyInPandas(merged, "block int, bits binary").collect():
        out[r.block : r.block + BLOCK] = np.frombuffer(r.bits, np.uint8)
    return out


def cosine_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(class_l, class_r): classes whose vectors may have a cosine of COSINE or more.

    The inverted lists of both sides are joined on the term, long lists in parts. The right side's vectors are whole, so what the
    left side did not post adds at most its residual. Each text of a class stands in the lists once.
    """
    a = left.select("term", F.col("class").alias("class_l"), F.col("w").alias("wl"), F.col("res").alias("rl"))
    b = right.select("term", F.col("class").alias("class_r"), F.col("w").alias("wr"))
    return (
        salted_join(b, a, "term")
        .groupBy("class_l", "class_r")
        .agg(F.sum(F.col("wl") * F.col("wr")).alias("dot"), F.max("rl").alias("rl"))
        .where(F.col("dot") >= COSINE - F.col("rl") - 1e-6)
        .select("class_l", "class_r")
    )


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key_l, key_r, agree): records of two sides with at least AGREE of the words of both in the same order.

    left, right: (key, text, name of the file), left the smaller side (held-out records), right the larger. Candidates
    come from a weighted cosine join; their cosines are then computed in full, and their words compared in order (by hashes of
    32 bits). Texts without words pair with nothing; rows stored twice and pairs found twice count once.
    """
    left, right = (d.select("key", "text", "name", F.lit(h).alias("held")).where("key is not null and text is not null") for d, h in ((left, True), (right, False)))
    shared = left.sparkSession.sparkContext.broadcast
    texts = materialize(coded(left.union(right)))
    n = frequencies(texts)
    total = max(int(n.sum()), 1)
    words = shared((np.log(np.maximum(n, 1) / total).astype(np.float32), float(np.log(total))))
    posted = materialize(postings(texts.where("held").select("class", "codes").dropDuplicates(["class"]), words))
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(1, posted.count()) - 1).bit_length()))
    theirs = materialize(postings(texts.where("not held"), words, shared((bitmap(posted, size), greatest(posted)))).dropDuplicates(["term", "class"]))
    pairs = materialize(cosine_pairs(posted, theirs))
    return _checked(texts, pairs, words)


def exact_dots(a: pa.ListArray, b: pa.ListArray, words) -> np.ndarray:
    """The full dot products of the vectors of two columns of texts, row by row."""
    found = []
    for column in (a, b):
        flat, lengths = _flat(column)
        of, terms, w, _ = vectors(flat, lengths, *words, 0.0)
        with np.errstate(over="ignore"):
            found.append((terms.view(np.uint64) ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), of, w))
    (x, _, wx), (y, of, wy) = found
    if not len(x) or not len(y):
        return np.zeros(len(a))
    order = np.argsort(x)
    x, wx = x[order], wx[order]
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return np.bincount(of, np.where(x[at] == y, wx[at] * wy, 0), len(a))


def _checked(texts, pairs, words):
    """Compare one record of each class; then every member of the two classes pairs, classes of very many in parts."""
    sides, members = [], []
    for s, held in (("l", "held"), ("r", "not held")):
        some = small(materialize(pairs.select(F.col(f"class_{s}").alias("class")).distinct()))
        own = materialize(texts.where(held).join(some, "class", "left_semi"))
        members.append(own.select(F.col("class").alias(f"class_{s}"), F.col("key").alias(f"key_{s}")).distinct())
        sides.append(own.dropDuplicates(["class"]).select(F.col("class").alias(f"class_{s}"), F.col("codes").alias(f"codes_{s}")))
    joined = pairs.join(sides[0], "class_l").join(sides[1], "class_r")

    def per_batch(batch):
        a, b = batch.column("codes_l"), batch.column("codes_r")
        near = np.flatnonzero(exact_dots(a, b, words.value) >= COSINE)
        at, agree = [], []
        for i in near.tolist():
            x, y = a[i].values.to_pylist(), b[i].values.to_pylist()
            if min(len(x), len(y)) < AGREE * max(len(x), len(y)):
                continue
            share = lcs(x, y) / max(len(x), len(y))
            if share >= AGREE:
                at.append(i)
                agree.append(share)
        return {**{c: batch.column(c).take(pa.array(at)) for c in ("class_l", "class_r")}, "agree": agree} if at else None

    found = materialize(arrow_map(joined.select("class_l", "class_r", "codes_l", "codes_r"), "class_l bigint, class_r bigint, agree double", per_batch))
    members = [materialize(m.join(small(found.select(c).distinct()), c, "left_semi")) for m, c in zip(members, ("class_l", "class_r"))]
    return salted_join(salted_join(found, members[0], "class_l"), members[1], "class_r").select("key_l", "key_r", "agree")
