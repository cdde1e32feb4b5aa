"""Problem 7: evaluation texts leaking into training text."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, small
from .texts import arrow_map, folded_words, keyed, lcs

#: Words in a row that make a leak, and the share of a whole item's words that may be replaced.
RUN, REPLACED = 20, 0.1
#: Every so many words of an item hold a posting term at least, so a run of RUN words holds two; fewer words where an item with as many
#: words replaced as may be would keep less than two.
STRIDE = 10
#: Items that are searched at once: their words go to every worker.
ITEMS = 20_000
#: Places at which offsets differ by up to so much belong to one match (divided words, inserted numbers).
SLACK = 16
_ROMAN = re.compile("[iuxlcdm]+").fullmatch


def load_items(items: DataFrame, key: str, text: str, most: int):
    """Folded words by item, `most` items at a time; items without words are left out."""
    block: dict[int, list[str]] = {}
    for r in keyed(items, key, text).dropDuplicates(["key"]).orderBy("key").toLocalIterator():
        if w := folded_words(r.text):
            block[r.key] = w
            if len(block) >= most:
                yield block
                block = {}
    if block:
        yield block


def folded(docs: DataFrame) -> DataFrame:
    """(key, text) of documents with words: folded words with blanks between them. Texts are folded once, here."""

    def per_batch(batch):
        return {"key": batch.column("key"), "text": [" ".join(folded_words(t)) for t in batch.column("text").to_pylist()]}

    return arrow_map(docs, f"key {dict(docs.dtypes)['key']}, text string", per_batch).where("text != ''")


def rejoined(ws: list[str], known: frozenset[str]) -> list[str]:
    """Words without roman numerals, with two neighbours made one where only together they are a known word."""
    if all(map(known.__contains__, ws)):
        return ws
    out, i, n = [], 0, len(ws)
    while i < n:
        w = ws[i]
        if w not in known:
            if i + 1 < n and w + ws[i + 1] in known:
                out.append(w + ws[i + 1])
                i += 2
                continue
            if _ROMAN(w):
                i += 1
                continue
        elif i + 1 < n and ws[i + 1] not in known and w + ws[i + 1] in known:
            out.append(w + ws[i + 1])
            i += 2
            continue
        out.append(w)
        i += 1
    return out


def term_counts(docs: DataFrame, known) -> DataFrame:
    """(term, n): how often each word of the items stands in the documents; partial sums per batch."""

    def per_batch(batch):
        n: dict[str, int] = defaultdict(int)
        vocabulary = known.value
        for t in batch.column("text").to_pylist():
            for w in t.split(" "):
                if w in vocabulary:
                    n[w] += 1
        return {"term": list(n), "n": list(n.values())} if n else None

    return arrow_map(docs.select("text"), "term string, n bigint", per_batch).groupBy("term").agg(F.sum("n").alias("n"))


def anchors(items: dict[int, list[str]], counts: dict[str, int]) -> list[tuple[str, int, int]]:
    """(term, item, offset): of every STRIDE words in a row of an item the one that is rarest in the documents.

    An item holds two windows more than words of it may be replaced, so two of its terms stay whatever the replaced words are.
    """
    out = set()
    for i, ws in items.items():
        rank = [(counts.get(w, 0), w, p) for p, w in enumerate(ws)]
        wide = min(STRIDE, max(1, len(ws) // (int(len(ws) * REPLACED) + 2)))
        for p in range(max(1, len(ws) - wide + 1)):
            _, w, at = min(rank[p : p + wide])
            out.add((w, i, at))
    return sorted(out)


def postings(docs: DataFrame, terms, known) -> DataFrame:
    """The positional inverted index: (term, key, pos) of the items' rarest terms in all documents."""

    def per_batch(batch):
        out = {"term": [], "key": [], "pos": []}
        wanted, vocabulary = terms.value, known.value
        for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            ws = t.split(" ")
            if wanted.isdisjoint(ws) and not any((a not in vocabulary or b not in vocabulary) and a + b in wanted for a, b in zip(ws, ws[1:])):
                continue
            for p, w in enumerate(rejoined(ws, vocabulary)):
                if w in wanted:
                    out["term"].append(w)
                    out["key"].append(k)
                    out["pos"].append(p)
        return out

    kind = dict(docs.dtypes)["key"]
    return arrow_map(docs, f"term string, key {kind}, pos int", per_batch)


def candidates(index: DataFrame, anchor: DataFrame, need: int = 2) -> DataFrame:
    """(key, item, diag): places where `need` anchors of an item stand at about their offsets (all, if it has fewer).

    diag is the position of the item's first word in the document, rounded to SLACK; each hit counts
    for two neighbouring places, so that no match is cut in two.
    """
    hit = index.join(anchor, "term").withColumn("at", F.floor((F.col("pos") - F.col("offset")) / SLACK))
    place = F.explode(F.array(F.col("at"), F.col("at") + 1)).alias("place")
    return (
        hit.select("key", "item", "offset", "anchors", place)
        .groupBy("key", "item", "place")
        .agg(F.count_distinct("offset").alias("n"), F.first("anchors").alias("anchors"))
        .where(f"n >= least({need}, anchors)")
        .groupBy("key", "item")
        .agg(F.collect_set(((F.col("place") - 1) * SLACK).cast("int")).alias("diags"))
    )


def matched(item: list[str], doc: list[str], diags: list[int]) -> tuple[int, float]:
    """Longest run of the item's words in the document, and the best share of its words in order, at these places.

    The run is found in the letters alone, so divisions of words don't matter. Where neither a half of a run of RUN words nor
    the share of a whole item is there, the run isn't measured and given as 0.
    """
    n, best, share = len(item), 0, 0.0
    parts = [doc[max(0, d - SLACK) : d + n + 2 * SLACK] for d in diags]
    half = RUN // 2
    halves = ["".join(item[i : i + half]) for i in range(0, n - half + 1, half)]
    for part in parts:
        own = lcs(item, part) / n
        share = max(share, own)
        stream = "".join(part)
        if own >= 1 - REPLACED or any(h in stream for h in halves):
            i = 0
            while i + best < n:
                if "".join(item[i : i + best + 1]) in stream:
                    best += 1
                else:
                    i += 1
    return best, share


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, run, share): documents that hold RUN consecutive words of an item, or the whole item
    with at most a tenth of its words replaced.

    Postings of the items' rarest terms in all documents are intersected with offsets adjusted; only
    the documents that stay are read again and compared exactly. Case, punctuation, numbers, marks,
    layout, divided words, vowel lengths, ligatures, u/v and i/j make no difference. Null or wordless
    items and documents match nothing. Items with the same key: one of them holds. A document stored
    twice counts once. Items are searched ITEMS at a time.
    """
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)[key], dict(items.dtypes)[item_key]
    schema = f"key {kind}, item {item_kind}, run int, share double"
    base = materialize(folded(keyed(docs, key, text)))
    found = [_block(base, every, kind, item_kind, schema) for every in load_items(items, item_key, item_text, ITEMS)]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)


def _block(base: DataFrame, every: dict[int, list[str]], kind: str, item_kind: str, schema: str) -> DataFrame:
    """leaks() of some items, whose words every worker holds, in folded documents."""
    spark = base.sparkSession
    shared = spark.sparkContext.broadcast
    known = shared(frozenset(w for ws in every.values() for w in ws))
    counts = {r.term: r.n for r in term_counts(base, known).collect()}  # no more rows than the items have words
    rows = anchors(every, counts)
    per_item: dict = defaultdict(int)
    for _, i, _ in rows:
        per_item[i] += 1
    anchor = spark.createDataFrame([(t, i, p, per_item[i]) for t, i, p in rows], f"term string, item {item_kind}, offset int, anchors int")
    index = postings(base, shared(frozenset(t for t, _, _ in rows)), known)
    found = materialize(candidates(index, small(materialize(anchor))))
    texts = base.join(small(found), "key")
    whole = shared(every)

    def per_batch(batch):
        out = {"key": [], "item": [], "run": [], "share": []}
        cols = (batch.column(c).to_pylist() for c in ("key", "text", "item", "diags"))
        last, words = None, []
        for k, t, i, diags in zip(*cols):
            if (k, t) != last:
                words = rejoined(t.split(" "), known.value)
                last = (k, t)
            item = whole.value[i]
            run, share = matched(item, words, diags)
            if run >= RUN or share >= 1 - REPLACED:
                for name, v in zip(out, (k, i, run, share)):
                    out[name].append(v)
        return out

    return arrow_map(texts, schema, per_batch).groupBy("key", "item").agg(F.max("run").alias("run"), F.max("share").alias("share"))
