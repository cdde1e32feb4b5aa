"""Problem 3: long exact spans shared between records."""

from __future__ import annotations

from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, salted_join, small
from .texts import Memo, arrow_map, flat_hashes, hash64, keyed, rolling

#: Words of a span that counts; words of an anchor. Any span of SPAN words holds an anchor that is the
#: least of SPAN - ANCHOR + 1 in a row, so equal spans have an anchor in common.
SPAN, ANCHOR = 30, 8
#: Words of passages that one automaton holds, about, and occurrences from which an anchor is split up.
SHARD_WORDS, HOT = 50_000, 2_000


class SuffixAutomaton:
    """Suffix automaton of several sequences of words, with the passages in which each state's strings end.

    Transitions are in one dict keyed by state and word number. Between sequences the automaton
    starts again at its root, so no string crosses two of them.
    """

    def __init__(self):
        self.next: dict[int, int] = {}
        self.edges: list[list[int]] = [[]]
        self.length, self.link = [0], [-1]
        self.numbers: dict[str, int] = {}

    def _key(self, state: int, c: int) -> int:
        return state << 32 | c

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.edges.append([])
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q])
        self.edges[clone] = list(self.edges[q])
        for x in self.edges[q]:
            self.next[clone << 32 | x] = self.next[q << 32 | x]
        self.link[q] = clone
        while p >= 0 and self.next.get(p << 32 | c) == q:
            self.next[p << 32 | c] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, c: int) -> int:
        to, length, link = self.next, self.length, self.link
        q = to.get(last << 32 | c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._split(last, q, c)
        new, p = self._state(length[last] + 1, 0), last
        while p >= 0 and (p << 32 | c) not in to:
            to[p << 32 | c] = new
            self.edges[p].append(c)
            p = link[p]
        if p >= 0:
            q = to[p << 32 | c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return new

    def add(self, words: list[str]) -> None:
        state = 0
        for w in words:
            state = self.extend(state, self.numbers.setdefault(w, len(self.numbers)))

    def statistics(self, words: list[str]):
        """Of each position the state of the longest string that ends there and is in the automaton, and its length."""
        state, n, to, link, length = 0, 0, self.next, self.link, self.length
        for w in words:
            c = self.numbers.get(w)
            if c is None:
                state = n = 0
            else:
                while state and (state << 32 | c) not in to:
                    state = link[state]
                    n = length[state]
                found = to.get(state << 32 | c)
                if found is None:
                    state = n = 0
                else:
                    state, n = found, n + 1
            yield state, n

    def owners(self, sequences: list[list[str]], least: int) -> list[set[int] | None]:
        """Of each state whose strings have `least` words or more, the numbers of the sequences that hold them."""
        out: list[set[int] | None] = [None] * len(self.length)
        for i, words in enumerate(sequences):
            for state, n in self.statistics(words):
                if n >= least:
                    if out[state] is None:
                        out[state] = set()
                    out[state].add(i)
        for state in sorted(range(len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            if out[state] and up > 0 and self.length[up] >= least:
                out[up] = (out[up] or set()) | out[state]
        return out


def shared_spans(sequences: list[list[str]], least: int = SPAN, several: frozenset[int] = frozenset()) -> list[tuple[int, int, int, int]]:
    """(i, j, start, length): for every two sequences the longest string of `least` words or more in common, at its place in i.

    Those in `several` stand in several records, and share themselves with themselves.
    """
    automaton = SuffixAutomaton()
    for s in sequences:
        automaton.add(s)
    owners = automaton.owners(sequences, least)
    longest: dict[tuple[int, int], tuple[int, int]] = {}
    for i, words in enumerate(sequences):
        for at, (state, n) in enumerate(automaton.statistics(words)):
            if n < least:
                continue
            seen: set[int] = set()
            length = n
            while state > 0 and length >= least:
                new = owners[state] - seen
                if i not in several:
                    new = new - {i}
                for j in new:
                    if length > longest.get((i, j), (0, 0))[1]:
                        longest[i, j] = (at - length + 1, length)
                seen |= new
                state = automaton.link[state]
                length = min(length, automaton.length[state])
    return [(i, j, *v) for (i, j), v in longest.items()]


def shared_places(sequences: list[list[str]], least: int = SPAN) -> list[tuple[int, int, int]]:
    """(i, start, length): maximal places of each sequence that another one holds too, `least` words or more each."""
    automaton = SuffixAutomaton()
    for s in sequences:
        automaton.add(s)
    owners = automaton.owners(sequences, least)
    out = []
    for i, words in enumerate(sequences):
        begin = end = -1
        for at, (state, n) in enumerate(automaton.statistics(words)):
            while state > 0 and n >= least and not owners[state] - {i}:
                state = automaton.link[state]
                n = min(n, automaton.length[state])
            if state > 0 and n >= least:
                if at - n + 1 > end:
                    if end >= 0:
                        out.append((i, begin, end - begin + 1))
                    begin = at - n + 1
                end = at
        if end >= 0:
            out.append((i, begin, end - begin + 1))
    return out


def anchors_of(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the anchors: the least ANCHOR-word hash, the last of equals, of every window."""
    window = SPAN - ANCHOR + 1
    grams = rolling(flat, ANCHOR)
    if len(grams) < window:
        return (np.empty(0, np.int64),) * 3
    ends = np.cumsum(lengths)
    of = np.repeat(np.arange(len(lengths)), lengths)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    at = np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1)
    whole = of[: len(views)] == of[SPAN - 1 : SPAN - 1 + len(views)]
    at = np.unique(at[whole])
    return of[at], at - (ends - lengths)[of[at]], grams[at]


def _anchor_rows(docs: DataFrame) -> DataFrame:
    memo = Memo(hash64)

    def per_batch(batch):
        flat, lengths = flat_hashes([t.split() for t in batch.column("text").to_pylist()], memo)
        of, pos, h = anchors_of(flat, lengths)
        return {"key": batch.column("key").take(pa_array(of)), "pos": pos, "anchor": h} if len(of) else None

    kind = dict(docs.dtypes)["key"]
    return arrow_map(docs, f"key {kind}, pos int, anchor bigint", per_batch)


def pa_array(x):
    import pyarrow as pa

    return pa.array(x)


def routed_passages(docs: DataFrame) -> DataFrame:
    """(route, key, begin, passage): what may be part of a shared span, at every place where it may be.

    A route is an anchor that several records hold; the passage is all that a span of SPAN words
    around it can cover. An anchor with more than HOT occurrences is split into the SPAN-word
    windows around it, so that only records that do share a span are together.
    """
    rows = materialize(_anchor_rows(docs))
    several = (
        rows.groupBy("anchor").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("n")).where("a < b").select("anchor", (F.col("n") > HOT).alias("hot"))
    )
    hits = materialize(rows.join(several, "anchor"))
    places = hits.groupBy("key").agg(F.collect_set(F.struct("anchor", "pos", "hot")).alias("places"))
    kind = dict(docs.dtypes)["key"]
    memo = Memo(hash64)

    def per_batch(batch):
        out = {"route": [], "key": [], "begin": [], "passage": []}
        for k, t, ps in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "places"))):
            ws, windows = t.split(), None
            for p in ps:
                begin, end = max(0, p["pos"] + ANCHOR - SPAN), min(len(ws), p["pos"] + SPAN)
                if p["hot"]:
                    if windows is None:
                        windows = rolling(flat_hashes([ws], memo)[0], SPAN)
                    cut = [(int(windows[b]), b, b + SPAN) for b in range(begin, max(begin, end - SPAN + 1))]
                else:
                    cut = [(p["anchor"], begin, end)]
                for route, b, e in cut:
                    for c, v in zip(out, (route, k, b, " ".join(ws[b:e]))):
                        out[c].append(v)
        return out if out["key"] else None

    places = materialize(places)
    found = arrow_map(docs.join(small(places), "key").dropDuplicates(["key"]).select("key", "text", "places"), f"route bigint, key {kind}, begin int, passage string", per_batch)
    return found


def span_pairs(docs: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key_a, key_b, begin_a, begin_b, words), key_a < key_b: records with SPAN words or more in common, compared exactly.

    Kind of white space makes no difference, case and punctuation do. Equal passages of a route are one class: the
    suffix automaton of a shard holds each once, and its passages are streamed through it for
    matching statistics, which say which classes share a span with others and, of several members, among themselves. Members of
    classes pair afterwards; a class of very many is joined in parts. A span longer than a passage is reported
    from it; `words` is then at least that much. Null and shorter texts share nothing; a record
    stored twice is one record.
    """
    passages, classes, shards = _shards(keyed(docs, key, text))

    def per_shard(f: pd.DataFrame) -> pd.DataFrame:
        texts = f["passage"].str.split().tolist()
        route, cls, out = f["route"].tolist(), f["class"].tolist(), []
        for i, j, start, length in shared_spans(texts, several=frozenset(np.flatnonzero(f["n"].to_numpy() > 1).tolist())):
            if route[i] == route[j] and cls[i] <= cls[j]:
                out.append((cls[i], cls[j], start, length))
        return pd.DataFrame(out, columns=["class_a", "class_b", "start_a", "words"])

    linked = materialize(
        classes.select("route", "passage", "class", "n")
        .withColumn("shard", F.pmod("route", F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(per_shard, "class_a bigint, class_b bigint, start_a int, words int")
        .select("class_a", "class_b", "words")
    )
    members = passages.select(F.xxhash64("route", "passage").alias("class"), "key")
    # only members of classes that share a span
    some = linked.select(F.col("class_a").alias("class")).union(linked.select("class_b")).distinct()
    members = materialize(members.join(some, "class", "left_semi").distinct())
    a = members.select(F.col("class").alias("class_a"), F.col("key").alias("key_1"))
    b = members.select(F.col("class").alias("class_b"), F.col("key").alias("key_2"))
    both = salted_join(salted_join(linked, a, "class_a"), b, "class_b").where("key_1 != key_2")
    return both.groupBy(F.least("key_1", "key_2").alias("key_a"), F.greatest("key_1", "key_2").alias("key_b")).agg(F.max("words").alias("words"))


def shared_words(docs: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, words, shared, share): how many words of each record stand in spans that other records hold too.

    Of records that share something; copies are not paired for it, so a text that very many records
    hold costs no more than its rows. Same rules as span_pairs.
    """
    base = keyed(docs, key, text)
    passages, classes, shards = _shards(base)

    def per_shard(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in f.groupby("route", sort=False):
            out += [(part["class"].iloc[i], start, length) for i, start, length in shared_places(part["passage"].str.split().tolist())]
        return pd.DataFrame(out, columns=["class", "start", "n"])

    places = classes.where("passages > 1").withColumn("shard", F.pmod("route", F.lit(shards))).groupBy("shard").applyInPandas(per_shard, "class bigint, start int, n int")
    copies = passages.withColumn("class", F.xxhash64("route", "passage")).select("class", "key").distinct().groupBy("class").count().where("count > 1")
    whole = classes.join(copies, "class").select("class", F.lit(0).alias("start"), F.size(F.split("passage", " ")).alias("n")).where(f"n >= {SPAN}")
    members = passages.withColumn("class", F.xxhash64("route", "passage")).select("class", "key", "begin")
    at = places.union(whole).join(members, "class").select("key", (F.col("begin") + F.col("start")).alias("b"), (F.col("begin") + F.col("start") + F.col("n")).alias("e")).distinct()
    w = Window.partitionBy("key").orderBy("b", "e").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("e") - F.greatest("b", F.coalesce(F.max("e").over(w), F.lit(0))))
    sums = at.withColumn("new", new).groupBy("key").agg(F.sum("new").alias("shared"))
    lengths = base.groupBy("key").agg(F.max(F.size(F.split(F.trim(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", " ")), " "))).alias("words"))
    return sums.join(lengths, "key").select("key", "words", F.col("shared").cast("int").alias("shared"), (F.col("shared") / F.col("words")).alias("share"))


def _shards(base: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(passages, their classes on routes of several records, number of shards)."""
    passages = materialize(routed_passages(base))
    classes = passages.groupBy("route", "passage").agg(F.count("*").alias("n")).withColumn("class", F.xxhash64("route", "passage"))
    several = classes.groupBy("route").agg(F.count("*").alias("passages"), F.sum("n").alias("n")).where("n > 1")
    classes = materialize(classes.select("route", "passage", "class", "n").join(several.select("route", "passages"), "route"))
    return passages, classes, max(1, classes.count() * (2 * SPAN - ANCHOR) // SHARD_WORDS)


def sample_statistics(docs: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "_text", sample_key: str = "sample_id", sample_text: str = "text", block_words: int = 500_000) -> DataFrame:
    """(sample, longest, doc): for each sample the longest run of words that a record holds too, and the least record that holds it.

    The samples' suffix automata are broadcast, one for about block_words words of them; records are streamed
    through each for matching statistics, whole.
    Samples without words have none; a sample of which no word is found has longest 0 and no record.
    """
    rows = [(r.key, r.text.split()) for r in keyed(samples, sample_key, sample_text).distinct().orderBy("key").toLocalIterator()]
    blocks: list[list] = [[]]
    for k, w in rows:
        if w:
            if sum(len(x) for _, x in blocks[-1]) >= block_words:
                blocks.append([])
            blocks[-1].append((k, w))
    base = keyed(docs, key, text)
    kinds = dict(samples.dtypes)[sample_key], dict(docs.dtypes)[key]
    found = reduce(DataFrame.union, [_block_statistics(base, b, kinds) for b in blocks])
    top = found.groupBy("sample").agg(F.max(F.struct("longest", (-F.col("doc")).alias("minus"))).alias("m"))
    return top.select("sample", F.col("m.longest").alias("longest"), (-F.col("m.minus")).alias("doc"))


def _block_statistics(docs: DataFrame, rows: list, kinds: tuple[str, str]) -> DataFrame:
    """(sample, longest, doc) of each batch of documents, for samples whose automaton every worker holds."""
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    state: dict = {}

    def per_batch(batch):
        if "at" not in state:
            automaton = SuffixAutomaton()
            for _, w in shared.value:
                automaton.add(w)
            state["at"] = automaton, automaton.owners([w for _, w in shared.value], 1)
        automaton, owners = state["at"]
        reach: dict[int, tuple[int, int]] = {}
        least: dict[int, int] = {}
        for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            top: dict[int, int] = {}
            for s, n in automaton.statistics(t.split()):
                if n > top.get(s, 0):
                    top[s] = n
            for s, n in top.items():
                if s not in reach or (n, -k) > reach[s]:
                    reach[s] = n, -k
                if s not in least or -k > least[s]:
                    least[s] = -k
        # a match holds its suffixes too, whose owners may be other samples: states pass on to their links, longest first
        queue = [(-automaton.length[s], s) for s in reach]
        heapify(queue)
        best: dict[int, tuple[int, int]] = {}
        while queue:
            _, s = heappop(queue)
            for i in owners[s]:
                if reach[s] > best.get(i, (0, 0)):
                    best[i] = reach[s]
            up = automaton.link[s]
            if up > 0:
                if up not in reach:
                    reach[up], least[up] = (0, 0), least[s]
                    heappush(queue, (-automaton.length[up], up))
                least[up] = max(least[up], least[s])
                reach[up] = max(reach[up], (automaton.length[up], least[s]))
        return {"sample": [shared.value[i][0] for i in best], "longest": [n for n, _ in best.values()], "doc": [-k for _, k in best.values()]} if best else None

    return arrow_map(docs, f"sample {kinds[0]}, longest int, doc {kinds[1]}", per_batch)
