"""Problem 4: noise in text from scanned pages."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.corpus import running_sum
from ..runtime import materialize, ship
from .texts import Memo, arrow_map, fold, hash64, plain

#: What a glyph was read as, and what was printed: pairs that count as if seen PRIOR times before any text is read. All else is learned.
KNOWN = (
    ("c", "e"), ("e", "c"), ("n", "u"), ("u", "n"), ("l", "t"), ("f", "s"), ("rn", "m"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("in", "m"), ("i", "l"), ("l", "i"),
    ("€", "e"), ("0", "o"), ("5", "s"), ("6", "b"), ("8", "b"), ("1", "i"), ("1", "l"), ("|", "l"), ("|)", "p"), ("'", ""),
)
#: A pair is learned from at least so many doubtful words, and LEAST_PAIR of them, if these align with common words by it so many times as often as
#: known words do by chance, before their endings. All words of either kind are aligned.
PRIOR, LEAST_WORDS, LEAST_PAIR, LIFT = 2.0, 4, 3e-4, 5.0
_SIGN = re.compile(r"\|\)|[€015689|']")
_ODD = re.compile(r"[€015689|]")
#: A lexicon of up to so many words goes to every worker as it is; of a larger one each block of pages, of so many bytes, gets
#: the words that can matter in it, found by joins; so many bits tell most of the words that aren't in it before. Results are equal.
LEXICON, BLOCK, BITS = 1_000_000, 8 << 20, 1 << 27
#: Skip-gram counts: hashed words x hashed neighbours within so many words. One size for every corpus.
ROWS, CONTEXTS, REACH, WEIGHT = 1 << 15, 64, 2, 64
#: A doubtful word is misread for another doubtful one if it is at most this often as common.
RARER = 0.1
#: A word stands for another if the logarithms of how much commoner that is, of how likely its glyphs are misread, and of how much better that
#: fits the neighbours come to more than this together.
EVIDENCE = -9.0

_EDGE = ".,;:!?()[]*†<>’\"—–-¬=~‐ \t"
_ROMAN = re.compile(r"[ivxlcdmu]+").fullmatch
_NUMBER = re.compile(r"^[—–-]?\s*[\[(]?\s*(?:\d+|(?:[IVXLCDM]|G(?=[IVXLC]))[IVXLCDMG1l]*)\s*[\])]?\s*[—–-]?$")
_SECTION = re.compile(r"^(?:L[I1l][B86]\.?\s*[IVXLCG1l]+\.?\s*)?(?:[CG][A4]P\.?\s*[IVXLCG1l]+\.?)?$")
_PAGE = re.compile(r"^[PF]ag\.?\s*[\dIVXLCDM]+\.?$|^[Ff]ol\.?\s*\d+\s*[rv]?\.?$")
_SIGNATURE = re.compile(r"^[A-Z]{1,2}\s+[ivxj]{1,4}\.?\*?$")
_SHELF = re.compile(r"^(?:[CG]od|[EF]x[eac]mpl|Ms|Bibl)\S*\s+\S+\s+(?:n|no|num|nr|sign)\.?\s*\d+\.?$", re.I)
#: A head and a number, apart: of another work, if the page was taken from one.
_HEAD = re.compile(r"^(?:(?:\d+|[IVXLCDMG1]+)\s{2,}[^.,;:!?]{3,60}|[^.,;:!?]{3,60}\s{2,}(?:\d+|[IVXLCDMG1]+))$")
_BREAK = re.compile(r"[^\W\d_]([-¬‐=~­])\s*$")


def bare(word: str) -> str:
    return fold(word.strip(_EDGE))


def replaced(word: str, pairs: dict[str, list[tuple[str, float]]], edits: int) -> dict[str, float]:
    """Words that differ by exactly so many of the pairs, each with the logarithm of its likelihood."""
    sites = [(i, a, b, p) for a, found in pairs.items() for i in _places(word, a) for b, p in found]
    out: dict[str, float] = {}
    for chosen in combinations(sorted(sites), edits):
        if any(x[0] + len(x[1]) > y[0] for x, y in zip(chosen, chosen[1:])):
            continue
        w, at, log = "", 0, 0.0
        for i, a, b, p in chosen:
            w += word[at:i] + b
            at = i + len(a)
            log += p
        w += word[at:]
        if log > out.get(w, -1e9):
            out[w] = log
    return out


def _places(word: str, a: str) -> list[int]:
    return [i for i in range(len(word) - len(a) + 1) if word.startswith(a, i)]


def _holes(df: DataFrame, word: str, widths: tuple[int, ...], cut: str) -> DataFrame:
    """df with (before, behind, `cut`, width, place) for holes of these widths in `word`, of four letters or more: what is before, behind and in it; behind it are two letters at least."""
    w = F.col(word)

    def cuts(n: int) -> Column:
        at = F.sequence(F.lit(0), F.length(w) - n - 2)
        hole = lambda i: F.struct(w.substr(F.lit(1), i).alias("before"), w.substr(i + n + 1, F.length(w)).alias("behind"), w.substr(i + 1, F.lit(n)).alias(cut), F.lit(n).alias("width"), i.alias("place"))
        return F.transform(at, hole)

    return df.withColumn("__hole", F.explode(F.concat(*map(cuts, widths)))).select(*df.columns, "__hole.*")


def learn_pairs(sure: DataFrame, doubtful: DataFrame) -> dict[tuple[str, str], float]:
    """{(read, printed): logarithm of its share among doubtful words}, from all doubtful words aligned with all commoner ones.

    sure: (word, n), doubtful: (word). Two words align if they are equal but for one or two letters in one place before the ending, where forms of one
    word differ. What the rarest quarter of the known words align by is chance. A pair's first part is a letter or two or a sign,
    its second may only be missing for a sign. KNOWN pairs count PRIOR times more. At most 1 / LEAST_PAIR pairs reach the driver, as each word counts once.
    """
    common = sure.where("length(word) >= 4").select("word", F.col("n").cast("bigint").alias("n"))
    words = doubtful.where("length(word) >= 4").where(~F.col("word").rlike(r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+$")).select("word")
    # only words that others come near in length are cut: elsewhere a text without blanks would be cut at each letter
    size = F.length("word")
    asking = {r.at: r["count"] for r in words.groupBy(size.alias("at")).count().collect()}
    having = {r.at: r for r in common.groupBy(size.alias("at")).agg(F.count("*").alias("c"), F.min("n").alias("least"), F.max("n").alias("most")).collect()}
    near = lambda at, others: [to for to in range(at - 2, at + 3) if to in others]
    likely = [(at, to) for at in having for to in near(at, having) if having[to].most * RARER >= having[at].least]
    total, known = sum(asking.values()), sum(r.c for r in having.values())
    rarest = max(1, known // 4)
    rare = running_sum(common.withColumn("one", F.lit(1)), ["n", "word"], "one", "rank").where(F.col("rank") < rarest)
    words, rare = words.where(size.isin([at for at in asking if near(at, having)])), rare.where(size.isin([at for at, _ in likely]))
    asked = words.select("word", F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("rare")).unionByName(rare.select("word", "n", F.lit(True).alias("rare")))
    index = _holes(common.where(size.isin([to for to in having if near(to, asking)] + [to for _, to in likely])).select(F.col("word").alias("other"), F.col("n").alias("others")), "other", (0, 1, 2), "b").drop("width", "place")
    a, b = F.col("a"), F.col("b")
    apart = (F.substring(a, 1, 1) != F.substring(b, 1, 1)) & (F.substring(a, -1, 1) != F.substring(b, -1, 1))
    pairs = _holes(asked, "word", (1, 2), "a").join(index, ["before", "behind"]).where(F.when(b == "", ~a.rlike(r"^\p{L}+$")).otherwise(apart)).where(F.col("others") * RARER >= F.col("n"))
    found = pairs.repartition("rare", "word").groupBy("rare", "word", "other").agg(F.max(F.struct("width", "place", "a", "b")).alias("x"))
    each = found.groupBy("rare", "word").agg(F.collect_list(F.struct("x.a", "x.b")).alias("xs")).select("rare", F.size("xs").alias("of"), F.explode("xs").alias("x"))
    shares = each.groupBy("rare", "x.a", "x.b", "of").agg(F.count("*").alias("c")).groupBy("rare", "a", "b").agg(F.sort_array(F.collect_list(F.struct("of", "c"))).alias("cs"))
    # summed in one order, so that no partitioning changes a sum
    shares = materialize(shares.select("rare", "a", "b", F.aggregate("cs", F.lit(0.0), lambda s, x: s + x["c"] / x["of"]).alias("n")))
    often = shares.where(~F.col("rare") & (F.col("n") >= max(LEAST_WORDS, LEAST_PAIR * total))).select("a", "b", "n")
    rows = often.join(shares.where("rare").select("a", "b", F.col("n").alias("chance")), ["a", "b"], "left").collect()
    learned = {(r.a, r.b): r.n for r in rows if r.n / max(total, 1) >= LIFT * ((r.chance or 0.0) + 0.5) / rarest}
    return {x: float(np.log((learned.get(x, 0.0) + PRIOR * (x in KNOWN)) / (max(total, 1) + PRIOR * len(KNOWN)))) for x in {*learned, *KNOWN}}


class Reader:
    """Says of words whether they are known, and which words they may stand for.

    A noisy channel: how common words are, how likely glyphs are misread for others, and skip-gram vectors of the neighbours decide together.
    """

    def __init__(self, lexicon: dict[str, int], vectors: np.ndarray | None = None, doubtful: frozenset[str] = frozenset(), pairs: dict[tuple[str, str], float] | None = None, given: dict[tuple[str, int], dict[str, float]] | None = None):
        self.lexicon, self.vectors, self.doubtful, self.given = lexicon, vectors, doubtful, given
        given = pairs if pairs is not None else {x: float(np.log(0.01)) for x in KNOWN}
        self.pairs: dict[str, list[tuple[str, float]]] = {}
        self.signs: dict[str, list[tuple[str, float]]] = {}
        for (a, b), log in sorted(given.items()):
            (self.pairs if a.isalpha() else self.signs).setdefault(a, []).append((b, log))
        self.memo = Memo(self._corrections, 500_000)
        self.at = Memo(lambda w: hash64(w), 500_000)

    def readings(self, word: str) -> dict[str, float]:
        """The word with its signs replaced by letters, in every way; a word of more signs than letters has none."""
        out = {word: 0.0}
        if sum(map(str.isalpha, word)) < len(_SIGN.findall(word)):
            return out
        while True:
            after: dict[str, float] = {}
            for w, log in out.items():
                m = _SIGN.search(w)
                for b, p in self.signs.get(m[0], [("", -9.0)]) if m else [(None, 0.0)]:
                    x = w if b is None else w[: m.start()] + b + w[m.end() :]
                    after[x] = max(after.get(x, -1e9), log + p)
            if after.keys() == out.keys():
                return out
            out = after

    def _corrections(self, word: str) -> tuple[tuple[str, float], ...]:
        """(known word, evidence without neighbours) that it may stand for; () if it is known itself or nothing is near.

        A doubtful word may stand for one that is no rarer and attested, or for a doubtful one that is so much more common.
        """
        if not word or self.attested(word) or word.isdigit() or _ROMAN(word):
            return ()
        options, count = self.readings(word), self.lexicon.get(word, 0)
        found: dict[str, float] = {}
        for edits in (0, 1, 2):
            if found or len(word) < 3 + edits and edits:
                break
            near = self.near(word, options, edits) if self.given is None else self.given.get((word, edits), {})
            found = {n: x for n, x in near.items() if self.attested(n) and self.lexicon[n] >= count} or {n: x for n, x in near.items() if n in self.doubtful and count <= RARER * self.lexicon[n]}
        if found:
            return tuple((n, x + float(np.log(self.lexicon[n] / max(count, 1)))) for n, x in sorted(found.items()))
        signs = _ODD.search(word) and sum(c.isalpha() for c in word) >= 2
        return ((max(options, key=lambda w: (len(w), w)), 0.0),) if signs else ()

    def near(self, word: str, options: dict[str, float], edits: int) -> dict[str, float]:
        """Words of the lexicon that the word's readings are by exactly so many misread pairs, each with the logarithm of its likelihood."""
        near: dict[str, float] = {}
        for w, log in options.items():
            for n, more in (replaced(w, self.pairs, edits) if edits else {w: 0.0}).items():
                if n in self.lexicon and n != word:
                    near[n] = max(near.get(n, -1e9), log + more)
        return near

    def attested(self, word: str) -> bool:
        """Whether it is known from texts that aren't scanned pages."""
        return word in self.lexicon and word not in self.doubtful

    def known(self, word: str) -> bool:
        return word in self.lexicon

    def stands(self, word: str) -> bool:
        """Whether it stands for another word, by frequency and glyphs alone."""
        return any(x >= EVIDENCE or v not in self.lexicon for v, x in self.memo[word])

    def fit(self, word: str, near: list[int]) -> float:
        return float(self.vectors[self.at[word] % ROWS][near].sum()) if near and self.vectors is not None else 0.0

    def best(self, word: str, around: list[str]) -> str | None:
        """The known word that it stands for among these neighbours; none if the evidence is for the word itself."""
        options = self.memo[word]
        if not options:
            return None
        near = [self.at[w] % CONTEXTS for w in around if w]
        own = self.fit(word, near) if word in self.lexicon else 0.0
        right, evidence = max(((v, x + self.fit(v, near) - own) for v, x in options), key=lambda o: (o[1], o[0]))
        return right if evidence >= EVIDENCE or not self.known(right) else None


def title_words(name: str) -> list[str]:
    """Words of the title in a page's file name."""
    stem = re.sub(r"\.djvu_\d+(\.txt)?$|\.txt$", "", re.sub(r"^Pagina_", "", name))
    return [w for w in map(bare, re.sub(r"\([^)]*\)", " ", stem).replace("_", " ").split()) if w and not w.isdigit()]


def _like(a: str, b: str) -> bool:
    """Equal but for a misread glyph or two; in capitals E is read as F and C as G and back."""
    a, b = a.replace("f", "e").replace("g", "c"), b.replace("f", "e").replace("g", "c")
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or len(b) < 4:
        return False
    same = sum(x == y for x, y in zip(a, b)) + sum(x == y for x, y in zip(a[::-1], b[::-1]))
    return same >= max(len(a), len(b)) - 1 and max(sum(x == y for x, y in zip(a, b)), sum(x == y for x, y in zip(a[::-1], b[::-1]))) >= 0.6 * len(b)


#: Reads signs in heads by the known pairs alone.
_PRIOR = Reader({})


def is_furniture(line: str, title: list[str]) -> bool:
    """Running heads, page and section numbers, signatures and shelf marks."""
    s = plain(line.strip())
    if not s:
        return False
    if _NUMBER.match(s) or _SECTION.match(s) or _PAGE.match(s) or _SIGNATURE.match(s) or _SHELF.match(s) or _HEAD.match(s):
        return True
    tokens = s.split()
    if not title or len(tokens) > len(title) + 3:
        return False
    number, hits, long_hit = False, 0, False
    for t in tokens:
        b = t.strip(_EDGE)
        if not b or b.isdigit() or re.fullmatch("[IVXLCDMG]+", b):
            number = True
            continue
        options = _PRIOR.readings(fold(b))
        if not any(_like(o, w) for o in options for w in title):
            return False
        hits += 1
        long_hit |= len(b) >= 5
    capitals = s.upper() == s
    return hits > 0 and (number or (capitals and long_hit) or (hits == len(title) > 1 and s[0].isupper()))


def read_page(text: str, name: str, reader: Reader) -> tuple[list[tuple[int, str, str, str]], str]:
    """([(line, kind, as printed, repaired)], the repaired text in paragraphs)."""
    title, lines = title_words(name), text.split("\n")
    places, kept = [], []
    for i, line in enumerate(lines, 1):
        if is_furniture(line, title):
            places.append((i, "furniture", line.strip(), ""))
        else:
            kept.append((i, line.split()))
    # words with the line of each of their parts; a blank line ends a paragraph
    flow: list[tuple[str, list[tuple[int, int]]] | None] = []
    carried: tuple[str, list[tuple[int, int]]] | None = None
    texts = [k for k, (_, ws) in enumerate(kept) if ws]
    following = dict(zip(texts, texts[1:]))
    for k, (i, ws) in enumerate(kept):
        if not ws:
            if carried is None and flow and flow[-1] is not None:
                flow.append(None)
            continue
        if carried is not None:
            head, parts = carried
            ws = ws[:]
            word, joined_parts = head + ws[0], parts + [(i, len(ws[0]))]
            rest = ws[1:]
        else:
            word, joined_parts, rest = ws[0], [(i, len(ws[0]))], ws[1:]
        entries = [(word, joined_parts)] + [(w, [(i, len(w))]) for w in rest]
        carried = None
        after = kept[following[k]][1] if k in following else None
        if after:
            last, last_parts = entries[-1]
            m = _BREAK.search(last)
            if m:
                places.append((i, "broken_word", last, last[: m.start(1)] + after[0]))
                carried = (last[: m.start(1)], last_parts[:-1] + [(i, last_parts[-1][1] - (len(last) - m.start(1)))])
            elif last[-1].isalpha() or _SIGN.match(last[-1]):
                a, b = bare(last), bare(after[0])
                if a and b and after[0][0].isalpha() and (after[0][0].islower() or last.isupper()) and _one_word(a, b, reader):
                    places.append((i, "broken_word", last, last + after[0]))
                    carried = (last, last_parts)
            if carried:
                entries.pop()
        flow += entries
    if carried:
        flow.append(carried)
    out, bares = [], [bare(x[0]) if x else "" for x in flow]
    for n, entry in enumerate(flow):
        if entry is None:
            out.append("\n\n")
            continue
        word, parts = entry
        right = reader.best(bares[n], bares[max(0, n - REACH) : n] + bares[n + 1 : n + 1 + REACH])
        if right is not None:
            for line in _lines_of_edit(word, parts, right):
                places.append((line, "misread", word, right))
            word = _put(word, right)
        out.append(word)
    repaired = re.sub(r" ?\n\n ?", "\n\n", " ".join(out)).strip()
    return sorted(set(places)), repaired


def asked_words(text: str, name: str, longest: int) -> tuple[set[str], set[tuple[str, str]]]:
    """(words, pairs of parts) about which read_page may ask a reader whose lexicon has no word of over `longest` letters.

    Whether parts are joined over the ends of lines depends on the lexicon, so both ways are followed. Two misread pairs
    take away four letters at most: what has more than that over `longest` is joined only for signs that are no letters.
    """
    title = title_words(name)
    lines = [ws for line in text.split("\n") if not is_furniture(line, title) and (ws := line.split())]
    out, joins, heads = set(), set(), {("", None)}
    for ws, after in zip(lines, [*lines[1:], None]):
        out.update(map(bare, ws[1:]))
        out.update(w for head, a in heads if (w := bare(head + ws[0])) != (a and a + bare(ws[0])))
        lasts = {head + ws[0] for head, _ in heads} if len(ws) == 1 else {ws[-1]}
        heads = set()
        for last in lasts:
            m = _BREAK.search(last)
            if m and after:
                heads.add((last[: m.start(1)], None))
                continue
            heads.add(("", None))
            if not after or not (last[-1].isalpha() or _SIGN.match(last[-1])):
                continue
            a, b = bare(last), bare(after[0])
            if a and b and after[0][0].isalpha() and (after[0][0].islower() or last.isupper()):
                joins.add((a, b))
                if sum(map(str.isalpha, a if _ODD.search(a + b) else a + b)) <= longest + 4 or (_ODD.search(b) and not _ODD.search(a)):
                    heads.add((last, a))
    return out, joins


def _one_word(a: str, b: str, reader: Reader) -> bool:
    """Whether the end of a line and the beginning of the next are one word, though nothing marks it."""
    for known in (reader.attested, reader.known):
        if known(a) and known(b):
            return False
        if known(a + b):
            return True
    return not reader.known(a) and not reader.known(b) and reader.stands(a + b) and not reader.stands(a) and not reader.stands(b)


def _lines_of_edit(word: str, parts: list[tuple[int, int]], right: str) -> list[int]:
    """The lines of a word's parts in which it was misread."""
    if len(parts) == 1:
        return [parts[0][0]]
    printed = fold(word.strip(_EDGE))
    lead = len(word) - len(word.lstrip(_EDGE))
    first = next((i for i, (x, y) in enumerate(zip(printed, right)) if x != y), min(len(printed), len(right)) - 1)
    last = len(printed) - 1 - next((i for i, (x, y) in enumerate(zip(printed[::-1], right[::-1])) if x != y), 0)
    out, at = [], 0
    for line, n in parts:
        if lead + min(first, last) < at + n and lead + max(first, last) >= at:
            out.append(line)
        at += n
    return out or [parts[0][0]]


def _put(word: str, right: str) -> str:
    """The corrected word with the case and the punctuation of the printed one."""
    core = word.strip(_EDGE)
    at = word.find(core)
    if core.isupper() and len(core) > 1:
        right = right.upper()
    elif core[:1].isupper():
        right = right.capitalize()
    return word[:at] + right + word[at + len(core) :]


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def corpus_counts(df: DataFrame) -> tuple[DataFrame, np.ndarray, dict[tuple[str, str], float]]:
    """(lexicon, skip-gram vectors, misread glyphs), from all words of all texts in one pass.

    df: (text, page). The lexicon (word, n, doubtful) has all words that stand at least twice in texts that aren't scanned pages, or in pages; the
    latter only are doubtful. Vectors are pointwise mutual information of hashed words and hashed neighbours.
    """
    memo = Memo(lambda w: (lambda b: (b, hash64(b)))(bare(w)))
    cells, block = ROWS * CONTEXTS, 1 << 14

    def run(frames):
        clean, pages, grid = Counter(), Counter(), np.zeros(cells, np.int64)
        for f in frames:
            hashes = []
            for t, page in zip(f["text"], f["page"]):
                found = [memo[w] for w in t.split()]
                (pages if page else clean).update([b for b, _ in found])
                hashes += [h for _, h in found] + [0] * REACH
            h = np.array(hashes, np.int64)
            row, col = (h % ROWS) * CONTEXTS, h % CONTEXTS
            for d in range(1, REACH + 1):
                both = (h[d:] != 0) & (h[:-d] != 0)
                for a, b in ((row[:-d], col[d:]), (row[d:], col[:-d])):
                    grid += np.bincount((a + b)[both], minlength=cells)
            if len(clean) + len(pages) > 400_000:
                yield _rows(clean, pages)
                clean.clear(), pages.clear()
        if clean or pages:
            yield _rows(clean, pages)
        for b in range(0, cells, block):
            if grid[b : b + block].any():
                yield pd.DataFrame({"word": [None], "clean": [0], "pages": [0], "block": [b], "cells": [grid[b : b + block].astype(np.int32).tobytes()]})

    def _rows(clean, pages):
        ws = list(clean.keys() | pages.keys())
        return pd.DataFrame({"word": ws, "clean": [clean[w] for w in ws], "pages": [pages[w] for w in ws], "block": [None] * len(ws), "cells": [None] * len(ws)})

    def added(f):
        return pd.DataFrame({"block": f["block"][:1], "cells": [sum(np.frombuffer(x, np.int32).astype(np.int64) for x in f["cells"]).tobytes()]})

    rows = materialize(df.mapInPandas(run, "word string, clean bigint, pages bigint, block int, cells binary"))
    words = materialize(rows.where("word is not null and word != ''").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("pages").alias("pages")))
    both = F.col("clean") + F.col("pages")
    listed = words.where(both >= 2).where(~F.col("word").rlike(r"[0-9€|]")).select("word", both.alias("n"), (F.col("clean") < 2).alias("doubtful"))
    grid = np.zeros(cells)
    for r in rows.where("block is not null").groupBy("block").applyInPandas(added, "block int, cells binary").collect():
        grid[r.block : r.block + block] = np.frombuffer(r.cells, np.int64)
    # neighbours as many as WEIGHT of the common kind are added to each word, so that the vectors of rare words say little
    grid = grid.reshape(ROWS, CONTEXTS)
    common = (grid.sum(0) + 1) / (grid.sum() + CONTEXTS)
    vectors = np.log((grid + WEIGHT * common) / ((grid.sum(1, keepdims=True) + WEIGHT) * common)).astype(np.float32)
    return listed, vectors, learn_pairs(listed.where("not doubtful"), words.where("clean = 0"))


def _lexicon(rows: pa.Table) -> tuple[dict[str, int], frozenset[str]]:
    """The lexicon and its doubtful words."""
    words = rows.column("word").to_pylist()
    return dict(zip(words, rows.column("n").to_pylist())), frozenset(w for w, d in zip(words, rows.column("doubtful").to_pylist()) if d)


class Bits:
    """Holds every word of a lexicon, and a few others."""

    def __init__(self, bits: bytes):
        self.bits = bits

    def __contains__(self, word: str) -> bool:
        at = zlib.crc32(word.encode("utf-8", "surrogatepass")) % (len(self.bits) * 8)
        return self.bits[at >> 3] >> (at & 7) & 1 == 1

    @classmethod
    def of(cls, lexicon: DataFrame) -> Bits:
        part = BITS >> 8

        def put(f):
            bits = np.zeros(part, np.uint8)
            bits[f["at"].to_numpy() % part] = 1
            return pd.DataFrame({"part": f["part"][:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

        at = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(BITS))
        found = lexicon.select(at.alias("at")).distinct().withColumn("part", F.floor(F.col("at") / part)).groupBy("part").applyInPandas(put, "part bigint, bits binary").collect()
        parts = {r.part: bytes(r.bits) for r in found}
        return cls(b"".join(parts.get(i, bytes(part // 8)) for i in range(256)))


def block_lexicons(pages: DataFrame, lexicon: DataFrame, pairs: dict[tuple[str, str], float]) -> DataFrame:
    """(block, asked, edits, log, word, n, doubtful): what reading the pages (block, text, name) of a block can look up, so that no worker holds all of the lexicon.

    Its words that may be asked for have null in `asked`; other rows have those that a word asked for is by so many misread pairs.
    """
    longest = lexicon.agg(F.coalesce(F.max(F.length("word")), F.lit(0))).first()[0]
    shared = pages.sparkSession.sparkContext.broadcast(Bits.of(lexicon))

    def ask(rows: pa.Table) -> pa.Table:
        found = [asked_words(t, n, longest) for t, n in zip(rows.column("text").to_pylist(), rows.column("name").to_pylist())]
        words = [(w, None, None) for w in sorted(set().union(*(ws for ws, _ in found)))] + [(a + b, a, b) for a, b in sorted(set().union(*(joins for _, joins in found)))]
        block = pa.array([rows.column("block")[0].as_py()] * len(words), pa.int64())
        return pa.table({"block": block, **{c: pa.array([w[i] for w in words], pa.string()) for i, c in enumerate(("word", "head", "tail"))}})

    def per_batch(batch):
        reader, rows = Reader(shared.value, pairs=pairs), []
        for w in batch.column("word").to_pylist():
            if w and not w.isdigit() and not _ROMAN(w):
                options = reader.readings(w)
                rows += [(w, edits, n, x) for edits in (0, 1, 2) if not edits or len(w) >= 3 + edits for n, x in reader.near(w, options, edits).items()]
        return {c: [r[i] for r in rows] for i, c in enumerate(("asked", "edits", "word", "log"))}

    asked = materialize(pages.groupBy("block").applyInArrow(ask, "block bigint, word string, head string, tail string"))
    # parts are joined if the whole is known, or if neither part is and the whole stands for another word
    joins = asked.where("head is not null").select("word", "head", "tail").distinct()
    known = lexicon.select(F.col("word").alias("known"))
    unknown = joins.join(known, F.col("head") == F.col("known"), "left_anti").join(known, F.col("tail") == F.col("known"), "left_anti")
    uncertain = asked.where("head is null").select("word").unionByName(unknown.select("word")).unionByName(joins.join(lexicon.where("doubtful"), "word", "left_semi").select("word"))
    uncertain = uncertain.distinct().join(lexicon.where("not doubtful"), "word", "left_anti")
    near = materialize(arrow_map(uncertain, "asked string, edits int, word string, log double", per_batch).join(lexicon, "word"))
    asked = asked.select("block", "word").distinct()
    own = asked.join(lexicon, "word").select("block", F.lit(None).cast("string").alias("asked"), F.lit(None).cast("int").alias("edits"), F.lit(None).cast("double").alias("log"), "word", "n", "doubtful")
    return own.unionByName(asked.withColumnRenamed("word", "asked").join(near, "asked").select(*own.columns))


def scan_noise(df: DataFrame, key: str = "doc_id", path: str = "path", text: str = "_text", repaired: bool = False) -> DataFrame:
    """(key, line, kind, printed, repaired) of every place in the pages; with repaired, (key, text) of every page.

    Pages are rows whose file name starts with Pagina_. Kinds: furniture, broken_word, misread; a line
    is given once for each place. Words are known from the lexicon of all texts; one that is not, but
    is a few confused glyphs away from such words, is misread for the one for which frequency, glyphs and neighbours speak most.
    Rows without key or text are left out, rows without path are no pages, an empty text has no places.
    A page stored twice gives its rows twice.
    """
    base = df.select(F.col(key).alias("key"), F.col(text).alias("text"), file_name(F.coalesce(F.col(path), F.lit(""))).alias("name"))
    base = base.where("key is not null and text is not null")
    page = F.col("name").startswith("Pagina_")
    spark = df.sparkSession
    lexicon, vectors, pairs = corpus_counts(base.select("text", page.alias("page")))
    pages, kind = base.where(page), dict(df.dtypes)[key]
    schema = f"key {kind}, text string" if repaired else f"key {kind}, line int, kind string, printed string, repaired string"

    def read(reader: Reader, batch) -> dict | None:
        keys, rows = batch.column("key"), []
        for n, (t, name) in enumerate(zip(batch.column("text").to_pylist(), batch.column("name").to_pylist())):
            places, whole = read_page(t, name, reader)
            rows += [(n, whole)] if repaired else [(n, *p) for p in places]
        if not rows:
            return None
        cols = list(zip(*rows))
        names = ("text",) if repaired else ("line", "kind", "printed", "repaired")
        return {"key": keys.take(pa.array(cols[0])), **dict(zip(names, map(list, cols[1:])))}

    if lexicon.count() <= LEXICON:
        shared = spark.sparkContext.broadcast((*_lexicon(lexicon.toArrow()), vectors, pairs))
        state: dict = {}

        def per_batch(batch):
            if "reader" not in state:
                known, doubtful, vectors, pairs = shared.value
                state["reader"] = Reader(known, vectors, doubtful, pairs)
            return read(state["reader"], batch)

        return arrow_map(pages, schema, per_batch)

    ship(spark)
    spread = spark.sparkContext.broadcast((vectors, pairs))
    wanted = to_arrow_schema(spark.createDataFrame([], schema).schema)
    blocks = pages.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // BLOCK + 1
    pages = materialize(pages.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))))

    def per_block(rows: pa.Table, words: pa.Table) -> pa.Table:
        vectors, pairs = spread.value
        given: dict[tuple[str, int], dict[str, float]] = {}
        for asked, edits, word, log in zip(*(words.column(c).to_pylist() for c in ("asked", "edits", "word", "log"))):
            if asked is not None:
                given.setdefault((asked, edits), {})[word] = log
        known, doubtful = _lexicon(words)
        out = read(Reader(known, vectors, doubtful, pairs, given), rows.combine_chunks())
        return pa.table({f.name: out[f.name] if f.name == "key" else pa.array(out[f.name], f.type) for f in wanted}, schema=wanted) if out else wanted.empty_table()

    return pages.groupBy("block").cogroup(block_lexicons(pages.drop("key"), lexicon, pairs).groupBy("block")).applyInArrow(per_block, schema)
