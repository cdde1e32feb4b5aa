"""What the operators share: words, folded spelling, languages, hashes and Arrow plumbing.

Everything here works on whole texts. A null text has no words; an empty one has none either.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.pieces import words  # noqa: F401
from ..runtime import arrow_map  # noqa: F401

#: Line ends inside a word: marks that printers and transcribers put there.
BREAK_MARKS = "-¬‐=~­"
_BROKEN = re.compile(f"[{BREAK_MARKS}][ \\t]*\\n\\s*")
_DROPPED = re.compile("[\u0300-\u036f\u200b-\u200d\u2060\ufeff†‡’\u00ad]")
_TAGS = re.compile(r"</?(?:i|b|u|em|strong|sup|sub|small|span|div|p|br|hi|lb|pb)\s*/?>", re.I)
#: Bytes to folded bytes: letters to lower case with v as u and j as i, editors' marks dropped, all else blanks.
_FOLDED = bytes(ord({"v": "u", "j": "i"}.get(c, c)) if (c := chr(i).lower()).isalpha() and c.isascii() else 32 for i in range(256))
_EDITORS = b"[](){}<>*'|"

#: Function words of English, French, German and Italian that Latin lacks.
MODERN_WORDS = frozenset(
    """
    the and of that with from this which there would about been was were have has is are by for on it our an
    und der die das nicht eine ein auch aber sich dieser ist sind wird wurde mit von zu den dem des auf aus bei nach
    les une dans pour avec cette nous vous le la du au aux sur pas que ce un sont était par page
    della degli questo essere il di che è con nel del dei una sono gli alla non anche questa più delle nella
    """.split()
) - {"non", "page"}


def plain(text: str) -> str:
    """The text without vowel lengths, accents, ligatures, joiners and daggers; other letters stay as they are."""
    if text.isascii():
        return text
    t = _DROPPED.sub("", unicodedata.normalize("NFKD", text))
    return t.replace("æ", "ae").replace("œ", "oe").replace("Æ", "AE").replace("Œ", "OE")


def fold(text: str) -> str:
    """Lower case without vowel lengths, ligatures and the u/v and i/j distinctions."""
    return plain(text).lower().replace("v", "u").replace("j", "i")


def folded_words(text: str) -> list[str]:
    """Folded words of letters, words divided at line ends put together, editors' marks and tags taken out."""
    if "\n" in text:
        text = _BROKEN.sub("", text)
    if "<" in text:
        text = _TAGS.sub("", text)
    return plain(text).encode("ascii", "replace").translate(_FOLDED, _EDITORS).decode("ascii").split()


def joined(text: str) -> list[str]:
    """Words as printed, those divided at line ends put together and tags taken out; folding them one by one gives folded_words."""
    if "\n" in text:
        text = _BROKEN.sub("", text)
    if "<" in text:
        text = _TAGS.sub("", text)
    return text.split()


def modern_share(ws: list[str]) -> float:
    """Share of modern function words among words (as printed)."""
    if not ws:
        return 0.0
    return sum(map(_MODERN.__getitem__, ws)) / len(ws)


#: From this share of modern function words on, a text is in a modern language: Latin texts have next to
#: none, modern ones of a few words already more than a tenth.
MODERN_FROM = 0.08


def is_latin(ws: list[str]) -> bool:
    return bool(ws) and modern_share(ws) < MODERN_FROM


def hash64(word: str) -> int:
    """A signed 64-bit hash that is the same in every process."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Memo(dict):
    """word -> value, each computed once; emptied when it holds `limit` words, which bounds a worker's memory."""

    def __init__(self, compute: Callable, limit: int = 1_000_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, word):
        value = self.compute(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value


_MODERN = Memo(lambda w: w.strip(".,;:!?").lower() in MODERN_WORDS)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive entries (empty if there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = hashes.view(np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def keyed(df: DataFrame, key: str, text: str, *more: Column | str) -> DataFrame:
    """Only the key, the text and what else is needed, under fixed names: other columns can't clash.

    Rows without key or text are left out.
    """
    return df.select(F.col(key).alias("key"), F.col(text).alias("text"), *more).where("key is not null and text is not null")


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = at.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def flat_hashes(lists: list[list[str]], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words one after another, number of words per text)."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((h for ws in lists for h in map(memo.__getitem__, ws)), np.int64, int(lengths.sum()))
    return flat, lengths


def signatures(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One hash of each text's words in order; 0 for a text without words."""
    out = np.zeros(len(lengths), np.int64)
    has = lengths > 0
    if has.any():
        starts = (np.cumsum(lengths) - lengths)[has]
        place = np.arange(len(flat)) - np.repeat(starts, lengths[has])
        with np.errstate(over="ignore"):
            odd = np.cumprod(np.full(int(lengths.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
            mixed = flat.view(np.uint64) * odd[place]
            mixed ^= mixed >> np.uint64(31)
            out[has] = np.add.reduceat(mixed, starts).view(np.int64)
    return out
