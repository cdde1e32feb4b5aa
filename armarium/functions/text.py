"""Column functions: cleaning, identity, classification and orthography of texts. Null in, null out unless said."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed

ZERO_WIDTH = "​‌‍⁠﻿"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _unmarked(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))), na_action="ignore")


def nfc(text: Column) -> Column:
    """Unicode NFC. Python sees only texts that aren't ASCII."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def decode(content: Column) -> Column:
    """Bytes as text: invalid UTF-8 replaced, line ends made line feeds."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\r\n?", "\n")


def clean_flags(text: Column) -> dict[str, Column]:
    return {
        "had_replacement_char": text.contains("�"),
        "had_zero_width": text.rlike(f"[{ZERO_WIDTH}]"),
        "had_editorial_codes": text.rlike(r"(?U)(?<=\s)\.[a-z]\.?(?=\s|$)"),
    }


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def _runs(text: Column) -> Column:
    for pattern, to in ((r"_{3,}", ""), (r"-{5,}", ""), (r"[{}\[\]]{2,}", ""), (" _ ", " ")):
        text = F.regexp_replace(text, pattern, to)
    return text


def _noise_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"(?mdU)^[\s.\-_*=]+$", "")


def clean_text(text: Column) -> Column:
    """NFC, signs that don't print, editors' single letters, then runs of rules, brackets, blanks and empty lines; stripped."""
    t = F.regexp_replace(nfc(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    t = F.translate(t, ZERO_WIDTH + "�", "")
    t = F.regexp_replace(t, r"(?U)(?<=\s)\.[a-z]\.?(?=\s|\z)", "")
    t = _noise_lines(_runs(t))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]{3,}", " "), r"\n{4,}", "\n\n\n")
    return strip(t)


def clean_legacy(text: Column) -> Column:
    """The older cleaner: stripped first, empty lines before noise lines, no sign or letter rules."""
    return _noise_lines(F.regexp_replace(_runs(strip(text)), r"\n{4,}", "\n\n\n"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def is_copy(name: Column) -> Column:
    return name.rlike(r"\.__dup\d+__\.txt$")


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.txt$", "")


def work_id(name: Column) -> Column:
    """The title without author; pages and parts of a work share it, and the volumes of known series."""
    stem = _stem(name)
    page = F.regexp_extract(stem, r"^Pagina_(.+?)\.djvu_\d+$", 1)
    work = F.when(page != "", page).otherwise(F.substring_index(stem, "_", 1))
    work = F.lower(F.trim(F.regexp_replace(work, r"\s*\([^)]*\)\s*$", "")))
    series = F.trim(F.regexp_extract(work, r"(?i)^(.+?)[ ,]+(?:t\.?|tomus|vol\.?|band)?\s*\d+$", 1))
    known = F.lit(False)
    for s in fixed.SERIES:
        known |= series.startswith(s)
    work = F.when(known, series).otherwise(work)
    return F.when(work != "", work).otherwise(F.lower(stem))


def author_hint(name: Column) -> Column:
    """What the title has in brackets at its end, an editor or not."""
    hint = F.lower(F.trim(F.regexp_extract(F.substring_index(_stem(name), "_", 1), r"\s*\(([^)]*)\)\s*$", 1)))
    return F.when(hint != "", hint)


def author_from_title(title: Column) -> Column:
    """The first words in brackets that name no editor, series, volume or year."""
    found = F.transform(F.regexp_extract_all(title, F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda x: F.lower(F.trim(x)))
    return F.get(F.filter(found, lambda x: (x != "") & ~x.rlike("(?i)" + fixed.NO_AUTHOR)), F.lit(0))


def era_from_volume(title: Column) -> Column:
    """The era of a volume of the one series that is ordered by time."""
    t = F.lower(title)
    pattern = r"patrologia latina[ ,]*(\d{1,3})|(?:^|\W)pl[ _]*(\d{1,3})\b"
    a, b = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
    n = F.when(a != "", a).when(b != "", b).try_cast("int")
    return F.when(n.between(1, 79), "late_antique").when(n.between(80, 190), "early_medieval").when(n.between(191, 217), "high_medieval")


def _first(title: Column, pairs: list[tuple[str, str]]) -> Column:
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(e).alias("e")) for n, e in pairs])
    return F.get(F.filter(table, lambda x: F.contains(title, x["n"])), F.lit(0))["e"]


def era(author: Column, title: Column) -> Column:
    """By author, else by an author's name in the title, else by a known title (the longest), else by volume."""
    authors = fixed.author_era()
    exact = F.create_map(*[F.lit(x) for pair in authors for x in pair])
    t = F.lower(title)
    return F.coalesce(
        F.try_element_at(exact, author), _first(t, [x for x in authors if len(x[0]) > 8]), _first(t, fixed.title_era()), era_from_volume(title), F.lit("unknown")
    )


def genre(title: Column) -> Column:
    out = F.lit("unknown")
    for name, pattern in reversed(fixed.GENRES):
        out = F.when(title.rlike(rf"(?iuU)\b({pattern})"), name).otherwise(out)
    return out


def is_canonical(work: Column) -> Column:
    return F.lower(work).rlike("|".join(fixed.CANON))


def verse_signal(text: Column, is_scan: Column) -> Column:
    """verse, prose or unknown by the lengths of lines; pages keep the lines of print, so they are unknown."""
    lengths = F.array_sort(F.filter(F.transform(F.split(text, "\n"), lambda x: F.length(strip(x))), lambda n: n > 3))
    n = F.size(lengths)
    at = lambda i: F.get(lengths, i.cast("int"))
    median = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    zero = F.lit(0.0)
    mean = F.aggregate(lengths, zero, lambda a, x: a + x) / n
    sd = F.sqrt(F.aggregate(F.transform(lengths, lambda x: (x - mean) * (x - mean)), zero, lambda a, x: a + x) / n)
    cv = sd / median
    return (
        F.when(F.coalesce(is_scan, F.lit(False)) | (n < 10), "unknown")
        .when(median.between(18, 72) & (cv < 0.45), "verse")
        .when((median > 90) | (cv >= 0.45), "prose")
        .otherwise("unknown")
    )


def word_count(text: Column) -> Column:
    t = strip(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+")))


def ocr_quality(text: Column) -> Column:
    """1 less the share of implausible signs and, up to 0.3, of words with digits inside."""
    t = F.substring(text, 1, 200_000)
    odd = F.regexp_count(t, F.lit(f"(?U)[^{fixed.PLAUSIBLE}]"))
    broken = F.regexp_count(t, F.lit(r"(?U)\b\w*\d+\w*[a-z]\w*\b"))
    score = 1 - odd / F.length(t) - F.least(F.lit(0.3), broken / F.greatest(F.lit(1), word_count(t)))
    return F.when(text == "", 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4))


def non_latin_per_1k(text: Column) -> Column:
    t = F.substring(text, 1, 200_000)
    n = word_count(t)
    return F.when(n == 0, 0.0).otherwise(F.round(1000.0 * F.regexp_count(t, F.lit(rf"(?iuU)\b(?:{fixed.NON_LATIN})\b")) / n, 3))


def fragment_score(text: Column) -> Column:
    """0 for continuous text to 1 for a stub; gaps, few sentence ends and shortness count."""
    t = strip(text)
    n = word_count(t)
    hundreds = F.greatest(F.lit(1.0), n / 100)
    gaps = F.regexp_count(t, F.lit(r"\.\.\.|\[\s*\.\.\.\s*\]|…|\*\*\*|†")) / hundreds
    ends = F.regexp_count(t, F.lit("[.!?;:]")) / hundreds
    score = F.when(n < 120, 0.4).otherwise(0.0) + F.when(ends < 2, 0.3).otherwise(0.0) + F.when(gaps > 5, 0.3).otherwise(0.0)
    return F.when(n < 40, 1.0).otherwise(F.round(F.least(F.lit(1.0), score), 3))


def orthography(text: Column, level: str) -> Column:
    """none, conservative (no marks on vowels), classical (v as u, j as i) or modern (u, i before vowels as v, j)."""
    if level not in ("none", "conservative", "classical", "modern"):
        raise ValueError(f"no orthography {level!r}")
    if level == "none":
        return text
    t = F.translate(text, fixed.MARKED, fixed.PLAIN)
    t = F.coalesce(_unmarked(F.when(t.rlike(r"[^\x00-\x7f]"), t)), t)
    if level == "classical":
        return F.translate(t, "vVjJ", "uUiI")
    if level == "modern":
        for pattern, to in ((r"\bu(?=[aeiouAEIOU])", "v"), (r"\bU(?=[aeiouAEIOU])", "V"), (r"(?<=[aeiou])u(?=[aeiou])", "v"), (r"\bi(?=[aeou])", "j"), (r"\bI(?=[aeou])", "J")):
            t = F.regexp_replace(t, f"(?U){pattern}", to)
    return t


def trim_to_whitespace(text: Column) -> Column:
    """Cut behind the last paragraph, line or sentence if it ends in the last three tenths, else behind the last blank."""
    n = F.length(text)

    def last(mark: str) -> Column:
        back = F.instr(F.reverse(text), mark[::-1])
        return F.when(back > 0, n - back - len(mark) + 1).otherwise(-1)

    out = None
    for mark, keep in (("\n\n", 2), ("\n", 1), (". ", 1), ("! ", 1), ("? ", 1)):
        cut = F.substring(text, F.lit(1), (last(mark) + keep).cast("int"))
        out = F.when(last(mark) > n * 0.7, cut) if out is None else out.when(last(mark) > n * 0.7, cut)
    return out.otherwise(F.coalesce(F.nullif(F.regexp_extract(text, r"(?sU)^(.*\s)", 1), F.lit("")), text))
