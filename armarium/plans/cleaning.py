"""Cleaning, orthography and trimming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import table
from .registry import query

#: Texts of documents with the dirt that cleaning takes out, by number of the document; the same in SQL.
_DIRT = {
    1: ("  ", "\t\n"), 2: ("roma .b et a.u.c. ", " .a"), 3: ("", "\n-----\n * * \nfinis"), 4: ("____", " _ x"), 5: ("​", "﻿"),
    6: ("a�", ""), 7: ("[[", "}}"), 8: ("a    b\n\n\n\n\n", ""), 9: ("\x01ē", ""),
}


def dirtied(spark, sf):
    kind = F.pmod("doc_id", F.lit(10))
    out = F.col("text")
    for k, (before, after) in _DIRT.items():
        out = F.when(kind == k, F.concat(F.lit(before), F.col("text"), F.lit(after))).otherwise(out)
    return table(spark, sf, "documents").select("doc_id", out.alias("t"))


_DIRTIED = "(SELECT doc_id, CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN '{a}' || text || '{b}'" for k, (a, b) in _DIRT.items()) + " ELSE text END AS t FROM documents)"


def _g(x: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', '{flags}')"


#: Unicode blanks: the regular expressions of the SQL engine know those of ASCII only.
_B = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_S = _B[1:-1]


def _runs(x: str) -> str:
    return _g(_g(_g(_g(x, "_{3,}"), "-{5,}"), r"[{}\[\]]{2,}"), " _ ", " ")


def _noise(x: str) -> str:
    return _g(x, rf"(?m)^[{_S}.\-_*=]+$")


def _strip(x: str) -> str:
    return _g(x, rf"^{_B}+|{_B}+\z")


_signs = _g("nfc_normalize(t)", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_signs = _g(_signs, r"[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}\x{fffd}]")
_letters = _g(_g(_signs, rf"({_B})\.[a-z]\.?({_B}|\z)", r"\1\2"), rf"({_B})\.[a-z]\.?({_B}|\z)", r"\1\2")
_CLEAN = _strip(_g(_g(_noise(_runs(_letters)), r"[ \t]{3,}", " "), r"\n{4,}", "\n\n\n"))
def _sql_metrics(cleaned: str) -> str:
    return f"SELECT doc_id, length(c) AS chars, strlen(c)::BIGINT AS bytes, sha1(c) AS content_sha1, c <> t AS changed FROM (SELECT doc_id, t, {cleaned} AS c FROM {_DIRTIED})"



def _metrics(df, cleaned):
    c = F.col("c")
    return df.withColumn("c", cleaned).select(
        "doc_id", F.length(c).cast("bigint").alias("chars"), F.octet_length(c).cast("bigint").alias("bytes"), F.sha1(c.cast("binary")).alias("content_sha1"), (c != F.col("t")).alias("changed")
    )


@query(_sql_metrics(_CLEAN))
def clean_metrics(spark, sf):
    return _metrics(dirtied(spark, sf), T.clean_text(F.col("t")))


@query(_sql_metrics(_noise(_g(_runs(_strip("t")), r"\n{4,}", "\n\n\n"))))
def clean_legacy(spark, sf):
    return _metrics(dirtied(spark, sf), T.clean_legacy(F.col("t")))


@query(
    rf"""SELECT doc_id, contains(t, chr(65533)) AS had_replacement_char, regexp_matches(t, '[\x{{200b}}\x{{200c}}\x{{200d}}\x{{2060}}\x{{feff}}]') AS had_zero_width,
    regexp_matches(t, '{_B}\.[a-z]\.?({_B}|\z)') AS had_editorial_codes FROM {_DIRTIED}"""
)
def clean_flags(spark, sf):
    return dirtied(spark, sf).select("doc_id", *[c.alias(n) for n, c in T.clean_flags(F.col("t")).items()])


_PLAIN = "translate(text, 'āēīōūȳăĕĭŏŭўÁÉÍÓÚáéíóú', 'aeiouyaeiouyAEIOUaeiou')"
_BARE = rf"nfc_normalize({_g(f'strip_accents({_PLAIN})', chr(92) + 'p{M}')})"


def _orthography(spark, sf, level):
    return table(spark, sf, "documents").select("doc_id", F.sha1(T.orthography(F.col("text"), level).cast("binary")).alias("h"))


#: Letters and digits as the engine's word boundaries see them.
_L = r"\p{L}\p{M}\p{N}_"


@query(f"SELECT doc_id, sha1({_BARE}) AS h FROM documents")
def orthography_conservative(spark, sf):
    return _orthography(spark, sf, "conservative")


@query(f"SELECT doc_id, sha1(translate({_BARE}, 'vVjJ', 'uUiI')) AS h FROM documents")
def orthography_classical(spark, sf):
    return _orthography(spark, sf, "classical")


_V = _g(rf"regexp_replace({_BARE}, '(^|[^{_L}])u([aeiouAEIOU])', '\1v\2', 'g')", rf"(^|[^{_L}])U([aeiouAEIOU])", r"\1V\2")
_BETWEEN = "list_transform(range(1, len(l) + 1), lambda i: CASE WHEN l[i] = 'u' AND i > 1 AND i < len(l) AND contains('aeiou', l[i - 1]) AND contains('aeiou', l[i + 1]) THEN 'v' ELSE l[i] END)"
_MODERN = _g(_g(f"array_to_string({_BETWEEN}, '')", rf"(^|[^{_L}])i([aeou])", r"\1j\2"), rf"(^|[^{_L}])I([aeou])", r"\1J\2")


@query(f"SELECT doc_id, sha1({_MODERN}) AS h FROM (SELECT doc_id, string_split(t, '') AS l FROM (SELECT doc_id, {_V} AS t FROM documents))")
def orthography_modern(spark, sf):
    return _orthography(spark, sf, "modern")


def _last(mark: str, keep: int) -> str:
    at = f"(length(text) - strpos(reverse(text), '{mark[::-1]}') - {len(mark) - 1})"
    return f"WHEN strpos(text, '{mark}') > 0 AND {at} > length(text) * 0.7 THEN substr(text, 1, {at} + {keep})"


def trimmed_sql(text: str) -> str:
    marks = " ".join(_last(m, k) for m, k in (("\n\n", 2), ("\n", 1), (". ", 1), ("! ", 1), ("? ", 1)))
    return rf"(SELECT doc_id, text, CASE {marks} ELSE coalesce(nullif(regexp_extract(text, '(?s)^(.*{_B})', 1), ''), text) END AS o FROM (SELECT doc_id, {text} AS text FROM documents WHERE text IS NOT NULL))"


@query("SELECT doc_id, length(o) AS kept, sha1(o) AS h FROM " + trimmed_sql("text || ' et'"))
def trim_whitespace(spark, sf):
    cut = T.trim_to_whitespace(F.concat("text", F.lit(" et")))
    return table(spark, sf, "documents").select("doc_id", F.length(cut).cast("bigint").alias("kept"), F.sha1(cut.cast("binary")).alias("h"))
