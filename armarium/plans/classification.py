"""Identity and classification of ledger records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..runtime import table
from .cleaning import _B, _strip
from .registry import NAME, TITLE, query


def named(spark, sf):
    """Every record once, with its file name and title."""
    name = T.base_name(F.col("path"))
    return table(spark, sf, "corpus_ledger").select("doc_id", name.alias("name"), F.regexp_replace(name, r"\.txt$", "").alias("title")).distinct()


_NAMED = f"(SELECT DISTINCT doc_id, {NAME} AS name, {TITLE} AS title FROM corpus_ledger)"
_STEM_WORK = r"CASE WHEN regexp_extract(title, '^Pagina_(.+?)\.djvu_\d+$', 1) <> '' THEN regexp_extract(title, '^Pagina_(.+?)\.djvu_\d+$', 1) ELSE split_part(title, '_', 1) END"
_WORK0 = rf"lower(trim(regexp_replace({_STEM_WORK}, '\s*\([^)]*\)\s*$', '')))"
_SERIES = r"trim(regexp_extract(w, '(?i)^(.+?)[ ,]+(?:t\.?|tomus|vol\.?|band)?\s*\d+$', 1))"
_WORK = "CASE WHEN " + " OR ".join(f"starts_with({_SERIES}, '{s}')" for s in fixed.SERIES) + f" THEN {_SERIES} WHEN w <> '' THEN w ELSE lower(title) END"
_HINT = r"nullif(lower(trim(regexp_extract(split_part(title, '_', 1), '\s*\(([^)]*)\)\s*$', 1))), '')"
_IDENTITY = f"(SELECT doc_id, name, title, {_WORK} AS work_id, {_HINT} AS author_hint FROM (SELECT *, {_WORK0} AS w FROM {_NAMED}))"


def identified(spark, sf):
    n = F.col("name")
    return named(spark, sf).select("doc_id", "name", "title", T.work_id(n).alias("work_id"), T.author_hint(n).alias("author_hint"))


@query(f"SELECT doc_id, work_id, author_hint, starts_with(name, 'Pagina_') AS is_scan_page FROM {_IDENTITY}")
def work_identity(spark, sf):
    return identified(spark, sf).select("doc_id", "work_id", "author_hint", F.col("name").startswith("Pagina_").alias("is_scan_page"))


_NO_AUTHOR = fixed.NO_AUTHOR.replace("'", "''")
_AUTHOR = rf"list_filter(list_transform(regexp_extract_all(title, '\(([^)]+)\)', 1), lambda x: lower(trim(x))), lambda x: x <> '' AND NOT regexp_matches(x, '(?i){_NO_AUTHOR}'))[1]"


def _first_of(pairs) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(title), '{n}') THEN '{e}'" for n, e in pairs) + " END"


_VOLUME = (
    r"(SELECT CASE WHEN n BETWEEN 1 AND 79 THEN 'late_antique' WHEN n BETWEEN 80 AND 190 THEN 'early_medieval' WHEN n BETWEEN 191 AND 217 THEN 'high_medieval' END FROM (SELECT try_cast(coalesce("
    r"nullif(regexp_extract(lower(title), 'patrologia latina[ ,]*(\d{1,3})|(?:^|\W)pl[ _]*(\d{1,3})\b', 1), ''), nullif(regexp_extract(lower(title), 'patrologia latina[ ,]*(\d{1,3})|(?:^|\W)pl[ _]*(\d{1,3})\b', 2), '')) AS INT) AS n))"
)
_EXACT = "CASE author " + " ".join(f"WHEN '{a}' THEN '{e}'" for a, e in fixed.author_era()) + " END"
_LONG = _first_of([x for x in fixed.author_era() if len(x[0]) > 8])
_GENRE = "CASE " + " ".join(rf"WHEN regexp_matches(title, '(?i)\b({p})') THEN '{g}'" for g, p in fixed.GENRES) + " ELSE 'unknown' END"
_CANON = "|".join(fixed.CANON)


@query(
    f"""SELECT doc_id, author, coalesce({_EXACT}, {_LONG}, {_first_of(fixed.title_era())}, {_VOLUME}, 'unknown') AS era, {_GENRE} AS genre,
    regexp_matches(work_id, '{_CANON}') AS canonical FROM (SELECT *, {_AUTHOR} AS author FROM {_IDENTITY})"""
)
def title_classes(spark, sf):
    t = F.col("title")
    author = T.author_from_title(t)
    return identified(spark, sf).select("doc_id", author.alias("author"), T.era(author, t).alias("era"), T.genre(t).alias("genre"), T.is_canonical(F.col("work_id")).alias("canonical"))


#: Titles for the rules that the ledger's invented ones never meet, by number of the document.
_TITLES = ("Patrologia Latina 79_3", "De civitate Dei (ed. Migne)_4", "Aeneis (Vergilius)_1", "Opera Rabanus Maurus_2", "PL 191_7", "Summa Theologiae_Quaestio 1", "Carmina (1599) (Horatius)_1", "Moralia_2", "Orationes_1", "Regula_1")
_CHOSEN = "CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TITLES)) + " END"


@query(f"SELECT doc_id, author, coalesce({_EXACT}, {_LONG}, {_first_of(fixed.title_era())}, {_VOLUME}, 'unknown') AS era, {_GENRE} AS genre FROM (SELECT *, {_AUTHOR} AS author FROM (SELECT doc_id, {_CHOSEN} AS title FROM documents))")
def era_precedence(spark, sf):
    title = F.get(F.array(*map(F.lit, _TITLES)), F.pmod("doc_id", F.lit(10)).cast("int"))
    df = table(spark, sf, "documents").select("doc_id", title.alias("title"))
    author = T.author_from_title(F.col("title"))
    return df.select("doc_id", author.alias("author"), T.era(author, F.col("title")).alias("era"), T.genre(F.col("title")).alias("genre"))


def texts(spark, sf):
    return table(spark, sf, "corpus_ledger").where("_text is not null").select("doc_id", F.col("_text").alias("t"), F.col("is_scan_page").alias("scan")).distinct()


_TEXTS = "(SELECT DISTINCT doc_id, _text AS t, is_scan_page AS scan FROM corpus_ledger WHERE _text IS NOT NULL)"
_N = rf"(CASE WHEN {_strip('t')} = '' THEN 0 ELSE len(regexp_extract_all({_strip('t')}, '[^{_B[1:-1]}]+')) END)".replace(r"[^\s", r"[^\t\n\f\r ")


@query(
    rf"""SELECT doc_id, CASE WHEN coalesce(scan, false) OR n < 10 THEN 'unknown' WHEN med BETWEEN 18 AND 72 AND sd / med < 0.45 THEN 'verse' WHEN med > 90 OR sd / med >= 0.45 THEN 'prose' ELSE 'unknown' END AS form
    FROM (SELECT doc_id, scan, len(l) AS n, list_aggregate(l, 'median') AS med, list_aggregate(l, 'stddev_pop') AS sd
    FROM (SELECT doc_id, scan, list_filter(list_transform(string_split(t, chr(10)), lambda x: length({_strip("x")})), lambda k: k > 3) AS l FROM {_TEXTS}))"""
)
def verse_signal(spark, sf):
    return texts(spark, sf).select("doc_id", T.verse_signal(F.col("t"), F.col("scan")).alias("form"))


_FRAGMENT = (
    rf"""SELECT doc_id, CASE WHEN n < 40 THEN 1.0 ELSE round(least(1.0, CASE WHEN n < 120 THEN 0.4 ELSE 0 END + CASE WHEN len(regexp_extract_all(s, '[.!?;:]')) / greatest(1.0, n / 100) < 2 THEN 0.3 ELSE 0 END
    + CASE WHEN len(regexp_extract_all(s, '\.\.\.|\[\s*\.\.\.\s*\]|…|\*\*\*|†')) / greatest(1.0, n / 100) > 5 THEN 0.3 ELSE 0 END)::DOUBLE, 3) END::DOUBLE AS fragment_score
    FROM (SELECT doc_id, {_strip("t")} AS s, {_N} AS n FROM {_TEXTS})"""
)
_RUN = r"[\p{L}\p{M}\p{N}_]+"
_PLAUSIBLE = fixed.PLAUSIBLE.replace(r"\s", _B[1:-1]).replace("'", "''")
_FOREIGN = ", ".join(f"'{w}'" for w in fixed.NON_LATIN.split("|"))
_N2 = _N.replace(_strip("t"), _strip("p"))


@query(
    rf"""SELECT doc_id, CASE WHEN t = '' THEN 0.0 ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - odd / length(p)::DOUBLE - least(0.3::DOUBLE, broken / greatest(1, n)::DOUBLE))), 4) END AS ocr_quality,
    CASE WHEN n = 0 THEN 0.0 ELSE round(1000.0::DOUBLE * nl / n, 3) END AS non_latin_per_1k, f.fragment_score FROM
    (SELECT doc_id, t, p, {_N2} AS n, length(p) - length(regexp_replace(p, '[^{_PLAUSIBLE}]', '', 'g')) AS odd,
    len(list_filter(regexp_extract_all(p, '{_RUN}'), lambda x: regexp_matches(x, '\p{{N}}.*[a-z]'))) AS broken, len(list_filter(regexp_extract_all(lower(p), '{_RUN}'), lambda x: x IN ({_FOREIGN}))) AS nl
    FROM (SELECT doc_id, t, substr(t, 1, 200000) AS p FROM {_TEXTS})) JOIN ({_FRAGMENT}) f USING (doc_id)"""
)
def text_signals(spark, sf):
    t = F.col("t")
    return texts(spark, sf).select("doc_id", T.ocr_quality(t).alias("ocr_quality"), T.non_latin_per_1k(t).alias("non_latin_per_1k"), T.fragment_score(t).alias("fragment_score"))


@query(_FRAGMENT)
def fragment_score(spark, sf):
    return texts(spark, sf).select("doc_id", T.fragment_score(F.col("t")).alias("fragment_score"))


@query(
    """SELECT field, value, docs, bytes, share FROM (SELECT *, round(bytes / sum(bytes) OVER (PARTITION BY field), 6) AS share, row_number() OVER (PARTITION BY field ORDER BY bytes DESC, value) AS r
    FROM (SELECT field, value, count(*) AS docs, sum(b)::BIGINT AS bytes FROM (SELECT DISTINCT doc_id, era, genre, form, source_type, coalesce(bytes, 0) AS b FROM corpus_ledger)
    UNPIVOT (value FOR field IN (era, genre, form, source_type)) GROUP BY field, value)) WHERE r <= 8"""
)
def coverage_by_field(spark, sf):
    """Documents and bytes by each of four fields, the eight largest values of each."""
    from pyspark.sql import Window

    fields = ["era", "genre", "form", "source_type"]
    docs = table(spark, sf, "corpus_ledger").select("doc_id", *fields, F.coalesce("bytes", F.lit(0)).alias("b")).distinct()
    sums = docs.groupingSets([[f] for f in fields], *fields).agg(F.grouping_id().alias("g"), F.count("*").alias("docs"), F.sum("b").cast("bigint").alias("bytes"))
    name = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(fields) for x in (15 - (8 >> i), f)]), F.col("g").cast("int"))
    value = F.coalesce(*fields)
    w = Window.partitionBy("field")
    long = sums.select(name.alias("field"), value.alias("value"), "docs", "bytes").where("value is not null")
    ranked = long.withColumn("share", F.round(F.col("bytes") / F.sum("bytes").over(w), 6)).withColumn("r", F.row_number().over(w.orderBy(F.desc("bytes"), "value")))
    return ranked.where("r <= 8").drop("r")


@query(
    """SELECT count(*) AS docs, count(*) FILTER (non_latin_per_1k > 15) AS suspects, count(*) FILTER (non_latin_per_1k > 40) AS excluded, count(*) FILTER (ocr_quality < 0.9) AS poor,
    coalesce(sum(b) FILTER (ocr_quality < 0.9), 0)::BIGINT AS poor_bytes, count(*) FILTER (chars >= 32) AS long_enough, count(*) FILTER (chars >= 32 AND fragment_score < 1) AS whole
    FROM (SELECT DISTINCT doc_id, non_latin_per_1k, ocr_quality, coalesce(bytes, 0) AS b, chars, fragment_score FROM corpus_ledger)"""
)
def quality_flags(spark, sf):
    docs = table(spark, sf, "corpus_ledger").select("doc_id", "non_latin_per_1k", "ocr_quality", F.coalesce("bytes", F.lit(0)).alias("b"), "chars", "fragment_score").distinct()
    n = lambda c: F.count_if(F.expr(c))
    return docs.agg(
        F.count("*").alias("docs"), n("non_latin_per_1k > 15").alias("suspects"), n("non_latin_per_1k > 40").alias("excluded"), n("ocr_quality < 0.9").alias("poor"),
        F.coalesce(F.sum(F.when(F.col("ocr_quality") < 0.9, F.col("b"))), F.lit(0)).cast("bigint").alias("poor_bytes"), n("chars >= 32").alias("long_enough"), n("chars >= 32 and fragment_score < 1").alias("whole"),
    )


@query(
    f"""SELECT count(*) AS docs, count(*) FILTER (length(t) < 200) AS shorts, count(*) FILTER (length(t) >= 200 AND s >= 0.7) AS fragments, count(*) FILTER (length(t) >= 200 AND s < 0.7) AS kept
    FROM (SELECT doc_id, t, f.fragment_score AS s FROM {_TEXTS} JOIN ({_FRAGMENT}) f USING (doc_id))"""
)
def fragment_filter_report(spark, sf):
    """Texts too short, and of the others fragments, counted apart."""
    d = texts(spark, sf).select(F.length("t").alias("n"), T.fragment_score(F.col("t")).alias("s"))
    short, fragment = F.col("n") < 200, F.col("s") >= 0.7
    return d.agg(F.count("*").alias("docs"), F.count_if(short).alias("shorts"), F.count_if(~short & fragment).alias("fragments"), F.count_if(~short & ~fragment).alias("kept"))
