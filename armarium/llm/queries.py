"""Queries of this package and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tokens import _IDS
from ..runtime import table
from . import grouping, leaks, levels, mixing, overlap, scans, spans, subjects, tokens
from .texts import MODERN_FROM, MODERN_WORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


#: Distinct words of docs(doc_id, _text) cut into pieces, and tokens of each record.
_PIECES = _IDS[_IDS.index("    pc AS") : _IDS.index("    own AS")]
_COUNTS = _PIECES + "t AS (SELECT d.doc_id, coalesce(n, 0) + 1 AS tokens, coalesce(m, 0) AS words FROM docs d LEFT JOIN (SELECT doc_id, sum(len(ids)) AS n, count(*) AS m FROM k JOIN cut USING (w) GROUP BY doc_id) c ON c.doc_id = d.doc_id)"
_LEDGER_TEXTS = "WITH RECURSIVE docs AS MATERIALIZED (SELECT DISTINCT doc_id, _text FROM corpus_ledger WHERE _text IS NOT NULL), "
_MODERN = ", ".join(f"'{w}'" for w in sorted(MODERN_WORDS))


def query(f):
    QUERIES[f.__name__] = f
    return f


def _ledger_counts(spark, sf):
    ledger = table(spark, sf, "corpus_ledger")
    return ledger, tokens.token_counts(ledger, table(spark, sf, "tokenizer_latin"), "doc_id", "_text")


@query
def p1_found(spark, sf):
    ledger, counts = _ledger_counts(spark, sf)
    recorded = ledger.where("tokens is not null").select(F.col("doc_id").alias("key"), "tokens").distinct()
    return counts.dropDuplicates(["key"]).join(recorded, "key").where("tokens != n_tokens").select(F.col("key").alias("doc_id")).distinct()


@query
def p1_budget(spark, sf):
    ledger, counts = _ledger_counts(spark, sf)
    slices = ledger.select(F.col("doc_id").alias("key"), tokens.source_of(F.col("path")).alias("source"), "era", "genre")
    return tokens.token_budget(counts, slices, ["source", "language", "era", "genre"])


ORACLE["p1_found"] = _LEDGER_TEXTS + _COUNTS + "SELECT DISTINCT l.doc_id FROM corpus_ledger l JOIN t ON t.doc_id = l.doc_id WHERE l.tokens IS NOT NULL AND l.tokens <> t.tokens"
ORACLE["p1_budget"] = (
    _LEDGER_TEXTS
    + _COUNTS
    + f""", latin AS (SELECT doc_id, count(*) FILTER (lower(trim(w, '.,;:!?')) IN ({_MODERN})) < {MODERN_FROM} * count(*) AS latin FROM k GROUP BY doc_id),
    slices AS (SELECT DISTINCT doc_id, CASE WHEN contains(replace(path, chr(92), '/'), '/') THEN split_part(replace(path, chr(92), '/'), '/', 1) ELSE 'unknown' END AS source, coalesce(era, 'unknown') AS era, coalesce(genre, 'unknown') AS genre FROM corpus_ledger)
    SELECT source, language, era, genre, count(*) AS docs, sum(words)::BIGINT AS words, sum(tokens)::BIGINT AS tokens, sum(bytes)::BIGINT AS bytes FROM (SELECT s.source, CASE WHEN coalesce(latin, false) THEN 'latin' ELSE 'modern' END AS language,
    s.era, s.genre, t.words, t.tokens, strlen(d._text) AS bytes FROM docs d JOIN t ON t.doc_id = d.doc_id LEFT JOIN latin ON latin.doc_id = d.doc_id JOIN slices s ON s.doc_id = d.doc_id) GROUP BY CUBE (source, language, era, genre)"""
)


LINKS = ("work_id", "work_group", "content_sha1")


@query
def p6_found(spark, sf):
    pairs = grouping.linked_pairs(table(spark, sf, "corpus_ledger"), LINKS)
    return pairs.select(F.col("a").alias("work_a"), F.col("b").alias("work_b"))


ORACLE["p6_found"] = r"""WITH RECURSIVE v AS (SELECT DISTINCT lower(trim(regexp_replace(work_id, '\s+', ' ', 'g'))) AS w, lower(trim(regexp_replace(work_group, '\s+', ' ', 'g'))) AS g,
    lower(trim(regexp_replace(content_sha1, '\s+', ' ', 'g'))) AS h FROM corpus_ledger),
    n AS (SELECT DISTINCT row_number() OVER () AS r, w, g, h FROM v),
    l AS (SELECT r, unnest([CASE WHEN w NOT IN ('', 'unknown', 'da39a3ee5e6b4b0d3255bfef95601890afd80709') THEN '0:' || w END, CASE WHEN g NOT IN ('', 'unknown', 'da39a3ee5e6b4b0d3255bfef95601890afd80709') THEN '1:' || g END,
    CASE WHEN h NOT IN ('', 'unknown', 'da39a3ee5e6b4b0d3255bfef95601890afd80709') THEN '2:' || h END]) AS x FROM n),
    e AS (SELECT DISTINCT a.x AS a, b.x AS b FROM l a JOIN l b ON a.r = b.r WHERE a.x IS NOT NULL AND b.x IS NOT NULL),
    c(a, b) AS (SELECT a, a FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
    SELECT DISTINCT substr(a, 3) AS work_a, substr(b, 3) AS work_b FROM c WHERE starts_with(a, '0:') AND starts_with(b, '0:') AND a < b"""


def _record_roots(ledger):
    """(doc_id, root, size): every record once with its group; a record that nothing links is its own group."""
    roots = grouping.components(grouping.links(ledger, *LINKS))
    values = [grouping.link_value(F.col(c)) for c in LINKS]
    node = F.coalesce(*[F.concat(F.lit(f"{i}:"), v) for i, v in enumerate(values)])
    records = ledger.select("doc_id", node.alias("node"), F.coalesce(F.octet_length("_text"), F.col("bytes"), F.lit(0)).alias("size")).dropDuplicates(["doc_id"])
    return records.join(roots, "node", "left").select("doc_id", F.coalesce("root", F.concat(F.lit("r:"), "doc_id")).alias("root"), "size")


@query
def p6_split(spark, sf):
    records = _record_roots(table(spark, sf, "corpus_ledger"))
    sizes = records.groupBy("root").agg(F.sum("size").alias("size"))
    assigned = grouping.split_groups(sizes, {"train": 0.85, "val": 0.10, "test": 0.05})
    return records.join(assigned, "root").select("doc_id", "root", "split")


@query
def p7_found(spark, sf):
    found = leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "heldout_items"))
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"))


def _document_tokens(spark, sf):
    documents = table(spark, sf, "documents")
    counts = tokens.token_counts(documents, table(spark, sf, "tokenizer_latin"))
    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    slices = documents.select(F.col("doc_id").alias("key"), "source", F.when(lang.isin("la", "en", "fr", "de", "it"), lang).alias("lang"), F.col("genre").alias("topic"))
    return counts.select("key", "n_tokens").dropDuplicates(["key"]).join(slices, "key")


@query
def p8_found(spark, sf):
    return mixing.unreachable(_document_tokens(spark, sf), table(spark, sf, "mixture_targets")).select("source")


_KEY = r"nullif(regexp_replace(lower(trim(regexp_replace(source, '\s+', ' ', 'g'))), '[ _-]', '_', 'g'), '')"
ORACLE["p8_found"] = (
    "WITH RECURSIVE docs AS MATERIALIZED (SELECT doc_id, text AS _text FROM documents WHERE text IS NOT NULL), "
    + _COUNTS
    + f""", own AS (SELECT {_KEY} AS s, sum(tokens) AS own FROM documents JOIN t USING (doc_id) GROUP BY 1),
    wanted AS (SELECT {_KEY} AS s, min(source) AS source, sum(target_share) AS share, max(max_repeats) AS most FROM mixture_targets WHERE target_share IS NOT NULL AND max_repeats IS NOT NULL GROUP BY 1 HAVING s IS NOT NULL)
    SELECT source FROM (SELECT m.source, share, most, coalesce(own, 0) AS own, sum(coalesce(own, 0)) OVER () AS total FROM wanted m LEFT JOIN own ON own.s = m.s) WHERE share * total > most * own"""
)


@query
def p8_mixture(spark, sf):
    return mixing.mixture_report(_document_tokens(spark, sf), table(spark, sf, "mixture_targets"))


def _split_sides(spark, sf):
    """Records of val and test, and of train, each once; rows without split are of neither."""
    ledger = table(spark, sf, "corpus_ledger")
    base = ledger.where("split in ('train', 'val', 'test') and doc_id is not null and _text is not null")
    cols = F.col("doc_id").alias("key"), F.col("_text").alias("text"), scans.file_name(F.col("path")).alias("name")
    return base.where("split != 'train'").select(*cols), base.where("split = 'train'").select(*cols), base


@query
def p5_found(spark, sf):
    held_out, train, _ = _split_sides(spark, sf)
    found = overlap.overlaps(held_out, train)
    return found.select(F.least("key_l", "key_r").alias("doc_id_a"), F.greatest("key_l", "key_r").alias("doc_id_b")).distinct()


@query
def p5_report(spark, sf):
    held_out, train, base = _split_sides(spark, sf)
    found = overlap.overlaps(held_out, train)
    about = base.select("doc_id", "split", tokens.source_of(F.col("path")).alias("source")).dropDuplicates(["doc_id"])
    return (
        found.groupBy(F.col("key_l").alias("doc_id")).agg(F.count_distinct("key_r").alias("n"))
        .join(about, "doc_id")
        .groupBy("split", "source")
        .agg(F.count("*").alias("records"), F.sum("n").alias("pairs"))
    )


def _records(spark, sf):
    """Ledger records and samples under one key."""
    ledger = table(spark, sf, "corpus_ledger").select(F.col("doc_id").alias("key"), F.col("_text").alias("text"))
    return ledger.union(table(spark, sf, "eval_samples").select("sample_id", "text"))


@query
def p3_found(spark, sf):
    return spans.span_pairs(_records(spark, sf)).select("key_a", "key_b")


@query
def p3_shared(spark, sf):
    found = spans.shared_words(_records(spark, sf))
    return found.select("key", "words", F.col("shared").alias("shared_words"), F.round("share", 4).alias("share"))


@query
def p3_longest(spark, sf):
    found = spans.sample_statistics(table(spark, sf, "corpus_ledger"), table(spark, sf, "eval_samples"))
    samples = table(spark, sf, "eval_samples").select("sample_id", "label", "sample_no")
    base = table(spark, sf, "eval_v2_baseline").where("contamination is not null")
    lengths = F.posexplode("contamination.longest_exact_train_ngram_tokens").alias("sample_no", "recorded_tokens")
    recorded = base.select("label", lengths).distinct().groupBy("label", "sample_no").agg(F.max("recorded_tokens").alias("recorded_tokens"))
    joined = samples.join(found, samples["sample_id"] == found["sample"], "left").join(recorded, ["label", "sample_no"], "left")
    return joined.select("sample_id", "label", "sample_no", F.coalesce("longest", F.lit(0)).alias("longest_words"), F.col("doc").alias("doc_id"), "recorded_tokens")


@query
def p4_found(spark, sf):
    found = scans.scan_noise(table(spark, sf, "corpus_ledger"))
    return found.select(F.col("key").alias("doc_id"), F.col("line").alias("line_no"), "kind").distinct()


@query
def p4_repaired(spark, sf):
    pages = scans.scan_noise(table(spark, sf, "corpus_ledger"), repaired=True)
    return pages.dropDuplicates(["key"]).select(F.col("key").alias("doc_id"), "text")


@query
def p2_found(spark, sf):
    found = subjects.subjects_of(table(spark, sf, "corpus_ledger"), table(spark, sf, "subject_terms"), table(spark, sf, "subject_examples"))
    return found.select(F.col("key").alias("doc_id"), "subject")


@query
def p2_composition(spark, sf):
    """Documents and words by subject; documents that treat several count for each."""
    found = subjects.subjects_of(table(spark, sf, "corpus_ledger"), table(spark, sf, "subject_terms"), table(spark, sf, "subject_examples"))
    return found.groupBy("subject").agg(F.count("*").alias("docs"), F.round(F.sum("words"), 1).alias("subject_words"))


@query
def p9_found(spark, sf):
    found = levels.reading_levels(table(spark, sf, "documents"), table(spark, sf, "graded_passages"))
    return found.select(F.col("key").alias("doc_id"), F.col("level").alias("reading_level")).distinct()


@query
def p9_profile(spark, sf):
    found = levels.reading_levels(table(spark, sf, "documents"), table(spark, sf, "graded_passages")).dropDuplicates(["key"])
    return found.groupBy(F.col("level").alias("reading_level")).agg(F.count("*").alias("docs"), F.sum("n_words").alias("words"), F.round(F.avg("expected"), 4).alias("expected"))
