"""Groups, duplicates, splits and offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus
from ..runtime import table
from .classification import _IDENTITY, identified
from .registry import query

_GROUPS = f"(SELECT i.doc_id, i.work_id, CASE WHEN n > 1 AND author_hint IS NOT NULL THEN i.work_id || ' (' || author_hint || ')' ELSE i.work_id END AS work_group FROM {_IDENTITY} i LEFT JOIN (SELECT work_id, count(DISTINCT author_hint) AS n FROM {_IDENTITY} GROUP BY work_id) a ON a.work_id = i.work_id)"


#: Names with authors for the ledger's invented titles, which name none: by number of the document, in SQL too.
_AUTHORED = "(SELECT doc_id, 'Carmina ' || (doc_id // 5 % 7) || CASE doc_id % 3 WHEN 0 THEN ' (Horatius)' WHEN 1 THEN ' (Venantius Fortunatus)' ELSE '' END || '_Liber ' || doc_id || '.txt' AS path FROM documents)"
_NAMES = _IDENTITY.replace("corpus_ledger", _AUTHORED)


@query(f"SELECT work_id, count(DISTINCT author_hint) AS authors, count(*) AS docs FROM {_NAMES} GROUP BY work_id HAVING count(DISTINCT author_hint) > 1")
def ambiguous_titles(spark, sf):
    hint = F.when(F.col("doc_id") % 3 == 0, " (Horatius)").when(F.col("doc_id") % 3 == 1, " (Venantius Fortunatus)").otherwise("")
    name = F.concat(F.lit("Carmina "), F.floor(F.col("doc_id") / 5) % 7, hint, F.lit("_Liber "), F.col("doc_id"), F.lit(".txt"))
    named = table(spark, sf, "documents").select(T.work_id(name).alias("work_id"), T.author_hint(name).alias("author_hint"))
    return named.groupBy("work_id").agg(F.count_distinct("author_hint").alias("authors"), F.count("*").alias("docs")).where("authors > 1")


@query(f"SELECT doc_id, work_group FROM {_GROUPS}")
def work_groups(spark, sf):
    return corpus.work_groups(identified(spark, sf)).select("doc_id", "work_group")


_HASHED = "(SELECT doc_id, sha1(text) AS h, strlen(text) AS b, source FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT h, count(*) AS docs, min(doc_id) AS first_doc, (sum(b) - max(b))::BIGINT AS reclaimable FROM {_HASHED} GROUP BY h HAVING count(*) > 1")
def exact_dup_clusters(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("h"), F.octet_length("text").alias("b"))
    return d.groupBy("h").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"), (F.sum("b") - F.max("b")).cast("bigint").alias("reclaimable")).where("docs > 1")


def _grouped(spark, sf):
    """Documents in groups of five by number, merged where they hold equal texts."""
    docs = table(spark, sf, "documents").where("text is not null")
    docs = docs.select("doc_id", F.floor(F.col("doc_id") / 5).cast("bigint").alias("work_group"), F.sha1(F.col("text").cast("binary")).alias("content_sha1"), F.octet_length("text").cast("bigint").alias("bytes"))
    return docs.join(corpus.merged_groups(docs), "work_group").select("doc_id", "bytes", F.col("merged").alias("group"))


_MERGED = """WITH RECURSIVE d AS (SELECT doc_id, doc_id // 5 AS g, sha1(text) AS h, strlen(text) AS b FROM documents WHERE text IS NOT NULL),
    e AS (SELECT DISTINCT x.g AS a, y.g AS b FROM d x JOIN d y ON x.h = y.h),
    r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    m AS (SELECT a, min(b) AS grp FROM r GROUP BY a),
    docs AS (SELECT doc_id, d.b::BIGINT AS bytes, m.grp AS "group" FROM d JOIN m ON m.a = d.g) """
_SPLIT = (
    _MERGED
    + """, s AS (SELECT "group", sum(bytes) AS size FROM docs GROUP BY 1), k AS (SELECT "group", size, md5('1337:' || "group") AS rk, (SELECT sum(size) * 0.1 FROM s) AS target FROM s),
    f AS (SELECT *, coalesce(sum(size) OVER (ORDER BY rk, "group" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k WHERE size <= target * 0.25),
    v AS (SELECT "group" FROM f WHERE before < target), labelled AS (SELECT docs.*, CASE WHEN v."group" IS NULL THEN 'train' ELSE 'val' END AS split FROM docs LEFT JOIN v ON v."group" = docs."group") """
)


@query(_MERGED + 'SELECT doc_id, "group" FROM docs')
def merged_groups(spark, sf):
    return _grouped(spark, sf).select("doc_id", "group")


def _split(spark, sf):
    docs = _grouped(spark, sf)
    held = corpus.held_out_groups(docs.groupBy("group").agg(F.sum("bytes").alias("size")), 0.1, 0.25, 1337)
    return docs.join(held.select("group", F.lit("val").alias("v")), "group", "left").withColumn("split", F.coalesce("v", F.lit("train"))).drop("v")


@query(_SPLIT + 'SELECT doc_id, "group", split FROM labelled')
def work_split(spark, sf):
    return _split(spark, sf).select("doc_id", "group", "split")


@query(_SPLIT + 'SELECT split, count(*) AS docs, count(DISTINCT "group") AS groups, sum(bytes)::BIGINT AS bytes FROM labelled GROUP BY ROLLUP (split)')
def split_stats(spark, sf):
    return _split(spark, sf).rollup("split").agg(F.count("*").alias("docs"), F.count_distinct("group").alias("groups"), F.sum("bytes").cast("bigint").alias("bytes"))


@query(_SPLIT + ", v2 AS (SELECT DISTINCT \"group\" FROM labelled WHERE split = 'val'), t2 AS (SELECT DISTINCT \"group\" FROM labelled WHERE split = 'train') SELECT (SELECT count(*) FROM v2) AS val_groups, (SELECT count(*) FROM t2) AS train_groups, (SELECT count(*) FROM (FROM v2 INTERSECT FROM t2)) AS in_both")
def split_disjoint(spark, sf):
    """Groups of either split, and those of both, which must be none."""
    g = _split(spark, sf).groupBy("group").agg(F.max((F.col("split") == "val").cast("int")).alias("v"), F.max((F.col("split") == "train").cast("int")).alias("t"))
    return g.agg(F.sum("v").alias("val_groups"), F.sum("t").alias("train_groups"), F.sum(F.col("v") * F.col("t")).alias("in_both"))


_KEPT = "(SELECT DISTINCT doc_id, split, tokens FROM corpus_ledger WHERE split IS NOT NULL AND tokens IS NOT NULL)"


@query(f"SELECT doc_id, split, tokens, coalesce(sum(tokens) OVER (PARTITION BY split ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS token_offset FROM {_KEPT}")
def token_offsets(spark, sf):
    kept = table(spark, sf, "corpus_ledger").where("split is not null and tokens is not null").select("doc_id", "split", "tokens").distinct()
    return corpus.running_sum(kept, ["doc_id"], "tokens", "token_offset", ["split"]).select("doc_id", "split", "tokens", F.col("token_offset").cast("bigint").alias("token_offset"))


@query("SELECT path, (row_number() OVER (ORDER BY path) - 1)::BIGINT AS doc_no FROM (SELECT DISTINCT path FROM corpus_ledger WHERE path IS NOT NULL)")
def dense_ids(spark, sf):
    paths = table(spark, sf, "corpus_ledger").where("path is not null").select("path").distinct().withColumn("one", F.lit(1))
    return corpus.running_sum(paths, ["path"], "one", "doc_no").select("path", F.col("doc_no").cast("bigint").alias("doc_no"))


@query("SELECT sum(n)::BIGINT AS n, sha1(string_agg(h, '' ORDER BY p)) AS fingerprint FROM (SELECT substr(h, 1, 4) AS p, count(*) AS n, sha1(string_agg(h, '' ORDER BY h)) AS h FROM (SELECT sha1(text) AS h FROM documents WHERE text IS NOT NULL) GROUP BY 1)")
def dataset_fingerprint(spark, sf):
    """Digests of all texts, sorted and digested in 65,536 ranges, then once more: order makes no difference, any changed text does."""
    h = table(spark, sf, "documents").where("text is not null").select(F.sha1(F.col("text").cast("binary")).alias("h"))
    digest = lambda c: F.sha1(F.array_join(c, "").cast("binary"))
    ranges = h.groupBy(F.substring("h", 1, 4).alias("p")).agg(F.count("*").alias("n"), digest(F.array_sort(F.collect_list("h"))).alias("h"))
    both = F.array_sort(F.collect_list(F.struct("p", "h")))
    return ranges.agg(F.sum("n").alias("n"), digest(F.transform(both, lambda x: x["h"])).alias("fingerprint"))


@query("SELECT doc_id, sha1(encode(text)[1:1024]) AS prefix, strlen(text)::BIGINT AS size FROM documents WHERE text IS NOT NULL")
def prefix_fingerprint(spark, sf):
    """The digest of a text's first 1,024 bytes, with its size: enough to notice another file."""
    raw = F.col("text").cast("binary")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha1(F.substring(raw, 1, 1024)).alias("prefix"), F.octet_length("text").cast("bigint").alias("size"))


@query(r"SELECT count(*) AS files, count(*) FILTER (NOT regexp_matches(path, '\.__dup\d+__\.txt$')) AS originals FROM (SELECT DISTINCT path FROM corpus_ledger WHERE path IS NOT NULL)")
def copy_exclusion(spark, sf):
    return table(spark, sf, "corpus_ledger").where("path is not null").select("path").distinct().agg(F.count("*").alias("files"), F.count_if(~T.is_copy(F.col("path"))).alias("originals"))


_KEYED = "(SELECT DISTINCT doc_id, tokens, weight FROM corpus_ledger WHERE split = 'train' AND tokens IS NOT NULL)"


@query(f"SELECT a.r, a.doc_id, a.tokens, round(b.weight, 6) AS weight FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS r, doc_id, tokens FROM {_KEYED}) a JOIN (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS r, weight FROM {_KEYED}) b ON a.r = b.r")
def positional_weights(spark, sf):
    """An index and a vector of weights of equal lengths, joined by position."""
    d = table(spark, sf, "corpus_ledger").where("split = 'train' and tokens is not null").select("doc_id", "tokens", "weight").distinct()
    both = corpus.positional_join(d.select("doc_id", "tokens"), ["doc_id"], d.select(F.col("doc_id").alias("at"), "weight"), ["at"])
    return both.select("r", "doc_id", "tokens", F.round("weight", 6).alias("weight"))
