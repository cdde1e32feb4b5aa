"""Scores of held-out text under a count model, intervals, strata, samples and verbatim matches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sampling
from ..operators.corpus import uniform
from ..runtime import materialize, table
from .registry import query


def _words(spark, sf):
    d = table(spark, sf, "corpus_ledger").where("_text is not null and split is not null").select("doc_id", "split", "era", "_text").distinct()
    return d.select("doc_id", "split", "era", F.octet_length("_text").alias("bytes"), F.explode(F.filter(F.split("_text", r"[ \t\n]+"), lambda x: x != "")).alias("w"))


_WORDS = "(SELECT doc_id, split, era, strlen(_text) AS bytes, unnest(regexp_extract_all(_text, '[^ \\t\\n]+')) AS w FROM (SELECT DISTINCT doc_id, split, era, _text FROM corpus_ledger WHERE _text IS NOT NULL AND split IS NOT NULL))"
_NLL = f"""(WITH k AS (SELECT * FROM {_WORDS}), c AS (SELECT w, count(*) AS n FROM k WHERE split = 'train' GROUP BY w), s AS (SELECT sum(n) AS t, count(*) AS v FROM c)
    SELECT doc_id, era, max(bytes) AS bytes, count(*) AS n, sum(-ln((coalesce(c.n, 0) + 1) / (s.t + s.v + 1)::DOUBLE)) AS nll FROM k LEFT JOIN c ON c.w = k.w CROSS JOIN s WHERE split <> 'train' GROUP BY doc_id, era)"""


def document_nll(spark, sf):
    """(doc_id, era, bytes, n, nll) of held-out records under smoothed word counts of the training records."""
    k = _words(spark, sf)
    c = k.where("split = 'train'").groupBy("w").agg(F.count("*").alias("c"))
    s = c.agg(F.sum("c").alias("t"), F.count("*").alias("v"))
    # words of a record are counted before they meet the counts
    held = k.where("split != 'train'").groupBy("doc_id", "era", "bytes", "w").agg(F.count("*").alias("m"))
    p = (F.coalesce("c", F.lit(0)) + 1) / (F.col("t") + F.col("v") + 1)
    return held.join(c, "w", "left").crossJoin(F.broadcast(s)).groupBy("doc_id", "era").agg(F.max("bytes").alias("bytes"), F.sum("m").alias("n"), F.sum(-F.log(p) * F.col("m")).alias("nll"))


@query(f"SELECT count(*) AS docs, sum(n)::BIGINT AS tokens, round(sum(nll) / sum(n), 5) AS ce, round(exp(sum(nll) / sum(n)), 2) AS perplexity, round(sum(nll) / ln(2) / sum(bytes), 5) AS bits_per_byte FROM {_NLL}")
def unigram_ce(spark, sf):
    ce = F.sum("nll") / F.sum("n")
    return document_nll(spark, sf).agg(F.count("*").alias("docs"), F.sum("n").cast("bigint").alias("tokens"), F.round(ce, 5).alias("ce"), F.round(F.exp(ce), 2).alias("perplexity"), F.round(F.sum("nll") / F.log(F.lit(2.0)) / F.sum("bytes"), 5).alias("bits_per_byte"))


@query(f"SELECT era, count(*) AS docs, round(avg(nll / n), 5) AS ce, round(stddev_pop(nll / n) / sqrt(count(*)), 5) AS sem FROM {_NLL} GROUP BY era HAVING count(*) >= 4")
def ce_by_stratum(spark, sf):
    x = F.col("nll") / F.col("n")
    return document_nll(spark, sf).groupBy("era").agg(F.count("*").alias("docs"), F.round(F.avg(x), 5).alias("ce"), F.round(F.stddev_pop(x) / F.sqrt(F.count("*")), 5).alias("sem")).where("docs >= 4")


_BATCH = f"(SELECT row_number() OVER (ORDER BY b) - 1 AS i, count(*) OVER () AS m, x FROM (SELECT doc_id % 64 AS b, sum(nll) / sum(n) AS x FROM {_NLL} GROUP BY 1))"


@query(
    f"""SELECT round(avg(mean), 4) AS mean, round(quantile_cont(mean, 0.025), 4) AS low, round(quantile_cont(mean, 0.975), 4) AS high FROM (SELECT r, avg(x) AS mean FROM
    (SELECT r, j, floor((('0x' || substr(md5('9:' || r || ':' || j), 1, 12))::UBIGINT / 281474976710656.0::DOUBLE) * (SELECT max(m) FROM {_BATCH}))::BIGINT AS i FROM range(500) a(r), range(64) c(j) WHERE j < (SELECT max(m) FROM {_BATCH})) d
    JOIN {_BATCH} USING (i) GROUP BY r)"""
)
def bootstrap_ci(spark, sf):
    """Means of 500 resamples of 64 batches at most, and their middle 95 per cent. The batches are few whatever the corpus."""
    b = document_nll(spark, sf).groupBy((F.col("doc_id") % 64).alias("b")).agg((F.sum("nll") / F.sum("n")).alias("x"))
    b = materialize(b.withColumn("i", F.row_number().over(Window.orderBy("b")) - 1).withColumn("m", F.count("*").over(Window.partitionBy())))
    m = b.agg(F.max("m").alias("m"))
    draws = spark.range(500).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j")).crossJoin(F.broadcast(m)).where("j < m")
    draws = draws.select("r", F.floor(uniform(F.lit("9"), F.col("r").cast("string"), F.col("j").cast("string")) * F.col("m")).alias("i"))
    means = draws.join(F.broadcast(b.select("i", "x")), "i").groupBy("r").agg(F.avg("x").alias("mean"))
    q = lambda p: F.round(F.percentile("mean", F.lit(p)), 4)
    return means.agg(F.round(F.avg("mean"), 4).alias("mean"), q(0.025).alias("low"), q(0.975).alias("high"))


@query(
    """SELECT label, round(avg(l), 6) AS uniform, round(sum(i * l) / sum(i), 6) AS linear, round(max(l) FILTER (i = n), 6) AS final FROM
    (SELECT label, unnest(per_readout_ce) AS l, unnest(range(1, len(per_readout_ce) + 1)) AS i, len(per_readout_ce) AS n FROM (SELECT DISTINCT label, per_readout_ce FROM eval_v2_baseline WHERE label IS NOT NULL)) GROUP BY label"""
)
def loop_loss_weighting(spark, sf):
    d = table(spark, sf, "eval_v2_baseline").where("label is not null").select("label", "per_readout_ce").distinct()
    e = d.select("label", F.size("per_readout_ce").alias("n"), F.posexplode("per_readout_ce").alias("p", "l")).withColumn("i", F.col("p") + 1)
    return e.groupBy("label").agg(F.round(F.avg("l"), 6).alias("uniform"), F.round(F.sum(F.col("i") * F.col("l")) / F.sum("i"), 6).alias("linear"), F.round(F.max(F.when(F.col("i") == F.col("n"), F.col("l"))), 6).alias("final"))


_RUNS = "(SELECT label, min(final_ce) AS ce FROM eval_v2_baseline WHERE label IS NOT NULL AND final_ce IS NOT NULL GROUP BY label)"


@query(f"SELECT a.label AS label_a, b.label AS label_b, round(b.ce - a.ce, 6) AS gap, round(exp(b.ce) / exp(a.ce), 6) AS ppl_ratio FROM {_RUNS} a JOIN {_RUNS} b ON a.label < b.label")
def eval_compare(spark, sf):
    """Every two results of the evaluation table, which is a few rows."""
    r = table(spark, sf, "eval_v2_baseline").where("label is not null and final_ce is not null").groupBy("label").agg(F.min("final_ce").alias("ce"))
    a, b = (r.select(F.col("label").alias(f"label_{x}"), F.col("ce").alias(f"ce_{x}")) for x in "ab")
    j = a.join(F.broadcast(b), F.col("label_a") < F.col("label_b"))
    return j.select("label_a", "label_b", F.round(F.expr("ce_b - ce_a"), 6).alias("gap"), F.round(F.exp("ce_b") / F.exp("ce_a"), 6).alias("ppl_ratio"))


_HIST = f"SELECT w, count(*) AS n FROM {_WORDS} WHERE split = 'train' GROUP BY w"


@query(_HIST)
def token_histogram(spark, sf):
    return _words(spark, sf).where("split = 'train'").groupBy("w").agg(F.count("*").alias("n"))


_TRAIN = "(SELECT doc_id, max(coalesce(weight, 0)) AS weight, max(coalesce(tokens, 0)) AS tokens FROM corpus_ledger WHERE split = 'train' AND NOT isnan(coalesce(weight, 0)) GROUP BY doc_id)"
_CDF = f"(SELECT doc_id, sum(weight * tokens) OVER (ORDER BY doc_id) / sum(weight * tokens) OVER () AS cdf FROM {_TRAIN})"


def train_records(spark, sf):
    """(doc_id, weight, tokens) of every training record once."""
    d = table(spark, sf, "corpus_ledger").where("split = 'train' and not isnan(coalesce(weight, 0))")
    return d.groupBy("doc_id").agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.max(F.coalesce("tokens", F.lit(0))).alias("tokens"))


def train_cdf(spark, sf):
    return sampling.sampling_cdf(train_records(spark, sf), "doc_id")


@query(f"SELECT doc_id, round(cdf, 6) AS cdf FROM {_CDF}")
def sampling_cdf(spark, sf):
    return train_cdf(spark, sf).select("doc_id", F.round("cdf", 6).alias("cdf"))


@query(f"SELECT draw, doc_id FROM (SELECT range AS draw, ('0x' || substr(md5('5:' || range), 1, 12))::UBIGINT / 281474976710656.0::DOUBLE AS u FROM range(2000)) d ASOF JOIN (SELECT k.doc_id, k.cdf FROM {_CDF} k JOIN {_TRAIN} t ON t.doc_id = k.doc_id WHERE t.weight * t.tokens > 0) c ON d.u <= c.cdf")
def sampled_documents(spark, sf):
    draws = spark.range(2000).select(F.col("id").alias("draw"), uniform(F.lit("5"), F.col("id").cast("string")).alias("u"))
    return sampling.first_at_or_above(draws, train_cdf(spark, sf).where("weight * tokens > 0").select(F.col("doc_id").alias("key"), F.col("cdf").alias("value"))).select("draw", F.col("key").alias("doc_id"))


@query(
    """SELECT split, i, floor(('0x' || substr(md5('3:' || split || ':' || i), 1, 12))::UBIGINT / 281474976710656.0::DOUBLE * (n - 512))::BIGINT AS start
    FROM (SELECT split, sum(tokens) AS n FROM (SELECT DISTINCT doc_id, split, tokens FROM corpus_ledger WHERE split IS NOT NULL AND tokens IS NOT NULL) GROUP BY split), (SELECT range AS i FROM range(200)) WHERE n > 513"""
)
def eval_windows(spark, sf):
    """Two hundred places of windows of 512 tokens in each split, the same in every run."""
    d = table(spark, sf, "corpus_ledger").where("split is not null and tokens is not null").select("doc_id", "split", "tokens").distinct()
    n = d.groupBy("split").agg(F.sum("tokens").alias("n")).where("n > 513")
    w = n.select("split", "n", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("i"))
    return w.select("split", F.col("i").cast("bigint").alias("i"), F.floor(uniform(F.lit("3"), F.col("split"), F.col("i").cast("string")) * (F.col("n") - 512)).cast("bigint").alias("start"))


#: Pairs of neighbouring words that item and document share; on one diagonal in a row they are a longer run.
_ITEM_WORDS = "(SELECT item_id AS probe, regexp_extract_all(text, '[^ \\t\\n]+') AS w FROM heldout_items WHERE text IS NOT NULL)"
_LONGEST = f"""(WITH a AS (SELECT probe, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x, unnest(list_append(w[2:], NULL)) AS y FROM {_ITEM_WORDS}),
    d AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x, unnest(list_append(w[2:], NULL)) AS y FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n]+') AS w FROM documents WHERE text IS NOT NULL)),
    h AS (SELECT DISTINCT probe, doc_id, i, j - i AS g FROM a JOIN d ON a.x = d.x AND a.y = d.y),
    r AS (SELECT probe, count(*) + 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY probe, doc_id, g ORDER BY i) AS s FROM h) GROUP BY probe, doc_id, g, s),
    one AS (SELECT DISTINCT probe FROM a SEMI JOIN (SELECT DISTINCT x FROM d) k ON k.x = a.x)
    SELECT q.probe, greatest(coalesce(max(r.n), 0), max(CASE WHEN one.probe IS NULL THEN 0 ELSE 1 END))::BIGINT AS words FROM {_ITEM_WORDS} q LEFT JOIN r ON r.probe = q.probe LEFT JOIN one ON one.probe = q.probe GROUP BY q.probe)"""


@query(f"SELECT count(*) AS items, max(words) AS longest, median(words)::DOUBLE AS middle FROM {_LONGEST}")
def contamination_summary(spark, sf):
    """The longest of the items' longest runs and the middle one."""
    return contamination_longest_match(spark, sf).agg(F.count("*").alias("items"), F.max("words").alias("longest"), F.median("words").cast("double").alias("middle"))


@query("SELECT label, p AS readout, round(avg(l), 6) AS ce FROM (SELECT label, unnest(per_readout_ce) AS l, unnest(range(len(per_readout_ce))) AS p FROM (SELECT DISTINCT label, final_ce, per_readout_ce FROM eval_v2_baseline WHERE label IS NOT NULL)) GROUP BY label, p")
def per_readout_mean(spark, sf):
    """The mean of each readout over a label's results."""
    d = table(spark, sf, "eval_v2_baseline").where("label is not null").select("label", "final_ce", "per_readout_ce").distinct()
    return d.select("label", F.posexplode("per_readout_ce").alias("readout", "l")).groupBy("label", F.col("readout").cast("bigint").alias("readout")).agg(F.round(F.avg("l"), 6).alias("ce"))


@query(f"SELECT probe, words FROM {_LONGEST}")
def contamination_longest_match(spark, sf):
    """Longest run of words of each held-out item in any document."""
    split = lambda c: F.filter(F.split(c, r"[ \t\n]+"), lambda x: x != "").alias("words")
    probes = table(spark, sf, "heldout_items").where("text is not null").select(F.col("item_id").alias("probe"), split("text"))
    docs = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), split("text"))
    return sampling.longest_runs(probes, docs)
