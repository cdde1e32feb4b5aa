"""Token ids of ledger records: encoding, streams, windows, count models over tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pieces, sampling
from ..operators.corpus import uniform
from ..runtime import materialize, table
from .registry import query
from .scoring import _TRAIN, train_records

#: Tokens of a window, windows of a batch, batches of a split, resamples, and windows of a stratum.
BLOCK, BATCH, BATCHES, RESAMPLES, STRATUM = 64, 4, 40, 2000, 32


def _u(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 12))::UBIGINT / 281474976710656.0::DOUBLE"


#: Every record's ids by greedy pieces: distinct words are cut by recursion, records put together from them.
_IDS = r"""WITH RECURSIVE docs AS MATERIALIZED (SELECT DISTINCT doc_id, split, era, work_group, coalesce(bytes, chars) AS bytes, _text FROM corpus_ledger WHERE _text IS NOT NULL AND split IS NOT NULL),
    pc AS MATERIALIZED (SELECT piece, max(token_id) AS id FROM tokenizer_latin WHERE piece IS NOT NULL AND token_id IS NOT NULL GROUP BY piece),
    p AS MATERIALIZED (SELECT * FROM pc WHERE piece NOT IN ('', '<unk>', '<eos>')), unk AS (SELECT id FROM pc WHERE piece = '<unk>'), eos AS (SELECT id FROM pc WHERE piece = '<eos>'),
    k AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM (SELECT doc_id, regexp_extract_all(_text, '[^ \t\n]+') AS ws FROM docs)),
    v AS MATERIALIZED (SELECT DISTINCT w FROM k),
    si AS MATERIALIZED (SELECT w, unnest(range(1, length(w) + 2)) AS i FROM v), sl AS MATERIALIZED (SELECT w, i, unnest(range(1, length(w) + 3 - i)) AS l FROM si),
    sub AS MATERIALIZED (SELECT w, i, l, substr('▁' || w, i, l) AS piece FROM sl WHERE l <= (SELECT max(length(piece)) FROM p)),
    m AS MATERIALIZED (SELECT w, i, max(l) AS l, arg_max(id, l) AS id, arg_max(piece, l) AS piece FROM sub JOIN p USING (piece) GROUP BY w, i),
    n AS MATERIALIZED (SELECT w, i, coalesce(l, 1) AS l, coalesce(m.id, (SELECT id FROM unk)) AS id, coalesce(piece, '<unk>') AS piece FROM si LEFT JOIN m USING (w, i)),
    r(w, i, ids, txt) AS (SELECT w, 1::BIGINT, []::INT[], '' FROM v UNION ALL SELECT r.w, r.i + n.l, list_append(r.ids, n.id), r.txt || n.piece FROM r JOIN n ON n.w = r.w AND n.i = r.i),
    cut AS MATERIALIZED (SELECT w, ids, txt FROM r WHERE i > length(w) + 1),
    own AS (SELECT doc_id, flatten(list(ids ORDER BY k)) AS ids, string_agg(txt, '' ORDER BY k) AS txt FROM k JOIN cut USING (w) GROUP BY doc_id),
    enc AS MATERIALIZED (SELECT d.doc_id, split, era, work_group, bytes, list_append(coalesce(own.ids, []::INT[]), (SELECT id FROM eos)) AS ids, trim(replace(coalesce(own.txt, ''), '▁', ' '), ' ') AS txt FROM docs d LEFT JOIN own ON own.doc_id = d.doc_id),
    st AS MATERIALIZED (SELECT *, len(ids) AS tokens, coalesce(sum(len(ids)) OVER (PARTITION BY split ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM enc),
    tok AS MATERIALIZED (SELECT split, b + unnest(range(len(ids))) AS pos, unnest(ids) AS id FROM st),
    total AS (SELECT split, sum(tokens)::BIGINT AS n FROM st GROUP BY split) """


def records(spark, sf):
    """Every record with text and split, once."""
    d = table(spark, sf, "corpus_ledger").where("_text is not null and split is not null")
    return d.select("doc_id", "split", "era", "work_group", F.coalesce("bytes", "chars").alias("bytes"), "_text").distinct()


def encoded(spark, sf):
    return pieces.encode(records(spark, sf), table(spark, sf, "tokenizer_latin"))


def streams(spark, sf):
    return pieces.stream(encoded(spark, sf), records(spark, sf).select("doc_id", "split"))


@query(_IDS + "SELECT doc_id, len(ids) AS tokens, sha1(array_to_string(ids, ',')) AS h FROM enc")
def token_ids(spark, sf):
    return encoded(spark, sf).select(F.col("key").alias("doc_id"), F.size("ids").cast("bigint").alias("tokens"), F.sha1(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")).alias("h"))


@query(_IDS + "SELECT doc_id, sha1(txt) AS h FROM enc")
def token_round_trip(spark, sf):
    back = pieces.decode(encoded(spark, sf), table(spark, sf, "tokenizer_latin"))
    return back.select(F.col("key").alias("doc_id"), F.sha1(F.col("text").cast("binary")).alias("h"))


@query(_IDS + "SELECT split, count(*) AS docs, sum(len(list_filter(ids, lambda x: x = e)))::BIGINT AS ends FROM (SELECT split, ids, eos.id AS e FROM enc, eos) GROUP BY split")
def eos_invariant(spark, sf):
    """Each split has as many ends as records."""
    eos = table(spark, sf, "tokenizer_latin").where("piece = '<eos>'").agg(F.max("token_id").alias("eos"))
    d = encoded(spark, sf).join(records(spark, sf).select(F.col("doc_id").alias("key"), "split"), "key").crossJoin(F.broadcast(eos))
    return d.groupBy("split").agg(F.count("*").alias("docs"), F.sum(F.size(F.filter("ids", lambda x: x == F.col("eos")))).cast("bigint").alias("ends"))


@query(_IDS + "SELECT split, count(*) AS docs, count(DISTINCT work_group) AS groups, sum(bytes)::BIGINT AS bytes, sum(len(ids))::BIGINT AS tokens, round(sum(bytes) / sum(len(ids)), 5) AS bytes_per_token FROM enc GROUP BY ROLLUP (split)")
def split_token_stats(spark, sf):
    d = records(spark, sf).drop("_text").join(encoded(spark, sf).select(F.col("key").alias("doc_id"), F.size("ids").alias("n")), "doc_id")
    return d.rollup("split").agg(
        F.count("*").alias("docs"), F.count_distinct("work_group").alias("groups"), F.sum("bytes").cast("bigint").alias("bytes"), F.sum("n").cast("bigint").alias("tokens"), F.round(F.sum("bytes") / F.sum("n"), 5).alias("bytes_per_token")
    )


@query(_IDS + "SELECT id, count(*) AS n FROM tok WHERE split = 'train' GROUP BY id")
def token_id_histogram(spark, sf):
    train = encoded(spark, sf).join(records(spark, sf).where("split = 'train'").select(F.col("doc_id").alias("key")), "key")
    return train.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def _eval_places(tokens, per_split: int, seed: str):
    """Places of windows in each split, the same in every run: as many as batches need."""
    n = tokens.groupBy("split").agg(F.sum("tokens").alias("n")).where(F.col("n") > BLOCK + 1)
    w = n.select("split", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(per_split - 1).cast("bigint"))).alias("i"))
    return w.select("split", "i", F.floor(uniform(F.lit(seed), F.col("split"), F.col("i").cast("string")) * (F.col("n") - BLOCK - 1)).cast("bigint").alias("start"))


_PLACES = f"places AS (SELECT split, i, floor({_u("'11'", 'split', 'i')} * (n - {BLOCK + 1}))::BIGINT AS start FROM total, (SELECT range AS i FROM range({BATCH * BATCHES})) WHERE n > {BLOCK + 1})"
_SEQ = f"seq AS (SELECT p.split, p.i, p.start, list(t.id ORDER BY t.pos) AS ids FROM places p JOIN tok t ON t.split = p.split AND t.pos BETWEEN p.start AND p.start + {BLOCK} GROUP BY ALL)"


@query(_IDS + f", {_PLACES}, {_SEQ} SELECT split, i, start, sha1(array_to_string(ids[1:{BLOCK}], ',')) AS x, sha1(array_to_string(ids[2:{BLOCK + 1}], ',')) AS y FROM seq")
def window_tokens(spark, sf):
    """Inputs and targets of the frozen windows of each split."""
    tokens = streams(spark, sf)
    w = pieces.windows(tokens, _eval_places(tokens, BATCH * BATCHES, "11"), BLOCK)
    x, y = pieces.shifted(F.col("ids"))
    text = lambda c: F.sha1(F.array_join(c.cast("array<string>"), ",").cast("binary"))
    return w.select("split", "i", "start", text(x).alias("x"), text(y).alias("y"))


def _sampled(spark, sf, weighted: bool):
    """Windows that start anywhere in a record drawn by weight x tokens (or by tokens alone), moved back from the end of the stream."""
    d = train_records(spark, sf)
    if not weighted:
        d = d.withColumn("weight", F.lit(1.0))
    d = sampling.sampling_cdf(d, "doc_id")
    placed = sampling.running_sum(d.select("doc_id", "tokens", "cdf", "weight"), ["doc_id"], "tokens", "b")
    points = placed.where("weight * tokens > 0").select(F.struct("doc_id", "tokens", "b").alias("key"), F.col("cdf").alias("value"))
    draws = spark.range(2000).select(F.col("id").alias("draw"), uniform(F.lit("13"), F.col("id").cast("string")).alias("u"))
    hit = sampling.first_at_or_above(draws, points)
    total = d.agg(F.sum("tokens").alias("n"))
    inside = F.floor(uniform(F.lit("17"), F.col("draw").cast("string")) * F.col("key.tokens"))
    start = F.greatest(F.lit(0), F.least(F.col("key.b") + inside, F.col("n") - BLOCK - 1))
    return hit.crossJoin(F.broadcast(total)).select("draw", F.col("key.doc_id").alias("doc_id"), start.cast("bigint").alias("start"))


def _sql_sampled(weight: str) -> str:
    return f"""WITH t AS (SELECT doc_id, {weight} AS weight, tokens FROM {_TRAIN}), c AS (SELECT doc_id, weight, tokens, sum(weight * tokens) OVER (ORDER BY doc_id) / sum(weight * tokens) OVER () AS cdf,
    coalesce(sum(tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(tokens) OVER () AS n FROM t)
    SELECT draw, doc_id, greatest(0, least(b + floor({_u("'17'", 'draw')} * tokens), n - {BLOCK + 1}))::BIGINT AS start FROM (SELECT range AS draw, {_u("'13'", 'range')} AS u FROM range(2000)) d ASOF JOIN (SELECT * FROM c WHERE weight * tokens > 0) c ON d.u <= c.cdf"""


@query(_sql_sampled("weight"))
def sampled_windows(spark, sf):
    return _sampled(spark, sf, True)


@query(_sql_sampled("1.0::DOUBLE"))
def sampled_windows_uniform(spark, sf):
    return _sampled(spark, sf, False)


#: Log-probabilities of pairs (a, b): by single tokens of the training records, and mixed with those of pairs.
_MODEL = """one AS (SELECT id, count(*) AS n FROM tok WHERE split = 'train' GROUP BY id), s AS (SELECT sum(n) AS t, count(*) AS v FROM one),
    two AS (SELECT a, b, count(*) AS n FROM (SELECT unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b FROM enc WHERE split = 'train' AND len(ids) > 1) GROUP BY a, b), after AS (SELECT a, sum(n) AS n FROM two GROUP BY a)"""
_P1 = "((coalesce(one.n, 0) + 1) / (s.t + s.v + 1)::DOUBLE)"
_NLL = f"-ln({_P1}) AS nll1, -ln(CASE WHEN after.n > 0 THEN 0.5::DOUBLE * coalesce(two.n, 0) / after.n + 0.5::DOUBLE * {_P1} ELSE {_P1} END) AS nll2"
_JOINS = "LEFT JOIN one ON one.id = q.b CROSS JOIN s LEFT JOIN two ON two.a = q.a AND two.b = q.b LEFT JOIN after ON after.a = q.a"


def models(train):
    return pieces.CountModel(train, 1), pieces.CountModel(train, 2)


@query(
    _IDS
    + f", {_MODEL}, q AS (SELECT doc_id, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b FROM enc WHERE split <> 'train' AND len(ids) > 1) "
    + f"SELECT count(*) AS tokens, round(avg(nll2), 5) AS ce, round(exp(avg(nll2)), 2) AS perplexity, round(sum(nll2) / ln(2) / (SELECT sum(bytes) FROM enc WHERE split <> 'train' AND len(ids) > 1), 5) AS bits_per_byte FROM (SELECT {_NLL} FROM q {_JOINS})"
)
def bigram_ce(spark, sf):
    """Held-out records under mixed counts of tokens and of pairs of tokens."""
    e = materialize(encoded(spark, sf).join(records(spark, sf).select(F.col("doc_id").alias("key"), "split", "bytes"), "key"))
    held = e.where("split != 'train' and size(ids) > 1")
    _, model = models(e.where("split = 'train'"))
    scored = model.nll(pieces.pairs(held, "key")).agg(F.count("*").alias("tokens"), F.avg("nll").alias("ce"), F.sum("nll").alias("s"))
    total = held.agg(F.sum("bytes").alias("bytes"))
    return scored.crossJoin(F.broadcast(total)).select("tokens", F.round("ce", 5).alias("ce"), F.round(F.exp("ce"), 2).alias("perplexity"), F.round(F.col("s") / F.log(F.lit(2.0)) / F.col("bytes"), 5).alias("bits_per_byte"))


_BATCHED = (
    f"q AS (SELECT split, i, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b FROM seq), w AS (SELECT split, i, count(*) AS n, sum(nll1) AS s1, sum(nll2) AS s2 FROM (SELECT q.split, q.i, {_NLL} FROM q {_JOINS}) GROUP BY split, i), "
    f"bt AS (SELECT split, r // {BATCH} AS batch, sum(s1) / sum(n) AS ce1, sum(s2) / sum(n) AS ce2 FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY split) // {BATCH} * {BATCH} AS m FROM w) WHERE r < m GROUP BY ALL)"
)
_BOOT = (
    f"nb AS (SELECT split, count(*) AS m FROM bt GROUP BY split), dr AS (SELECT split, a.range AS r, floor({_u("'19'", 'a.range', 'c.range')} * m)::BIGINT AS batch FROM nb, range({RESAMPLES}) a, range({BATCHES}) c WHERE c.range < m), "
    "means AS (SELECT split, r, avg(ce2) AS mean FROM dr JOIN bt USING (split, batch) GROUP BY ALL)"
)


@query(
    _IDS
    + f", {_PLACES}, {_SEQ}, {_MODEL}, {_BATCHED}, {_BOOT} "
    + f"""SELECT split, n_batches, n_batches * {BATCH * BLOCK} AS n_tokens_scored, final_ce, final_ppl, ci_low, ci_high, objective_ce, single_ce, round(raw / ln(2) / bpt, 4) AS bits_per_byte FROM
    (SELECT split, count(*) AS n_batches, avg(ce2) AS raw, round(avg(ce2), 4) AS final_ce, round(exp(avg(ce2)), 2) AS final_ppl, round(avg((ce1 + ce2) / 2), 4) AS objective_ce, round(avg(ce1), 4) AS single_ce FROM bt GROUP BY split)
    JOIN (SELECT split, round(quantile_cont(mean, 0.025), 4) AS ci_low, round(quantile_cont(mean, 0.975), 4) AS ci_high FROM means GROUP BY split) USING (split)
    JOIN (SELECT split, sum(bytes) / sum(len(ids)) AS bpt FROM enc GROUP BY split) USING (split)"""
)
def score_windows(spark, sf):
    """The evaluation's record: batches of frozen windows of each split, two readouts, the last one's mean with its middle 95 per cent of 2,000 resamples of batches."""
    tokens = materialize(streams(spark, sf))
    seqs = materialize(pieces.windows(tokens, _eval_places(tokens, BATCH * BATCHES, "11"), BLOCK))
    single, double = models(tokens.where("split = 'train'"))
    p = pieces.pairs(seqs, "split", "i")
    one, two = (pieces.batches(m.nll(p), ["split"], BATCH) for m in (single, double))
    b = materialize(one.withColumnRenamed("ce", "ce1").join(two.withColumnRenamed("ce", "ce2"), ["split", "batch"]))
    draws = b.groupBy("split").agg(F.count("*").alias("m")).select("split", "m", F.explode(F.sequence(F.lit(0), F.lit(RESAMPLES - 1))).alias("r")).select("split", "m", "r", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)).alias("j"))
    draws = draws.select("split", "r", F.floor(uniform(F.lit("19"), F.col("r").cast("string"), F.col("j").cast("string")) * F.col("m")).alias("batch"))
    # batches are BATCHES a split at most
    means = draws.join(F.broadcast(b.select("split", "batch", "ce2")), ["split", "batch"]).groupBy("split", "r").agg(F.avg("ce2").alias("mean"))
    q = lambda x: F.round(F.percentile("mean", F.lit(x)), 4)
    ci = means.groupBy("split").agg(q(0.025).alias("ci_low"), q(0.975).alias("ci_high"))
    bpt = tokens.join(records(spark, sf).select("doc_id", "bytes"), "doc_id").groupBy("split").agg((F.sum("bytes") / F.sum("tokens")).alias("bpt"))
    mean = b.groupBy("split").agg(
        F.count("*").alias("n_batches"), F.avg("ce2").alias("raw"), F.round(F.avg("ce2"), 4).alias("final_ce"), F.round(F.exp(F.avg("ce2")), 2).alias("final_ppl"),
        F.round(F.avg((F.col("ce1") + F.col("ce2")) / 2), 4).alias("objective_ce"), F.round(F.avg("ce1"), 4).alias("single_ce"),
    )
    return mean.join(ci, "split").join(bpt, "split").select(
        "split", "n_batches", (F.col("n_batches") * BATCH * BLOCK).alias("n_tokens_scored"), "final_ce", "final_ppl", "ci_low", "ci_high", "objective_ce", "single_ce", F.round(F.col("raw") / F.log(F.lit(2.0)) / F.col("bpt"), 4).alias("bits_per_byte")
    )


@query(
    _IDS
    + f""", long AS (SELECT *, row_number() OVER (PARTITION BY era ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY era) AS n_docs FROM st WHERE split = 'val' AND tokens > {BLOCK + 1}),
    dw AS (SELECT era, i, n_docs, floor({_u("'23'", 'era', 'i')} * n_docs)::BIGINT AS r FROM (SELECT DISTINCT era, n_docs FROM long), (SELECT range AS i FROM range({STRATUM}))),
    places AS (SELECT 'val' AS split, dw.era, dw.n_docs, dw.i, long.b + floor({_u("'29'", 'dw.era', 'dw.i')} * greatest(1, tokens - {BLOCK + 1}))::BIGINT AS start FROM dw JOIN long ON long.era = dw.era AND long.r = dw.r),
    seq AS (SELECT p.era AS split, p.n_docs, p.i, list(t.id ORDER BY t.pos) AS ids FROM places p JOIN tok t ON t.split = 'val' AND t.pos BETWEEN p.start AND p.start + {BLOCK} GROUP BY ALL HAVING count(*) = {BLOCK + 1}), """
    + _MODEL
    + ", "
    + _BATCHED
    + "SELECT split AS era, (SELECT max(n_docs) FROM long WHERE long.era = bt.split) AS n_docs, count(*) AS n_batches, round(avg(ce2), 4) AS ce, round(stddev_pop(ce2) / sqrt(count(*)), 4) AS sem FROM bt GROUP BY split"
)
def ce_by_stratum_windows(spark, sf):
    """Windows inside held-out records drawn evenly within each era; eras with fewer windows than a batch are left out."""
    tokens = materialize(streams(spark, sf).join(records(spark, sf).select("doc_id", "era"), "doc_id"))
    long = tokens.where(f"split = 'val' and tokens > {BLOCK + 1} and era is not null").select("era", "doc_id", "tokens", "token_offset").withColumn("one", F.lit(1))
    ranked = sampling.running_sum(long, ["doc_id"], "one", "r", ["era"])
    n = long.groupBy("era").agg(F.count("*").alias("n_docs"))
    draws = n.select("era", "n_docs", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(STRATUM - 1).cast("bigint"))).alias("i"))
    draws = draws.withColumn("r", F.floor(uniform(F.lit("23"), F.col("era"), F.col("i").cast("string")) * F.col("n_docs")))
    inside = F.floor(uniform(F.lit("29"), F.col("era"), F.col("i").cast("string")) * F.greatest(F.lit(1), F.col("tokens") - BLOCK - 1))
    places = draws.join(ranked, ["era", "r"]).select(F.lit("val").alias("split"), F.struct("era", "i").alias("i"), (F.col("token_offset") + inside).cast("bigint").alias("start"))
    seqs = materialize(pieces.windows(tokens, places, BLOCK).select(F.col("i.era").alias("era"), F.col("i.i").alias("i"), "ids"))
    _, model = models(tokens.where("split = 'train'"))
    b = pieces.batches(model.nll(pieces.pairs(seqs, "era", "i")), ["era"], BATCH)
    out = b.groupBy("era").agg(F.count("*").alias("n_batches"), F.round(F.avg("ce"), 4).alias("ce"), F.round(F.stddev_pop("ce") / F.sqrt(F.count("*")), 4).alias("sem"))
    return out.join(n, "era").select("era", "n_docs", "n_batches", "ce", "sem")
