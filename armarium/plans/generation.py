"""Logit filters on rows of embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logits as L
from ..runtime import table
from .cleaning import trimmed_sql
from .registry import query

_TRIMMED = trimmed_sql("text")


def _rows(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("token_id", "logit"))
    return e.select("row_id", F.col("token_id").cast("bigint").alias("token_id"), (F.col("logit").cast("double") * 8).alias("logit"))


_ROWS = "(SELECT vec_id AS row_id, unnest(range(len(embedding)))::BIGINT AS token_id, unnest(embedding)::DOUBLE * 8 AS logit FROM embeddings)"
_P = "(SELECT row_id, token_id, logit, exp(logit) / sum(exp(logit)) OVER (PARTITION BY row_id) AS p FROM {})"
_TOP = f"(SELECT row_id, token_id, logit FROM (SELECT *, rank() OVER (PARTITION BY row_id ORDER BY logit DESC) AS r FROM {_ROWS}) WHERE r <= 20)"


@query("SELECT row_id, token_id, round(p, 6) AS p FROM " + _P.format(f"(SELECT row_id, token_id, 2 * tanh(logit / 2) AS logit FROM {_ROWS})"))
def softmax_softcap(spark, sf):
    return L.softmax(_rows(spark, sf), cap=2.0).select("row_id", "token_id", F.round("p", 6).alias("p"))


@query(f"SELECT row_id, token_id, round(logit, 6) AS logit FROM {_TOP}")
def top_k(spark, sf):
    return L.top_k(_rows(spark, sf), 20).select("row_id", "token_id", F.round("logit", 6).alias("logit"))


@query(f"SELECT row_id, count(*) AS kept FROM (SELECT *, max(p) OVER (PARTITION BY row_id) AS m FROM {_P.format(_TOP)}) WHERE p >= 0.3 * m GROUP BY row_id")
def min_p(spark, sf):
    return L.min_p(L.softmax(L.top_k(_rows(spark, sf), 20)), 0.3).groupBy("row_id").agg(F.count("*").alias("kept"))


@query(
    f"SELECT row_id, count(*) AS kept FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY row_id ORDER BY p DESC, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {_P.format(_TOP)}) WHERE b <= 0.8 GROUP BY row_id"
)
def top_p(spark, sf):
    return L.top_p(L.softmax(L.top_k(_rows(spark, sf), 20)), 0.8).groupBy("row_id").agg(F.count("*").alias("kept"))


@query(f"SELECT row_id, token_id, round(CASE WHEN token_id % 3 <> row_id % 3 THEN logit WHEN logit > 0 THEN logit / 1.2::DOUBLE ELSE logit * 1.2::DOUBLE END, 6) AS logit FROM {_ROWS}")
def repetition_penalty(spark, sf):
    rows = _rows(spark, sf)
    return L.repetition_penalty(rows, rows.where("token_id % 3 = row_id % 3"), 1.2).select("row_id", "token_id", F.round("logit", 6).alias("logit"))


@query("SELECT row_id, token_id, round(p, 6) AS p FROM " + _P.format(f"(SELECT row_id, token_id, logit / 0.8::DOUBLE AS logit FROM {_ROWS})"))
def temperature(spark, sf):
    return L.softmax(_rows(spark, sf), temperature=0.8).select("row_id", "token_id", F.round("p", 6).alias("p"))


@query(
    f"SELECT row_id, token_id, round(CASE WHEN NOT list_contains(h, token_id) THEN logit WHEN logit > 0 THEN logit / 1.3::DOUBLE ELSE logit * 1.3::DOUBLE END, 6) AS logit FROM "
    f"(SELECT *, list_transform(range(36, 100), lambda k: (row_id * 7 + k * k) % len) AS h FROM (SELECT r.*, (SELECT max(len(embedding)) FROM embeddings) AS len FROM {_ROWS} r))"
)
def repetition_window(spark, sf):
    """Of a history of a hundred tokens only the last 64 count."""
    rows = _rows(spark, sf)
    n = table(spark, sf, "embeddings").agg(F.max(F.size("embedding")).alias("n"))
    history = rows.select("row_id").distinct().crossJoin(F.broadcast(n)).select("row_id", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: ((F.col("row_id") * 7 + k * k) % F.col("n")).cast("int")).alias("history"))
    return L.penalized(rows, history, 1.3).select("row_id", "token_id", F.round("logit", 6).alias("logit"))


@query(
    "SELECT row_id, array_to_string(CASE WHEN p IS NULL OR p = 0 THEN s ELSE list_transform(range(1, 21), lambda i: CASE WHEN i <= p THEN s[i] ELSE 0 END) END, ',') AS ids FROM "
    "(SELECT *, list_position(s, 0) AS p FROM (SELECT vec_id AS row_id, list_transform(range(20), lambda k: (vec_id * 3 + k * k + k) % 11) AS s FROM embeddings))"
)
def end_stop(spark, sf):
    """Sequences of twenty tokens, all ends from the first end on."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: ((F.col("vec_id") * 3 + k * k + k) % 11).cast("int"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.array_join(L.stopped(ids, 0).cast("array<string>"), ",").alias("ids"))


@query(
    "SELECT c, length(t) AS kept, sha1(t) AS h FROM (SELECT c, list_reduce(list_prepend('', list(x ORDER BY doc_id)), lambda a, b: CASE WHEN starts_with(b, chr(1)) THEN a || CASE WHEN a = '' OR ends_with(a, ' ') THEN '' ELSE ' ' END || substr(b, 2) "
    "ELSE a || b END) AS t FROM (SELECT doc_id, doc_id // 6 AS c, CASE WHEN doc_id % 2 = 1 THEN chr(1) || text ELSE o END AS x FROM " + _TRIMMED + " WHERE doc_id % 2 = 1 OR trim(replace(replace(o, chr(10), ' '), chr(9), ' '), ' ') <> '') GROUP BY c)"
)
def transcript_context(spark, sf):
    """Six documents a dialogue, generated and added in turn: the text that the next generation would see."""
    from ..functions.text import trim_to_whitespace

    d = table(spark, sf, "documents").where("text is not null").select(F.floor(F.col("doc_id") / 6).alias("c"), F.struct("doc_id", (F.col("doc_id") % 2 == 0).alias("generated"), "text").alias("turn"))
    turns = F.transform(F.array_sort(F.collect_list("turn")), lambda x: F.struct(x["generated"].alias("generated"), x["text"].alias("text"), trim_to_whitespace(x["text"]).alias("cut")))
    said = d.groupBy("c").agg(turns.alias("turns")).select("c", L.transcript(F.col("turns"), None).alias("t"))
    return said.select("c", F.length("t").cast("bigint").alias("kept"), F.sha1(F.col("t").cast("binary")).alias("h"))


@query(f"SELECT row_id, min(token_id) AS token_id FROM (SELECT *, sum(p) OVER (PARTITION BY row_id ORDER BY token_id) AS c, ('0x' || substr(md5('7:' || row_id), 1, 12))::UBIGINT / 281474976710656.0::DOUBLE AS u FROM {_P.format(_ROWS)}) WHERE c >= u GROUP BY row_id")
def multinomial(spark, sf):
    from pyspark.sql import Window

    from ..operators.corpus import uniform

    p = L.softmax(_rows(spark, sf)).withColumn("c", F.sum("p").over(Window.partitionBy("row_id").orderBy("token_id")))
    return p.where(F.col("c") >= uniform(F.lit("7"), F.col("row_id").cast("string"))).groupBy("row_id").agg(F.min("token_id").alias("token_id"))
