"""Tiers, weights and mixture reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.weights import resolve_profile, weight
from ..operators import corpus
from ..runtime import table
from .classification import _CANON
from .registry import query

_TIERS = "(SELECT replace(original, chr(92), '/') AS original, max(tier) AS tier FROM tier_manifest WHERE original IS NOT NULL AND tier IS NOT NULL GROUP BY 1)"
_BASE = f"(SELECT doc_id, era, genre, w, q, nl, t, coalesce(m.tier, 1) AS tier FROM (SELECT DISTINCT doc_id, path, era, genre, coalesce(work_id, '') AS w, coalesce(ocr_quality, 1) AS q, coalesce(non_latin_per_1k, 0) AS nl, coalesce(tokens, 0) AS t FROM corpus_ledger) l LEFT JOIN {_TIERS} m ON m.original = l.path)"


def tiers(spark, sf):
    """One tier a path: the highest, whatever the separators of the path."""
    m = table(spark, sf, "tier_manifest").where("original is not null and tier is not null")
    return m.groupBy(F.replace("original", F.lit("\\"), F.lit("/")).alias("path")).agg(F.max("tier").alias("m_tier"))


def records(spark, sf):
    docs = table(spark, sf, "corpus_ledger").select(
        "doc_id", "path", "era", "genre", F.coalesce("work_id", F.lit("")).alias("w"), F.coalesce("ocr_quality", F.lit(1.0)).alias("q"), F.coalesce("non_latin_per_1k", F.lit(0.0)).alias("nl"), F.coalesce("tokens", F.lit(0)).alias("t")
    ).distinct()
    return docs.join(tiers(spark, sf), "path", "left").withColumn("tier", F.coalesce("m_tier", F.lit(1)))


def _sql_weight(p: dict) -> str:
    def factor(c, table):
        return "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in table.items()) + " ELSE 1.0 END" if table else "1.0"

    parts = ["tier::DOUBLE" if p["use_tier"] else "1.0::DOUBLE", factor("era", p["era"]) + "::DOUBLE", factor("genre", p["genre"]) + "::DOUBLE"]
    if p["canon"] != 1:
        parts.append(f"(CASE WHEN regexp_matches(lower(w), '{_CANON}') THEN {p['canon']} ELSE 1.0 END)::DOUBLE")
    if p["quality"]:
        parts.append("(CASE WHEN q < 1 THEN greatest(0.1::DOUBLE, least(1.0::DOUBLE, (q - 0.7::DOUBLE) / 0.3::DOUBLE)) ELSE 1.0 END)::DOUBLE")
    w = " * ".join(f"({x})" for x in parts)
    if p.get("max_weight"):
        w = f"least({w}, {p['max_weight']}::DOUBLE)"
    return f"CASE WHEN nl > 40 THEN 0.0 ELSE round({w}, 4) END::DOUBLE"


def _weighted(spark, sf, profile):
    w = weight(resolve_profile(profile), F.col("tier"), F.col("era"), F.col("genre"), F.col("w"), F.col("q"), F.col("nl"))
    return records(spark, sf).withColumn("weight", w)


for _name in fixed.PROFILES:

    def _run(spark, sf, profile=_name):
        return _weighted(spark, sf, profile).select("doc_id", "weight")

    _run.__name__ = f"weights_{_name}"
    query(f"SELECT doc_id, {_sql_weight(resolve_profile(_name))} AS weight FROM {_BASE}")(_run)


@query(f"SELECT tier, count(*) AS docs FROM {_BASE} GROUP BY tier")
def tier_counts(spark, sf):
    return records(spark, sf).groupBy("tier").agg(F.count("*").alias("docs"))


_W = f"(SELECT era, genre, {_sql_weight(resolve_profile('canonical'))} AS weight, t FROM {_BASE})"
_REPORT = f"""(SELECT field, value, round(m / sum(m) OVER (PARTITION BY field), 6) AS sampled, round(t / sum(t) OVER (PARTITION BY field), 6) AS raw,
    round((m / sum(m) OVER (PARTITION BY field)) / (t / sum(t) OVER (PARTITION BY field)), 4) AS emphasis, round(1e8 * (m / sum(m) OVER (PARTITION BY field)) / t, 3) AS epochs, 1e8 * (m / sum(m) OVER (PARTITION BY field)) / t > 40 AS high
    FROM (SELECT field, value, sum(weight * t) AS m, sum(t)::DOUBLE AS t FROM {_W} UNPIVOT (value FOR field IN (era, genre)) GROUP BY field, value))"""


@query(f"SELECT field, value, round(sampled, 4) AS sampled, round(raw, 4) AS raw, round(emphasis, 3) AS emphasis, round(epochs, 1) AS epochs, high FROM {_REPORT}")
def mixture_report(spark, sf):
    df = _weighted(spark, sf, "canonical").select("era", "genre", "weight", F.col("t").alias("tokens"))
    r = corpus.mixture_report(df, 1e8)
    return r.select("field", "value", F.round("sampled", 4).alias("sampled"), F.round("raw", 4).alias("raw"), F.round("emphasis", 3).alias("emphasis"), F.round("epochs", 1).alias("epochs"), "high")


@query(f"SELECT tier, count(*) AS docs FROM {_BASE.replace('coalesce(tokens, 0) AS t FROM corpus_ledger', "coalesce(tokens, 0) AS t FROM corpus_ledger WHERE split = 'train'")} GROUP BY tier")
def train_tier_counts(spark, sf):
    train = table(spark, sf, "corpus_ledger").where("split = 'train'").select("doc_id").distinct()
    return records(spark, sf).join(train, "doc_id", "left_semi").groupBy("tier").agg(F.count("*").alias("docs"))


@query(f"SELECT field || '=' || value AS worst, round(epochs, 1) AS epochs, epochs > 40 AS warn FROM {_REPORT} ORDER BY epochs DESC, field, value LIMIT 1")
def mixture_warning(spark, sf):
    """The stratum that a training run would see most often, and whether that is too often; eras come before genres."""
    r = corpus.mixture_report(_weighted(spark, sf, "canonical").select("era", "genre", "weight", F.col("t").alias("tokens")), 1e8)
    top = r.orderBy(F.desc("epochs"), "field", "value").limit(1)
    return top.select(F.concat_ws("=", "field", "value").alias("worst"), F.round("epochs", 1).alias("epochs"), (F.col("epochs") > 40).alias("warn"))


@query(f"SELECT doc_id, CASE WHEN q < 0.97::DOUBLE THEN 0.0 ELSE {_sql_weight(resolve_profile('balanced'))} END AS weight FROM {_BASE}")
def weights_min_quality(spark, sf):
    w = weight(resolve_profile("balanced"), F.col("tier"), F.col("era"), F.col("genre"), F.col("w"), F.col("q"), F.col("nl"), min_quality=0.97)
    return records(spark, sf).select("doc_id", w.alias("weight"))


@query(f"SELECT round(sum(weight * t) / sum(t), 6) AS expansion, count(*) FILTER (weight = 0) AS excluded, sum(t)::BIGINT AS tokens FROM {_W}")
def mixture_expansion(spark, sf):
    d = _weighted(spark, sf, "canonical")
    return d.agg(F.round(F.sum(F.col("weight") * F.col("t")) / F.sum("t"), 6).alias("expansion"), F.count_if(F.col("weight") == 0).alias("excluded"), F.sum("t").cast("bigint").alias("tokens"))


@query(f"SELECT sum(tier * t)::BIGINT AS weighted_tokens, sum(tier)::BIGINT AS copies FROM {_BASE}")
def legacy_physical_weighting(spark, sf):
    """Every record as often as its tier says."""
    copies = records(spark, sf).select("t", F.explode(F.sequence(F.lit(1), F.col("tier"))).alias("copy"))
    return copies.agg(F.sum("t").cast("bigint").alias("weighted_tokens"), F.count("*").cast("bigint").alias("copies"))


@query(
    """SELECT doc_id, greatest(0, least(n, cut - b))::BIGINT AS train_chars FROM (SELECT doc_id, n, coalesce(sum(n + 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
    floor((sum(n + 2) OVER () - 2) * 0.9) AS cut FROM (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL))"""
)
def legacy_char_split(spark, sf):
    """The texts end to end, two line feeds between, the first nine tenths of the characters for training."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.length("text").alias("n")).withColumn("m", F.col("n") + 2)
    total = d.agg(F.sum("m").alias("s"))
    cut = F.floor((F.col("s") - 2) * 0.9)
    return corpus.running_sum(d, ["doc_id"], "m", "b").crossJoin(F.broadcast(total)).select("doc_id", F.greatest(F.lit(0), F.least("n", cut - F.col("b"))).cast("bigint").alias("train_chars"))
