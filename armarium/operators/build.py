"""The whole way from raw texts to a ledger: clean, name, classify, group, split and weigh, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.weights import resolve_profile, weight
from . import corpus


def classified(raw: DataFrame, orthography: str = "none", min_chars: int = 32, max_fragment_score: float = 1.01) -> DataFrame:
    """Records of raw texts (path, name, raw): cleaned, long enough, no fragments, with identity, measures and classes."""
    flags = [c.alias(n) for n, c in T.clean_flags(F.col("raw")).items()]
    cleaned = raw.select("path", "name", *flags, T.orthography(T.clean_text(F.col("raw")), orthography).alias("_text")).where(F.length("_text") >= min_chars)
    t, title, scan = F.col("_text"), F.regexp_replace("name", r"\.txt$", ""), F.col("name").startswith("Pagina_")
    author = T.author_from_title(title)
    return cleaned.select(
        "*", T.work_id(F.col("name")).alias("work_id"), T.author_hint(F.col("name")).alias("author_hint"), scan.alias("is_scan_page"),
        F.length(t).cast("bigint").alias("chars"), F.octet_length(t).cast("bigint").alias("bytes"), F.sha1(t.cast("binary")).alias("content_sha1"),
        F.coalesce(author, F.lit("unknown")).alias("author"), T.era(author, title).alias("era"), T.genre(title).alias("genre"), T.verse_signal(t, scan).alias("form"),
        F.when(scan, "scan_page").otherwise("text").alias("source_type"), T.ocr_quality(t).alias("ocr_quality"), T.non_latin_per_1k(t).alias("non_latin_per_1k"), T.fragment_score(t).alias("fragment_score"),
    ).where(F.col("fragment_score") < max_fragment_score)


def build(raw: DataFrame, tiers: DataFrame, val_fraction: float = 0.1, max_group_share: float = 0.25, seed: int = 1337, profile: str = "manifest", **options) -> DataFrame:
    """The ledger of raw texts; tiers: (original, tier). No group and no equal text is in two splits; only training records have a weight."""
    docs = classified(raw, **options).join(tiers.groupBy(F.col("original").alias("path")).agg(F.max("tier").alias("tier")), "path", "left").withColumn("tier", F.coalesce("tier", F.lit(1)))
    grouped = corpus.work_groups(docs)
    grouped = grouped.join(corpus.merged_groups(grouped), "work_group").drop("work_group").withColumnRenamed("merged", "work_group")
    sizes = grouped.groupBy(F.col("work_group").alias("group")).agg(F.sum("bytes").alias("size"))
    held = corpus.held_out_groups(sizes, val_fraction, max_group_share, seed).select(F.col("group").alias("work_group"), F.lit("val").alias("held"))
    ledger = grouped.join(held, "work_group", "left").withColumn("split", F.coalesce("held", F.lit("train"))).drop("held")
    w = weight(resolve_profile(profile), F.col("tier"), F.col("era"), F.col("genre"), F.col("work_id"), F.col("ocr_quality"), F.col("non_latin_per_1k"))
    return ledger.withColumn("weight", F.when(F.col("split") == "train", w))


def reweighted(ledger: DataFrame, profile: dict) -> DataFrame:
    """The ledger with new weights; texts and tokens aren't touched."""
    w = weight(profile, F.col("tier"), F.col("era"), F.col("genre"), F.col("work_id"), F.col("ocr_quality"), F.col("non_latin_per_1k"))
    return ledger.withColumn("weight", F.when(F.col("split") == "train", w))
