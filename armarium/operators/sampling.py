"""Weighted sampling, as-of look-ups and verbatim overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, salted_join, small
from .corpus import running_sum


def sampling_cdf(df: DataFrame, order: str, weight: str = "weight", tokens: str = "tokens") -> DataFrame:
    """df with cdf: the share of weight x tokens up to and with each row; rows without mass keep the cdf before them."""
    mass = F.coalesce(F.col(weight), F.lit(0.0)) * F.coalesce(F.col(tokens), F.lit(0))
    summed = running_sum(df.withColumn("__mass", mass), [order], "__mass", "__before")
    total = summed.agg(F.sum("__mass").alias("__total"))
    return summed.crossJoin(F.broadcast(total)).withColumn("cdf", (F.col("__before") + F.col("__mass")) / F.col("__total")).drop("__mass", "__before", "__total")


def first_at_or_above(draws: DataFrame, points: DataFrame, partitions: int | None = None) -> DataFrame:
    """(draw, u, key): for each draw the point with the least value >= u; of equal values the least key.

    draws: (draw, u), points: (key, value). Both are range-partitioned together by value; a draw
    behind the last point of its partition takes the first point of the next that has any.
    """
    partitions = partitions or int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = points.select(F.col("value").alias("v"), F.lit(1).alias("side"), F.struct("value", "key").alias("p"), F.lit(None).cast("bigint").alias("draw")).unionByName(
        draws.select(F.col("u").alias("v"), F.lit(0).alias("side"), F.lit(None).cast(points.select(F.struct("value", "key").alias("p")).schema["p"].dataType).alias("p"), F.col("draw").cast("bigint").alias("draw"))
    )
    ranged = materialize(both.repartitionByRange(partitions, "v", "side").withColumn("part", F.spark_partition_id()))
    firsts = ranged.where("p is not null").groupBy("part").agg(F.min("p").alias("p"))
    after = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    parts = ranged.select("part").distinct().join(firsts, "part", "left").withColumn("next", F.min("p").over(after)).select("part", "next")
    inside = Window.partitionBy("part").orderBy("v", "side").rowsBetween(0, Window.unboundedFollowing)
    found = ranged.withColumn("q", F.min("p").over(inside)).where("draw is not null").join(F.broadcast(parts), "part")
    hit = F.coalesce("q", "next")
    return found.select("draw", F.col("v").alias("u"), hit["key"].alias("key"))


def word_hashes(df: DataFrame, key: str) -> DataFrame:
    """(key, hs): hashes of the words of (key, words)."""
    return df.where(F.size("words") > 0).select(key, F.explode(F.array(F.transform("words", lambda w: F.xxhash64(w)))).alias("hs"))


def hashed_runs(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, at, h, g): every run of k words of (key, words), as two hashes of its words' hashes, 96 bits together.

    Only the key goes with each run, never the text; the explode of one array keeps the words' hashes from being computed anew for each.
    """
    hashed = (df if "hs" in df.columns else word_hashes(df, key)).where(F.size("hs") >= k)

    def run(at):
        words = F.slice("hs", at + 1, F.lit(k)) if k > 1 else F.col("hs")[at]
        return F.struct(at.alias("at"), F.xxhash64(words).alias("h"), F.hash(words).alias("g"))

    return hashed.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.size("hs") - k), run)).alias("r")).select(key, "r.*")


def _met(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """docs' runs joined with those looked for (materialized): few go to the documents, whose own are then never shuffled; of many, hot hashes are split."""
    few = small(runs)
    both = docs.withColumnRenamed("g", "g2")
    return (both.join(few, "h") if few is not runs else salted_join(both, runs, "h")).where("g = g2")


def longest_matches(probes: DataFrame, docs: DataFrame, k: int = 8) -> DataFrame:
    """(probe, words): the longest run of words of each probe that some document holds too, 0 under k.

    probes: (probe, words array), docs: (doc, words array). Runs of k words of both are joined by
    their hashes; hits on one diagonal of probe and document in a row make a longer run.
    """
    a = materialize(hashed_runs(probes, "probe", k).select("probe", F.col("at").alias("i"), "h", "g"))
    b = hashed_runs(docs, "doc", k).select("doc", F.col("at").alias("j"), "h", "g")
    hits = _met(b, a).select("probe", "doc", "i", (F.col("j") - F.col("i")).alias("diag")).distinct()
    w = Window.partitionBy("probe", "doc", "diag").orderBy("i")
    runs = hits.withColumn("island", F.col("i") - F.row_number().over(w)).groupBy("probe", "doc", "diag", "island").agg((F.count("*") + k - 1).alias("n"))
    best = runs.groupBy("probe").agg(F.max("n").alias("n"))
    return probes.select("probe").distinct().join(best, "probe", "left").select("probe", F.coalesce("n", F.lit(0)).cast("bigint").alias("words"))


def longest_runs(probes: DataFrame, docs: DataFrame, k: int = 8) -> DataFrame:
    """(probe, words): the longest run of words of each probe that some document holds too, however short.

    Same inputs as longest_matches, which serves all runs of k words or more; it is asked again for half as many words for the probes that it leaves
    at 0, down to two. For the last ones it is enough to know whether any of their words stands in any document.
    """
    # texts are split into words once; spread anew, as one file may hold very many
    docs = materialize(word_hashes(docs, "doc").repartition("doc"))
    found, left = [], probes
    while k > 1 and not left.isEmpty():
        some = materialize(longest_matches(left, docs, k))
        found.append(some.where("words > 0"))
        left = materialize(left.join(small(some.where("words = 0").select("probe")), "probe", "left_semi"))
        k //= 2
    a = materialize(hashed_runs(left, "probe", 1).select("probe", "h", "g").distinct())
    if not a.isEmpty():
        held = materialize(_met(hashed_runs(docs, "doc", 1).select("h", "g"), materialize(a.select("h", "g").distinct())).select("h", "g").distinct())
        found.append(a.join(small(held), ["h", "g"]).select("probe", F.lit(1).cast("bigint").alias("words")).distinct())
    best = reduce(DataFrame.union, found).groupBy("probe").agg(F.max("words").alias("words")) if found else a.select("probe", F.lit(0).cast("bigint").alias("words"))
    return probes.select("probe").distinct().join(best, "probe", "left").select("probe", F.coalesce("words", F.lit(0)).cast("bigint").alias("words"))
