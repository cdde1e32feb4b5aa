"""Groups of records, splits, offsets and mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize


def running_sum(df: DataFrame, order: list[str], value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """df with the sum of `value` over the rows before, in order and within `by`: a prefix sum in two levels.

    Rows are range-partitioned by the order; totals of the partitions are summed by one small
    window, and each partition adds its base. No task sees all rows.
    """
    by = by or []
    keys = [*by, *order]
    ranged = materialize(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy("__part", *by).agg(F.sum(value).alias("__sum"))
    base = totals.withColumn("__base", F.sum("__sum").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).drop("__sum")
    inside = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.lit(True)
    for c in ["__part", *by]:
        same &= F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = ranged.withColumn("__in", F.sum(value).over(inside)).alias("r").join(base.alias("b") if by else F.broadcast(base.alias("b")), same, "left")
    zero = F.lit(0)
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], (F.coalesce("__base", zero) + F.coalesce("__in", zero)).alias(name))


def work_groups(df: DataFrame) -> DataFrame:
    """df with work_group: the work, with its author where several authors have works of that name."""
    authors = df.groupBy("work_id").agg(F.count_distinct("author_hint").alias("__n"))
    group = F.when((F.col("__n") > 1) & F.col("author_hint").isNotNull(), F.concat("work_id", F.lit(" ("), "author_hint", F.lit(")"))).otherwise(F.col("work_id"))
    return df.join(authors, "work_id", "left").withColumn("work_group", group).drop("__n")


def merged_groups(df: DataFrame, group: str = "work_group", digest: str = "content_sha1") -> DataFrame:
    """(group, merged): groups that hold equal texts merged; merged is the least name of its component.

    Groups and digests are the two sides of a graph of distinct edges, contracted by stars: every
    round is two aggregations with partial sums and joins on their results, written out, until nothing changes.
    """
    edges = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(digest).alias("h")).distinct()
    labels = materialize(edges.select("g", F.col("g").alias("l")).distinct())
    several = materialize(edges.where("h is not null").join(edges.where("h is not null").groupBy("h").count().where("count > 1").select("h"), "h", "left_semi"))
    while True:
        least = several.join(labels, "g").groupBy("h").agg(F.min("l").alias("m"))
        hop = several.join(least, "h").groupBy("g").agg(F.min("m").alias("m"))
        after = labels.join(hop, "g", "left").select("g", F.least("l", F.coalesce("m", "l")).alias("l"))
        # pointer jumping: a label takes its own label, which halves the way
        jump = after.select(F.col("g").alias("l"), F.col("l").alias("j"))
        after = after.join(jump, "l", "left").select("g", F.least("l", F.coalesce("j", "l")).alias("l"))
        after = materialize(after.join(labels.select("g", F.col("l").alias("o")), "g").select("g", "l", (F.col("l") != F.col("o")).alias("moved")))
        moved = not after.where("moved").isEmpty()
        after = after.select("g", "l")
        if not moved:
            return after.select(F.col("g").alias(group), F.col("l").alias("merged"))
        labels = after


def held_out_groups(sizes: DataFrame, fraction: float, most: float, seed: int) -> DataFrame:
    """(group, size) of the groups held out: in the order of a seeded hash those that fit, until the target is reached.

    sizes: (group, size). A group larger than most x target is passed over.
    """
    target = (sizes.agg(F.sum("size")).first()[0] or 0) * fraction
    ordered = sizes.where(F.col("size") <= target * most).withColumn("rank", F.md5(F.concat(F.lit(f"{seed}:"), "group")))
    return running_sum(ordered, ["rank", "group"], "size", "before").where(F.col("before") < target).select("group", "size")


def mixture_report(df: DataFrame, budget: float, most_epochs: float = 40) -> DataFrame:
    """Sampled and raw shares, emphasis and epochs by era and by genre; df: (era, genre, weight, tokens)."""
    sums = df.withColumn("mass", F.col("weight") * F.col("tokens")).groupingSets([["era"], ["genre"]], "era", "genre").agg(
        F.grouping("genre").alias("g"), F.sum("mass").alias("mass"), F.sum("tokens").alias("tokens")
    )
    w = Window.partitionBy("g")
    share, raw = F.col("mass") / F.nullif(F.sum("mass").over(w), F.lit(0.0)), F.col("tokens") / F.nullif(F.sum("tokens").over(w), F.lit(0))
    out = sums.select(F.when(F.col("g") == 1, "era").otherwise("genre").alias("field"), F.when(F.col("g") == 1, F.col("era")).otherwise(F.col("genre")).alias("value"), share.alias("sampled"), raw.alias("raw"), "tokens")
    epochs = budget * F.col("sampled") / F.nullif(F.col("tokens"), F.lit(0))
    return out.select("field", "value", F.round("sampled", 6).alias("sampled"), F.round("raw", 6).alias("raw"), F.round(F.col("sampled") / F.col("raw"), 4).alias("emphasis"), F.round(epochs, 3).alias("epochs"), (epochs > most_epochs).alias("high"))


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash of the parts, the same in every run and engine."""
    digest = F.md5(F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def positional_join(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str]) -> DataFrame:
    """Rows of equal rank side by side, with their rank r; sides of unequal lengths are an error."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} and {m} rows can't be joined by position")
    one = lambda d, order: running_sum(d.withColumn("__one", F.lit(1)), order, "__one", "r").drop("__one").withColumn("r", F.col("r").cast("bigint"))
    return one(left, left_order).join(one(right, right_order), "r")
