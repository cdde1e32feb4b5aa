"""Problem 8: mixing sources to target weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import running_sum
from ..runtime import materialize, small

#: Cells of source x language x topic that are raked on the driver; more are raked by aggregations.
MOST_CELLS = 200_000


def source_key(name: Column) -> Column:
    """Source names are equal apart from case, outer blanks and blank/hyphen/underscore; empty ones are null."""
    k = F.regexp_replace(F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))), "[ _-]", "_")
    return F.when(k != "", k)


def capacities(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, docs, own_tokens, all_tokens, wanted, reachable) per target.

    tokens: (source, n_tokens) per document. all_tokens is what the documents of listed sources hold.
    Targets named twice (after normalisation) keep the first name, the sum of shares and the largest
    cap; null names, shares or caps are no targets. A source without documents has none to repeat.
    """
    wanted = (
        targets.where("source is not null and target_share is not null and max_repeats is not null")
        .withColumn("k", source_key(F.col("source")))
        .where("k is not null")
        .groupBy("k")
        .agg(F.min("source").alias("source"), F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    own = tokens.groupBy(source_key(F.col("source")).alias("k")).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("own_tokens"))
    joined = wanted.join(own, "k", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("docs", "own_tokens")})
    total = joined.agg(F.coalesce(F.sum("own_tokens"), F.lit(0).cast("bigint")).alias("all_tokens"))
    return joined.crossJoin(F.broadcast(total)).select(
        "k", "source", "target_share", "max_repeats", "docs", "own_tokens", "all_tokens",
        (F.col("target_share") * F.col("all_tokens")).alias("wanted"),
        (F.col("target_share") * F.col("all_tokens") <= F.col("max_repeats") * F.col("own_tokens")).alias("reachable"),
    )


def rake(mass: np.ndarray, cells: np.ndarray, marginals: list[np.ndarray], caps: np.ndarray, rounds: int = 200, near: float = 1e-6) -> np.ndarray:
    """Iterative proportional fitting: a factor per cell so that mass x factor has the marginals, none above its cap.

    mass: tokens per cell. cells: for each dimension (rows) the index of the cell's category.
    Dimension 0 (sources) is fitted last, so that its shares hold exactly wherever the caps allow;
    what capped cells leave over goes to the source's other cells in the next round.
    """
    factor = np.ones(len(mass))
    for _ in range(rounds):
        before = factor.copy()
        for d in reversed(range(len(marginals))):
            now = np.bincount(cells[d], mass * factor, len(marginals[d]))
            ratio = np.divide(marginals[d], now, out=np.ones_like(now), where=now > 0)
            factor = np.minimum(factor * ratio[cells[d]], caps)
        if np.max(np.abs(factor - before), initial=0) <= near * max(1.0, factor.max(initial=1)):
            break
    return factor


def prepared(docs: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, list]:
    """(documents of listed sources with their cell, sums of cells, targets with their capacities), all counted once.

    docs: (key, source, lang, topic, n_tokens).
    """
    named = materialize(docs.select("key", source_key(F.col("source")).alias("k"), *[F.coalesce(c, F.lit("unknown")).alias(c) for c in ("lang", "topic")], "n_tokens").where("k is not null"))
    cap = capacities(named.select(F.col("k").alias("source"), "n_tokens"), targets).collect()  # one row per target
    labelled = named.where(F.col("k").isin([r.k for r in cap]))
    return labelled, labelled.groupBy("k", "lang", "topic").agg(F.sum("n_tokens").alias("mass")), cap


def raked_cells(sums: DataFrame, cap: list, rounds: int = 200) -> DataFrame:
    """(k, lang, topic, mass, factor): how often to use the documents of each cell of the listed sources.

    Sources have the targets' shares; the marginals of language and topic are those of the listed
    documents, so that mixing sources shifts them least. Up to MOST_CELLS cells are raked on the driver, more by
    aggregations with the same steps.
    """
    spark = sums.sparkSession
    sums = materialize(sums)
    if sums.count() > MOST_CELLS:
        return _raked_apart(sums, cap, rounds)
    listed = {r.k: i for i, r in enumerate(cap)}
    rows = sums.orderBy("k", "lang", "topic").collect()
    langs = {x: i for i, x in enumerate(sorted({r.lang for r in rows}))}
    topics = {x: i for i, x in enumerate(sorted({r.topic for r in rows}))}
    mass = np.array([r.mass for r in rows], float)
    cells = np.array([[listed[r.k] for r in rows], [langs[r.lang] for r in rows], [topics[r.topic] for r in rows]], int).reshape(3, -1)
    marginals = [np.array([r.wanted for r in cap], float), np.bincount(cells[1], mass, len(langs)), np.bincount(cells[2], mass, len(topics))]
    factor = rake(mass, cells, marginals, np.array([cap[i].max_repeats for i in cells[0]], float), rounds) if rows else []
    found = [(r.k, r.lang, r.topic, r.mass, float(f)) for r, f in zip(rows, factor)]
    return spark.createDataFrame(found, "k string, lang string, topic string, mass bigint, factor double")


def _raked_apart(sums: DataFrame, cap: list, rounds: int, near: float = 1e-6) -> DataFrame:
    """rake() where the cells are too many for the driver: three aggregations a round, each round written out."""
    spark = sums.sparkSession
    wanted = spark.createDataFrame([(r.k, float(r.wanted), float(r.max_repeats)) for r in cap], "k string, m double, cap double")
    given = {"k": wanted.select("k", "m"), **{d: materialize(sums.groupBy(d).agg(F.sum("mass").cast("double").alias("m"))) for d in ("lang", "topic")}}
    now = materialize(sums.join(F.broadcast(wanted.select("k", "cap")), "k").withColumn("factor", F.lit(1.0)))
    for _ in range(rounds):
        after = now.withColumn("before", F.col("factor"))
        for d in ("topic", "lang", "k"):
            have = after.groupBy(d).agg(F.sum(F.col("mass") * F.col("factor")).alias("s"))
            ratio = small(materialize(have.join(given[d], d).select(d, F.when(F.col("s") > 0, F.col("m") / F.col("s")).otherwise(1.0).alias("ratio"))))
            after = after.join(ratio, d).withColumn("factor", F.least(F.col("factor") * F.col("ratio"), "cap")).drop("ratio")
        after = materialize(after)
        moved = after.agg(F.max(F.abs(F.col("factor") - F.col("before"))), F.max("factor")).first()
        now = after.drop("before")
        if (moved[0] or 0) <= near * max(1.0, moved[1] or 0):
            break
    return now.select("k", "lang", "topic", "mass", "factor")


def unreachable(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, wanted, raked): targets whose raked tokens fall short of their share, and whose tokens can't reach it however often they are used.

    Raking leaves a source short only if its cells are at their caps, or if it was stopped early: the exact comparison of shares
    and capacities that follows decides the latter.
    """
    _, sums, cap = prepared(docs, targets)
    got = {r.k: r.s for r in raked_cells(sums, cap).groupBy("k").agg(F.sum(F.col("mass") * F.col("factor")).alias("s")).collect()}
    short = [(r.source, float(r.wanted), float(got.get(r.k, 0.0))) for r in cap if got.get(r.k, 0.0) < r.wanted and not r.reachable]
    return docs.sparkSession.createDataFrame(short, "source string, wanted double, raked double")


def mixture(docs: DataFrame, targets: DataFrame, seed: int = 1) -> DataFrame:
    """(key, k, n_tokens, repeats): how often each document of a listed source is used, 0 included."""
    labelled, sums, cap = prepared(docs, targets)
    return _drawn(labelled, raked_cells(sums, cap), cap, seed)


def _drawn(labelled: DataFrame, cells: DataFrame, cap: list, seed: int) -> DataFrame:
    """Repeats by calibrated probabilities, totals of sources kept.

    The whole part of a cell's factor holds for all its documents. Its fraction p is a chance: documents of a source are
    taken in order of u / p, u a hash, while they fit what the fractions add up to (sequential Poisson sampling). Of
    those left the one that comes nearest to what is still lacking fills the gap. No document exceeds max_repeats, as no factor does.
    """
    spark = labelled.sparkSession
    caps = F.broadcast(spark.createDataFrame([(r.k, int(r.max_repeats)) for r in cap], "k string, cap bigint"))
    u = ((F.xxhash64("key", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))) + 1) / F.lit(float(1 << 52))
    whole = F.floor("factor")
    docs = materialize(labelled.join(small(materialize(cells.select("k", "lang", "topic", "factor"))), ["k", "lang", "topic"]).select("key", "k", "n_tokens", whole.alias("whole"), (F.col("factor") - whole).alias("p"), u.alias("u")))
    open_ = docs.where("p > 0").withColumn("rank", F.col("u") / F.col("p"))
    goal = open_.groupBy("k").agg(F.sum(F.col("p") * F.col("n_tokens")).alias("goal"))
    ranked = running_sum(open_.select("key", "k", "n_tokens", "rank"), ["rank", "key"], "n_tokens", "before", ["k"]).join(F.broadcast(goal), "k")
    ranked = materialize(ranked.withColumn("taken", F.col("before") + F.col("n_tokens") <= F.col("goal")))
    gap = ranked.groupBy("k").agg((F.max("goal") - F.sum(F.when(F.col("taken"), F.col("n_tokens")).otherwise(0))).alias("gap"))
    far = F.abs(F.col("n_tokens") - F.col("gap"))
    last = ranked.where("not taken").join(F.broadcast(gap), "k").where(far < F.col("gap")).groupBy("k").agg(F.min_by("key", F.struct(far, F.col("rank"), F.col("key"))).alias("key"))
    extra = ranked.where("taken").select("key", "k").union(last.select("key", "k")).withColumn("one", F.lit(1).cast("bigint"))
    out = docs.join(extra, ["key", "k"], "left").join(caps, "k")
    return out.select("key", "k", "n_tokens", F.least("cap", F.col("whole") + F.coalesce("one", F.lit(0))).cast("bigint").alias("repeats"))


def mixture_report(docs: DataFrame, targets: DataFrame, seed: int = 1) -> DataFrame:
    """Per target: its share, what it got, documents used, the most repeats of one, and whether it could reach its share.

    actual_share is of all tokens used, reached of the tokens wanted: where some sources fall short, the others' shares of the rest are larger.
    """
    labelled, sums, cap = prepared(docs, targets)
    used = _drawn(labelled, raked_cells(sums, cap), cap, seed).groupBy("k").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"),
        F.count_if(F.col("repeats") > 0).alias("docs_used"),
        F.max("repeats").alias("most_repeats"),
    )
    zero = F.lit(0).cast("bigint")
    known = labelled.sparkSession.createDataFrame([(r.k, r.source, r.target_share, r.max_repeats, r.own_tokens, float(r.wanted), r.reachable) for r in cap], "k string, source string, target_share double, max_repeats int, own_tokens bigint, wanted double, reachable boolean")
    joined = known.join(used, "k", "left").withColumns({c: F.coalesce(c, zero) for c in ("used_tokens", "docs_used", "most_repeats")})
    total = joined.agg(F.sum("used_tokens").alias("used_in_all"))
    return joined.crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "own_tokens", "used_tokens", "docs_used", "most_repeats",
        F.round(F.col("used_tokens") / F.nullif(F.col("used_in_all"), zero), 6).alias("actual_share"),
        F.round(F.col("used_tokens") / F.nullif(F.col("wanted"), F.lit(0.0)), 6).alias("reached"), "reachable",
    )
