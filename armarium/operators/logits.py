"""Filters and penalties on rows of logits, as windows over (row, token, logit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _row():
    return Window.partitionBy("row_id")


def softmax(df: DataFrame, temperature: float = 1.0, cap: float | None = None) -> DataFrame:
    """df with p; with a cap, logits are first bent to +-cap by tanh."""
    x = F.col("logit") / temperature
    if cap:
        x = cap * F.tanh(x / cap)
    bent = df.withColumn("__x", x)
    e = F.exp(F.col("__x") - F.max("__x").over(_row()))
    return bent.withColumn("__e", e).withColumn("p", F.col("__e") / F.sum("__e").over(_row())).drop("__x", "__e")


def top_k(df: DataFrame, k: int) -> DataFrame:
    """The k largest of each row; ties with the k-th stay."""
    return df.withColumn("__r", F.rank().over(_row().orderBy(F.desc("logit")))).where(F.col("__r") <= k).drop("__r")


def min_p(df: DataFrame, share: float) -> DataFrame:
    """Tokens of at least `share` of the largest probability of their row; df has p."""
    return df.withColumn("__m", F.max("p").over(_row())).where(F.col("p") >= share * F.col("__m")).drop("__m")


def top_p(df: DataFrame, mass: float) -> DataFrame:
    """Tokens before which, from the largest down, no more than `mass` lies; the first always stays; df has p."""
    w = _row().orderBy(F.desc("p"), "token_id").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__b", F.coalesce(F.sum("p").over(w), F.lit(0.0))).where(F.col("__b") <= mass).drop("__b")


def repetition_penalty(df: DataFrame, seen: DataFrame, penalty: float) -> DataFrame:
    """Logits of tokens seen in the row (row_id, token_id): positive ones divided by the penalty, others multiplied."""
    hit = df.join(seen.select("row_id", "token_id").distinct().withColumn("__s", F.lit(True)), ["row_id", "token_id"], "left")
    x = F.col("logit")
    return hit.withColumn("logit", F.when(F.col("__s").isNull(), x).when(x > 0, x / penalty).otherwise(x * penalty)).drop("__s")


def recent(history: Column, n: int = 64) -> Column:
    """The distinct tokens among the last n of a history; none of a null one."""
    return F.coalesce(F.array_distinct(F.slice(history, -F.least(F.size(history), F.lit(n)), F.lit(n))), F.array().cast("array<int>"))


def penalized(df: DataFrame, history: DataFrame, penalty: float, n: int = 64) -> DataFrame:
    """repetition_penalty by what each row's history (row_id, history) holds in its last n tokens; 1 or less changes nothing."""
    if penalty <= 1:
        return df
    return repetition_penalty(df, history.where(F.size("history") > 0).select("row_id", F.explode(recent(F.col("history"), n).cast("array<bigint>")).alias("token_id")), penalty)


def stopped(ids: Column, eos: int) -> Column:
    """A sequence of which all from the first end on is ends, so that rows keep their length."""
    at = F.array_position(ids, F.lit(eos).cast("int")).cast("int")
    return F.when(at > 0, F.concat(F.slice(ids, F.lit(1), at), F.array_repeat(F.lit(eos).cast("int"), F.size(ids) - at))).otherwise(ids)


def transcript(turns: Column, trim=None) -> Column:
    """The running text of a dialogue's turns, an array of (generated, text) in order.

    What was generated is cut by `trim` (without it, the turn's own `cut` is taken) and appended; what a person adds follows a blank, unless one is there
    already or nothing was said. A generated turn of blanks changes nothing.
    """
    def add(said: Column, turn: Column) -> Column:
        cut = trim(turn["text"]) if trim else turn["cut"]
        gap = F.when((said == "") | said.endswith(" "), "").otherwise(" ")
        return F.when(turn["generated"], F.when(F.trim(F.translate(cut, "\n\t", "  ")) == "", said).otherwise(F.concat(said, cut))).otherwise(F.concat(said, gap, turn["text"]))

    return F.aggregate(F.filter(turns, lambda x: x["text"].isNotNull()), F.lit(""), add)
