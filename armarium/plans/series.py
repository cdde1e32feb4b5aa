"""Telemetry of runs: one value a run, metric and iteration, the largest of repeated points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import training
from ..functions.weights import learning_rate
from ..runtime import table
from .registry import query

_POINTS = "(SELECT run_label, metric, iter, max(metric_value) AS v FROM telemetry_series WHERE run_label IS NOT NULL AND metric IS NOT NULL AND iter IS NOT NULL AND metric_value IS NOT NULL GROUP BY ALL)"
_W = "PARTITION BY run_label, metric ORDER BY iter"
_BEST = f"(SELECT *, min(v) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM {_POINTS})"
def _series():
    return Window.partitionBy("run_label", "metric").orderBy("iter")


def points(spark, sf):
    t = table(spark, sf, "telemetry_series").where("run_label is not null and metric is not null and iter is not null and metric_value is not null")
    return t.groupBy("run_label", "metric", "iter").agg(F.max("metric_value").alias("v"))


def with_best(spark, sf):
    return points(spark, sf).withColumn("best", F.min("v").over(_series().rowsBetween(Window.unboundedPreceding, -1)))


@query(f"SELECT run_label, metric, iter, coalesce(v < best, true) AS is_best, coalesce(v < best - 0.001::DOUBLE, true) AS improved FROM {_BEST}")
def running_best(spark, sf):
    return with_best(spark, sf).select("run_label", "metric", "iter", F.coalesce(F.expr("v < best"), F.lit(True)).alias("is_best"), F.coalesce(F.expr("v < best - 0.001D"), F.lit(True)).alias("improved"))


@query(
    f"""SELECT *, max(CASE WHEN patience >= 5 THEN 1 ELSE 0 END) OVER ({_W}) = 1 AS stopped FROM (SELECT run_label, metric, iter, row_number() OVER (PARTITION BY run_label, metric, island ORDER BY iter) - CASE WHEN island > 0 THEN 1 ELSE 0 END AS patience
    FROM (SELECT *, sum(CASE WHEN improved THEN 1 ELSE 0 END) OVER ({_W}) AS island FROM (SELECT *, coalesce(v < best - 0.001::DOUBLE, true) AS improved FROM (SELECT *, max(iter) OVER (PARTITION BY run_label, metric) AS last FROM {_BEST})) WHERE iter >= floor(0.5 * last) AND iter > 0))"""
)
def patience(spark, sf):
    """Evaluations since the last improvement once rates decay, here in the second half of each series, and whether five of them have stopped the run."""
    d = with_best(spark, sf).withColumn("improved", F.coalesce(F.expr("v < best - 0.001D"), F.lit(True))).withColumn("last", F.max("iter").over(Window.partitionBy("run_label", "metric"))).where("iter >= floor(0.5 * last) and iter > 0")
    d = d.withColumn("island", F.sum(F.when(F.col("improved"), 1).otherwise(0)).over(_series()))
    n = F.row_number().over(Window.partitionBy("run_label", "metric", "island").orderBy("iter"))
    counted = d.select("run_label", "metric", "iter", (n - F.when(F.col("island") > 0, 1).otherwise(0)).cast("bigint").alias("patience"))
    return counted.withColumn("stopped", F.max(F.when(F.col("patience") >= 5, 1).otherwise(0)).over(_series()) == 1)


@query(f"SELECT run_label, metric, iter, round(list_reduce(list(v) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, b: 0.9::DOUBLE * a + 0.1::DOUBLE * b), 6) AS ema FROM (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER ({_W}) AS k FROM {_POINTS}) WHERE k > 5)")
def ema(spark, sf):
    """Exponential mean with nine tenths of the past, from the sixth point on; what lies over 400 points back weighs under 1e-18 and is left out."""
    past = F.collect_list("v").over(_series().rowsBetween(-400, 0))
    value = F.aggregate(F.slice(past, 2, 401), F.get(past, F.lit(0)), lambda a, x: F.lit(0.9) * a + F.lit(0.1) * x)
    late = points(spark, sf).withColumn("k", F.row_number().over(_series())).where("k > 5")
    return late.select("run_label", "metric", "iter", F.round(value, 6).alias("ema"))


@query(
    f"""SELECT run_label, metric, iter, round(s / least(i, w), 6) AS smoothed FROM (SELECT run_label, metric, iter, i, w, list_sum(list_slice(l, greatest(1, i - w), i)) AS s
    FROM (SELECT *, least(50, n // 4) AS w FROM (SELECT run_label, metric, iter, row_number() OVER ({_W}) AS i, count(*) OVER (PARTITION BY run_label, metric) AS n, list(v) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM {_POINTS})) WHERE w > 0)"""
)
def smoothed_times(spark, sf):
    """Moving sums of w + 1 points over w, w a quarter of the series and 50 at most; the surplus point is what the plots show."""
    whole = Window.partitionBy("run_label", "metric")
    d = points(spark, sf).withColumn("i", F.row_number().over(_series())).withColumn("w", F.least(F.lit(50), F.floor(F.count("*").over(whole) / 4)).cast("int")).where("w > 0")
    last = F.collect_list("v").over(_series().rowsBetween(-50, 0))
    total = F.aggregate(F.slice(last, -F.least(F.size(last), F.col("w") + 1), F.least(F.size(last), F.col("w") + 1)), F.lit(0.0), lambda a, x: a + x)
    return d.select("run_label", "metric", "iter", F.round(total / F.least("i", "w"), 6).alias("smoothed"))


@query(f"SELECT run_label, metric, min(v) AS least, min(iter) FILTER (v = m) AS at_iter, round(avg(v) FILTER (v > 0), 6) AS mean_valid FROM (SELECT *, min(v) OVER (PARTITION BY run_label, metric) AS m FROM {_POINTS}) GROUP BY run_label, metric")
def series_summary(spark, sf):
    d = points(spark, sf).groupBy("run_label", "metric")
    return d.agg(F.min("v").alias("least"), F.min_by("iter", F.struct("v", "iter")).alias("at_iter"), F.round(F.avg(F.when(F.col("v") > 0, F.col("v"))), 6).alias("mean_valid"))


@query(
    f"""SELECT DISTINCT run_label, iter, round(CASE WHEN iter < 100 THEN 6e-4::DOUBLE * (iter + 1) / 101 WHEN iter < 8000 THEN 6e-4::DOUBLE
    ELSE 6e-5::DOUBLE + (6e-4::DOUBLE - 6e-5::DOUBLE) * (1 - greatest(0.0::DOUBLE, least(1.0::DOUBLE, (iter - 8000) / 2000.0::DOUBLE))) END, 9) AS lr FROM {_POINTS}"""
)
def lr_schedule(spark, sf):
    return points(spark, sf).select("run_label", "iter").distinct().select("run_label", "iter", F.round(learning_rate(F.col("iter"), 100, 10_000, 6e-4, 6e-5, 0.2), 9).alias("lr"))


def _case(value: str, ladder, field: str) -> str:
    steps, rest = ladder
    return f"CASE {' '.join(f'WHEN {value} > {n} THEN {d[field]}' for n, d in steps)} ELSE {rest[field]} END"


_RUNS = "(SELECT run_label, count(*) AS points, max(iter) AS last, max(v) FILTER (metric = 'iter_ms') AS ms FROM " + _POINTS + " GROUP BY run_label)"
_GRID = f"(SELECT run_label, v, t, mem, ms, 3000 + v * 137 AS vocabulary, points * v * v AS train_tokens, (v + 1)::BIGINT * 1073741824 * 2 AS memory FROM (SELECT *, range AS v, range * points AS t, range AS mem FROM {_RUNS}, range(90)) WHERE ms > 0)"
_S = lambda f: _case("vocabulary", training.SIZES, f)
_I = lambda f: _case("train_tokens", training.INTERVALS, f)
_M = lambda f: _case("memory", training.MEMORY, f)


@query(
    f"""SELECT run_label, v, {_S('n_layer')} AS n_layer, {_I('eval_interval')} AS eval_interval, {_I('warmup')} AS warmup, {_M('batch')} AS batch, {_M('block')} AS block, (ceil(vocabulary / 64.0) * 64)::BIGINT AS padded,
    (ceil(floor(8.0::DOUBLE / 3 * {_S('n_embd')}) / 64) * 64)::BIGINT AS hidden, ({_I('accumulation')} * 2 * {_M('batch')} * {_M('block')})::BIGINT AS tokens_per_iteration,
    round(((6 * 31800000 + 12 * {_S('n_layer')} * {_S('n_head')} * floor({_S('n_embd')} / {_S('n_head')}) * {_M('block')}) * 3)::DOUBLE * {_M('block')} * 8 / (ms / 1000) / 312e12::DOUBLE, 8) AS utilization FROM {_GRID}"""
)
def training_arithmetic(spark, sf):
    """Sizes, intervals, batches, padding and utilization of runs over a grid of vocabularies, token counts and memories."""
    p = points(spark, sf).groupBy("run_label").agg(F.count("*").alias("points"), F.max(F.when(F.col("metric") == "iter_ms", F.col("v"))).alias("ms")).where("ms > 0")
    g = p.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(89).cast("bigint"))).alias("v"))
    sizes, every, fit = training.model_sizes(3000 + F.col("v") * 137), training.intervals(F.col("points") * F.col("v") * F.col("v")), training.batch_for((F.col("v") + 1) * F.lit(2 << 30))
    g = g.select("run_label", "v", "ms", sizes.alias("s"), every.alias("e"), fit.alias("m"))
    used = training.utilization(F.lit(31_800_000), F.col("s.n_layer"), F.col("s.n_head"), F.col("s.n_embd"), F.col("m.block"), F.lit(3), F.lit(8), F.col("ms") / 1000)
    return g.select(
        "run_label", "v", "s.n_layer", "e.eval_interval", "e.warmup", "m.batch", "m.block", training.padded_vocabulary(3000 + F.col("v") * 137).alias("padded"), training.hidden_size(F.col("s.n_embd")).alias("hidden"),
        training.tokens_per_iteration(F.col("e.accumulation"), F.lit(2), F.col("m.batch"), F.col("m.block")).cast("bigint").alias("tokens_per_iteration"), F.round(used, 8).alias("utilization"),
    )
