"""Arithmetic of training runs as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ladder(value: Column, steps: list[tuple[int, dict]], rest: dict) -> Column:
    """The first step that the value exceeds, as a struct."""
    row = lambda d: F.struct(*[F.lit(v).alias(k) for k, v in d.items()])
    out = row(rest)
    for least, found in reversed(steps):
        out = F.when(value > least, row(found)).otherwise(out)
    return out


# Sizes by vocabulary, intervals by training tokens, batches and blocks by bytes of memory.
SIZES = [(12_000, {"n_layer": 8, "n_head": 8, "n_kv_head": 4, "n_embd": 512}), (8_000, {"n_layer": 7, "n_head": 7, "n_kv_head": 7, "n_embd": 448})], {"n_layer": 6, "n_head": 6, "n_kv_head": 3, "n_embd": 384}
INTERVALS = [(10_000_000, {"eval_interval": 500, "accumulation": 4, "warmup": 500}), (1_000_000, {"eval_interval": 350, "accumulation": 5, "warmup": 400})], {"eval_interval": 250, "accumulation": 6, "warmup": 300}
MEMORY = [(32 << 30, {"batch": 32, "block": 1024}), (16 << 30, {"batch": 24, "block": 1024}), (12 << 30, {"batch": 16, "block": 512}), (8 << 30, {"batch": 12, "block": 512})], {"batch": 6, "block": 256}
PEAK = 312e12


def model_sizes(vocabulary: Column) -> Column:
    return _ladder(vocabulary, *SIZES)


def intervals(train_tokens: Column) -> Column:
    return _ladder(train_tokens, *INTERVALS)


def batch_for(memory: Column) -> Column:
    return _ladder(memory, *MEMORY)


def padded_vocabulary(vocabulary: Column) -> Column:
    return (F.ceil(vocabulary / 64) * 64).cast("bigint")


def hidden_size(n_embd: Column) -> Column:
    """Eight thirds of the width, the fraction cut, up to a multiple of 64."""
    return (F.ceil(F.floor(F.lit(8.0) / 3 * n_embd) / 64) * 64).cast("bigint")


def tokens_per_iteration(accumulation: Column, world: Column, batch: Column, block: Column) -> Column:
    return accumulation * world * batch * block


def utilization(parameters: Column, layers: Column, heads: Column, width: Column, block: Column, loops: Column, passes: Column, seconds: Column, peak: float = PEAK) -> Column:
    """Share of the peak rate of operations that a training iteration reached."""
    per_token = (6 * parameters + 12 * layers * heads * F.floor(width / heads) * block) * loops
    return per_token.cast("double") * block * passes / seconds / F.lit(peak)


def peak_rate(name: Column, table: list[tuple[str, float]], default: float = PEAK) -> Column:
    """The rate of the first listed name that stands in `name`, whatever the case."""
    out = F.lit(default)
    for part, rate in reversed(table):
        out = F.when(F.lower(name).contains(part.lower()), F.lit(rate)).otherwise(out)
    return out
