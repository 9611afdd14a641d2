"""Learning-rate schedules, batches of an update, parameter ledgers, and plans that spend equal FLOPs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def learning_rate(step: Column, total: int, warmup: int, least: float) -> Column:
    """Multiplier at a step counted from 1: a linear rise, then half a cosine down to ``least``."""
    if not (total >= 1 and 0 <= warmup <= total and 0 <= least <= 1):
        raise ValueError("the schedule's figures differ")
    span = total - warmup if warmup else max(1, total - 1)
    progress = (step - warmup) / max(1, span) if warmup else (step - 1) / span
    curve = least + (1.0 - least) * 0.5 * (1.0 + F.cos(F.lit(math.pi) * progress))
    return F.when(step <= warmup, step / max(1, warmup)).when(F.lit(total == warmup), 1.0).otherwise(curve)


def micro_batches(update: Column, sequences: int, per_update: int, size: int) -> Column:
    """Sizes of the micro-batches of an update counted from 1, the last update being partial; null beyond the last."""
    left = F.least(F.lit(per_update), sequences - (update - 1) * per_update)
    whole, rest = F.floor(left / size).cast("int"), (left % size).cast("int")
    full = F.array_repeat(F.lit(size), F.greatest(whole, F.lit(0)))
    return F.when(left > 0, F.when(rest > 0, F.concat(full, F.array(rest))).otherwise(full))


def parameters(vocabulary: Column, hidden: Column, inner: Column, layers: Column, mixer: Column) -> Column:
    """struct of a model's parameter counts: tied embedding, mixers, feed-forward, norms and all together."""
    parts = {"embedding": vocabulary * hidden, "mixers": mixer * layers, "feed_forward": 3 * hidden * inner * layers, "norms": 2 * hidden * layers + hidden}
    total = sum(parts.values(), F.lit(0))
    return F.struct(*(c.cast("long").alias(n) for n, c in parts.items()), total.cast("long").alias("total"))


def fitted_inner(vocabulary: Column, hidden: Column, layers: Column, mixer: Column, target: Column, multiple: int = 64) -> Column:
    """The inner size, a multiple rounded half to even, that brings the parameters nearest to ``target``."""
    fixed = vocabulary * hidden + mixer * layers + 2 * hidden * layers + hidden
    raw = (target - fixed) / (3 * hidden * layers)
    return F.greatest(F.lit(multiple), multiple * F.bround(raw / multiple)).cast("long")


def equal_flops(families: DataFrame, sequences: int) -> DataFrame:
    """(family, flops, budget, sequences): the greatest budget within ``sequences`` of the cheapest family that every
    family can spend exactly in whole sequences, by the least common multiple; ``families`` is a row a family."""
    rows = families.select("family", "flops").collect()
    quantum = math.lcm(*(r["flops"] for r in rows))
    budget = min(r["flops"] for r in rows) * sequences // quantum * quantum
    if budget <= 0:
        raise ValueError("no budget is a whole number of sequences of every family")
    return families.sparkSession.createDataFrame([(r["family"], r["flops"], budget, budget // r["flops"]) for r in rows], "family string, flops long, budget long, sequences long")


def run_grid(families: DataFrame, contrasts: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every family with every contrast and seed: small tables of a plan, a row each."""
    return families.crossJoin(F.broadcast(contrasts)).crossJoin(F.broadcast(seeds))
