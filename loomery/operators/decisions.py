"""Evaluation scores, intervals and the decisions that follow from them, as conjunctions of named checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The slots of the routing gate, those that may not lose, and the margins in points.
SLOTS = ["multi_step_reasoning", "self_correction", "coding", "mathematics", "science"]
PROTECTED = ["multi_step_reasoning", "self_correction"]
GAIN, LOSS, WINS = 1.0, -1.0, 4


def weighted_score(score: Column, weight: Column) -> Column:
    """Aggregate: 100 times the weighted mean."""
    return 100.0 * F.sum(score * weight) / F.sum(weight)


def uniform_baseline(choices: Column) -> Column:
    """Aggregate: the mean chance of a uniform guess."""
    return F.avg(1.0 / F.size(choices))


def routed(rows: DataFrame) -> DataFrame:
    """Paired rows (slot, fast, slow, control, weight and flops of each) with what an oracle that takes the slow path only
    where it scores higher gets, and the same rows with the control in the slow path's place."""
    slow = F.col("slow") > F.col("fast")
    pick = lambda a, b: F.when(F.col("routed"), F.col(a)).otherwise(F.col(b))
    return rows.withColumn("routed", slow).withColumns({"oracle": F.greatest("fast", "slow"), "masked": pick("control", "fast"), "oracle_flops": pick("slow_flops", "fast_flops"), "masked_flops": pick("control_flops", "fast_flops")})


def paired_three(fast: DataFrame, slow: DataFrame, control: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that all three runs have, with each run's score."""
    named = lambda df, name: df.select(*keys, F.col("score").alias(name), F.col("flops").alias(f"{name}_flops"))
    return named(fast, "fast").join(named(slow, "slow"), keys).join(named(control, "control"), keys)


def slot_scores(rows: DataFrame, *keys: str) -> DataFrame:
    """Scores and FLOPs of every run and route in each slot."""
    scores = [weighted_score(F.col(c).cast("double"), F.col("weight")).alias(c) for c in ("fast", "slow", "control", "oracle", "masked")]
    flops = [F.sum(c).alias(c) for c in ("fast_flops", "slow_flops", "control_flops", "oracle_flops", "masked_flops") if c in rows.columns]
    return rows.groupBy(*keys, "slot").agg(F.count("*").alias("rows"), F.count_if("routed").alias("slow_rows"), *scores, *flops)


def routing_checks(slots: DataFrame) -> DataFrame:
    """One row: the macro gains, every check of the routing decision, and whether all hold."""
    gain, other = F.col("oracle") - F.col("fast"), F.col("oracle") - F.col("masked")
    safe = F.col("slot").isin(PROTECTED)
    sums = slots.agg(
        F.avg(gain).alias("gain"), F.avg(other).alias("control_gain"), F.min(gain).alias("worst"), F.min(other).alias("control_worst"),
        F.count_if(gain > 0).alias("wins"), F.count_if(other > 0).alias("control_wins"),
        F.min(F.when(safe, F.least(gain, other))).alias("protected"), F.bool_and(F.col("oracle_flops") == F.col("masked_flops")).alias("matched"),
    )
    checks = {
        "gain_enough": F.col("gain") >= GAIN, "control_gain_enough": F.col("control_gain") >= GAIN, "no_slot_loses": F.col("worst") >= LOSS, "no_slot_loses_to_control": F.col("control_worst") >= LOSS,
        "wins_enough": F.col("wins") >= WINS, "control_wins_enough": F.col("control_wins") >= WINS, "protected_hold": F.col("protected") >= 0, "flops_matched": F.col("matched"),
    }
    return sums.select("gain", "control_gain", *(c.alias(k) for k, c in checks.items())).withColumn("supported", F.expr(" AND ".join(checks)))


#: Rows of a stratum whose values one task holds, parts that the replicates are dealt out to, and slots made at a time.
HELD_ROWS, REPLICATE_PARTS, SLOTS_AT_ONCE = 1 << 18, 40, 1 << 16


def resampled_sums(rows: DataFrame, stratum: str, order: str, replicates: int, values: dict[str, Column]) -> DataFrame:
    """(replicate, stratum, sums of ``values``): of rows drawn with replacement inside each stratum, as many as it has,
    by a hash of replicate, stratum and slot.

    A task holds the values of HELD_ROWS neighbouring rows of a stratum as arrays, makes the draws of its part of the
    replicates one after the other and adds up what falls on its rows. No draw is shuffled or kept, and nothing but
    sums leaves a task. A stratum of several such pieces has its hashes made once for each.
    """
    from loomery.operators.ordering import ranked_in_groups, settled

    placed = settled(ranked_in_groups(rows.select(stratum, order, *(c.cast("double").alias(k) for k, c in values.items())).filter(F.col(stratum).isNotNull()), stratum, [order], "__place"))
    sizes = placed.groupBy(stratum).agg(F.count("*").alias("__size"))  # a row a stratum
    held = placed.groupBy(stratum, F.floor(F.col("__place") / HELD_ROWS).alias("__piece")).agg(F.sort_array(F.collect_list(F.struct("__place", *values))).alias("__rows"))
    arrays = held.join(F.broadcast(sizes), stratum).select(stratum, "__piece", "__size", *(F.col("__rows").getField(k).alias(k) for k in values))
    parts = min(replicates, REPLICATE_PARTS)
    dealt = arrays.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(4 * parts, stratum, "__piece", "__part")
    each = dealt.withColumn("replicate", F.explode(F.sequence("__part", F.lit(replicates - 1), F.lit(parts))))
    named = each.withColumn("__name", F.concat(F.col("replicate").cast("string"), F.lit(":"), F.col(stratum).cast("string"), F.lit(":")))
    blocks = named.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__size") - 1, F.lit(SLOTS_AT_ONCE).cast("long"))))
    slots = blocks.withColumn("__slot", F.explode(F.sequence("__block", F.least(F.col("__block") + SLOTS_AT_ONCE, F.col("__size")) - 1)))
    mixed = F.sha2(F.concat("__name", F.col("__slot").cast("string")).cast("binary"), 256)
    place = (F.conv(F.substring(mixed, 1, 12), 16, 10).cast("long") % F.col("__size") - F.col("__piece") * HELD_ROWS).alias("__at")
    # A place outside the piece gets null, which sums leave out; the place is one column, so that its hash is made once.
    taken = slots.select("replicate", stratum, *values, place).select("replicate", stratum, *(F.get(k, F.col("__at").cast("int")).alias(k) for k in values))
    return taken.groupBy("replicate", stratum).agg(*(F.sum(k).alias(k) for k in values))


def percentile_floor(values: Column, p: float) -> Column:
    """Of a sorted array of n: the one at floor(p n), held inside."""
    return F.get(values, F.greatest(F.lit(0), F.least(F.size(values) - 1, F.floor(p * F.size(values)).cast("int"))))


def percentile_below(values: Column, p: float) -> Column:
    """Of a sorted array of n: the one at floor(p (n - 1))."""
    return F.get(values, F.floor(p * (F.size(values) - 1)).cast("int"))


def percentile_linear(values: Column, p: float) -> Column:
    """Of a sorted array: linear interpolation between neighbours."""
    at = p * (F.size(values) - 1)
    low = F.floor(at).cast("int")
    return F.get(values, low) + (at - low) * (F.get(values, F.least(low + 1, F.size(values) - 1)) - F.get(values, low))


def interval_asym(values: Column, tail: float = 0.025) -> Column:
    """struct<low, high> of a sorted array of n: those at floor(tail n) and ceil((1 - tail) n) - 1."""
    return F.struct(F.get(values, F.floor(tail * F.size(values)).cast("int")).alias("low"), F.get(values, (F.ceil((1 - tail) * F.size(values)) - 1).cast("int")).alias("high"))


def flipped(delta: Column, low: Column, high: Column) -> Column:
    """The interval of the opposite difference."""
    return F.struct((-delta).alias("delta"), (-high).alias("low"), (-low).alias("high"))


def family_decision(rows: DataFrame, margin: float) -> DataFrame:
    """(family, floor, noninferior, positive, eligible, selected) of families with ``accuracy``, ``baseline``, ``low`` (the
    lower bound of the gain over the reference) and ``place`` on each benchmark: all above their baseline, none below
    ``margin``, some gain above 0; the eligible one with the best (worst bound, mean accuracy, least place) is selected."""
    each = rows.groupBy("family").agg(
        F.bool_and(F.col("accuracy") > F.col("baseline")).alias("floor"), F.bool_and(F.col("low") >= margin).alias("noninferior"), F.bool_or(F.col("low") > 0).alias("positive"),
        F.min("low").alias("worst"), F.avg("accuracy").alias("macro"), F.min("place").alias("place"),
    )
    judged = each.withColumn("eligible", F.expr("floor AND noninferior AND positive"))
    best = judged.filter("eligible").agg(F.max_by("family", F.struct("worst", "macro", -F.col("place"))).alias("best"))
    return judged.crossJoin(F.broadcast(best)).withColumn("selected", F.coalesce(F.col("family") == F.col("best"), F.lit(False))).drop("best")


def public_gate(reports: DataFrame, protected: list[str]) -> DataFrame:
    """One row: macro gains of candidate over original and equal-compute control, every check, and whether to promote."""
    a, b = F.col("candidate") - F.col("original"), F.col("candidate") - F.col("control")
    sums = reports.agg(F.avg(a).alias("gain"), F.avg(b).alias("control_gain"), F.min(F.least(a, b)).alias("worst"), F.count_if(a > 0).alias("wins"), F.count_if(b > 0).alias("control_wins"), F.min(F.when(F.col("benchmark").isin(protected), F.least(a, b))).alias("protected"))
    checks = {"gains": (F.col("gain") >= GAIN) & (F.col("control_gain") >= GAIN), "no_loss": F.col("worst") >= LOSS, "wins_enough": (F.col("wins") >= WINS) & (F.col("control_wins") >= WINS), "protected_hold": F.col("protected") >= 0}
    return sums.select("gain", "control_gain", *(c.alias(k) for k, c in checks.items())).withColumn("promote", F.expr(" AND ".join(checks)))


def curve_deltas(points: DataFrame, *keys: str) -> DataFrame:
    """Of curves (``step``, ``done``, ``nll``): the first, that at completion (the last with ``done``) and the last value,
    what was acquired until completion and forgotten after it."""
    sums = points.groupBy(*keys).agg(F.min_by("nll", "step").alias("initial"), F.max_by("nll", F.when(F.col("done"), F.col("step"))).alias("completion"), F.max_by("nll", "step").alias("terminal"))
    return sums.withColumns({"acquired": F.col("initial") - F.col("completion"), "forgotten": F.col("terminal") - F.col("completion")})


def arms_compared(left: DataFrame, right: DataFrame, keys: list[str], nll: str, units: list[str]) -> DataFrame:
    """Matched strata of two runs: the difference of ``nll`` a unit, and whether the right run is worse in any."""
    sums = lambda df, side: df.groupBy(*keys).agg(*((F.sum(nll) / F.sum(u)).alias(f"{side}_{u}") for u in units))
    both = sums(left, "left").join(sums(right, "right"), keys)
    deltas = {f"{u}_delta": F.col(f"right_{u}") - F.col(f"left_{u}") for u in units}
    return both.withColumns(deltas).withColumn("regressed", F.greatest(*(F.col(d) for d in deltas)) > 0 if len(deltas) > 1 else F.col(next(iter(deltas))) > 0)


def config_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, left, right) of settings that two runs do not share."""
    both = left.select("key", F.col("value").alias("left")).join(right.select("key", F.col("value").alias("right")), "key", "full_outer")
    return both.filter(~F.col("left").eqNullSafe(F.col("right")))
