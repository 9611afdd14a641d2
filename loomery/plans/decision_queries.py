"""Queries on evaluation scores, intervals and decisions, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import decisions as X
from loomery.sources.tables import table

REPLICATES = 10_000
FAMILIES = ["alpha", "beta", "gamma", "delta"]
BENCHMARKS = ["one", "two", "three", "four", "five"]


def runs(s, d):
    """Three runs over the labelled documents: row, slot, weight, score, flops."""
    i = F.col("doc_id")
    rows = table(s, d, "labels").select(i, F.element_at(F.array(*map(F.lit, X.SLOTS)), (i % 5 + 1).cast("int")).alias("slot"), (i % 4 + 1).alias("weight"), "quality", "toxic")
    run = lambda score, flops: rows.select("doc_id", "slot", "weight", score.alias("score"), flops.cast("long").alias("flops"))
    return run(F.col("quality"), 1000 + i), run(F.greatest(F.col("quality"), 1 - F.col("toxic")) - (i % 17 == 0).cast("int") * F.col("quality"), 3000 + i), run((i % 3 == 0).cast("int"), 3000 + i)


def routed(s, d):
    return X.routed(X.paired_three(*runs(s, d), ["doc_id", "slot", "weight"]))


def rounded(df, keep):
    return df.select(*(F.round(c, 9).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


def bootstrap(s, d):
    """Percentiles of the resampled macro gain over the fast run and over the control."""
    drawn = X.resampled_sums(routed(s, d), "slot", "doc_id", REPLICATES, {c: F.col(c) * F.col("weight") for c in ("oracle", "fast", "masked")} | {"weight": F.col("weight")})
    score = lambda c: F.lit(100.0) * F.col(c) / F.col("weight")
    macro = drawn.groupBy("replicate").agg(F.avg(score("oracle") - score("fast")).alias("gain"), F.avg(score("oracle") - score("masked")).alias("control"))
    lists = macro.agg(F.sort_array(F.collect_list("gain")).alias("gain"), F.sort_array(F.collect_list("control")).alias("control"))  # a value a replicate
    return lists.select(*(X.percentile_floor(F.col(c), p).alias(f"{c}_{n}") for c in ("gain", "control") for n, p in (("low", 0.025), ("median", 0.5), ("high", 0.975))))


def sorted_values(s, d):
    """Sorted lengths of the texts of each language and tenth."""
    return table(s, d, "documents").groupBy("lang", (F.col("doc_id") % 10).alias("part")).agg(F.sort_array(F.collect_list(F.col("n_chars").cast("double"))).alias("x"))


def family_rows(s, d):
    """Accuracies of four families on five benchmarks, with a chance baseline and a bound on the gain over the reference."""
    i = F.col("doc_id")
    rows = table(s, d, "labels").select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("place"), (i % 5).alias("b"), F.col("quality"), i)
    hit = (F.col("quality") + (i % (F.col("place") + 2) == 0).cast("int") > 0).cast("int")
    sums = rows.groupBy("place", "b").agg(F.avg(hit).alias("accuracy"), F.avg(hit - F.col("quality")).alias("low"))
    return sums.select(F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("place") + 1).alias("family"), "place", "accuracy", (0.5 + F.col("b") / 20).alias("baseline"), (F.col("low") - 0.12).alias("low"))


def reports(s, d):
    i = F.col("doc_id")
    score = lambda c: 100 * F.avg(c)
    rows = table(s, d, "labels").groupBy((i % 5).cast("int").alias("b")).agg(score(F.greatest(F.col("quality"), (i % 9 == 0).cast("int"))).alias("candidate"), score(F.col("quality")).alias("original"), score(F.col("quality") * (i % 11 != 0).cast("int")).alias("control"))
    return rows.withColumn("benchmark", F.element_at(F.array(*map(F.lit, BENCHMARKS)), F.col("b") + 1)).drop("b")


def curves(s, d):
    """Order prices as a loss by customer group and day."""
    o = table(s, d, "orders")
    return o.select((F.col("o_custkey") % 4).alias("phase"), (F.col("o_custkey") % 2).alias("arm"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("nll"), (F.col("o_orderkey") % 10 < 6).alias("done"))


def strata(s, d):
    line = table(s, d, "lineitem")
    rows = line.select((F.col("l_linenumber") % 4).alias("phase"), (F.col("l_orderkey") % 2).alias("arm"), F.col("l_extendedprice").alias("nll"), F.col("l_quantity").alias("targets"), (F.col("l_quantity") * (2 + F.col("l_linenumber") % 3)).alias("bytes"))
    return rows.filter("arm = 0"), rows.filter("arm = 1")


def settings(s, d, low, high):
    return table(s, d, "nation").filter(F.col("n_nationkey").between(low, high)).select(F.col("n_name").alias("key"), (F.col("n_regionkey") * F.when((F.col("n_nationkey") % 6 == 0) & F.lit(low > 0), 10).otherwise(1)).cast("string").alias("value"))


QUERIES = {
    "three_way_paired_join": lambda s, d: X.paired_three(*runs(s, d), ["doc_id", "slot", "weight"]),
    "oracle_routing_score": lambda s, d: rounded(X.slot_scores(routed(s, d)), []),
    "oracle_routing_decision": lambda s, d: rounded(X.routing_checks(X.slot_scores(routed(s, d))), []),
    "oracle_bootstrap": lambda s, d: rounded(bootstrap(s, d), []),
    "flop_totals": lambda s, d: routed(s, d).agg(*(F.sum(c).alias(c) for c in ("fast_flops", "slow_flops", "control_flops", "oracle_flops", "masked_flops"))),
    "uniform_choice_baseline": lambda s, d: table(s, d, "documents").select("lang", F.slice(F.split("text", " "), 1, (F.col("doc_id") % 15 + 2).cast("int")).alias("c")).groupBy("lang").agg(F.round(X.uniform_baseline(F.col("c")), 9).alias("baseline")),
    "percentiles_floor_n": lambda s, d: sorted_values(s, d).select("lang", "part", *(X.percentile_floor(F.col("x"), p).alias(f"p{int(1000 * p)}") for p in (0.025, 0.5, 0.975, 1.0))),
    "percentiles_floor_n_minus_1": lambda s, d: sorted_values(s, d).select("lang", "part", *(X.percentile_below(F.col("x"), p).alias(f"p{int(1000 * p)}") for p in (0.1, 0.5, 0.9, 0.99))),
    "percentiles_linear": lambda s, d: sorted_values(s, d).select("lang", "part", *(F.round(X.percentile_linear(F.col("x"), p), 6).alias(f"p{int(1000 * p)}") for p in (0.05, 0.5, 0.95))),
    "interval_asym": lambda s, d: sorted_values(s, d).select("lang", "part", X.interval_asym(F.col("x")).alias("i")).select("lang", "part", "i.low", "i.high"),
    "interval_flip": lambda s, d: sorted_values(s, d).select("lang", "part", X.flipped(F.get("x", F.lit(0)), F.array_min("x"), F.array_max("x")).alias("i")).select("lang", "part", "i.delta", "i.low", "i.high"),
    "family_decision": lambda s, d: rounded(X.family_decision(family_rows(s, d), -0.1), []),
    "public_gate": lambda s, d: rounded(X.public_gate(reports(s, d), ["one", "four"]), []),
    "curve_deltas": lambda s, d: rounded(X.curve_deltas(curves(s, d), "phase"), []),
    "milestone_curve_comparison": lambda s, d: X.curve_deltas(curves(s, d), "arm").groupBy().pivot("arm", [0, 1]).agg(F.round(F.first("acquired"), 6).alias("acquired"), F.round(F.first("forgotten"), 6).alias("forgotten")),
    "order_comparison": lambda s, d: rounded(X.arms_compared(*strata(s, d), ["phase"], "nll", ["targets"]), []),
    "source_addition_comparison": lambda s, d: X.arms_compared(*strata(s, d), ["phase"], "nll", ["targets", "bytes"]).agg(F.count("*").alias("strata"), F.count_if("regressed").alias("regressions"), (~F.bool_or("regressed")).alias("accepted"), F.round(F.min("bytes_delta"), 6).alias("best")),
    "readiness_config_difference": lambda s, d: X.config_difference(settings(s, d, 0, 20), settings(s, d, 3, 24)),
}

RUNS = f"""ru AS (SELECT doc_id, {X.SLOTS}[doc_id % 5 + 1] AS slot, doc_id % 4 + 1 AS weight, quality AS fast, greatest(quality, 1 - toxic) - (doc_id % 17 = 0)::int * quality AS slow, (doc_id % 3 = 0)::int AS control,
  1000 + doc_id AS fast_flops, 3000 + doc_id AS slow_flops, 3000 + doc_id AS control_flops FROM labels),
ro AS (SELECT *, slow > fast AS routed, greatest(fast, slow) AS oracle, CASE WHEN slow > fast THEN control ELSE fast END AS masked, CASE WHEN slow > fast THEN slow_flops ELSE fast_flops END AS oracle_flops, CASE WHEN slow > fast THEN control_flops ELSE fast_flops END AS masked_flops FROM ru)"""
SCORES = ", ".join(f"100.0::double * sum({c} * weight) / sum(weight) AS {c}" for c in ("fast", "slow", "control", "oracle", "masked"))
FLOPS = ", ".join(f"sum({c})::bigint AS {c}" for c in ("fast_flops", "slow_flops", "control_flops", "oracle_flops", "masked_flops"))
SLOT = f"sl AS (SELECT slot, count(*) AS rows, count_if(routed) AS slow_rows, {SCORES}, {FLOPS} FROM ro GROUP BY slot)"
SORTED = "so AS (SELECT lang, doc_id % 10 AS part, list(n_chars::double ORDER BY n_chars) AS x, count(*) AS n FROM documents GROUP BY ALL)"
STRATA = "li AS (SELECT l_linenumber % 4 AS phase, l_orderkey % 2 AS arm, sum(l_extendedprice) / sum(l_quantity) AS t, sum(l_extendedprice) / sum(l_quantity * (2 + l_linenumber % 3)) AS b FROM lineitem GROUP BY ALL)"
CURVE = "SELECT {k}, arg_min(o_totalprice, o_orderkey) AS initial, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderkey % 10 < 6) AS completion, arg_max(o_totalprice, o_orderkey) AS terminal FROM orders GROUP BY ALL"

ORACLES = {
    "three_way_paired_join": f"WITH {RUNS} SELECT doc_id, slot, weight, fast, fast_flops, slow, slow_flops, control, control_flops FROM ru",
    "oracle_routing_score": f"WITH {RUNS}, {SLOT} SELECT slot, rows, slow_rows, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("fast", "slow", "control", "oracle", "masked")) + ", fast_flops, slow_flops, control_flops, oracle_flops, masked_flops FROM sl",
    "oracle_routing_decision": f"""WITH {RUNS}, {SLOT}, x AS (SELECT avg(oracle - fast) AS gain, avg(oracle - masked) AS control_gain, min(oracle - fast) AS worst, min(oracle - masked) AS cw, count_if(oracle > fast) AS w, count_if(oracle > masked) AS c,
  min(least(oracle - fast, oracle - masked)) FILTER (WHERE slot IN ('multi_step_reasoning', 'self_correction')) AS p, bool_and(oracle_flops = masked_flops) AS m FROM sl),
y AS (SELECT round(gain, 9) AS gain, round(control_gain, 9) AS control_gain, x.gain >= 1 AS gain_enough, x.control_gain >= 1 AS control_gain_enough, worst >= -1 AS no_slot_loses, cw >= -1 AS no_slot_loses_to_control, w >= 4 AS wins_enough, c >= 4 AS control_wins_enough, p >= 0 AS protected_hold, m AS flops_matched FROM x)
SELECT *, gain_enough AND control_gain_enough AND no_slot_loses AND no_slot_loses_to_control AND wins_enough AND control_wins_enough AND protected_hold AND flops_matched AS supported FROM y""",
    "oracle_bootstrap": f"""WITH {RUNS}, pl AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY slot) AS size FROM ro),
dr AS (SELECT r.range AS replicate, slot, ('0x' || substr(sha256(r.range || ':' || slot || ':' || place), 1, 12))::bigint % size AS place FROM pl, range({REPLICATES}) r),
sc AS (SELECT replicate, slot, {SCORES} FROM dr JOIN pl USING (slot, place) GROUP BY ALL), ma AS (SELECT avg(oracle - fast) AS g, avg(oracle - masked) AS c FROM sc GROUP BY replicate),
so AS (SELECT list(g ORDER BY g) AS g, list(c ORDER BY c) AS c FROM ma)
SELECT """ + ", ".join(f"round({a}[least({REPLICATES - 1}, floor({p} * {REPLICATES}))::int + 1], 9) AS {n}_{q}" for a, n in (("g", "gain"), ("c", "control")) for q, p in (("low", 0.025), ("median", 0.5), ("high", 0.975))) + " FROM so",
    "flop_totals": f"WITH {RUNS} SELECT {FLOPS} FROM ro",
    "uniform_choice_baseline": "SELECT lang, round(avg(1.0::double / len(string_split(text, ' ')[1:doc_id % 15 + 2])), 9) AS baseline FROM documents GROUP BY lang",
    "percentiles_floor_n": f"WITH {SORTED} SELECT lang, part, " + ", ".join(f"x[greatest(0, least(n - 1, floor({p} * n)))::int + 1] AS p{int(1000 * p)}" for p in (0.025, 0.5, 0.975, 1.0)) + " FROM so",
    "percentiles_floor_n_minus_1": f"WITH {SORTED} SELECT lang, part, " + ", ".join(f"x[floor({p}::double * (n - 1))::int + 1] AS p{int(1000 * p)}" for p in (0.1, 0.5, 0.9, 0.99)) + " FROM so",
    "percentiles_linear": "SELECT lang, doc_id % 10 AS part, " + ", ".join(f"round(quantile_cont(n_chars::double, {p}), 6) AS p{int(1000 * p)}" for p in (0.05, 0.5, 0.95)) + " FROM documents GROUP BY ALL",
    "interval_asym": f"WITH {SORTED} SELECT lang, part, x[floor(0.025::double * n)::int + 1] AS low, x[ceil(0.975::double * n)::int] AS high FROM so",
    "interval_flip": f"WITH {SORTED} SELECT lang, part, -x[1] AS delta, -list_max(x) AS low, -list_min(x) AS high FROM so",
    "family_decision": f"""WITH h AS (SELECT p.range AS place, doc_id % 5 AS b, (quality + (doc_id % (p.range + 2) = 0)::int > 0)::int AS hit, quality FROM labels, range(4) p),
r AS (SELECT {FAMILIES}[place + 1] AS family, place, avg(hit) AS accuracy, 0.5 + b / 20 AS baseline, avg(hit - quality) - 0.12 AS low FROM h GROUP BY place, b),
j AS (SELECT family, bool_and(accuracy > baseline) AS floor, bool_and(low >= -0.1) AS noninferior, bool_or(low > 0) AS positive, min(low) AS worst, avg(accuracy) AS macro, min(place)::int AS place FROM r GROUP BY family),
e AS (SELECT *, floor AND noninferior AND positive AS eligible FROM j), o AS (SELECT family AS best FROM e WHERE eligible ORDER BY worst DESC, macro DESC, place LIMIT 1)
SELECT family, floor, noninferior, positive, round(worst, 9) AS worst, round(macro, 9) AS macro, place, eligible, coalesce(family = (SELECT best FROM o), false) AS selected FROM e""",
    "public_gate": f"""WITH r AS (SELECT {BENCHMARKS}[doc_id % 5 + 1] AS benchmark, 100 * avg(greatest(quality, (doc_id % 9 = 0)::int)) AS c, 100 * avg(quality) AS o, 100 * avg(quality * (doc_id % 11 <> 0)::int) AS k FROM labels GROUP BY 1),
x AS (SELECT avg(c - o) AS gain, avg(c - k) AS control_gain, min(least(c - o, c - k)) AS worst, count_if(c > o) AS w, count_if(c > k) AS v, min(least(c - o, c - k)) FILTER (WHERE benchmark IN ('one', 'four')) AS p FROM r),
y AS (SELECT round(gain, 9) AS gain, round(control_gain, 9) AS control_gain, x.gain >= 1 AND x.control_gain >= 1 AS gains, worst >= -1 AS no_loss, w >= 4 AND v >= 4 AS wins_enough, p >= 0 AS protected_hold FROM x)
SELECT *, gains AND no_loss AND wins_enough AND protected_hold AS promote FROM y""",
    "curve_deltas": f"WITH c AS ({CURVE.format(k='o_custkey % 4 AS phase')}) SELECT phase, round(initial, 9) AS initial, round(completion, 9) AS completion, round(terminal, 9) AS terminal, round(initial - completion, 9) AS acquired, round(terminal - completion, 9) AS forgotten FROM c",
    "milestone_curve_comparison": f"WITH c AS ({CURVE.format(k='o_custkey % 2 AS arm')}) SELECT " + ", ".join(f'round(max(initial - completion) FILTER (WHERE arm = {a}), 6) AS "{a}_acquired", round(max(terminal - completion) FILTER (WHERE arm = {a}), 6) AS "{a}_forgotten"' for a in (0, 1)) + " FROM c",
    "order_comparison": f"WITH {STRATA} SELECT l.phase, round(l.t, 9) AS left_targets, round(r.t, 9) AS right_targets, round(r.t - l.t, 9) AS targets_delta, r.t > l.t AS regressed FROM li l JOIN li r ON l.phase = r.phase AND l.arm = 0 AND r.arm = 1",
    "source_addition_comparison": f"WITH {STRATA}, x AS (SELECT r.t > l.t OR r.b > l.b AS w, r.b - l.b AS d FROM li l JOIN li r ON l.phase = r.phase AND l.arm = 0 AND r.arm = 1) SELECT count(*) AS strata, count_if(w) AS regressions, NOT bool_or(w) AS accepted, round(min(d), 6) AS best FROM x",
    "readiness_config_difference": """WITH l AS (SELECT n_name AS key, n_regionkey::varchar AS v FROM nation WHERE n_nationkey BETWEEN 0 AND 20), r AS (SELECT n_name AS key, (n_regionkey * CASE WHEN n_nationkey % 6 = 0 THEN 10 ELSE 1 END)::varchar AS v FROM nation WHERE n_nationkey BETWEEN 3 AND 24)
SELECT key, l.v AS left, r.v AS right FROM l FULL JOIN r USING (key) WHERE l.v IS DISTINCT FROM r.v""",
}
