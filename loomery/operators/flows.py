"""Whole flows over corpora: the mathematics filter and ladder, the freeze of training roles, order controls, policies of
learnability and mixtures, tokenizer reports, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions import hashing as H
from loomery.functions import parsing as G
from loomery.functions import text as T
from loomery.operators import contamination as C
from loomery.operators import ordering as O
from loomery.operators import quality as Q

# Limits of the mathematics filter, its strata by language score, and the name of its language reason.
LEAST_SCORE, LEAST_LANGUAGE, LEAST_WORDS, MOST_CHARACTERS, LEAST_CLASSES, MOST_URLS = 5, 0.98, 160, 200_000, 2, 8
LANGUAGE_REASON = "language_confidence_below_0p98"
STRATA = {"below_0p90": 900_000, "0p90_to_0p95": 950_000}


def ppm(share: Column) -> Column:
    """A share in parts per million, cut off."""
    return (share * 1_000_000).cast("int")


def micro(value: Column) -> Column:
    """A number in millionths, halves rounded up."""
    return F.floor(value * 1e6 + 0.5)


def math_reasons(host: Column) -> Column:
    """Sorted names of what speaks against a row (text, metadata, int_score, language_score) of a page on ``host``."""
    text, score = F.col("text"), F.col("language_score")
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    rules = {
        "upstream_score_below_5": F.col("int_score") != LEAST_SCORE,
        "found_math_absent": ~F.coalesce(G.found_math(F.col("metadata")), F.lit(False)),
        LANGUAGE_REASON: score.isNull() | F.isnan(score) | (score < LEAST_LANGUAGE),
        "url_host_absent_or_malformed": host == "",
        "denied_answer_farm_host": (host != "") & Q.host_denied(host),
        "under_160_words": words < LEAST_WORDS,
        "over_200k_characters": F.length(text) > MOST_CHARACTERS,
        "insufficient_distinct_math_signals": Q.classes(text, Q.MATH) < LEAST_CLASSES,
        "insufficient_explanatory_structure": Q.classes(text, Q.EXPLANATION) < LEAST_CLASSES,
        "excessive_embedded_urls": T.matches(text, T.URL) > MOST_URLS,
    } | {f"risk_pattern:{n}": text.rlike(p) for n, p in Q.RISKS.items()}
    return F.array_sort(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()))))


def stratum(score_ppm: Column) -> Column:
    """The ladder's stratum of a language score."""
    low, middle = STRATA.items()
    return F.when(score_ppm < low[1], low[0]).when(score_ppm < middle[1], middle[0]).otherwise("at_least_0p95")


def ladder(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``reasons``, as the ladder sees them: all but the language's, and whether the text came before."""
    seen = C.first_occurrence(rows, H.sha(F.col("text")), order)
    base = F.array_remove("reasons", LANGUAGE_REASON)
    return seen.withColumn("reasons", F.array_sort(F.when(F.col("duplicate"), F.concat(base, F.array(F.lit("exact_duplicate_text")))).otherwise(base))).withColumn("stratum", stratum(ppm(F.col("language_score"))))


def frozen_roles(rows: DataFrame, boundary: DataFrame, order: str) -> DataFrame:
    """Training rows (role, prompt, response, malformed) in ``order`` with ``outcome``: malformed, duplicate, exact:prompt,
    ngram:prompt, exact:response, ngram:response or accepted.

    A prompt's key is taken only by a row that is accepted, and the test for duplicates comes before that for overlap: so
    a row is a duplicate if an earlier clean row has its key, whatever else speaks against it.
    """
    named = rows.withColumn("__key", H.sha(T.nfkc_casefold(F.col("prompt"))))
    kinds = {}
    for field in ("prompt", "response"):
        kinds[field] = C.overlap_kind(rows.filter(F.col(field).isNotNull()).select(F.col(order).alias("doc_id"), F.col(field).alias("text")), boundary).select(F.col("doc_id").alias(order), F.concat("kind", F.lit(f":{field}")).alias(f"__{field}"))
    known = O.settled(named.join(kinds["prompt"], order, "left").join(kinds["response"], order, "left").withColumn("__overlap", F.coalesce("__prompt", "__response")).drop("__prompt", "__response"))
    clean = known.filter(~F.col("malformed") & F.col("__overlap").isNull()).groupBy("__key").agg(F.min(order).alias("__first"))
    joined = known.join(clean, "__key", "left")
    outcome = F.when(F.col("malformed"), "malformed").when(F.col(order) > F.col("__first"), "duplicate").when(F.col("__overlap").isNotNull(), F.col("__overlap")).otherwise("accepted")
    return joined.withColumn("outcome", outcome).drop("__key", "__first", "__overlap")


def order_control(rows: DataFrame, index: str, band: str, phases: int, seed: str) -> DataFrame:
    """(index, band, phase, position): records of a band in an order by hash, cut into ``phases`` equal slices, and each
    phase in an order by another hash: the same records as before, with difficulty and place unrelated."""
    key = lambda name: F.sha2(F.concat(F.lit(f"{seed}:{name}:"), F.col(index).cast("string")).cast("binary"), 256)
    first = O.ranked_in_groups(rows.select(index, band, key("band").alias("__k")), band, ["__k", index], "__r")
    sizes = first.groupBy(band).agg(F.count("*").alias("__n"))  # a row a band
    sliced = first.join(F.broadcast(sizes), band).withColumn("phase", F.floor(F.col("__r") * phases / F.col("__n")).cast("int"))
    return O.ranked_in_groups(sliced.select(index, band, "phase", key("phase").alias("__k")), "phase", ["__k", index], "position").drop("__k")


def policy_faults(matrix: DataFrame, phase_counts: DataFrame, band_counts: DataFrame, update: int) -> DataFrame:
    """One row of checks on a policy (phase, band, n) of four by four: sums by phase and band, nothing of the last band in
    the first phase, some of the second band later, phases end on whole updates, and the mean band rises."""
    by_phase = matrix.groupBy("phase").agg(F.sum("n").alias("n"), F.sum(F.col("band") * F.col("n")).alias("weight")).join(phase_counts.select("phase", "stated"), "phase", "full_outer")
    order = Window.orderBy("phase")  # four rows
    means = by_phase.withColumns({"mean": F.col("weight") / F.col("n"), "end": F.sum("n").over(order)}).withColumn("before", F.lag("mean").over(order))
    phases = means.agg(F.bool_and(F.col("n") == F.col("stated")).alias("phase_sums"), F.bool_and(F.col("before").isNull() | (F.col("mean") > F.col("before"))).alias("rising"), F.bool_and((F.col("phase") == 3) | (F.col("end") % update == 0)).alias("on_updates"))
    bands = matrix.groupBy("band").agg(F.sum("n").alias("n")).join(band_counts.select("band", "stated"), "band", "full_outer").agg(F.bool_and(F.col("n") == F.col("stated")).alias("band_sums"))
    cells = matrix.agg(F.bool_and(~((F.col("phase") == 0) & (F.col("band") == 3)) | (F.col("n") == 0)).alias("no_stretch_first"), F.bool_and(~((F.col("phase") > 0) & (F.col("band") == 1)) | (F.col("n") > 0)).alias("ready_later"))
    return phases.crossJoin(bands).crossJoin(cells)


def band_evidence(rows: DataFrame, value: str, phases: int, bands: int) -> DataFrame:
    """(phase, band, n, low, high) of every cell of the grid, empty ones with nulls."""
    spark = rows.sparkSession
    grid = spark.range(phases).withColumnRenamed("id", "phase").crossJoin(spark.range(bands).withColumnRenamed("id", "band"))
    sums = rows.groupBy("phase", "band").agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return grid.join(sums, ["phase", "band"], "left").na.fill(0, ["n"])


def mixture_faults(plan: DataFrame, budget: int, length: int) -> DataFrame:
    """One row of checks on a mixture (phase, source, domain, tokens, least_phase): the budget is met, all of it whole
    sequences, every phase has every domain, no source comes before its least phase, and all come again later."""
    spread = plan.groupBy("phase").agg(F.count_distinct("domain").alias("domains"))
    every = plan.agg(F.count_distinct("domain").alias("every"))
    last = plan.groupBy("source").agg(F.max(F.when(F.col("tokens") > 0, F.col("phase"))).alias("last")).agg(F.min("last").alias("first_end"))
    sums = plan.agg((F.sum("tokens") == budget).alias("budget"), F.bool_and(F.col("tokens") % length == 0).alias("aligned"), F.bool_and((F.col("tokens") == 0) | (F.col("phase") >= F.col("least_phase"))).alias("in_time"), F.max("phase").alias("__last"))
    covered = spread.crossJoin(F.broadcast(every)).agg(F.bool_and(F.col("domains") == F.col("every")).alias("covered"))
    return sums.crossJoin(covered).crossJoin(last).withColumn("rehearsed", F.col("first_end") == F.col("__last")).drop("__last", "first_end")


def fertility(rows: DataFrame, domain: str) -> DataFrame:
    """Per domain, and over all with a null domain: texts, bytes, tokens, their ratios in thousandths, failures; ``tokens``
    are what a tokenizer made of ``text`` and ``decoded`` what it makes of them."""
    sums = rows.rollup(domain).agg(F.count("*").alias("texts"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.size("tokens")).alias("tokens"), F.count_if(~F.col("text").eqNullSafe(F.col("decoded"))).alias("failures"))
    return sums.withColumns({"tokens_per_1k_bytes_milli": F.expr("tokens * 1000000 div bytes"), "bytes_per_token_milli": F.expr("bytes * 1000 div tokens")})


def removable(vocabulary: DataFrame, used: DataFrame) -> DataFrame:
    """(script, n): tokens of the vocabulary that nothing uses and whose letters are all of one script of SCRIPTS."""
    unused = vocabulary.join(used.select("token").distinct(), "token", "left_anti")
    return unused.withColumn("script", G.script_of(F.col("token"))).filter("script is not null").groupBy("script").agg(F.count("*").alias("n"))


def receipt(fields: DataFrame) -> DataFrame:
    """``fields``, columns in the order of their names, with ``receipt_sha256``: the digest of their canonical JSON."""
    names = sorted(fields.columns)
    body = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return fields.select(*names, F.sha2(body.cast("binary"), 256).alias("receipt_sha256"))


def sound_receipts(receipts: DataFrame) -> DataFrame:
    """``receipts`` with ``sound``: whether each carries the digest of the rest of it."""
    again = receipt(receipts.drop("receipt_sha256")).columns
    body = F.to_json(F.struct(*again[:-1]), {"ignoreNullFields": "false"})
    return receipts.withColumn("sound", F.col("receipt_sha256") == F.sha2(body.cast("binary"), 256))
