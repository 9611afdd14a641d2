"""Concept taxonomies, exposure progressions, blind samples and reviewer agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.operators.metadata import closure

#: Parts per million of rows that two reviewers, or a review and its check, may differ in.
MOST_DIFFERENT = 50_000


def taxonomy_faults(concepts: DataFrame, domains: list[str]) -> DataFrame:
    """(concept, fault) of concepts (``concept``, ``name``, ``domain``, ``prerequisites``, ``least_prior``): repeated ids,
    blank names, unknown domains, own or absent prerequisites, a threshold without prerequisites or the reverse; a domain
    that no concept covers is a fault of no concept."""
    own = F.array_contains("prerequisites", F.col("concept"))
    rules = {
        "repeated": F.col("__times") > 1, "unnamed": F.trim("name") == "", "domain": ~F.col("domain").isin(domains),
        "own_prerequisite": own, "repeated_prerequisite": F.size(F.array_distinct("prerequisites")) < F.size("prerequisites"),
        "threshold": (F.size("prerequisites") > 0) != (F.col("least_prior") > 0),
    }
    counted = concepts.withColumn("__times", F.count("*").over(Window.partitionBy("concept")))
    found = counted.select("concept", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))).alias("fault"))
    edges = concepts.select("concept", F.explode("prerequisites").alias("needs"))
    absent = edges.join(concepts.select(F.col("concept").alias("needs")), "needs", "left_anti").select("concept", F.lit("absent_prerequisite").alias("fault"))
    spark = concepts.sparkSession
    named = spark.createDataFrame([(d,) for d in domains], "domain string").join(concepts.select("domain"), "domain", "left_anti")
    return found.unionByName(absent).unionByName(named.select(F.lit(None).cast("string").alias("concept"), F.concat(F.lit("uncovered:"), "domain").alias("fault")))


def cyclic(edges: DataFrame) -> DataFrame:
    """``node``: those of the directed ``edges`` (a, b) that reach themselves."""
    return closure(edges).filter(F.col("a") == F.col("b")).select(F.col("a").alias("node"))


def prior_exposures(exposures: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, concept, needs, least, prior): for each exposure of a concept and each of its prerequisites, the documents
    strictly before that expose the prerequisite.

    Exposures and questions about them are one stream by (concept asked about, document): a running count over it answers
    all questions in one sort, with no pairs of documents. A concept's rows are one window group; they are counted by
    document first.
    """
    asked = exposures.join(F.broadcast(edges), exposures["concept"] == edges["b"]).select(F.col("a").alias("needs"), "doc", "concept", "least", F.lit(0).alias("one"))
    said = exposures.select(F.col("concept").alias("needs"), "doc", F.lit(None).cast("string").alias("concept"), F.lit(None).cast("int").alias("least"), F.lit(1).alias("one"))
    order = Window.partitionBy("needs").orderBy("doc").rangeBetween(Window.unboundedPreceding, -1)
    both = asked.unionByName(said).withColumn("prior", F.coalesce(F.sum("one").over(order), F.lit(0)))
    return both.filter("concept is not null").select("doc", "concept", "needs", "least", "prior")


def new_concepts(exposures: DataFrame) -> DataFrame:
    """(doc, new): how many concepts each document is the first to expose."""
    first = exposures.groupBy("concept").agg(F.min("doc").alias("doc"))
    return first.groupBy("doc").agg(F.count("*").alias("new"))


def coverage_faults(exposures: DataFrame, required: DataFrame) -> DataFrame:
    """(concept, phase, least, seen) where fewer documents of a phase expose a concept than ``required`` asks for."""
    seen = exposures.groupBy("concept", "phase").agg(F.count_distinct("doc").alias("seen"))
    return required.join(seen, ["concept", "phase"], "left").na.fill(0, ["seen"]).filter("seen < least")


def premature(exposures: DataFrame, required: DataFrame) -> DataFrame:
    """Exposures in a phase before the earliest that requires the concept."""
    earliest = required.filter("least > 0").groupBy("concept").agg(F.min("phase").alias("earliest"))
    return exposures.join(earliest, "concept").filter(F.col("phase") < F.col("earliest"))


def not_monotone(rows: DataFrame, order: str, value: str, parts: int | None = None) -> DataFrame:
    """Rows whose ``value`` is below that of the row before in the global ``order``.

    Inside range partitions by ``lag``; across them by each partition's last value, a row a partition.
    """
    from loomery.operators.ordering import _in_ranges

    split = _in_ranges(rows, [order], parts)
    last = split.groupBy("__part").agg(F.max_by(value, order).alias("__end"))
    before = last.select("__part", F.last("__end", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))  # a row a partition
    inside = F.lag(value).over(Window.partitionBy("__part").orderBy(order))
    return split.join(F.broadcast(before), "__part").withColumn("__prior", F.coalesce(inside, "__before")).filter(F.col(value) < F.col("__prior")).drop("__part", "__before", "__prior")


def sampled(df: DataFrame, strata: list[str], salt: str, identity: str, k: int) -> DataFrame:
    """The ``k`` rows of each stratum whose salted digests are least, and ``enough``: whether the stratum had as many."""
    rank = F.sha2(F.concat(F.lit(salt), F.col(identity).cast("string")).cast("binary"), 256)
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("__rank", identity))
    top = df.withColumn("__rank", rank).withColumn("__place", place).filter(F.col("__place") <= k)
    return top.withColumn("enough", F.count("*").over(Window.partitionBy(*strata)) == k).drop("__rank", "__place")


def blinded(df: DataFrame, salt: str, identity: str, shown: list[str]) -> tuple[DataFrame, DataFrame]:
    """(blind rows, key): rows under salted names that tell nothing of their origin, and what the names stand for."""
    name = F.sha2(F.concat(F.lit(salt), F.col(identity).cast("string")).cast("binary"), 256)
    named = df.withColumn("blind_id", name)
    return named.select("blind_id", *shown), named.drop(*shown)


def restored(annotations: DataFrame, key: DataFrame) -> DataFrame:
    """Blind annotations under the identities of the sealed key."""
    return annotations.join(key, "blind_id")


def differences(left: DataFrame, right: DataFrame, key: str, sets: list[str], numbers: dict[str, int]) -> DataFrame:
    """Rows of two reviewers side by side with a flag a dimension: sets that are not equal, numbers further apart than
    allowed."""
    rows = left.alias("l").join(right.alias("r"), key)
    apart = {f"{c}_differs": F.array_sort(F.array_distinct(f"l.{c}")) != F.array_sort(F.array_distinct(f"r.{c}")) for c in sets}
    apart |= {f"{c}_differs": F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")) > most for c, most in numbers.items()}
    return rows.select(key, *(c.alias(n) for n, c in apart.items()))


def agreement(flags: DataFrame, key: str, weights: dict[str, int] | None = None) -> DataFrame:
    """(dimension, differing, rows, ppm rounded up, within) of flags of ``differences``."""
    names = [c for c in flags.columns if c != key]
    each = flags.select(F.explode(F.create_map(*(x for n in names for x in (F.lit(n), F.col(n))))).alias("dimension", "differs"))
    sums = each.groupBy("dimension").agg(F.count_if("differs").alias("differing"), F.count("*").alias("rows"))
    ppm = F.expr("(differing * 1000000 + rows - 1) div rows")
    return sums.withColumn("ppm", ppm).withColumn("within", F.col("ppm") <= MOST_DIFFERENT)


def by_priority(flags: DataFrame, key: str, weights: dict[str, int], k: int) -> DataFrame:
    """The ``k`` rows with the most weight of differences, ties by identity."""
    score = sum((F.col(n).cast("int") * w for n, w in weights.items()), F.lit(0))
    return flags.withColumn("priority", score).filter("priority > 0").orderBy(F.desc("priority"), key).limit(k).select(key, "priority")


def qualified(reviews: DataFrame, least: int = 100) -> DataFrame:
    """One row: whether a labeller's ``label`` may stand in for the ``truth`` of reviewed rows: enough rows, enough of
    each side, and few enough missed and false labels, in parts per million rounded up."""
    sums = reviews.agg(
        F.count("*").alias("reviewed"), F.count_if("truth").alias("positive"), F.count_if(~F.col("truth")).alias("negative"),
        F.count_if(F.col("truth") & ~F.col("label")).alias("missed"), F.count_if(~F.col("truth") & F.col("label")).alias("wrong"),
    )
    ppm = lambda k, n: F.expr(f"CASE WHEN {n} > 0 THEN ({k} * 1000000 + {n} - 1) div {n} END")
    out = sums.withColumns({"missed_ppm": ppm("missed", "positive"), "wrong_ppm": ppm("wrong", "negative")})
    return out.withColumn("qualified", F.expr(f"reviewed >= {least} AND positive >= {least} AND negative >= {least} AND missed_ppm <= {MOST_DIFFERENT} AND wrong_ppm <= {MOST_DIFFERENT}"))


def complete(shards: DataFrame, index: str, same: list[str]) -> DataFrame:
    """One row: whether ``index`` takes exactly 0 to n - 1 and the columns ``same`` agree in all shards."""
    rules = [F.min(index) == 0, F.max(index) == F.count("*") - 1, F.count_distinct(index) == F.count("*"), *(F.count_distinct(c) == 1 for c in same)]
    return shards.agg(F.count("*").alias("shards"), *(r.alias(f"r{i}") for i, r in enumerate(rules))).select("shards", F.expr(" AND ".join(f"r{i}" for i in range(len(rules)))).alias("complete"))


def attempts_sound(attempts: DataFrame, key: str, order: str, failed: str) -> DataFrame:
    """(key, attempts, sound): attempts of a key are numbered from 0 without gaps, and all but the last failed."""
    last = F.max(order)
    sums = attempts.groupBy(key).agg(F.count("*").alias("attempts"), F.count_distinct(order).alias("__d"), F.min(order).alias("__a"), last.alias("__b"), F.count_if(~F.col(failed)).alias("__ok"), F.max_by(failed, order).alias("__last"))
    sound = (F.col("__a") == 0) & (F.col("__b") == F.col("attempts") - 1) & (F.col("__d") == F.col("attempts")) & (F.col("__ok") == F.when(F.col("__last"), 0).otherwise(1))
    return sums.select(key, "attempts", sound.alias("sound"))


def same_multiset(left: DataFrame, right: DataFrame) -> Column:
    """Whether two tables hold the same rows, each as often: grouped counts, never sorted lists."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def list_digest(values: Column) -> Column:
    """Digest of the canonical text of a list of plain strings, in order."""
    return F.sha2(F.to_json(values).cast("binary"), 256)
