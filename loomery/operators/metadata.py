"""Source metadata: policy predicates, snapshot alignment, prerequisite graphs, reviewer agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.operators.ordering import settled

# Licences that the policy accepts.
LICENSES = ["0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "ISC", "MIT", "Unlicense", "Zlib"]


def accepted(licenses: Column, kind: Column, score: Column, encoding: Column, size: Column) -> Column:
    """The metadata policy: permissive, all licences listed, score 4 or 5, UTF-8, a size in bounds."""
    listed = (F.size(licenses) > 0) & (F.size(F.array_except(licenses, F.array(*map(F.lit, LICENSES)))) == 0)
    return (kind == "permissive") & listed & score.isin(4, 5) & (encoding == "UTF-8") & size.between(128, 1_000_000)


def duplicate_stats(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys, repeats and groups of more than one."""
    groups = df.groupBy(key).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.sum(F.col("n") - 1).alias("repeats"), F.count_if(F.col("n") > 1).alias("groups"))


def align(candidates: DataFrame, current: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Candidates with the first eligible current row of their keys, and why one is removed: absent, vendor or generated."""
    held = current.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.min(F.when(~F.col("vendor") & ~F.col("generated"), F.col(order))).alias("chosen"), F.bool_and("vendor").alias("all_vendor"))
    joined = candidates.join(held, keys, "left")
    reason = F.when(F.col("occurrences").isNull(), "absent").when(F.col("chosen").isNotNull(), None).when(F.col("all_vendor"), "vendor").otherwise("generated")
    return joined.withColumn("reason", reason)


def closure(edges: DataFrame, rounds: int = 32) -> DataFrame:
    """(a, b): b is reachable from a. Paths double in every round, so rounds grow with the logarithm of the longest."""
    paths = settled(edges.select("a", "b").distinct())
    count = paths.count()
    for _ in range(rounds):
        longer = paths.alias("x").join(paths.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        paths = settled(paths.unionByName(longer).distinct())
        now = paths.count()
        if now == count:
            return paths
        count = now
    raise RuntimeError("the closure did not settle")


def prior_counts(exposures: DataFrame, key: str, order: str) -> DataFrame:
    """Adds ``prior``: exposures of the same key in strictly earlier rows."""
    return exposures.withColumn("prior", F.count("*").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))


def disagreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows, differing rows, and their parts per million rounded down and up."""
    counts = pairs.agg(F.count("*").alias("n"), F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias("k"))
    return counts.select("n", "k", F.expr("k * 1000000 div n").alias("ppm_floor"), F.expr("(k * 1000000 + n - 1) div n").alias("ppm_ceil"))
