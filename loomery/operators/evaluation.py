"""Paired comparison of evaluation arms: accuracy, intervals, gates, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators.decisions import resampled_sums

#: Fixed value: the normal quantile of a two-sided 95 % interval.
NORMAL = 1.959963984540054


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both arms with the difference of their 0/1 ``correct``."""
    return a.select(*keys, F.col("correct").alias("a")).join(b.select(*keys, F.col("correct").alias("b")), keys).withColumn("delta", F.col("a") - F.col("b"))


def accuracy(rows: DataFrame, by: str) -> DataFrame:
    """Correct, rows and accuracy by domain and, with a null domain, over all."""
    return rows.rollup(by).agg(F.sum("correct").alias("correct"), F.count("*").alias("rows")).withColumn("accuracy", F.col("correct") / F.col("rows"))


def interval(pairs: DataFrame) -> DataFrame:
    """Mean difference with its normal interval."""
    stats = pairs.agg(F.avg("delta").alias("mean"), F.var_samp("delta").alias("v"), F.count("*").alias("n"))
    half = NORMAL * F.sqrt(F.col("v") / F.col("n"))
    return stats.select("n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def bootstrap(pairs: DataFrame, key: str, stratum: str, replicates: int = 200) -> DataFrame:
    """(replicate, mean): resampled means within strata, drawn by hashes of (replicate, stratum, slot)."""
    sums = resampled_sums(pairs, stratum, key, replicates, {"sum": F.col("delta"), "known": F.col("delta").isNotNull().cast("int")})
    return sums.groupBy("replicate").agg((F.sum("sum") / F.sum("known")).alias("mean"))
