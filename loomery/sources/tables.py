"""Scans with explicit schemas, JSON-lines documents, and sinks that refuse to overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked(df: DataFrame, columns: set[str], exact: bool = False) -> DataFrame:
    """``df`` if it has the columns (and, with ``exact``, no others)."""
    missing, more = columns - set(df.columns), set(df.columns) - columns
    if missing or (exact and more):
        raise ValueError(f"columns differ: missing {sorted(missing)}, unexpected {sorted(more) if exact else []}")
    return df


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a JSON-lines file; blank lines are skipped, what does not parse is a reject."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    whole = F.col("row").isNotNull() & F.try_parse_json("value").isNotNull()
    return parsed.filter(whole).select("row.*"), parsed.filter(~F.coalesce(whole, F.lit(False))).select("value")


def write_once(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes ``df``; an existing output is an error and a failed write leaves no finished folder."""
    df.write.mode("errorifexists").format(kind).save(path)
