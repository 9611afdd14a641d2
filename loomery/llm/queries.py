"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomery.llm import bpe, jaccard, langid, linededup, lm, media, neighbours, oracles, packing, toxicity, urlrules
from loomery.llm.common import table, tokenizer_path


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-probability of every text."""
    return lm.predict(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text."""
    return langid.predict(table(spark, sf_dir, "documents"))


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an MPEG audio stream, read back."""
    return media.digests(table(spark, sf_dir, "documents"))


#: (verdict, host, beginning of the path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    return urlrules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of similar documents that each document is in."""
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every text."""
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of every document lies."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found to every fiftieth."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What boilerplate removal takes from every text."""
    return linededup.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return {f.__name__: f for f in (op1_lm_scoring, op2_language_id, op3_mpeg_audio, op4_url_filters, op5_jaccard_join, op6_toxicity, op7_byte_bpe, op8_packing, op9_nearest_neighbours, op10_line_dedup)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that SQL expresses."""
    return {"op4_url_filters": oracles.OP4, "op10_line_dedup": oracles.OP10}
