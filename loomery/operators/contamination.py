"""Decontamination against benchmark text, and the variants of exact deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions import text as T
from loomery.operators.ordering import settled

# Words and code tokens of a shingle, least characters of a boundary text.
WORD_WIDTH, CODE_WIDTH, LEAST_BOUNDARY = 13, 8, 8
#: Distinct boundary shingles up to which they are broadcast; beyond, both sides are shuffled by shingle.
BROADCAST_ROWS = 500_000


def boundary(texts: DataFrame, column: str = "text", width: int = WORD_WIDTH, code: bool = False) -> DataFrame:
    """Distinct shingles ``g`` of the boundary texts."""
    normal = T.nfkc_casefold(F.col(column))
    tokens = T.code_tokens(normal) if code else T.words(normal)
    return texts.filter(F.length(F.trim(column)) >= LEAST_BOUNDARY).select(tokens.alias("t")).transform(T.exploded, [], T.shingles(F.col("t"), width), "g").distinct()


def overlap_counts(docs: DataFrame, grams: DataFrame, key: str = "doc_id", width: int = WORD_WIDTH, code: bool = False) -> DataFrame:
    """(key, hits): how many distinct shingles of each document lie in the boundary; documents without one are left out."""
    normal = T.nfkc_casefold(F.col("text"))
    tokens = T.code_tokens(normal) if code else T.words(normal)
    each = T.exploded(docs.select(key, tokens.alias("t")), [key], T.shingles(F.col("t"), width), "g")
    small = grams.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return each.join(F.broadcast(grams) if small else grams, "g", "left_semi").groupBy(key).agg(F.count("*").alias("hits"))


def first_occurrence(df: DataFrame, by: Column, order: str) -> DataFrame:
    """Adds ``duplicate``: the key was in an earlier row. A min per key and a join, so a hot key is no single task."""
    keyed = df.withColumn("__key", by)
    least = keyed.groupBy("__key").agg(F.min(order).alias("__first"))
    return keyed.join(least, keyed["__key"].eqNullSafe(least["__key"])).withColumn("duplicate", F.col(order) > F.col("__first")).drop("__key", "__first")


def decontaminate(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Each document with its shingle hits and whether it repeats an earlier text; ``accepted`` if neither."""
    words = overlap_counts(docs, boundary(texts))
    code = overlap_counts(docs, boundary(texts, width=CODE_WIDTH, code=True), width=CODE_WIDTH, code=True).withColumnRenamed("hits", "code_hits")
    normal = docs.select("doc_id", T.nfkc_casefold(F.col("text")).alias("n"))
    named = settled(normal.select("doc_id", F.sha2(F.col("n").cast("binary"), 256).alias("sha")))
    seen = first_occurrence(named, F.col("sha"), "doc_id").select("doc_id", "duplicate")
    joined = docs.join(seen, "doc_id").join(words, "doc_id", "left").join(code, "doc_id", "left").na.fill(0, ["hits", "code_hits"])
    return joined.withColumn("accepted", ~F.col("duplicate") & (F.col("hits") == 0) & (F.col("code_hits") == 0))


def overlap_kind(docs: DataFrame, texts: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, kind): 'exact' if the whole text is a boundary text, 'ngram' if a window is, short texts being one window."""
    normal = T.nfkc_casefold(F.col("text"))
    simple = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    side = texts.select(normal.alias("n")).withColumn("t", simple(F.col("n")))
    grams = T.exploded(side, [], T.shingles(F.col("t"), width, short=True), "g").distinct()
    mine = docs.select("doc_id", normal.alias("n")).withColumn("t", simple(F.col("n")))
    exact = mine.join(side.select("n").distinct(), "n", "left_semi").select("doc_id", F.lit(True).alias("exact"))
    gram = T.exploded(mine, ["doc_id"], T.shingles(F.col("t"), width, short=True), "g").join(grams, "g", "left_semi").select("doc_id", F.lit(True).alias("gram")).distinct()
    out = docs.select("doc_id").join(exact, "doc_id", "left").join(gram, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("exact"), "exact").when(F.col("gram"), "ngram").alias("kind"))
