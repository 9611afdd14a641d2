"""Cross-site boilerplate removal by distinct-site spread.

Sites of a line are counted by HyperLogLog sketches, one a line hash, which tasks build and the shuffle merges. Lines
whose estimate is near the threshold get an exact distinct count. A line that reaches it goes from every document but
the one with the smallest id, so its text stays in the corpus once. DataFrame functions only.

Lines are what newlines separate, without spaces around; those of fewer than MIN_WORDS words stay. Defined results: a
null source is no site; a null text stays null; a document may end up empty, never missing; repeated rows of one id and
text are one document, and rows without an id never hold the copy that stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import cut, spread_join

MIN_SITES, MIN_WORDS = 8, 4
#: Registers of a sketch, as a power of two; its relative error, three times over.
REGISTERS = 12
ERROR = 3 * 1.04 / 2 ** (REGISTERS / 2)
#: Line hashes up to which they are broadcast (24 bytes each); beyond, lines meet them by a shuffle.
BROADCAST_ROWS = 200_000


def line_hash(line: Column) -> Column:
    """96 bits of a trimmed line, null if it has too few words."""
    bare = F.trim(line)
    return F.when(F.size(F.split(bare, " +")) >= MIN_WORDS, F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b")))


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each distinct long line of each document: its hash, the document's key and id, the site's hash."""
    hashes = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), line_hash), lambda h: h.isNotNull()))
    site = F.when(F.col("source").isNotNull(), F.xxhash64("source"))
    rows = docs.select(*_key(), F.col("doc_id").alias("id"), site.alias("site"), F.explode(hashes).alias("h"))
    return rows.select("k1", "k2", "id", "site", "h.a", "h.b")


def _key() -> tuple[Column, Column]:
    """96 bits that name a document by id and text."""
    return F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2")


def _among(lines: DataFrame, few: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose hash is one of those of ``few``, with the columns of ``few``. However often a line is
    repeated, its rows stay where they are read, or are dealt over several tasks."""
    few = cut(few)
    if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(few), ["a", "b"])
    return spread_join(lines, few.withColumnRenamed("b", "__loomery_b"), "a", ["k1", "k2"]).filter("b = __loomery_b").drop("__loomery_b")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(a, b, first) of each line hash on at least ``min_sites`` sites, ``first`` the smallest id that holds it."""
    lines = _lines(docs)
    sketched = lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(REGISTERS)).alias("sketch"), F.min("id").alias("first"))
    margin = max(1.0, ERROR * min_sites)
    spread = cut(sketched.select("a", "b", "first", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites - margin))
    near = spread.filter(F.col("sites") <= min_sites + margin).select("a", "b")
    exact = _among(lines, near).groupBy("a", "b", "site").agg(F.lit(1).alias("one")).groupBy("a", "b").agg(F.count("site").alias("exact"))
    return spread.join(exact, ["a", "b"], "left").filter(F.coalesce("exact", "sites") >= min_sites).select("a", "b", "first")


def clean(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs``, all columns kept, without boilerplate in ``text``; also ``__loomery_lines`` and ``__loomery_gone``,
    the number of lines before and of those removed."""
    hits = _among(_lines(docs), boilerplate(docs, min_sites)).filter(~F.col("id").eqNullSafe(F.col("first"))).groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("__loomery_drop"))
    hits = hits.select(F.col("k1").alias("__loomery_k1"), F.col("k2").alias("__loomery_k2"), "__loomery_drop")
    first, second = _key()
    keyed = docs.withColumns({"__loomery_k1": first, "__loomery_k2": second})
    # Both sides grow with the corpus, so the join is a shuffle at every size.
    joined = keyed.join(hits.hint("merge"), ["__loomery_k1", "__loomery_k2"], "left")
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda x: ~F.coalesce(F.array_contains(F.col("__loomery_drop"), line_hash(x)), F.lit(False)))
    out = joined.withColumn("__loomery_kept", F.when(F.col("__loomery_drop").isNull(), parts).otherwise(kept))
    before, after = F.coalesce(F.size(parts), F.lit(0)), F.coalesce(F.size("__loomery_kept"), F.lit(0))
    counted = out.withColumns({"__loomery_lines": F.greatest(before, F.lit(0)), "__loomery_gone": F.greatest(before - after, F.lit(0))})
    text = F.when(F.col("__loomery_drop").isNull(), F.col("text")).otherwise(F.array_join("__loomery_kept", "\n"))
    return counted.withColumn("text", text).select(*docs.columns, "__loomery_lines", "__loomery_gone")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the text that stays, of every document."""
    out = clean(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", F.col("__loomery_lines").cast("long").alias("n_lines"), F.col("__loomery_gone").cast("long").alias("n_removed"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def remove_boilerplate(docs: DataFrame) -> DataFrame:
    """The documents, all of them and all columns, without boilerplate lines."""
    return clean(docs).drop("__loomery_lines", "__loomery_gone")
