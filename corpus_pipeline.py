"""From raw documents to packed sequences, one operator a stage.

Every stage takes and returns whole tables and defines its results for odd rows. Null and empty texts, and texts without a
letter, have no language and go in the first stage. Rows without an id count as an empty id wherever an id is hashed, and
a row without an id stays only if no document with one is like it. Repeated rows are judged alike; of similar documents
the one with the smallest id stays. Other columns, whatever their names, pass through all stages but the last. Empty
tables give empty results, and without labels no document is toxic.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomery.llm import jaccard, langid, linededup, packing, toxicity
from loomery.llm.common import shared_folder, table, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return langid.keep_identified(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many sites share."""
    return linededup.remove_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return jaccard.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("packing", packed),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


#: Bytes of a row group between stages: writers hold no more than that.
ROW_GROUP = 16 << 20


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of whatever file system it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)  # nothing reads it any more
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
