"""Streaming twins of stateful operators: deduplication, windows, sessions and running counts.

A finished stream leaves its result and its checkpoint in a folder that all executors share, never on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` as a stream with event time."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")


def folder_of(spark: SparkSession) -> str:
    """A new folder below the session's spark.checkpoint.dir, or the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def finished(out: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a bounded stream to its end and returns its result: of the last batch in ``complete`` mode, else of all. A
    batch that is done again replaces what it had written."""
    spark, folder, seen = out.sparkSession, folder_of(out.sparkSession), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batches/{number}")
        seen.append(number)

    out.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not seen:
        return spark.createDataFrame([], out.schema)
    numbers = [max(seen)] if mode == "complete" else sorted(set(seen))
    return spark.read.schema(out.schema).parquet(*(f"{folder}/batches/{n}" for n in numbers))


def running_counts(events: DataFrame, key: str = "user_id", order: str = "event_id") -> DataFrame:
    """(key, order, event_type, prior): how many events of its key came before each, of a bounded stream run to its end.

    Events of a micro-batch count by ``order`` and after those of earlier ones. What goes from batch to batch is one number
    a key, in a folder; a batch that is done again reads the counts before it and replaces what it had written.
    """
    spark, folder, seen = events.sparkSession, folder_of(events.sparkSession), []
    rows = events.select(key, order, "event_type")
    whole = rows.withColumn("prior", F.lit(0).cast("long")).schema

    def keep(batch: DataFrame, number: int) -> None:
        inside = batch.withColumn("prior", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))
        counts = batch.groupBy(key).agg(F.count("*").alias("__n"))
        earlier = [n for n in seen if n < number]
        if earlier:
            before = batch.sparkSession.read.parquet(f"{folder}/counts/{max(earlier)}")
            known = before.select(F.col(key).alias("__key"), F.col("__n").alias("__before"))
            inside = inside.join(known, F.col(key).eqNullSafe(F.col("__key")), "left").withColumn("prior", F.col("prior") + F.coalesce("__before", F.lit(0)))
            counts = before.unionByName(counts).groupBy(key).agg(F.sum("__n").alias("__n"))
        inside.select(key, order, "event_type", "prior").write.mode("overwrite").parquet(f"{folder}/batches/{number}")
        counts.write.mode("overwrite").parquet(f"{folder}/counts/{number}")
        seen.append(number)

    rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(whole).parquet(*(f"{folder}/batches/{n}" for n in sorted(set(seen)))) if seen else spark.createDataFrame([], whole)


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events and their value by type and window."""
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").cast("string").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: events no more than ``gap`` apart."""
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast("string").alias("start"), "n")


def deduplicated(events: DataFrame) -> DataFrame:
    """The distinct (user, type) pairs of a stream."""
    return events.dropDuplicates(["user_id", "event_type"]).groupBy("event_type").agg(F.count("*").alias("users"))


def for_each_batch(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands every micro-batch to ``sink``. What is done is kept in ``checkpoint``: a restart goes on after it, and hands
    a batch that was under way over again under its number."""
    events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def resumed(records: DataFrame, cursor: int, size: int) -> tuple[DataFrame, int]:
    """(the next ``size`` records by dense ``sequence`` from ``cursor`` on, the cursor after them): a filter, so any batch
    can be made again."""
    return records.filter((F.col("sequence") >= cursor) & (F.col("sequence") < cursor + size)), cursor + size
