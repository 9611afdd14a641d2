"""Hash orders, samples, splits, apportionment, interleaving and sequence offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The share of each band's documents that each phase takes.
PHASES = ["grounding", "integration", "reasoning", "specialization"]
SHARES = {
    "foundation": (0.50, 0.25, 0.15, 0.10),
    "composition": (0.20, 0.35, 0.30, 0.15),
    "reasoning": (0.05, 0.20, 0.40, 0.35),
    "specialization": (0.00, 0.05, 0.30, 0.65),
}


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; map tasks keep k of each themselves."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= k)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that two passes over it see the same partitions
    even after executors are lost. The session's spark.checkpoint.dir is used, else a folder in the warehouse."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    return df.checkpoint(eager=True)


def _in_ranges(df: DataFrame, order: list[str], parts: int | None) -> DataFrame:
    """``df`` range-partitioned by ``order``, with the partition's number."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))


def ranked(df: DataFrame, order: list[str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """Adds the 0-based global rank by ``order`` without one task that sees all rows: a range partitioning, ranks inside
    partitions, and offsets from the partitions' counts. Keep ``df`` narrow: it is shuffled and kept once."""
    rows = _in_ranges(df, order, parts)
    sums = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    before = rows.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(sums), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return rows.withColumn("__inside", inside).join(F.broadcast(before), "__part").withColumn(name, F.col("__inside") + F.col("__before")).drop("__part", "__inside", "__before")


def ranked_in_groups(df: DataFrame, group: str, order: list[str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """Adds the 0-based rank inside each ``group`` of few groups with many rows: global ranks less the group's first."""
    out = ranked(df, [group, *order], "__overall", parts)
    sizes = out.groupBy(group).count()
    first = sizes.select(F.col(group).alias("__group"), F.coalesce(F.sum("count").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))  # a row a group
    joined = out.join(F.broadcast(first), F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumn(name, F.col("__overall") - F.col("__first")).drop("__overall", "__group", "__first")


def ntile_of(rank: Column, size: Column, parts: int) -> Column:
    """The part, from 1, of a 0-based rank among ``size`` rows: equal parts, the first ones taking what is left over."""
    whole, rest = F.floor(size / parts), size % parts
    first = rest * (whole + 1)
    return (F.when(rank < first, F.floor(rank / (whole + 1))).otherwise(rest + F.floor((rank - first) / F.greatest(whole, F.lit(1)))) + 1).cast("int")


def running_total(df: DataFrame, order: str | list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows, by two levels of prefix sums."""
    order = [order] if isinstance(order, str) else order
    rows = _in_ranges(df, order, parts)
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    before = rows.groupBy("__part").agg(F.sum(value).alias("s")).select("__part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__inside", inside).join(F.broadcast(before), "__part").withColumn(name, F.col("__inside") + F.col("__before")).drop("__part", "__inside", "__before")


def largest_remainder(counts: DataFrame) -> DataFrame:
    """(band, phase_index, n): each band's ``count`` shared out to phases, the largest fractions rounded up."""
    spark = counts.sparkSession
    shares = spark.createDataFrame([(b, i, s) for b, row in SHARES.items() for i, s in enumerate(row)], "band string, phase_index int, share double")
    exact = counts.join(F.broadcast(shares), "band").withColumn("exact", F.col("count") * F.col("share")).withColumn("whole", F.floor("exact"))
    order = Window.partitionBy("band").orderBy(F.desc(F.col("exact") - F.col("whole")), "phase_index")
    left = F.col("count") - F.sum("whole").over(Window.partitionBy("band"))
    return exact.withColumn("place", F.row_number().over(order)).withColumn("left", left).select("band", "phase_index", (F.col("whole") + (F.col("place") <= F.col("left")).cast("long")).alias("n"))


def bucket(text: Column) -> Column:
    """The hash bucket of a text in the order of its band."""
    return F.pmod(F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long"), F.lit(16))


def phases(df: DataFrame, order: str = "doc_id", salt: str = "loomery-order") -> DataFrame:
    """(``order``, band, bucket, band_rank, phase_index) of documents with ``band`` and ``text`` (or its ``bucket``):
    those of a band, ordered by hash bucket and then by ``order``, fill its phases' shares in turn. Buckets follow one another by the digest of
    ``salt``, band and bucket, so the salt decides the curriculum. Texts stay where they are; join them back by id."""
    # Settled, since a range partitioning reads its rows twice: what a band takes to find is done once.
    narrow = settled(df.select(order, "band", F.col("bucket") if "bucket" in df.columns else bucket(F.col("text")).alias("bucket")))
    key = F.sha2(F.concat_ws(":", F.lit(salt), "band", F.col("bucket").cast("string")).cast("binary"), 256)
    ranks = ranked_in_groups(narrow.withColumn("bucket_key", key), "band", ["bucket_key", order], "band_rank").drop("bucket_key")
    ends = largest_remainder(ranks.groupBy("band").count()).withColumn("stop", F.sum("n").over(Window.partitionBy("band").orderBy("phase_index"))).withColumn("start", F.col("stop") - F.col("n"))
    limits = F.broadcast(ends.select(F.col("band").alias("b"), "phase_index", "start", "stop"))
    out = ranks.join(limits, (F.col("band") == F.col("b")) & (F.col("band_rank") >= F.col("start")) & (F.col("band_rank") < F.col("stop")))
    return out.drop("b", "start", "stop")


def curriculum(df: DataFrame, order: str = "doc_id", salt: str = "loomery-order") -> DataFrame:
    """(``order``, band, phase_index, position): where each document with ``text`` and ``band`` stands in its phase."""
    placed = settled(phases(df, order, salt))
    counts = placed.groupBy("band", "phase_index").agg(F.count("*").alias("n"), F.min("band_rank").alias("start"))
    inside = placed.join(F.broadcast(counts.select("band", "phase_index", "start")), ["band", "phase_index"]).withColumn("k", F.col("band_rank") - F.col("start"))
    return inside.join(interleaved(counts), ["band", "phase_index", "k"]).select(order, "band", "phase_index", "position")


#: Positions of a phase that one task deals out.
BLOCK = 100_000


def interleaved(counts: DataFrame) -> DataFrame:
    """(phase_index, position, band, k): at every position of a phase the band furthest behind its share is next, ties
    to the earlier band; ``counts`` are (band, phase_index, n).

    The recurrence never lets a band fall behind by more than the number of bands, so a block of positions is dealt out
    by a task of its own once the counts at its beginning are known; those are found on the driver, which steps through
    the recurrence by whole periods: if g divides all of a phase's counts, the first 1/g of its positions repeat.
    """
    from math import gcd

    order = list(SHARES)
    table: dict[int, list[int]] = {}
    for row in counts.collect():  # a row a band and phase
        table.setdefault(row["phase_index"], [0] * len(order))[order.index(row["band"])] = row["n"]
    spark, blocks = counts.sparkSession, []
    for phase, target in sorted(table.items()):
        total, periods = sum(target), gcd(*target)
        if not total:
            continue
        period, sent = total // periods, [0] * len(order)
        for start in range(0, period, BLOCK):
            blocks.append((phase, start, min(period, start + BLOCK), total, periods, target, list(sent)))
            if start + BLOCK < period:
                sent = _dealt(target, total, start, start + BLOCK, sent)[1]
    schema = "phase_index int, start long, stop long, total long, periods long, target array<long>, sent array<long>"
    frame = spark.createDataFrame(blocks, schema).repartition(max(1, len(blocks)), "phase_index", "start")

    def deal(batches):
        import pandas as pd

        for batch in batches:
            for b in batch.itertuples():
                chosen, _ = _dealt(list(b.target), b.total, b.start, b.stop, list(b.sent))
                yield pd.DataFrame({"phase_index": b.phase_index, "place": range(b.start, b.stop), "band": [order[i] for i, _ in chosen], "n": [k for _, k in chosen], "total": b.total, "periods": b.periods, "whole": [b.target[i] for i, _ in chosen]})

    first = frame.mapInPandas(deal, "phase_index int, place long, band string, n long, total long, periods long, whole long")
    each = first.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("periods") - 1)))
    place = F.col("place") + F.col("t") * F.expr("total div periods")
    return each.select("phase_index", place.alias("position"), "band", (F.col("n") + F.col("t") * F.expr("whole div periods")).alias("k"))


def _dealt(target: list[int], total: int, start: int, stop: int, sent: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """((band, how many of it before) at each position, how many of each band after them). Shares are compared as whole
    numbers: target * (position + 1) - sent * total."""
    sent, chosen, live = list(sent), [], range(len(target))
    for position in range(start, stop):
        best = max((i for i in live if sent[i] < target[i]), key=lambda i: (target[i] * (position + 1) - sent[i] * total, -i))
        chosen.append((best, sent[best]))
        sent[best] += 1
    return chosen, sent


def sequence_offsets(docs: DataFrame, length: int, order: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """Adds ``offset`` (tokens and one end token of all earlier rows), first and last sequence of each document."""
    sized = docs.withColumn("__n", F.col(tokens) + 1)
    out = running_total(sized, order, "__n", "offset")
    return out.withColumn("first_sequence", F.floor(F.col("offset") / length)).withColumn("last_sequence", F.floor((F.col("offset") + F.col("__n") - 1) / length)).drop("__n")
