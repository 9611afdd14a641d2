"""Packed token streams: phase budgets, fixed-length records, segment starts, masks, ledgers, binary shards.

A document is its token ids and an end token (END). Documents of a phase follow one another; the phase has a budget of
whole sequences, the document that crosses its end is cut there and later ones are left out. Pieces of documents, not
single tokens, are what is shuffled to sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.operators.ordering import running_total, settled

#: Id of the token that ends a document.
END = 0


def utf8_increments(text: Column) -> Column:
    """Bytes that each word token adds, with the white space before it (and, for the last, after it): they sum up to the
    whole text's."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\s*\S+(?:\s+$)?|^\s+$"), F.lit(0)), F.octet_length)


def words(text: Column) -> Column:
    """Words by white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_ids(text: Column, vocabulary: int) -> Column:
    """A stand-in tokenizer: words by white space, ids from their digests, END left out."""
    ids = lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 7), 16, 10).cast("long") % (vocabulary - 1) + 1).cast("int")
    return F.transform(words(text), ids)


def budgeted(docs: DataFrame, targets: dict[int, int], length: int, order: str = "doc_id") -> DataFrame:
    """(phase, order, tokens or how many, ``n_tokens``, ...) with ``start``, the place of each document in its phase, ``kept``, how many of its
    tokens and end fit in, ``cut`` (some did not) and ``skipped`` (none did)."""
    sized = running_total(docs.withColumn("__n", ((F.col("n_tokens") if "n_tokens" in docs.columns else F.size("tokens")) + 1).cast("long")), ["phase", order], "__n", "__all")
    spark = docs.sparkSession
    base = sized.groupBy("phase").agg(F.min("__all").alias("__base"))  # a row a phase
    room = spark.createDataFrame([(p, t * length) for p, t in targets.items()], "phase long, __room long")
    out = sized.join(F.broadcast(base), "phase").join(F.broadcast(room), "phase").withColumn("start", F.col("__all") - F.col("__base"))
    kept = F.greatest(F.lit(0), F.least("__n", F.col("__room") - F.col("start")))
    return out.withColumn("kept", kept).withColumns({"cut": (F.col("kept") < F.col("__n")) & (F.col("kept") > 0), "skipped": F.col("kept") == 0}).drop("__n", "__all", "__base", "__room")


def pieces(packed: DataFrame, targets: dict[int, int], length: int, order: str = "doc_id") -> DataFrame:
    """(sequence, offset, ids, phase, order): what each document puts into each sequence; sequences count on from phase to
    phase."""
    spark = packed.sparkSession
    firsts, total = [], 0
    for phase in sorted(targets):
        firsts.append((phase, total))
        total += targets[phase]
    first = spark.createDataFrame(firsts, "phase long, __first long")
    whole = F.slice(F.concat("tokens", F.array(F.lit(END))), F.lit(1), F.col("kept").cast("int"))
    rows = packed.filter("kept > 0").join(F.broadcast(first), "phase").withColumn("__ids", whole)
    each = rows.withColumn("__s", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("kept") - 1) / length))))
    begin, end = F.greatest(F.col("start"), F.col("__s") * length), F.least(F.col("start") + F.col("kept"), (F.col("__s") + 1) * length)
    ids = F.slice("__ids", (begin - F.col("start") + 1).cast("int"), (end - begin).cast("int"))
    return each.select((F.col("__first") + F.col("__s")).alias("sequence"), (begin - F.col("__s") * length).alias("offset"), ids.alias("ids"), "phase", order)


def records(parts: DataFrame, length: int) -> DataFrame:
    """(sequence, tokens, starts, segments, mask) of every full sequence. A segment is a piece; a position's target is
    valid if the next position is of the same segment."""
    held = parts.groupBy("sequence").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))  # length bounds it
    flat = lambda f: F.flatten(F.transform("p", f))
    size = lambda x: F.size(x["ids"])
    out = held.select(
        "sequence",
        flat(lambda x: x["ids"]).alias("tokens"),
        flat(lambda x: F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), size(x) - 1))).alias("starts"),
        flat(lambda x, i: F.array_repeat(i, size(x))).alias("segments"),
        flat(lambda x: F.concat(F.array_repeat(F.lit(True), size(x) - 1), F.array(F.lit(False)))).alias("mask"),
    )
    return out.filter(F.size("tokens") == length)


def start_bits(starts: Column, length: int) -> Column:
    """The starts as bytes, the first position in the lowest bit."""
    one = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda a, k: a + F.when(F.coalesce(F.get(starts, i * 8 + k), F.lit(False)), F.pow(F.lit(2), k).cast("int")).otherwise(0))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(-(-length // 8) - 1)), lambda i: F.lpad(F.hex(one(i)), 2, "0")), ""))


def starts_of(bits: Column, length: int) -> Column:
    """The starts that ``bits`` hold; null if the bytes are not as many as they must be, the first position does not
    begin a segment, or padding is set."""
    byte = lambda i: F.conv(F.hex(F.substring(bits, (i / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.lit(-(-length // 8) * 8 - 1)), lambda i: byte(i).bitwiseAND(F.pow(F.lit(2), i % 8).cast("int")) > 0)
    sound = (F.octet_length(bits) == -(-length // 8)) & F.get(every, F.lit(0)) & ~F.exists(F.slice(every, length + 1, 8), lambda x: x)
    return F.when(sound, F.slice(every, 1, length))


def record_bytes(tokens: Column) -> Column:
    """Tokens as little-endian unsigned 32-bit integers."""
    return F.unhex(F.array_join(F.transform(tokens, lambda t: _swapped(F.lpad(F.hex(t), 8, "0"))), ""))


def _swapped(hexed: Column) -> Column:
    return F.concat(*(F.substring(hexed, i, 2) for i in (7, 5, 3, 1)))


def shards(rows: DataFrame, per_shard: int, length: int) -> DataFrame:
    """(shard, first, stop, payload): ``per_shard`` records a shard, their tokens one after the other, then their bits."""
    coded = rows.select(F.floor(F.col("sequence") / per_shard).alias("shard"), "sequence", record_bytes(F.col("tokens")).alias("t"), start_bits(F.col("starts"), length).alias("b"))
    held = coded.groupBy("shard").agg(F.min("sequence").alias("first"), (F.max("sequence") + 1).alias("stop"), F.sort_array(F.collect_list(F.struct("sequence", "t", "b"))).alias("x"))
    joined = lambda f: F.array_join(F.transform("x", lambda r: F.hex(r[f])), "")
    return held.select("shard", "first", "stop", F.unhex(F.concat(joined("t"), joined("b"))).alias("payload"))


def scanned(payloads: DataFrame, length: int) -> DataFrame:
    """(sequence, tokens, starts) of fixed-stride records, read back from shards."""
    wide, narrow = 4 * length, -(-length // 8)
    n = F.col("stop") - F.col("first")
    rows = payloads.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("n", n)
    cut = lambda at, size: F.substring(F.col("payload"), (at + 1).cast("int"), F.lit(size))
    parts = rows.select((F.col("first") + F.col("i")).alias("sequence"), cut(F.col("i") * wide, wide).alias("t"), cut(F.col("n") * wide + F.col("i") * narrow, narrow).alias("b"))
    token = lambda k: F.conv(_swapped(F.hex(F.substring(F.col("t"), k * 4 + 1, F.lit(4)))), 16, 10).cast("int")
    return parts.select("sequence", F.transform(F.sequence(F.lit(0), F.lit(length - 1)), token).alias("tokens"), starts_of(F.col("b"), length).alias("starts"))


def looked_up(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose ``sequence`` is wanted, by a join on it."""
    return rows.join(wanted.select("sequence").distinct(), "sequence", "left_semi")


def ranges_of(rows: DataFrame, limits: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with ``name`` of the half-open range [start, stop) of ``limits``, a row a phase or shard, that holds
    ``value``."""
    return rows.join(F.broadcast(limits.select(F.col("start").alias("__a"), F.col("stop").alias("__b"), name)), (F.col(value) >= F.col("__a")) & (F.col(value) < F.col("__b")), "left").drop("__a", "__b")


def prefix_ledger(parts: DataFrame, prefixes: list[int]) -> DataFrame:
    """(prefix, phase, tokens, documents): what the first ``prefix`` sequences hold."""
    limits = parts.sparkSession.createDataFrame([(p,) for p in prefixes], "prefix long")
    sums = settled(parts.groupBy("phase", "sequence").agg(F.sum(F.size("ids")).alias("tokens"), F.count_if(F.col("ids")[F.size("ids") - 1] == END).alias("ended")))
    return sums.join(F.broadcast(limits), F.col("sequence") < F.col("prefix")).groupBy("prefix", "phase").agg(F.sum("tokens").alias("tokens"), F.sum("ended").alias("documents"))


def token_usage(docs: DataFrame) -> DataFrame:
    """(token, n): how often each id occurs."""
    return docs.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def contiguous(index: DataFrame, group: str, offset: str = "offset", size: str = "length") -> DataFrame:
    """``index`` with ``joins``: whether each entry begins where the one before it in its group ends, the first at 0."""
    order = Window.partitionBy(group).orderBy(offset, size)
    return index.withColumn("joins", F.col(offset) == F.coalesce(F.lag(F.col(offset) + F.col(size)).over(order), F.lit(0)))


def stream_faults(rows: DataFrame, length: int, vocabulary: int) -> DataFrame:
    """One row of invariants over all records: dense sequences, full length, ids below the vocabulary, a start first."""
    return rows.agg(
        F.count("*").alias("records"),
        ((F.max("sequence") + 1 == F.count("*")) & (F.min("sequence") == 0) & (F.count_distinct("sequence") == F.count("*"))).alias("dense"),
        F.bool_and(F.size("tokens") == length).alias("full"),
        (F.max(F.array_max("tokens")) < vocabulary).alias("known"),
        F.bool_and(F.col("starts")[0]).alias("started"),
        F.sum(F.size(F.filter("mask", lambda x: x))).alias("targets"),
        F.sum(F.array_max("segments") + 1).alias("segments"),
    )
