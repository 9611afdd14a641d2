"""Packing into fixed-length sequences as a cutting-stock problem, solved by column generation.

Every document becomes full pieces of ``LENGTH`` ids and at most one shorter rest. Rests are counted by length class;
the linear program over patterns of classes starts from one pattern a class, a knapsack dynamic program prices new
patterns, and the rounded patterns are handed to the documents ranked within each class. Only the class histogram
(a fixed number of rows) reaches the driver; ids never leave the task that made them.

Defined results: a null text is an empty text, which still has its end id; a repeated row is packed once for each
repeat; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.bpe import PIECES_KEPT, portions
from loomery.llm.common import cut

LENGTH, END_ID = 2048, 1
#: Ids in a length class of the linear program, classes in a sequence, and salts that split a class for ranking.
UNIT, SALTS = 8, 256
CAPACITY = LENGTH // UNIT
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves, the others
    follow in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}


class Tokenizer:
    """Ids of a byte-level BPE vocabulary file, cached by what stands between single spaces."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = byte_of_letter()
        self.special = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in model["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, k)): v for k, v in model["model"]["vocab"].items() if k not in self.special}
        self.core = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for data, i in ranks.items():
            self.sizes[i] = len(data)
        self.chunks: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.core.encode_ordinary(text), "<u4").tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """A space before anything but white space always begins a piece, so chunks encode alike alone and joined."""
        if len(self.chunks) > PIECES_KEPT:
            self.chunks.clear()
        missing = list(chunks - self.chunks.keys())
        if missing:
            ids = np.array(self.core.encode_ordinary(" " + " ".join(missing)), "<u4")
            ends = np.cumsum(np.fromiter((len(x.encode()) + 1 for x in missing), np.int64, len(missing)))
            stops = (4 * (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1)).tolist()
            flat = ids.tobytes()
            self.chunks.update((x, flat[a:b]) for x, a, b in zip(missing, [0, *stops], stops, strict=False))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cuts = [text.split(" ") for text in texts]
        seen = set().union(*(x[1:] for x in cuts))
        odd = {x for x in seen if not x or x[0].isspace()}
        self._learn(seen - odd)
        of = self.chunks.__getitem__
        for text, (head, *rest) in zip(texts, cuts, strict=True):
            if odd.isdisjoint(rest) and not any(x in text for x in self.special):
                yield self._plain(head) + b"".join(map(of, rest))
            else:
                parts = [text]
                for name in self.special:
                    parts = [y for x in parts for y in ([x] if x in self.special else _kept(x, name))]
                yield b"".join(self.special.get(x) or self._plain(x) for x in parts)


def _kept(text: str, name: str) -> list[str]:
    """``text`` split at ``name``, which stays as an item."""
    return [y for x in text.split(name) for y in (x, name)][:-1]


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer for each file in each Python worker."""
    return Tokenizer(path)


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """One row for each piece of every document."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = tokenizer(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            rows, at = [], 0
            for part in portions([x or "" for x in batch.column(1).to_pylist()]):
                for data in coder.encode(part):
                    data += end
                    n = len(data) // 4
                    rows += [(ids_of[at], i, min(LENGTH, n - i), zlib.crc32(data[4 * i : 4 * (i + LENGTH)]), n) for i in range(0, n, LENGTH)]
                    at += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_up, PIECE_SCHEMA)


def priced(duals: np.ndarray) -> tuple[float, np.ndarray]:
    """The pattern of greatest dual value that fits (unbounded knapsack over classes 1..CAPACITY), and that value."""
    best = np.zeros(CAPACITY + 1)
    took = np.zeros(CAPACITY + 1, np.int64)
    for room in range(1, CAPACITY + 1):
        values = best[room - 1 :: -1] + duals[:room]
        took[room] = values.argmax()
        best[room] = values[took[room]]
    pattern, room = np.zeros(CAPACITY, np.int64), CAPACITY
    while room > 0 and best[room] > 0:
        pattern[took[room]] += 1
        room -= took[room] + 1
    return best[CAPACITY], pattern


def greedy(demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A first basis: patterns filled longest first from what is left, each repeated until a class of it runs out,
    which no later pattern holds, so that the columns are independent."""
    left, columns, level = demand.copy(), [], []
    open_classes = np.flatnonzero(demand)
    while len(open_classes):
        room, pattern = CAPACITY, np.zeros(CAPACITY)
        for k in open_classes[::-1]:
            pattern[k] = room // (k + 1)
            room -= pattern[k] * (k + 1)
        held = np.flatnonzero(pattern)
        out = held[(left[held] / pattern[held]).argmin()]
        times = left[out] / pattern[out]
        left = np.maximum(left - times * pattern, 0)
        columns.append(pattern)
        level.append(times)
        open_classes = open_classes[open_classes != out]
    return np.array(columns).T, np.array(level)


def patterns(demand: np.ndarray, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """(pattern, how often) covering ``demand``, the number of rests of each class 1..CAPACITY.

    Column generation by a revised simplex method; the optimum is rounded down and what is left over packed by first
    fit, longest first. It stops early only at a basis that already covers the demand.
    """
    used = np.flatnonzero(demand)
    if not len(used):
        return []
    basis, level = greedy(demand.astype(float))
    basis = basis[used]
    inverse = np.linalg.inv(basis)
    duals = np.full(CAPACITY, -1.0)
    for step in range(rounds):
        duals[used] = inverse.sum(0)
        value, pattern = priced(duals)
        if value <= 1 + 1e-7:
            break
        column = pattern[used].astype(float)
        move = inverse @ column
        up = move > 1e-9
        ratios = np.where(up, level / np.where(up, move, 1), np.inf)
        out = int(ratios.argmin())
        basis[:, out] = column
        level -= ratios[out] * move
        level[out] = ratios[out]
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
            level = inverse @ demand[used]
        else:
            inverse[out] /= move[out]
            others = np.arange(len(used)) != out
            inverse[others] -= np.outer(move[others], inverse[out])
        level = np.maximum(level, 0)
    found: Counter[tuple[int, ...]] = Counter()
    left = demand.astype(np.int64).copy()
    for j in np.argsort(-level, kind="stable"):
        whole = np.zeros(CAPACITY, np.int64)
        whole[used] = np.round(basis[:, j]).astype(np.int64)
        times = min(int(level[j] + 1e-6), *(int(left[k] // whole[k]) for k in np.flatnonzero(whole)))
        if times:
            found[tuple(whole)] += times
            left -= times * whole
    room: list[int] = []
    bins: list[np.ndarray] = []
    for k in np.flatnonzero(left)[::-1]:
        for _ in range(left[k]):
            at = next((i for i, r in enumerate(room) if r > k), None)
            if at is None:
                at = len(room)
                room.append(CAPACITY)
                bins.append(np.zeros(CAPACITY, np.int64))
            room[at] -= k + 1
            bins[at][k] += 1
    for x in bins:
        found[tuple(x)] += 1
    return [(np.array(x), n) for x, n in found.items()]


def pack(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece of every document."""
    spark = docs.sparkSession
    kept = cut(pieces(docs, path).withColumn("class", F.ceil(F.col("length") / UNIT).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int")))
    # A full piece and a rest that needs a whole sequence are alike.
    demand = np.zeros(CAPACITY, np.int64)
    for row in kept.groupBy("class").count().collect():
        demand[row["class"] - 1] = row["count"]
    blocks, ends, base = [], Counter(), 0
    for pattern, times in patterns(demand):
        slot = 0
        for k in np.flatnonzero(pattern)[::-1].tolist():
            each = int(pattern[k])
            blocks.append((k + 1, ends[k], ends[k] + times * each, each, base, slot))
            ends[k] += times * each
            slot += each
        base += times
    # A fixed number of classes and patterns bounds the rows of this table.
    block = spark.createDataFrame(blocks, "class int, first long, stop long, each int, base long, slot int")
    sums = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = kept.groupBy("class", "salt").count().select("class", "salt", F.coalesce(F.sum("count").over(sums), F.lit(0)).alias("before"))
    order = Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = kept.withColumn("rank", F.row_number().over(order)).join(F.broadcast(before), ["class", "salt"]).withColumn("rank", F.col("rank") + F.col("before") - 1)
    placed = ranked.join(F.broadcast(block), (ranked["class"] == block["class"]) & F.col("rank").between(F.col("first"), F.col("stop") - 1)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("slot") + F.pmod(F.col("rank") - F.col("first"), F.col("each"))).alias("slot"),
    )
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).drop("slot")
