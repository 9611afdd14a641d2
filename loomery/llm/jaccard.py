"""Exact Jaccard join of documents on word shingles, by universe partition and the pigeonhole principle.

A document's set holds the 64-bit hashes of its distinct SIZE-word shingles. The hash space is split into m segments,
m chosen by size band; sets of similarity THRESHOLD or more differ in at most H = (a + b) / 9 shingles. A set is indexed
in its own band and in the next smaller one if a partner may be there. Bands are allocated by cost (``plan``): small
sets have few shingles, so their segments get a threshold of one (each segment and its one-deletion neighbourhoods are
signatures, half as many segments suffice, hardly any is empty); larger sets get a threshold of zero (segments alone).
Each threshold v counts v + 1 towards the H + 1 that the pigeonhole principle asks for, so segments beyond that may be
left out: those whose signature more than COMMON sets share. A set that has not enough others is short, and short sets
also meet on common signatures, the rarest first. Two similar sets always meet: in a cheap segment, or both are short.

Sets that meet are not all paired. Each group has a hub, the set that shares most; all others are held against it, and
links give components. Only where a group still spans several, its members meet again: in groups of up to LARGE sets
directly; in larger ones by what they differ in from the hub. Two members that are not both close to the hub and are
similar to each other share a known number of these differences, so they meet on one of the first of them (a prefix
filter over differences, in an order that begins with what the hub has not, which few members share). Groups that are large even so have hubs of their own, and so on.

Pairs are first tested by a parity bitmap, whose differing bits bound the symmetric difference from below, then exactly.

Defined results: equal sets are one node from the start; null texts and texts without words have no set and link with
nothing; nodes are known by a 64-bit sum of mixed hashes beside their size. Repeated rows are one node; a null id never
names a component that has another. ``keep_one`` keeps, of each component, the rows of the smallest id (and, of these, of
the smallest text hash): rows that repeat that id and text stay together, and rows without an id stay only if their
whole component has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.common import cut, slices, spread_join, written
from loomery.llm.components import components

SIZE, PERCENT = 5, 80
#: Sets that share a signature before it counts as common; largest group whose members are paired directly.
COMMON, LARGE = 32, 128
#: Bytes whose words are hashed at once.
BLOCK = 1 << 18
#: Rows up to which ids of documents to be read again are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Most rounds of hubs. Pairs a member up to which a group of members that share a difference from their hub is paired,
#: rather than given a hub of its own; as many a row of the index are paired without another round.
ROUNDS, PAIRS_EACH = 6, 64
U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
SIGNS = _mixed(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
#: An odd number and its inverse modulo 2 ** 64.
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)


class _Powers:
    """Powers of BASE and of its inverse, as many as the longest block has bytes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up, self.down = (np.concatenate([x, x * U(pow(r, k, 1 << 64))]) for x, r in ((self.up, BASE), (self.down, INVERSE)))
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, words of each text); A-Z count as a-z. A word's hash is a polynomial in BASE over
    random values of its bytes, read off running sums."""
    coded = [(text or "").encode("utf-8", "surrogatepass").lower() for text in texts]
    data = np.frombuffer(b" " + b" ".join(coded) + b" ", np.uint8)
    gap = SPACE[data]
    start, end = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK, "right")))
        low, high = int(start[at]), int(end[stop - 1])
        up, down = POWERS.upto(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(SIGNS[data[low:high]] * up[:-1], out=sums[1:])
        begin = start[at:stop] - low
        out[at:stop] = _mixed((sums[end[at:stop] - low] - sums[begin]) * down[begin])
        at = stop
    bounds = np.cumsum([1, *(len(x) + 1 for x in coded)])
    return out, np.diff(np.searchsorted(start, bounds))


def shingled(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of fewer than SIZE words, one hash of them all."""
    hashes, counts = word_hashes(texts)
    whole = _rolled(hashes, SIZE)
    out = []
    for end, n in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True):
        if n >= SIZE:
            out.append(_distinct(np.sort(whole[end - n : end - SIZE + 1])))
        else:
            out.append(_rolled(hashes[end - n : end], n) if n else np.zeros(0, np.uint64))
    return out


def _distinct(values: np.ndarray) -> np.ndarray:
    return values[np.append(True, values[1:] != values[:-1])]


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    n = max(0, len(hashes) - width + 1)
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total = _mixed(total + hashes[i : i + n])
    return total


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return shingled([text])[0]


def node_of(values: np.ndarray) -> int:
    """A set's 64-bit name."""
    return int((_mixed(values ^ U(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + U(len(values))).astype(np.int64))


def _bands() -> list[tuple[int, int]]:
    out, low = [], 1
    while low < 1 << 40:
        high = max(low, low * 3 // 2)
        out.append((low, high))
        low = high + 1
    return out


BANDS = _bands()
HIGHS = np.array([high for _, high in BANDS])
#: Greatest set of the bands whose segments get a threshold of one.
SMALL = 60


def plan(high: int) -> tuple[int, bool]:
    """(segments, do they get a threshold of one) of a band of sets of at most ``high`` shingles.

    A threshold of one writes a signature a shingle besides those of the segments; it is the cheaper one where the many
    segments that a threshold of zero needs would often be empty, that is to say, shared by sets of no likeness.
    """
    differ = high // 4
    if high <= SMALL:
        return (differ + 2) // 2 + 1, True
    return differ + 1 + high // 48 + 2, False


def signatures(values: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(signatures, spare * 4 + role * 2 + whether the threshold is one) of a set in its own band (role 0) and the next
    smaller one (role 1); ``spare`` is the number of its segments that may be left out, negative if it is short of filled
    ones."""
    n = len(values)
    band = int(np.searchsorted(HIGHS, n))
    roles = [(band, n // 4, 0)]
    if band and -(-4 * n // 5) <= BANDS[band - 1][1]:
        roles.append((band - 1, (n + BANDS[band - 1][1]) // 9, 1))
    for k, differ, role in roles:
        if not differ:  # only equal sets are that similar, and those are one node
            continue
        m, one = plan(BANDS[k][1])
        place = ((values >> U(32)) * U(m) >> U(32)).view(np.int64)  # in order, as the values are
        mixed = _mixed(values + U(k))
        first = np.append(0, np.flatnonzero(place[1:] != place[:-1]) + 1)
        filled, content = place[first], np.add.reduceat(mixed, first)
        tag = _mixed(filled.astype(np.uint64) + U(k << 40))
        out = [_mixed(content ^ tag)]
        spare = m - (differ + 2) // 2 if one else len(filled) - differ - 1
        if one:
            owner = np.repeat(np.arange(len(filled)), np.diff(first, append=n))
            out.append(_mixed((content[owner] - mixed) ^ tag[owner]))
        if one or spare < 0:
            empty = np.setdiff1d(np.arange(m), filled).astype(np.uint64)
            out.append(_mixed(_mixed(empty + U(k << 40))))
        yield np.concatenate(out), max(-(1 << 24), min(1 << 24, spare)) * 4 + role * 2 + one


def bitmap(values: np.ndarray) -> bytes:
    """Parities of the shingles that fall on each of a power of two of bits, about as many as shingles."""
    bits = 1 << max(6, int(len(values) - 1).bit_length())
    counts = np.bincount((values & U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(n: int, a: bytes, m: int, b: bytes) -> bool:
    """False only if the two sets cannot be similar enough."""
    if min(n, m) * 100 < PERCENT * max(n, m):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * 9 <= n + m


def similar(a: bytes, b: bytes) -> bool:
    """Whether 100 * intersection >= PERCENT * union."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Runs of rows, few or of few characters, and the sets of their texts."""
    for batch in batches:
        for part in slices(batch, "text"):
            yield part, shingled(part.column("text").to_pylist())


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, n and node of every document; n is 0 and node null without words."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches):
            n, node = [len(x) for x in sets], [node_of(x) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), pa.array(n, pa.int64()), pa.array(node, pa.int64())], ["doc_id", "hash", "n", "node"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").mapInArrow(named, "doc_id long, hash long, n long, node long")


def index(docs: DataFrame) -> DataFrame:
    """(sig, node, spare) rows of every set; a task indexes equal sets once."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def out() -> pa.RecordBatch:
            counts = [len(s) for s, _, _ in held]
            columns = [np.concatenate([s for s, _, _ in held]).view(np.int64), np.repeat([x for _, x, _ in held], counts), np.repeat(np.array([w for _, _, w in held], np.int32), counts)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "node", "spare"])

        for x in chain.from_iterable(sets for _, sets in _sets(batches)):
            if not len(x) or (node := node_of(x)) in seen:
                continue
            seen.add(node)
            for sig, spare in signatures(x):
                held.append((sig, node, spare))
                size += len(sig)
            if size > 100_000:
                yield out()
                size = 0
        if held:
            yield out()

    return docs.select("text").mapInArrow(indexed, "sig long, node long, spare int")


def meetings(docs: DataFrame) -> DataFrame:
    """(sig, node, many) rows of the groups in which sets have to be compared: at least two nodes each."""
    together = Window.partitionBy("sig")
    rows = index(docs).withColumns({"many": F.count("*").over(together), "low": F.min("node").over(together), "high": F.max("node").over(together)})
    shared = written(rows.filter("low <> high").select("sig", "node", "spare", "many"))
    is_common = F.col("many") > COMMON
    of_set = Window.partitionBy("node", "spare")
    common = shared.filter(is_common).dropDuplicates(["node", "spare", "sig"]).withColumns({"count": F.count("*").over(of_set), "rank": F.row_number().over(of_set.orderBy("many", "sig"))})
    may = F.shiftright("spare", 2)
    # With a threshold of zero, the H + 1 rarest signatures are enough: similar sets then meet on the rarest they share.
    needed = (F.col("count") > may) & ((F.col("rank") <= F.col("count") - may) | (F.col("spare").bitwiseAND(F.lit(1)) == 1))
    kept = shared.filter(~is_common).select("sig", "node", "many").unionByName(common.filter(needed).select("sig", "node", "many"))
    return kept.groupBy("sig", "node").agg(F.max("many").alias("many"))


SKETCH = [f"b{i}" for i in range(8)]


def sketch(values: np.ndarray) -> np.ndarray:
    """Parities of the shingles that fall on each of 512 bits, as eight integers."""
    return np.packbits((np.bincount((values & U(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def documents_of(docs: DataFrame, named: DataFrame, nodes: DataFrame) -> DataFrame:
    """The text of one document of each of ``nodes``."""
    wanted = cut(named.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("wanted")).select("wanted").distinct())
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    source = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return source.join(F.broadcast(wanted) if small else wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("text")


def profiles(texts: DataFrame) -> DataFrame:
    """node, n, bits and sketch of the set of each text."""

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _sets(batches):
            sets = [x for x in held if len(x)]
            eight = np.array([sketch(x) for x in sets], np.int64).reshape(-1, 8).T
            columns = [pa.array([node_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([bitmap(x) for x in sets], pa.binary()), *map(pa.array, eight)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "bits", *SKETCH])

    return written(texts.mapInArrow(profiled, "node long, n long, bits binary, " + ", ".join(f"{b} long" for b in SKETCH)))


def values_of(texts: DataFrame) -> DataFrame:
    """node and values, the whole set, of each text."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _sets(batches):
            sets = [x for x in held if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "values"])

    return texts.mapInArrow(listed, "node long, values binary")


def with_both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (u, v), cut, with the columns of both nodes, as u_... and v_...; a node may be in most of the pairs."""
    out = pairs
    for name, other in ("uv", "vu"):
        side = table.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))
        out = spread_join(out, side, name, [other], counted=pairs)
    return out.select("u", *(f"u_{c}" for c in columns), "v", *(f"v_{c}" for c in columns))


def verified(pairs: DataFrame, held: DataFrame, docs: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough; whole sets are made again for those that ``held`` leaves open."""

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("u_n", "u_bits", "v_n", "v_bits")), strict=True)
            yield batch.select(["u", "v"]).filter(pa.array([may_be_similar(*row) for row in rows], pa.bool_()))

    def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("u_values"), batch.column("v_values"), strict=True)
            yield batch.select(["u", "v"]).filter(pa.array([similar(a.as_py(), b.as_py()) for a, b in rows], pa.bool_()))

    rough = with_both(pairs, held, "n", "bits")
    likely = cut(rough.mapInArrow(tested, "u long, v long"))
    nodes = likely.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = values_of(documents_of(docs, named, nodes))
    whole = with_both(likely, sets, "values")
    return whole.mapInArrow(proved, "u long, v long").distinct()


def differences(large: DataFrame, docs: DataFrame, named: DataFrame) -> DataFrame:
    """(sig, node, kind, many, pairs): the members of ``large`` groups (hub, node) by what they differ in from their hub.

    Let x and y have the differences X and Y from their hub h and let y be far from h, that is |Y| > (|y| + |h|) / 9.
    If x and y are similar, X and Y share at least (|X| + |Y| - (|x| + |y|) / 9) / 2 differences, more than
    (9|X| + |h| - |x|) / 18 of those of x. So, in any one order, both have one of the shared differences among their
    first: x among all but that many, y, if x is not far, among |y| / 4 + 1. ``kind`` is 0 for members near their hub, 1
    for far ones on a difference that would be enough for x, 2 on the others.
    """
    met = cut(large.select("hub", "node").distinct())
    nodes = met.select("node").unionByName(met.select(F.col("hub").alias("node"))).distinct()
    sets = values_of(documents_of(docs, named, nodes)).dropDuplicates(["node"])
    both = spread_join(met.join(sets, "node"), sets.select(F.col("node").alias("hub"), F.col("values").alias("center")), "hub", ["node"], counted=met)

    def differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                kinds, what = [], []
                for a, b in zip(part.column("values"), part.column("center"), strict=True):
                    x, h = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                    apart = np.concatenate([np.setdiff1d(x, h, assume_unique=True), np.setdiff1d(h, x, assume_unique=True)])
                    far = 9 * len(apart) > len(x) + len(h)
                    enough = len(apart) - (9 * len(apart) + len(h) - len(x)) // 18
                    what.append(apart[: max(enough, len(x) // 4 + 1) if far else enough])
                    kinds.append(np.where(np.arange(len(what[-1])) < enough, 1, 2) if far else np.zeros(len(what[-1]), np.int64))
                counts = [len(x) for x in what]
                columns = [np.repeat(part.column(c).to_numpy(), counts) for c in ("hub", "node")] + [np.concatenate(what).view(np.int64), np.concatenate(kinds).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hub", "node", "what", "kind"])

    rows = both.select("hub", "node", "values", "center").mapInArrow(differing, "hub long, node long, what long, kind int")
    group = Window.partitionBy("sig")
    near, enough = (F.count_if(F.col("kind") == k).over(group) for k in (0, 1))
    counted = rows.select(F.xxhash64("hub", "what").alias("sig"), "node", "kind").withColumns({"many": F.count("*").over(group), "near": near, "enough": enough})
    pairs = F.col("near") * (F.col("many") - F.col("near")) + F.col("enough") * (F.col("enough") - 1) / 2
    return counted.select("sig", "node", "kind", "many", pairs.alias("pairs")).filter("pairs > 0")


def paired(left: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (u, v), of different components ``c``, in the groups ``sig`` of ``left`` whose kinds and sketches leave
    them possible: the differing parities of two sketches bound the symmetric difference from below."""
    rows = cut(left.join(held.select("node", "n", *SKETCH).dropDuplicates(["node"]), "node"))
    a, b = (rows.select("sig", *(F.col(c).alias(f"{side}_{c}") for c in ("node", "c", "kind", "n", *SKETCH))) for side in "uv")
    apart = sum((F.bit_count(F.col(f"u_{c}").bitwiseXOR(F.col(f"v_{c}"))) for c in SKETCH), F.lit(0))
    near = (F.col("u_n") * 100 >= F.col("v_n") * PERCENT) & (F.col("v_n") * 100 >= F.col("u_n") * PERCENT) & (apart * 9 <= F.col("u_n") + F.col("v_n"))
    possible = ((F.col("u_kind") == 1) & (F.col("v_kind") == 1)) | ((F.col("u_kind") == 0) != (F.col("v_kind") == 0))
    met = a.join(b, (a["sig"] == b["sig"]) & (F.col("u_node") < F.col("v_node")) & (F.col("u_c") != F.col("v_c")) & possible & near)
    return met.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")).distinct()


def classes(docs: DataFrame, named: DataFrame) -> DataFrame:
    """(node, component) of the nodes that are similar to another; the component is its smallest node."""
    met = cut(meetings(docs))
    held = profiles(documents_of(docs, named, met.select("node").distinct()))
    bound = PAIRS_EACH * met.count()
    member = tested = None
    for turn in range(ROUNDS):
        weight = met.groupBy("node").agg(F.sum("many").alias("weight"))
        hubs = met.join(weight, "node").groupBy("sig").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"))
        at_hub = cut(met.join(hubs, "sig").filter("node <> hub"))
        pairs = at_hub.select(F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v")).distinct()
        fresh = cut(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"))
        tested = fresh if tested is None else tested.unionByName(fresh)
        member = merged(member, verified(fresh, held, docs, named))
        placed = at_hub.join(member, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        mixed = placed.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("sig")
        left = cut(placed.join(mixed, "sig").select("sig", "hub", "node", "c", F.count("*").over(Window.partitionBy("sig")).alias("many")))
        large = left.filter(F.col("many") > LARGE)
        direct, again = left.withColumn("kind", F.lit(1)).select("sig", "node", "c", "kind", "many"), None
        if not large.isEmpty():
            apart = cut(differences(large, docs, named))
            too_many = F.col("pairs") > PAIRS_EACH * F.col("many")
            # Groups that are large even so are paired as they are if that makes few pairs for the size of the table.
            rest = apart.filter(too_many).agg(F.sum(F.col("pairs") / F.col("many"))).first()[0] or 0
            if rest > bound and turn < ROUNDS - 1:
                again = cut(apart.filter(too_many).select("sig", "node", "many").distinct())
                apart = apart.filter(~too_many)
            close = apart.join(member.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
            direct = direct.filter(F.col("many") <= LARGE).unionByName(close.select("sig", "node", "c", "kind", "many"))
        rest = paired(direct.drop("many"), held).join(tested, ["u", "v"], "left_anti")
        member = merged(member, verified(rest, held, docs, named))
        if again is None:
            break
        met = again
    return member


def merged(member: DataFrame | None, links: DataFrame) -> DataFrame:
    """``member`` (node, component) after the ``links`` (u, v) as well."""
    links = cut(links)
    if member is None:
        return cut(components(links))
    if links.isEmpty():
        return member
    return cut(components(member.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links)))


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, hash, n, node, and the smallest id and row of its component, of every document."""
    named = cut(sizes(docs))
    member = classes(docs, named)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    nodes = named.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.min(row).alias("row"))
    nodes = nodes.join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = nodes.groupBy("component").agg(F.min("low").alias("component_id"), F.min("row").alias("first"))
    label = nodes.select("node", "component").join(smallest, "component").select("node", "component_id", "first")
    return spread_join(named, label, "node", ["doc_id", "hash"], "left")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return labelled(docs).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, that come first of their group."""
    found = labelled(docs)
    first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.hash") == F.col("hash"))
    kept = found.filter(F.col("node").isNull() | first).select(F.col("doc_id").alias("__loomery_id"), F.col("hash").alias("__loomery_hash")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__loomery_id")) & (F.xxhash64(docs["text"]) == F.col("__loomery_hash"))
    return docs.join(kept, same, "left_semi")
