"""Approximate nearest neighbours by shifted space-filling curves.

Equal vectors are one point. Each of CURVES orderings turns points by its own random rotation, takes DIMS coordinates,
shifts them and walks them along a Hilbert curve; Spark range-partitions the keys of all curves, and a point's global
rank on a curve follows from the partitions' counts. A query point meets the points within a window of ranks on every
curve; buckets of at most BUCKET ranks bound every task's group, whatever vector is common. Only ids and codes of a byte
a component travel along the curves: each curve gives some of the nearest by code, the curves' finds are merged, and the
NEAR best of a query point are scored by the exact cosine in double precision, for which alone vectors are fetched.

The window is measured on each table: SAMPLE query points of smallest hash are compared with all points, and the window
is the least in which the curves find the part AIM of their true neighbours, WINDOW at least. So it grows with the table
as far as recall needs it. Measured recall: see the README. Defined results:
vectors that are null, zero or hold null or non-finite components take no part; vectors of other lengths are not
compared; ties go to the smaller id; with fewer candidates than asked for, all come; repeated ids are one candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.common import cut, spread_join

CURVES, WINDOW, DIMS, BITS, SEED = 40, 512, 12, 5, 20_240_229
PARTITIONS = 64
#: Points that all curves together pass on for exact scores, for each that is asked for; a curve passes on three.
NEAR = 8
#: Query points whose true neighbours are looked up; the part of these that the window holds; most ranks in a bucket.
SAMPLE, AIM, BUCKET = 256, 0.95, 16_384


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer cells [n, dims] on the Hilbert curve of ``bits`` bits a coordinate."""
    x = cells.astype(np.int64).T.copy()
    high = 1 << (bits - 1)
    level = high
    while level > 1:  # undo the rotations, coarsest first
        low = level - 1
        for i in range(len(x)):
            flip = (x[i] & level) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            if i:
                x[i] ^= swap
        level >>= 1
    for i in range(1, len(x)):  # Gray code
        x[i] ^= x[i - 1]
    turn, level = np.zeros(x.shape[1], np.int64), high
    while level > 1:
        turn ^= np.where(x[-1] & level, level - 1, 0)
        level >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | (row >> bit & 1)
    return key


def keys(unit: np.ndarray, curve: int) -> np.ndarray:
    """Curve keys of unit vectors; coordinates within four standard deviations of a random direction fill the cells."""
    size = unit.shape[1]
    random = np.random.default_rng([SEED, curve, size])
    turned, _ = np.linalg.qr(random.normal(size=(size, min(DIMS, size))))
    place = np.clip(unit @ turned * np.sqrt(size) / 8 + 0.5, 0, 1 - 1e-9)
    return hilbert(((place + random.random(place.shape[1])) / 2 * (1 << BITS)).astype(np.int64), BITS)


def _vectors(values: pa.Array) -> np.ndarray:
    data = values.to_pylist()
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    return (y := x / big) / np.sqrt((y * y).sum(1, keepdims=True))


def codes(vec: pa.Array) -> pa.Array:
    """Vectors with a signed byte a component, scaled to their largest."""
    out = []
    for value in vec:
        x = np.frombuffer(value.as_py(), np.float64)
        out.append(np.rint(x / np.abs(x).max() * 127).astype(np.int8).tobytes())
    return pa.array(out, pa.binary())


def vectors(df: DataFrame) -> DataFrame:
    """(vec_id, vec): the usable vectors as double-precision bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or not value or None in value:
                    continue
                x = np.array(value, np.float64) + 0.0
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "vec"])

    return df.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(read, "vec_id long, vec binary")


def true_neighbours(points: DataFrame, searched: DataFrame, k: int) -> DataFrame:
    """(q, v): the ``k`` nearest points to each of SAMPLE of the ``searched`` ones, by comparison with all."""
    chosen = searched.select("point").orderBy(F.xxhash64("point"), "point").limit(SAMPLE)
    by_size: dict[int, list[tuple[int, bytes]]] = {}
    for r in points.select("point", "vec").join(F.broadcast(chosen), "point").collect():
        by_size.setdefault(len(r["vec"]), []).append((r["point"], bytes(r["vec"])))
    asked = {size: (np.array([i for i, _ in held]), _unit(np.frombuffer(b"".join(v for _, v in held), np.float64).reshape(len(held), -1))) for size, held in by_size.items()}
    shared = points.sparkSession.sparkContext.broadcast(asked)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v.as_py()) for v in batch.column("vec")])
            for size, (ids, unit) in shared.value.items():
                rows = np.flatnonzero(sizes == size)
                if not len(rows):
                    continue
                part = batch.take(pa.array(rows))
                have = part.column("point").to_numpy()
                near = unit @ _unit(_vectors(part.column("vec"))).T
                near[ids[:, None] == have] = -np.inf
                take = min(k, len(have))
                best = np.argpartition(-near, take - 1, axis=1)[:, :take]
                score = np.take_along_axis(near, best, 1)
                good = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, take)[good.ravel()]), pa.array(have[best[good]]), pa.array(score[good])], ["q", "v", "score"])

    met = points.select("point", "vec").mapInArrow(compared, "q long, v long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "v")
    return met.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).select("q", "v")


def window_of(placed: DataFrame, true: DataFrame) -> int:
    """The least window, WINDOW at least, that holds the part AIM of the pairs ``true`` on some curve."""
    ends = cut(true)
    line = placed.select("size", "curve", "rank", "point")
    one = line.join(F.broadcast(ends), F.col("point") == F.col("q")).select("size", "curve", F.col("rank").alias("at"), "q", "v")
    other = line.join(F.broadcast(ends.select("v").distinct()), F.col("point") == F.col("v")).select("size", "curve", "rank", "v")
    # SAMPLE * k numbers at most reach the driver.
    far = one.join(other, ["size", "curve", "v"]).groupBy("q", "v").agg(F.min(F.abs(F.col("at") - F.col("rank"))).alias("far")).collect()
    return max(WINDOW, int(np.quantile([r["far"] for r in far], AIM, method="higher"))) if far else WINDOW


def nearest(df: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found to each vector whose id ``every`` divides."""
    usable = cut(vectors(df).distinct())
    order = Window.partitionBy("vec").orderBy("vec_id")
    first = usable.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    # k + 1 ids at most of each point: enough once the query itself is left out.
    points = cut(first.groupBy("vec").agg(F.min("vec_id").alias("point"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = usable.filter(F.col("vec_id") % every == 0)
    queries = cut(asked.join(points.select("vec", "point"), "vec").select(F.col("vec_id").alias("query_id"), "point"))
    searched = queries.select("point").distinct().withColumn("asks", F.lit(True))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_size: dict[int, list[int]] = {}
            for i, value in enumerate(batch.column("vec")):
                by_size.setdefault(len(value.as_py()), []).append(i)
            for size, rows in by_size.items():
                part = batch.take(pa.array(rows))
                unit = _unit(_vectors(part.column("vec")))
                for curve in range(CURVES):
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, size // 8, np.int32)), pa.array(np.full(n, curve, np.int32)), pa.array(keys(unit, curve)), part.column("point")], ["size", "curve", "key", "point"])

    ordered = points.select("point", "vec").mapInArrow(keyed, "size int, curve int, key long, point long").repartitionByRange(max(PARTITIONS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "size", "curve", "key", "point")
    ranged = cut(ordered.withColumn("part", F.spark_partition_id()))
    line = Window.partitionBy("size", "curve")
    counts = ranged.groupBy("size", "curve", "part").count()
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(line.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("size", "curve", "part").orderBy("key", "point"))
    placed = cut(ranged.withColumn("inside", inside).join(before, ["size", "curve", "part"]).select("size", "curve", (F.col("before") + F.col("inside") - 1).alias("rank"), "point"))
    window = window_of(placed, true_neighbours(points, searched, k))
    bucket = min(window, BUCKET)
    reach = -(-window // bucket)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("point"), codes(batch.column("vec"))], ["point", "code"])

    short = cut(points.select("point", "vec").mapInArrow(coded, "point long, code binary"))
    full = placed.join(short, "point").join(searched, "point", "left").withColumn("bucket", F.floor(F.col("rank") / bucket))
    asking = full.filter("asks").withColumn("bucket", F.explode(F.sequence(F.col("bucket") - reach, F.col("bucket") + reach))).withColumn("role", F.lit(True))
    both = full.withColumn("role", F.lit(False)).unionByName(asking).select("size", "curve", "bucket", "role", "rank", "point", "code")
    most = NEAR * k

    def met(group: pa.Table) -> pa.Table:
        role = group.column("role").to_numpy(zero_copy_only=False)
        rank, point = group.column("rank").to_numpy(), group.column("point").to_numpy()
        data = group.column("code").to_pylist()
        x = np.frombuffer(b"".join(data), np.int8).reshape(len(data), -1).astype(np.float32)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        ask, have = np.flatnonzero(role), np.flatnonzero(~role)
        q, v, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        if len(ask) and len(have):
            theirs = x[have].T
            for at in range(0, len(ask), 256):
                rows = ask[at : at + 256]
                near = x[rows] @ theirs
                near[(np.abs(rank[rows][:, None] - rank[have]) > window) | (point[rows][:, None] == point[have])] = -np.inf
                take = min(3 * k, len(have))
                best = np.argpartition(-near, take - 1, axis=1)[:, :take]
                score = np.take_along_axis(near, best, 1)
                good = np.isfinite(score)
                q.append(point[rows[np.nonzero(good)[0]]])
                v.append(point[have[best[good]]])
                s.append(score[good])
        return pa.table([pa.array(np.concatenate(c)) for c in (q, v, s)], ["q", "v", "score"])

    merged = both.groupBy("size", "curve", "bucket").applyInArrow(met, "q long, v long, score float").groupBy("q", "v").agg(F.max("score").alias("score"))
    first = Window.partitionBy("q").orderBy(F.desc("score"), "v")
    likely = merged.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most).select("q", "v")

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("a"), batch.column("b"), strict=True)
            score = [float(cosine(*(np.frombuffer(x.as_py(), np.float64)[None] for x in pair))[0]) for pair in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("v"), pa.array(score, pa.float64())], ["q", "v", "score"])

    sides = [points.select(F.col("point").alias(name), F.col("vec").alias(column)) for name, column in (("q", "a"), ("v", "b"))]
    found = spread_join(cut(likely), sides[1], "v", ["q"]).join(sides[0], "q").select("q", "v", "a", "b").mapInArrow(exactly, "q long, v long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "v")
    top = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).select("q", "v", "score")

    def itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(v.as_py(), np.float64)[None] for v in batch.column("vec")]
            score = pa.array([float(cosine(y, y)[0]) for y in x], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("point"), batch.column("point"), score], ["q", "v", "score"])

    own = points.filter(F.size("ids") > 1).join(searched, "point").select("point", "vec").mapInArrow(itself, "q long, v long, score double")
    spread = top.unionByName(own).join(points.select(F.col("point").alias("v"), "ids"), "v").join(queries.withColumnRenamed("point", "q"), "q")
    each = spread.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of original vectors, in double precision; scaled only where squares would leave the range."""
    big_a, big_b = np.abs(a).max(1, keepdims=True), np.abs(b).max(1, keepdims=True)
    a = np.where((big_a > 1e100) | (big_a < 1e-100), a / big_a, a)
    b = np.where((big_b > 1e100) | (big_b < 1e-100), b / big_b, b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
