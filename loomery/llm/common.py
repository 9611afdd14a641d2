"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of texts that are Python objects at once.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20
#: Rows of one key that a task takes in spread_join, at least; at most so many keys are dealt over several tasks.
HOT_ROWS, HOT_KEYS = 1000, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, whatever file system it is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir, or, where that is unset, one in the
    warehouse, which executors share too."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/loomery-checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut at a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def remainder(doc_id, divisor: int):
    """crc32(doc_id as text) mod ``divisor``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; imported here so that executors resolve their own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: like cut(), but compressed and by column."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of ``batch``: SLICE_ROWS at most, and fewer where the values of ``column`` are long."""
    values = batch.column(column)
    at = 0
    for n in _runs(values):
        yield batch.slice(at, n)
        at += n


def by_slices(values: pa.Array, f: Callable[[list], pa.Array]) -> pa.Array:
    """``f`` of the values, few rows or characters at a time as Python objects."""
    at, out = 0, []
    for n in _runs(values) or [0]:
        out.append(f(values[at : at + n].to_pylist()))
        at += n
    return pa.concat_arrays(out)


def _runs(values: pa.Array) -> list[int]:
    out, rows, size = [], 0, 0
    for value in values:
        length = value.as_buffer().size if value.is_valid else 0
        if rows and (rows == SLICE_ROWS or size + length > SLICE_BYTES):
            out.append(rows)
            rows = size = 0
        rows += 1
        size += length
    return [*out, rows] if rows else out


_HELD: OrderedDict = OrderedDict()


def held(kind: str, key: object, make: Callable[[], object], most: int = 2) -> object:
    """What ``make`` returns, made once in a Python worker for each (kind, key); the ``most`` used last stay, so that
    models and caches of operators that ran before do not fill a worker's memory."""
    if (kind, key) not in _HELD:
        while len(_HELD) >= most:
            _HELD.popitem(last=False)
        _HELD[kind, key] = make()
    _HELD.move_to_end((kind, key))
    return _HELD[kind, key]


def spread_join(many: DataFrame, one: DataFrame, key: str, by: list[str], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """``many`` joined with ``one`` on ``key``; rows of a key that is hot in ``many`` are dealt over several tasks by
    the columns ``by``, and that key's rows of ``one`` are sent to each. Keys are counted in ``counted``, or in ``many``
    itself, which should be cut before."""
    counted = many if counted is None else counted
    most = max(HOT_ROWS, counted.count() // HOT_KEYS)
    # Fewer than HOT_KEYS keys can have that many rows: that bounds what reaches the driver and the broadcast.
    counts = counted.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") > most) & F.col(key).isNotNull())
    hot = counts.select(key, F.ceil(F.col("n") / most).cast("int").alias("__loomery_parts")).collect()
    if not hot:
        return many.join(one, key, how)
    parts = F.broadcast(many.sparkSession.createDataFrame(hot, f"{key} {dict(many.dtypes)[key]}, __loomery_parts int"))
    salt = F.pmod(F.xxhash64(*by), F.coalesce("__loomery_parts", F.lit(1)))
    left = many.join(parts, key, "left").withColumn("__loomery_salt", salt.cast("int")).drop("__loomery_parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__loomery_parts", F.lit(1)) - 1))
    right = one.join(parts, key, "left").withColumn("__loomery_salt", copies).drop("__loomery_parts")
    return left.join(right, [key, "__loomery_salt"], how).drop("__loomery_salt")
