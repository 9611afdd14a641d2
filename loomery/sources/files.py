"""Files as tables: JSON lines with line numbers, pinned inputs, archives, bundles; and sinks that publish once."""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.functions import parsing as G
from loomery.operators import contracts as K
from loomery.operators import flows as L
from loomery.sources.tables import checked


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's spark.checkpoint.dir, or the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scan(spark: SparkSession, paths: str | list[str], columns: list[str], exact: bool = False) -> DataFrame:
    """The ``columns`` of Parquet files, which must have them (and, with ``exact``, no others); only they are read."""
    whole = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return checked(whole, set(columns), exact).select(*columns)


def scan_shards(spark: SparkSession, folder: str, members: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of the shards ``<language>/train-i-of-n.parquet`` with each row's ``shard``; names must be well-formed
    and the shards complete."""
    names = spark.createDataFrame([(m,) for m in members], "name string").select("name", K.member(F.col("name")).alias("m"))
    found = names.collect()  # a row a shard
    counts = {r["m"]["count"] for r in found if r["m"]}
    if any(r["m"] is None for r in found) or len(counts) != 1 or sorted(r["m"]["index"] for r in found) != list(range(counts.pop())):
        raise ValueError("the shards differ from a complete set")
    shard = F.regexp_extract("_metadata.file_name", r"train-(\d+)-of-", 1).cast("int")
    return spark.read.parquet(*(f"{folder}/{m}" for m in members)).select(*columns, shard.alias("shard"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines counted from 1 in each file.

    Blocks of a file are read side by side: a line's number is its place in its block, which the ids of the rows of one
    scan give, and the lines of the blocks before, a row a block.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(before, ["file", "block"]).select("file", (1 + F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")


def documents(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with file and line, rejects with their text) of JSON lines; blank lines count but are no rows."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", schema))
    whole = F.col("row").isNotNull() & F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{")
    return parsed.filter(whole).select("file", "line", "row.*"), parsed.filter(~F.coalesce(whole, F.lit(False))).select("file", "line", "value")


def boundary_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line, text): every string of every JSON line of the boundary files; a line that is no JSON is an error."""
    if len(set(paths)) < len(paths):
        raise ValueError("boundary files are not distinct")
    files = [numbered_lines(spark, p).filter(F.trim("value") != "") for p in paths]
    every = files[0]
    for more in files[1:]:
        every = every.unionByName(more)
    leaves = every.select("file", "line", G.json_leaves(F.col("value")).alias("x"))
    sound = F.when(F.col("x").isNull(), F.raise_error(F.concat(F.lit("no JSON on line "), F.col("line").cast("string")))).otherwise(F.lit(True))
    return leaves.filter(sound).select("file", "line", F.explode("x").alias("text"))


def pinned(spark: SparkSession, path: str, digest: str, rows: int) -> DataFrame:
    """The lines of a file whose bytes have the SHA-256 ``digest`` and which has ``rows`` lines, none blank."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).collect()  # a row a file
    lines = numbered_lines(spark, path)
    sums = lines.agg(F.count("*").alias("n"), F.count_if(F.trim("value") == "").alias("blank")).first()
    if [r["d"] for r in found] != [digest] or sums["n"] != rows or sums["blank"]:
        raise ValueError(f"{path} differs from what it is pinned to")
    return lines


def tree_digest(spark: SparkSession, folder: str) -> str:
    """Digest of the sorted names and digests of a folder's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    each = files.select(F.concat(F.element_at(F.split("path", "/"), -1), F.lit(" "), F.sha2("content", 256)).alias("m"))
    return each.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("m")), "\n").cast("binary"), 256).alias("d")).first()["d"]  # a line a file


def archive_members(archives: DataFrame) -> DataFrame:
    """(path, name, text) of the files in gzip tar archives (path, content); links, names that leave the archive,
    repeated names and bytes that are no UTF-8 are errors. No built-in source opens archives."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                seen: set[str] = set()
                with tarfile.open(fileobj=io.BytesIO(content.as_py()), mode="r:gz") as archive:
                    for member in archive:
                        parts = member.name.split("/")
                        if member.name.startswith("/") or ".." in parts or member.name in seen or not (member.isfile() or member.isdir()):
                            raise ValueError(f"unsafe member {member.name!r}")
                        seen.add(member.name)
                        if member.isfile():
                            text = archive.extractfile(member).read().decode("utf-8")
                            yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([member.name]), pa.array([text])], ["path", "name", "text"])

    return archives.select("path", "content").mapInArrow(members, "path string, name string, text string")


#: Bytes of a piece of a bundle: a blob is cut out of the pieces it lies in, so no row holds or copies a whole bundle.
PIECE = 1 << 14


def pieces_of(blob: Column, offset: Column, most: Column) -> Column:
    """array<struct<piece, at, part>>: what a blob of ``most`` bytes at ``offset`` of a bundle puts into each piece. An
    empty one puts nothing into one piece."""
    numbers = F.sequence(F.floor(offset / PIECE), F.floor((offset + F.greatest(most, F.lit(1)) - 1) / PIECE))
    at = lambda p: F.greatest(offset, p * PIECE)
    return F.transform(numbers, lambda p: F.struct(p.alias("piece"), at(p).alias("at"), F.substring(blob, (at(p) - offset + 1).cast("int"), ((p + 1) * PIECE - at(p)).cast("int")).alias("part")))


def joined_pieces(blobs: DataFrame) -> DataFrame:
    """(bundle, piece, content) of bundles that are ``blobs`` (bundle, offset, blob) one after the other."""
    each = blobs.select("bundle", F.explode_outer(pieces_of(F.col("blob"), F.col("offset"), F.octet_length("blob"))).alias("x")).filter("x is not null")
    held = each.groupBy("bundle", "x.piece").agg(F.sort_array(F.collect_list(F.struct("x.at", F.hex("x.part").alias("h")))).alias("rows"))  # PIECE bounds it
    return held.select("bundle", "piece", F.unhex(F.array_join(F.col("rows").getField("h"), "")).alias("content"))


def bundle_blobs(bundles: DataFrame, index: DataFrame) -> DataFrame:
    """(bundle, offset, length, sha256, blob, sound): the blobs that ``index`` (bundle, offset, length, sha256) cuts out of
    ``bundles`` (bundle, content), or of their pieces (bundle, piece, content); ``sound`` if the digest is right and the
    index covers the bundle without gaps."""
    if "piece" not in bundles.columns:
        bundles = joined_pieces(bundles.select("bundle", F.lit(0).cast("long").alias("offset"), F.col("content").alias("blob")))
    order = Window.partitionBy("bundle").orderBy("offset", "length")
    running = F.coalesce(F.lag(F.col("offset") + F.col("length")).over(order), F.lit(0))
    numbered = index.withColumns({"__joins": F.col("offset") == running, "__row": F.row_number().over(order)})
    ends = index.groupBy("bundle").agg(F.max(F.col("offset") + F.col("length")).alias("__end"))
    sizes = bundles.groupBy("bundle").agg(F.max(F.col("piece") * PIECE + F.octet_length("content")).alias("__size"))
    covers = ends.join(sizes.withColumnRenamed("bundle", "__b"), F.col("bundle").eqNullSafe(F.col("__b"))).select("__b", (F.col("__end") == F.col("__size")).alias("__covers"))
    entries = numbered.join(covers, F.col("bundle").eqNullSafe(F.col("__b"))).drop("__b")
    last = F.floor((F.col("offset") + F.greatest("length", F.lit(1)) - 1) / PIECE)
    each = entries.withColumn("__piece", F.explode_outer(F.sequence(F.floor(F.col("offset") / PIECE), last)))
    held = bundles.select(F.col("bundle").alias("__b"), F.col("piece").alias("__p"), "content")
    begin = F.greatest(F.col("offset") - F.col("__piece") * PIECE, F.lit(0))
    stop = F.least(F.col("offset") + F.col("length") - F.col("__piece") * PIECE, F.lit(PIECE))
    met = each.join(held, F.col("bundle").eqNullSafe(F.col("__b")) & (F.col("__piece") == F.col("__p")), "left")
    parts = met.select("bundle", "__row", "offset", "length", "sha256", "__joins", "__covers", "__piece", F.hex(F.substring("content", (begin + 1).cast("int"), (stop - begin).cast("int"))).alias("h"))
    firsts = [F.first(c).alias(c) for c in ("offset", "length", "sha256", "__joins", "__covers")]
    whole = parts.groupBy("bundle", "__row").agg(*firsts, F.sort_array(F.collect_list(F.struct("__piece", "h"))).alias("x"))
    blob = F.when(F.col("length").isNotNull(), F.unhex(F.array_join(F.col("x").getField("h"), "")))
    sound = F.col("__joins") & F.col("__covers") & (F.sha2("blob", 256) == F.col("sha256"))
    return whole.withColumn("blob", blob).select("bundle", "offset", "length", "sha256", "blob", sound.alias("sound"))


def canonical_lines(df: DataFrame, ascii_only: bool = False) -> DataFrame:
    """``value``: each row as JSON with its fields in the order of their names and no spaces."""
    body = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.select((G.canonical_ascii(body) if ascii_only else body).alias("value"))


def publish(df: DataFrame, path: str, summary: dict[str, int | str], kind: str = "parquet") -> DataFrame:
    """Writes ``df`` to a new folder and then its receipt, with rows, a digest that no order changes, and ``summary``; an
    existing output is an error, and a folder without a receipt is not finished. Returns the receipt."""
    spark = df.sparkSession
    df.write.mode("errorifexists").format(kind).save(f"{path}/data")
    written = spark.read.format(kind).load(f"{path}/data")
    whole = F.sha2(F.to_json(F.struct(*sorted(written.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    limbs = [F.sum(F.conv(F.substring(whole, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    sums = written.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(",", *limbs).cast("binary"), 256).alias("fingerprint"))
    receipt = L.receipt(sums.withColumns({k: F.lit(v) for k, v in summary.items()}))
    receipt.coalesce(1).write.mode("errorifexists").json(f"{path}/receipt")
    return spark.read.json(f"{path}/receipt")
