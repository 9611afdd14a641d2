"""Queries that write tables as files to the shared folder and read them back, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import ordering as O
from loomery.sources import files as X
from loomery.sources.tables import table


def numbered(s, d):
    """Documents as JSON lines in one file, in order, every tenth followed by a blank line and one by no JSON."""
    path = X.shared_folder(s, "lines")
    body = F.to_json(F.struct("doc_id", "lang"))
    more = F.when(F.col("doc_id") % 10 == 0, F.concat(body, F.lit("\n\n{broken"))).otherwise(body)
    table(s, d, "documents").select("doc_id", "lang").orderBy("doc_id").coalesce(1).select(more.alias("value")).write.text(path)
    return X.documents(s, path, "doc_id long, lang string")


def boundary(s, d):
    """Benchmark items as JSON lines of two files, and every string in them."""
    paths = []
    for part in (0, 1):
        path = X.shared_folder(s, "boundary")
        rows = table(s, d, "benchmark").filter(F.col("item_id") % 2 == part)
        rows.select(F.to_json(F.struct(F.lit("short").alias("a"), F.array("text").alias("list"), F.col("item_id").alias("n"))).alias("value")).write.text(path)
        paths.append(path)
    return X.boundary_texts(s, paths)


def published(s, d):
    path = X.shared_folder(s, "published")
    receipt = X.publish(table(s, d, "nation").select("n_nationkey", "n_name"), path, {"source": "nation"})
    from loomery.operators.flows import sound_receipts

    return sound_receipts(receipt).select("rows", "source", "sound")


def bundled(s, d):
    """The first hundred characters of texts one after the other as one bundle a language, cut up again."""
    rows = table(s, d, "documents").select("lang", "doc_id", F.substring("text", 1, 100).cast("binary").alias("blob"))
    placed = O.running_total(rows.withColumn("length", F.octet_length("blob")), ["lang", "doc_id"], "length", "__all")
    base = placed.groupBy(F.col("lang").alias("bundle")).agg(F.min("__all").alias("__base"))  # a row a language
    blobs = placed.join(F.broadcast(base), F.col("lang").eqNullSafe(F.col("bundle"))).withColumn("offset", F.col("__all") - F.col("__base"))
    index = blobs.select("bundle", "offset", "length", F.when(F.col("doc_id") % 20 == 0, "x").otherwise(F.sha2("blob", 256)).alias("sha256"))
    return X.bundle_blobs(X.joined_pieces(blobs), index).select("bundle", "offset", F.sha2("blob", 256).alias("digest"), "sound")


QUERIES = {
    "jsonl_scan_documents": lambda s, d: numbered(s, d)[0].select("line", "doc_id", "lang"),
    "jsonl_scan_rejects": lambda s, d: numbered(s, d)[1].select("line", "value"),
    "jsonl_scan_boundary": lambda s, d: boundary(s, d).select("text"),
    "published_receipt": published,
    "content_bundle_scan": bundled,
    "canonical_jsonl_encode": lambda s, d: X.canonical_lines(table(s, d, "documents").select("source", "lang", "doc_id"), ascii_only=True),
}

LINE = "doc_id + 1 + 2 * ((doc_id + 9) // 10)"
ORACLES = {
    "jsonl_scan_documents": f"SELECT {LINE} AS line, doc_id, lang FROM documents",
    "jsonl_scan_rejects": f"SELECT {LINE} + 2 AS line, '{{broken' AS value FROM documents WHERE doc_id % 10 = 0",
    "jsonl_scan_boundary": "SELECT text FROM benchmark WHERE length(trim(text)) >= 8",
    "published_receipt": "SELECT count(*) AS rows, 'nation' AS source, true AS sound FROM nation",
    "content_bundle_scan": """SELECT lang AS bundle, coalesce(sum(octet_length(encode(substr(text, 1, 100)))) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS "offset", sha256(substr(text, 1, 100)) AS digest, doc_id % 20 <> 0 AS sound FROM documents""",
    "canonical_jsonl_encode": """SELECT '{"doc_id":' || doc_id || CASE WHEN lang IS NULL THEN ',"lang":null' ELSE ',"lang":"' || lang || '"' END || ',"source":' || coalesce('"' || source || '"', 'null') || '}' AS value FROM documents""",
}
