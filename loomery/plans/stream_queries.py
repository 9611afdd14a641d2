"""Queries on packed token streams, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import contamination as C
from loomery.operators import stream as P
from loomery.operators.ordering import settled
from loomery.sources.tables import table

LENGTH, VOCABULARY, PER_SHARD = 64, 50_000, 16
#: Sequences that each phase may fill.
TARGETS = {0: 100, 1: 75, 2: 50, 3: 25}
PREFIXES = [1, 10, 100, 250]


def documents(s, d):
    """The first document of each text, with its phase and stand-in token ids."""
    rows = C.first_occurrence(table(s, d, "documents"), F.sha2(F.col("text").cast("binary"), 256), "doc_id").filter("not duplicate")
    return rows.select("doc_id", "lang", "text", (F.col("doc_id") % 4).alias("phase"), P.word_ids(F.col("text"), VOCABULARY).alias("tokens"))


def sha():
    return F.sha2(F.col("text").cast("binary"), 256)


def packed(s, d):
    """The same documents in their phases' budgets. Texts are read once, for digests and numbers of tokens."""
    read = settled(table(s, d, "documents").select("doc_id", "lang", (F.col("doc_id") % 4).alias("phase"), sha().alias("sha"), F.size(P.words(F.col("text"))).alias("n_tokens")))
    return P.budgeted(C.first_occurrence(read, F.col("sha"), "doc_id").filter("not duplicate"), TARGETS, LENGTH)


def parts(s, d):
    """Pieces of the documents that fit in: TARGETS bounds how many, and only they get token ids."""
    kept = settled(packed(s, d).filter("kept > 0"))
    texts = table(s, d, "documents").join(F.broadcast(kept.select("doc_id").distinct()), "doc_id", "left_semi").withColumn("__sha", sha()).dropDuplicates(["doc_id", "__sha"])
    named = texts.select(F.col("doc_id").alias("__id"), "__sha", P.word_ids(F.col("text"), VOCABULARY).alias("tokens"))
    return settled(P.pieces(kept.join(named, (F.col("doc_id") == F.col("__id")) & F.col("sha").eqNullSafe(F.col("__sha"))), TARGETS, LENGTH))


def rows(s, d):
    return settled(P.records(parts(s, d), LENGTH))


def payloads(s, d):
    return settled(P.shards(rows(s, d), PER_SHARD, LENGTH))


def in_shards(s, d):
    """Every record with its shard, both of the same records."""
    held = rows(s, d)
    return P.ranges_of(held, P.shards(held, PER_SHARD, LENGTH).select(F.col("first").alias("start"), "stop", "shard"), "sequence", "shard").select("sequence", "shard")


def joined(column):
    return F.array_join(F.transform(column, lambda x: x.cast("int").cast("string")), ",")


def index(s, d):
    """Blobs of each language one after the other, one of a hundred displaced."""
    sized = table(s, d, "documents").select("lang", "doc_id", F.octet_length("text").cast("long").alias("length"))
    from loomery.operators.ordering import running_total

    placed = running_total(sized, ["lang", "doc_id"], "length", "all")
    base = placed.groupBy("lang").agg(F.min("all").alias("base"))
    return placed.join(F.broadcast(base), "lang").select("lang", "doc_id", "length", (F.col("all") - F.col("base") + F.when(F.col("doc_id") % 100 == 99, 1).otherwise(0)).alias("offset"))


def limits(s):
    return s.createDataFrame([(0, 100, 0), (100, 175, 1), (175, 225, 2), (225, 250, 3)], "start long, stop long, phase long")


QUERIES = {
    "utf8_increments": lambda s, d: table(s, d, "documents").select("doc_id", P.utf8_increments(F.col("text")).alias("x")).select("doc_id", F.size("x").alias("tokens"), F.aggregate("x", F.lit(0), lambda a, v: a + v).alias("bytes"), F.array_max("x").alias("most")),
    "token_usage": lambda s, d: P.token_usage(documents(s, d)),
    "phase_budgets": lambda s, d: packed(s, d).select("doc_id", "phase", "start", "kept", "cut", "skipped"),
    "phase_budget_totals": lambda s, d: packed(s, d).groupBy("phase").agg(F.count_if("skipped").alias("skipped"), F.count_if("cut").alias("cut"), F.sum("kept").alias("kept")),
    "packed_tokens": lambda s, d: rows(s, d).select("sequence", joined("tokens").alias("tokens")),
    "segment_starts_ids_mask": lambda s, d: rows(s, d).select("sequence", joined("starts").alias("starts"), joined("segments").alias("segments"), joined("mask").alias("mask")),
    "start_bitset_encode": lambda s, d: rows(s, d).select("sequence", F.lower(F.hex(P.start_bits(F.col("starts"), LENGTH))).alias("bits")),
    "start_bitset_decode": lambda s, d: s.range(4096).select("id", F.unhex(F.lpad(F.hex("id"), 4, "0")).alias("bits")).select("id", joined(P.starts_of(F.col("bits"), 12)).alias("starts")),
    "binary_shards": lambda s, d: payloads(s, d).select("shard", "first", "stop", F.octet_length("payload").alias("bytes"), F.sha2("payload", 256).alias("digest")),
    "binary_scan_round_trip": lambda s, d: P.scanned(payloads(s, d), LENGTH).select("sequence", joined("tokens").alias("tokens"), joined("starts").alias("starts")),
    "record_lookup": lambda s, d: P.looked_up(rows(s, d), s.range(0, 250, 7).withColumnRenamed("id", "sequence")).select("sequence", F.col("tokens")[0].alias("first_token")),
    "range_join_phase_of_sequence": lambda s, d: P.ranges_of(rows(s, d), limits(s), "sequence", "phase").groupBy("phase").agg(F.count("*").alias("n")),
    "range_join_shard": in_shards,
    "stream_prefix_ledger": lambda s, d: P.prefix_ledger(parts(s, d), PREFIXES),
    "stream_invariants": lambda s, d: P.stream_faults(rows(s, d), LENGTH, VOCABULARY),
    "offset_contiguity": lambda s, d: P.contiguous(index(s, d), "lang").select("doc_id", "joins"),
}

BASE = f"""u AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text),
d AS (SELECT doc_id, lang, doc_id % 4 AS phase, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 7))::bigint % {VOCABULARY - 1} + 1) AS tokens FROM documents JOIN u USING (doc_id)),
tg AS (SELECT * FROM (VALUES {", ".join(f"({p}, {t}, {sum(x for q, x in TARGETS.items() if q < p)})" for p, t in TARGETS.items())}) v(phase, target, first)),
st AS (SELECT d.*, coalesce(sum(len(tokens) + 1) OVER (PARTITION BY phase ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM d),
pk AS (SELECT st.*, first, greatest(0, least(len(tokens) + 1, target * {LENGTH} - start)) AS kept FROM st JOIN tg USING (phase)),
ex AS (SELECT phase, doc_id, unnest(list_append(tokens, 0)[1:kept]) AS token, unnest(range(kept)) AS i, start, first FROM pk WHERE kept > 0),
po AS (SELECT phase, doc_id, token, first + (start + i) // {LENGTH} AS sequence, (start + i) % {LENGTH} AS pos, i = 0 OR (start + i) % {LENGTH} = 0 AS st FROM ex),
sg AS (SELECT *, sum(st::int) OVER (PARTITION BY sequence ORDER BY pos) - 1 AS seg, coalesce(NOT lead(st) OVER (PARTITION BY sequence ORDER BY pos), false) AS mk FROM po),
rc AS (SELECT sequence, list(token ORDER BY pos) AS tokens, list(st::int ORDER BY pos) AS starts, list(seg ORDER BY pos) AS segments, list(mk::int ORDER BY pos) AS mask FROM sg GROUP BY sequence HAVING count(*) = {LENGTH}),
bt AS (SELECT *, array_to_string(list_transform(range({LENGTH // 8}), lambda b: printf('%02x', list_sum(list_transform(range(8), lambda k: starts[b * 8 + k + 1] * (1 << k)))::int)), '') AS bits,
  array_to_string(list_transform(tokens, lambda t: regexp_replace(printf('%08x', t), '(..)(..)(..)(..)', '\\4\\3\\2\\1')), '') AS le FROM rc)"""
CSV = "array_to_string({c}, ',') AS {c}"

ORACLES = {
    "utf8_increments": r"SELECT doc_id, len(x) AS tokens, coalesce(list_sum(list_transform(x, lambda v: octet_length(encode(v)))), 0)::int AS bytes, list_max(list_transform(x, lambda v: octet_length(encode(v)))) AS most FROM (SELECT doc_id, regexp_extract_all(text, '\s*\S+(?:\s+$)?|^\s+$') AS x FROM documents)",
    "token_usage": f"WITH {BASE} SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM d) GROUP BY token",
    "phase_budgets": f"WITH {BASE} SELECT doc_id, phase, start, kept, kept > 0 AND kept < len(tokens) + 1 AS cut, kept = 0 AS skipped FROM pk",
    "phase_budget_totals": f"WITH {BASE} SELECT phase, count_if(kept = 0) AS skipped, count_if(kept > 0 AND kept < len(tokens) + 1) AS cut, sum(kept)::bigint AS kept FROM pk GROUP BY phase",
    "packed_tokens": f"WITH {BASE} SELECT sequence, {CSV.format(c='tokens')} FROM rc",
    "segment_starts_ids_mask": f"WITH {BASE} SELECT sequence, {CSV.format(c='starts')}, {CSV.format(c='segments')}, {CSV.format(c='mask')} FROM rc",
    "start_bitset_encode": f"WITH {BASE} SELECT sequence, bits FROM bt",
    "start_bitset_decode": "WITH i AS (SELECT range AS id, range // 256 AS lo, range % 256 AS hi FROM range(4096)) SELECT id, CASE WHEN lo % 2 = 1 AND hi < 16 THEN array_to_string(list_transform(range(12), lambda k: CASE WHEN k < 8 THEN (lo >> k) & 1 ELSE (hi >> (k - 8)) & 1 END), ',') END AS starts FROM i",
    "binary_shards": f"WITH {BASE} SELECT sequence // {PER_SHARD} AS shard, min(sequence) AS first, max(sequence) + 1 AS stop, (count(*) * {4 * LENGTH + LENGTH // 8})::int AS bytes, sha256(unhex(string_agg(le, '' ORDER BY sequence) || string_agg(bits, '' ORDER BY sequence))) AS digest FROM bt GROUP BY 1",
    "binary_scan_round_trip": f"WITH {BASE} SELECT sequence, {CSV.format(c='tokens')}, {CSV.format(c='starts')} FROM rc",
    "record_lookup": f"WITH {BASE} SELECT sequence, tokens[1] AS first_token FROM rc WHERE sequence % 7 = 0",
    "range_join_phase_of_sequence": f"WITH {BASE} SELECT CASE WHEN sequence < 100 THEN 0 WHEN sequence < 175 THEN 1 WHEN sequence < 225 THEN 2 ELSE 3 END AS phase, count(*) AS n FROM rc GROUP BY 1",
    "range_join_shard": f"WITH {BASE} SELECT sequence, sequence // {PER_SHARD} AS shard FROM rc",
    "stream_prefix_ledger": f"WITH {BASE} SELECT prefix, phase, count(*) AS tokens, count_if(token = 0) AS documents FROM po, (SELECT unnest({PREFIXES}) AS prefix) WHERE sequence < prefix GROUP BY ALL",
    "stream_invariants": f"WITH {BASE} SELECT count(*) AS records, max(sequence) + 1 = count(*) AND min(sequence) = 0 AND count(DISTINCT sequence) = count(*) AS dense, bool_and(len(tokens) = {LENGTH}) AS full, max(list_max(tokens)) < {VOCABULARY} AS known, bool_and(starts[1] = 1) AS started, sum(list_sum(mask))::bigint AS targets, sum(list_max(segments) + 1)::bigint AS segments FROM rc",
    "offset_contiguity": """WITH s AS (SELECT lang, doc_id, octet_length(encode(text)) AS length FROM documents),
i AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN doc_id % 100 = 99 THEN 1 ELSE 0 END AS o FROM s)
SELECT doc_id, o = coalesce(lag(o + length) OVER (PARTITION BY lang ORDER BY o, length), 0) AS joins FROM i""",
}
