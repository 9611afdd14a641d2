"""Queries on sampling, ordering, packing and curriculum, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomery.functions import hashing as H
from loomery.operators import ordering as O
from loomery.operators import quality as Q
from loomery.plans.text_queries import SCORED
from loomery.sources.tables import table

LENGTH = 2048


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def hashed(spark, sf_dir):
    sha = H.sha(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", "lang", "source", sha.alias("sha"), H.salted_rank("sample", sha).alias("rank"))


def banded(spark, sf_dir):
    return Q.with_signals(docs(spark, sf_dir)).filter(F.size("quality_reasons") == 0).select("doc_id", "text", "band")


def packed(spark, sf_dir):
    words = F.size(F.split(F.col("text"), r"\s+"))
    return O.sequence_offsets(docs(spark, sf_dir).select("doc_id", "lang", words.alias("tokens")), LENGTH)


def learnable(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", (100000 + F.col("n_chars")).alias("strong"), (100000 + F.col("n_chars") + F.col("doc_id") % 997).alias("weak"), H.sha(F.col("doc_id").cast("string")).alias("rec"), (F.col("doc_id") % 4).alias("phase"))


def by_strength(spark, sf_dir):
    """Records of a phase by strong loss, falling difference, weak loss and digest, with their rank ``r``."""
    rows = learnable(spark, sf_dir).withColumn("less", F.col("strong") - F.col("weak"))
    return O.ranked_in_groups(rows, "phase", ["strong", "less", "weak", "rec"], "r")


def quarters(spark, sf_dir):
    rows = O.ranked_in_groups(learnable(spark, sf_dir), "phase", ["strong", "rec"], "r")
    sizes = rows.groupBy("phase").agg(F.count("*").alias("size"))  # a row a phase
    return rows.join(F.broadcast(sizes), "phase").withColumn("band", O.ntile_of(F.col("r"), F.col("size"), 4))


def permuted(spark, sf_dir):
    return O.ranked(docs(spark, sf_dir).select("doc_id", H.sha(F.concat(F.lit("seed:"), F.col("doc_id").cast("string"))).alias("key")), ["key"], "position")


def interleave(spark, sf_dir):
    counts = banded(spark, sf_dir).groupBy("band").count()
    return O.interleaved(O.largest_remainder(counts))


QUERIES = {
    "hash_rank_topk": lambda s, d: hashed(s, d).orderBy("rank", F.desc("doc_id")).limit(64).select("doc_id", "rank"),
    "hash_topk_per_stratum": lambda s, d: O.top_per_group(hashed(s, d), ["lang"], [F.col("rank"), F.col("doc_id")], 16).select("lang", "doc_id", "place"),
    "blind_shuffle_order": lambda s, d: O.ranked(hashed(s, d).select("doc_id", H.salted_rank("blind", F.col("sha")).alias("blind")), ["blind", "doc_id"], "position").select("doc_id", "position"),
    "hash_split_counts": lambda s, d: hashed(s, d).groupBy((H.bucket(F.col("sha"), 16, 100) == 0).alias("development"), "lang").agg(F.count("*").alias("n")),
    "hash_permutation_fixed_points": lambda s, d: permuted(s, d).agg(F.count("*").alias("n"), F.count_if(F.col("position") == F.col("doc_id")).alias("fixed")),
    "contiguous_shards": lambda s, d: O.ranked(docs(s, d).select("doc_id"), ["doc_id"], "i").crossJoin(F.broadcast(docs(s, d).agg(F.count("*").alias("n")))).groupBy(F.floor(((F.col("i") + 1) * 8 - 1) / F.col("n")).cast("long").alias("shard")).agg(F.count("*").alias("rows"), F.min("doc_id").alias("first")),
    "largest_remainder_alloc": lambda s, d: O.largest_remainder(docs(s, d).groupBy(F.when(F.col("lang") == "en", "foundation").when(F.col("lang") == "fr", "composition").when(F.col("lang") == "de", "reasoning").otherwise("specialization").alias("band")).count()).select("band", "phase_index", "n"),
    "phase_assignment": lambda s, d: O.phases(banded(s, d)).groupBy("band", "phase_index").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids")),
    "deficit_interleave": interleave,
    "learnability_bands": lambda s, d: by_strength(s, d).groupBy("phase", F.floor(F.col("r") / 100).cast("long").alias("band")).agg(F.count("*").alias("n"), F.min("strong").alias("low"), F.max("strong").alias("high")),
    "ntile_phase_bands": lambda s, d: quarters(s, d).groupBy("phase", "band").agg(F.count("*").alias("n"), F.sum("strong").alias("strong")),
    "score_summary": lambda s, d: learnable(s, d).groupBy("phase").agg(F.min(F.col("weak") - F.col("strong")).alias("low"), F.max(F.col("weak") - F.col("strong")).alias("high"), F.floor(F.sum(F.col("weak") - F.col("strong")) / F.count("*")).alias("mean")),
    "pack_sequence_ids": lambda s, d: packed(s, d).select("doc_id", "offset", "first_sequence", "last_sequence"),
    "prefix_ledger": lambda s, d: packed(s, d).groupBy("first_sequence").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens")),
    "segment_boundaries": lambda s, d: packed(s, d).select(F.explode(F.sequence("first_sequence", "last_sequence")).alias("sequence")).groupBy("sequence").agg(F.count("*").alias("segments")),
    "loss_mask_counts": lambda s, d: packed(s, d).agg(F.sum(F.col("tokens") + 1).alias("positions"), F.sum("tokens").alias("targets"), F.max("last_sequence").alias("last")),
    "sorted_multiset_digest": lambda s, d: hashed(s, d).groupBy(F.substring("sha", 1, 2).alias("part")).agg(F.sha2(F.unhex(F.array_join(F.sort_array(F.collect_list("sha")), "")), 256).alias("digest")),
    "xor_fingerprint": lambda s, d: hashed(s, d).agg(F.count("*").alias("n"), *(F.bit_xor(F.conv(F.substring("sha", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"x{i}") for i in range(8)), *(F.sum(F.conv(F.substring("sha", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"s{i}") for i in range(8))),
}

HASHED = "h AS (SELECT doc_id, lang, source, sha256(text) AS sha, sha256('sample'::blob || unhex(sha256(text))) AS rank FROM documents)"
PACKED = f"""t AS (SELECT doc_id, lang, len(regexp_split_to_array(text, '\\s+')) AS tokens FROM documents),
p AS (SELECT *, coalesce(sum(tokens + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS "offset" FROM t),
k AS (SELECT *, "offset" // {LENGTH} AS first_sequence, ("offset" + tokens) // {LENGTH} AS last_sequence FROM p)"""
LEARN = "l AS (SELECT doc_id, 100000 + n_chars AS strong, 100000 + n_chars + doc_id % 997 AS weak, sha256(doc_id::varchar) AS rec, doc_id % 4 AS phase FROM documents)"
SHARES = "sh AS (SELECT * FROM (VALUES " + ", ".join(f"('{b}', {i}, {x})" for b, row in O.SHARES.items() for i, x in enumerate(row)) + ") AS v(band, phase_index, share))"
WORD = "('0x' || substr(sha, {a}, 8))::bigint"

BANDED = f"""{SCORED}, ba AS (SELECT doc_id, text, band FROM s3 WHERE len(reasons) = 0), {SHARES}, cb AS (SELECT band, count(*) AS n FROM ba GROUP BY band),
ex AS (SELECT band, phase_index, n, n * share::double AS x, floor(n * share::double) AS w FROM cb JOIN sh USING (band)),
rx AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY x - w DESC, phase_index) AS place, n - sum(w) OVER (PARTITION BY band) AS lft FROM ex),
al AS (SELECT band, phase_index, (w + (place <= lft)::int)::bigint AS n FROM rx)"""

DEALT = f"""ta AS (SELECT phase_index, sum(n)::bigint AS total, [{", ".join(f"coalesce(sum(n) FILTER (WHERE band = '{b}'), 0)::bigint" for b in O.SHARES)}] AS t FROM al GROUP BY phase_index),
r AS (SELECT phase_index, t, total, [0, 0, 0, 0]::bigint[] AS s, -1 AS position, 0 AS best FROM ta
  UNION ALL SELECT phase_index, t, total, [s[1] + (b = 1)::bigint, s[2] + (b = 2)::bigint, s[3] + (b = 3)::bigint, s[4] + (b = 4)::bigint], position + 1, b
  FROM (SELECT *, list_position(l, list_max(l)) AS b FROM (SELECT *, [{", ".join(f"CASE WHEN s[{i}] < t[{i}] THEN t[{i}] * (position + 2) - s[{i}] * total ELSE -1000000000000 END" for i in (1, 2, 3, 4))}] AS l FROM r WHERE position + 1 < total)))"""

ORACLES = {
    "hash_rank_topk": f"WITH {HASHED} SELECT doc_id, rank FROM h ORDER BY rank, doc_id DESC LIMIT 64",
    "hash_topk_per_stratum": f"WITH {HASHED}, r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY rank, doc_id) AS place FROM h) SELECT * FROM r WHERE place <= 16",
    "blind_shuffle_order": f"WITH {HASHED} SELECT doc_id, row_number() OVER (ORDER BY sha256('blind'::blob || unhex(sha)), doc_id) - 1 AS position FROM h",
    "hash_split_counts": f"WITH {HASHED} SELECT (('0x' || substr(sha, 1, 16))::ubigint % 100) = 0 AS development, lang, count(*) AS n FROM h GROUP BY 1, 2",
    "hash_permutation_fixed_points": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('seed:' || doc_id)) - 1 AS position FROM documents) SELECT count(*) AS n, count_if(position = doc_id) AS fixed FROM r",
    "contiguous_shards": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT ((i + 1) * 8 - 1) // n AS shard, count(*) AS rows, min(doc_id) AS first FROM r GROUP BY 1",
    "largest_remainder_alloc": f"""WITH {SHARES}, c AS (SELECT CASE lang WHEN 'en' THEN 'foundation' WHEN 'fr' THEN 'composition' WHEN 'de' THEN 'reasoning' ELSE 'specialization' END AS band, count(*) AS n FROM documents GROUP BY 1),
e AS (SELECT band, phase_index, n, n * share::double AS x, floor(n * share::double) AS w FROM c JOIN sh USING (band)),
r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY x - w DESC, phase_index) AS place, n - sum(w) OVER (PARTITION BY band) AS lft FROM e)
SELECT band, phase_index, (w + (place <= lft)::int)::bigint AS n FROM r""",
    "phase_assignment": f"""WITH {BANDED}, bk AS (SELECT doc_id, band, ('0x' || substr(sha256(text), 1, 8))::bigint % 16 AS bucket FROM ba),
rk AS (SELECT doc_id, band, row_number() OVER (PARTITION BY band ORDER BY sha256('loomery-order:' || band || ':' || bucket), doc_id) - 1 AS r FROM bk),
li AS (SELECT band, phase_index, n, sum(n) OVER (PARTITION BY band ORDER BY phase_index) AS stop FROM al)
SELECT rk.band, phase_index, count(*) AS n, sum(doc_id)::bigint AS ids FROM rk JOIN li ON rk.band = li.band AND r >= stop - n AND r < stop GROUP BY ALL""",
    "deficit_interleave": f"""WITH RECURSIVE {BANDED}, {DEALT}
SELECT phase_index, position, {list(O.SHARES)}[best] AS band, s[best] - 1 AS k FROM r WHERE position >= 0""",
    "learnability_bands": f"WITH {LEARN}, r AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY strong, weak - strong DESC, weak, rec) AS r FROM l) SELECT phase, (r - 1) // 100 AS band, count(*) AS n, min(strong) AS low, max(strong) AS high FROM r GROUP BY 1, 2",
    "ntile_phase_bands": f"WITH {LEARN}, r AS (SELECT *, ntile(4) OVER (PARTITION BY phase ORDER BY strong, rec) AS band FROM l) SELECT phase, band, count(*) AS n, sum(strong)::bigint AS strong FROM r GROUP BY 1, 2",
    "score_summary": f"WITH {LEARN} SELECT phase, min(weak - strong) AS low, max(weak - strong) AS high, floor(sum(weak - strong) / count(*))::bigint AS mean FROM l GROUP BY phase",
    "pack_sequence_ids": f'WITH {PACKED} SELECT doc_id, "offset", first_sequence, last_sequence FROM k',
    "prefix_ledger": f"WITH {PACKED} SELECT first_sequence, count(*) AS documents, sum(tokens)::bigint AS tokens FROM k GROUP BY 1",
    "segment_boundaries": f"WITH {PACKED}, u AS (SELECT unnest(range(first_sequence, last_sequence + 1)) AS sequence FROM k) SELECT sequence, count(*) AS segments FROM u GROUP BY 1",
    "loss_mask_counts": f"WITH {PACKED} SELECT sum(tokens + 1)::bigint AS positions, sum(tokens)::bigint AS targets, max(last_sequence) AS last FROM k",
    "sorted_multiset_digest": f"WITH {HASHED} SELECT substr(sha, 1, 2) AS part, sha256(unhex(string_agg(sha, '' ORDER BY sha))) AS digest FROM h GROUP BY 1",
    "xor_fingerprint": f"WITH {HASHED} SELECT count(*) AS n, " + ", ".join(f"bit_xor({WORD.format(a=8 * i + 1)}) AS x{i}" for i in range(8)) + ", " + ", ".join(f"sum({WORD.format(a=8 * i + 1)})::bigint AS s{i}" for i in range(8)) + " FROM h",
}
