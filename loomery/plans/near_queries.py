"""Queries on near-duplicates and the curriculum built without them, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import text as T
from loomery.operators import near as N
from loomery.operators import ordering as O
from loomery.operators import quality as Q
from loomery.plans import order_queries as R
from loomery.plans.text_queries import W
from loomery.sources.tables import table


def docs(s, d):
    return table(s, d, "documents")


def nodes(s, d):
    return O.settled(N.sketched(docs(s, d)))


def pairs(s, d):
    return N.candidate_pairs(nodes(s, d))


def kept(s, d):
    every = nodes(s, d)
    return N.greedy_kept(every, N.candidate_pairs(every))


def built(s, d):
    """The curriculum: documents of sound quality, without near-duplicates, banded, shared out to phases, interleaved."""
    sound = Q.with_signals(docs(s, d)).filter(F.size("quality_reasons") == 0).withColumn("bucket", O.bucket(F.col("text")))
    rows = O.settled(N.with_sketch(sound, "doc_id", "band", "bucket"))
    return O.curriculum(N.kept_of(rows).select("doc_id", "band", "bucket"))


QUERIES = {
    "evenly_spaced_positions": lambda s, d: docs(s, d).select("doc_id", F.array_join(N.evenly_spaced((F.col("doc_id") % 400).cast("int")), ",").alias("positions")),
    "minhash_sketches": lambda s, d: docs(s, d).select("doc_id", T.words(T.nfkc_casefold(F.col("text"))).alias("w")).select("doc_id", N.sketch(F.col("w")).alias("k")).select("doc_id", F.array_join("k", ",").alias("sketch")),
    "minhash_candidate_pairs": pairs,
    "near_dup_greedy_kept": kept,
    "build_curriculum": built,
    "curriculum_phase_stats": lambda s, d: built(s, d).groupBy("phase_index", "band").agg(F.count("*").alias("n"), F.sum("position").alias("positions"), F.max("position").alias("last")),
}

EVEN = "CASE WHEN {n} <= 0 THEN [] WHEN {n} <= 128 THEN range({n}) ELSE list_transform(range(128), lambda i: i * ({n} - 1) // 127) END"
SKETCHED = f"""sk AS (SELECT doc_id, list_transform({EVEN.format(n="(len(w) - 4)")}, lambda p: sha256(array_to_string(w[p + 1:p + 5], chr(31)))[1:16]) AS g FROM {W} WHERE len(w) >= 5),
ks AS (SELECT doc_id, [{", ".join(f"coalesce(list_min(list_filter(g, lambda x: ('0x' || x[16])::int % 8 = {b})), '{N.EMPTY}')" for b in range(8))}] AS k FROM sk),
no AS (SELECT k, min(doc_id) AS first FROM ks GROUP BY k),
pr AS (SELECT x.first AS a, y.first AS b FROM no x JOIN no y ON x.first < y.first AND {" + ".join(f"(x.k[{i}] = y.k[{i}])::int" for i in range(1, 9))} >= 6)"""
GREEDY = """od AS (SELECT first, row_number() OVER (ORDER BY first) AS i FROM (SELECT DISTINCT unnest([a, b]) AS first FROM pr)),
nb AS (SELECT b, list(a) AS near FROM pr GROUP BY b),
gr AS (SELECT 0 AS i, []::bigint[] AS kept UNION ALL
  SELECT od.i, CASE WHEN near IS NOT NULL AND list_has_any(near, kept) THEN kept ELSE list_append(kept, od.first) END FROM gr JOIN od ON od.i = gr.i + 1 LEFT JOIN nb ON nb.b = od.first),
ok AS (SELECT first FROM no WHERE first NOT IN (SELECT first FROM od) UNION ALL SELECT unnest(kept) FROM (SELECT kept FROM gr ORDER BY i DESC LIMIT 1))"""
CURRICULUM = R.BANDED.replace("FROM s3 WHERE len(reasons) = 0)", "FROM s3 WHERE len(reasons) = 0 AND doc_id IN (SELECT first FROM ok))").replace(
    R.SCORED, f"{R.SCORED}, ss AS (SELECT doc_id FROM s3 WHERE len(reasons) = 0), {SKETCHED.replace(f'FROM {W} WHERE', f'FROM {W} WHERE doc_id IN (SELECT doc_id FROM ss) AND')}, {GREEDY}"
)
PLACED = f"""{CURRICULUM}, bk AS (SELECT doc_id, band, ('0x' || substr(sha256(text), 1, 8))::bigint % 16 AS bucket FROM ba),
rk AS (SELECT doc_id, band, row_number() OVER (PARTITION BY band ORDER BY sha256('loomery-order:' || band || ':' || bucket), doc_id) - 1 AS rank FROM bk),
li AS (SELECT band, phase_index, n, sum(n) OVER (PARTITION BY band ORDER BY phase_index) AS stop FROM al),
pl AS (SELECT doc_id, rk.band, phase_index, rank - (stop - n) AS k FROM rk JOIN li ON rk.band = li.band AND rank >= stop - n AND rank < stop),
{R.DEALT}, po AS (SELECT phase_index, position, {list(O.SHARES)}[best] AS band, s[best] - 1 AS k FROM r WHERE position >= 0),
cu AS (SELECT doc_id, band, phase_index, position FROM pl JOIN po USING (phase_index, band, k))"""

ORACLES = {
    "evenly_spaced_positions": f"SELECT doc_id, array_to_string({EVEN.format(n='(doc_id % 400)')}, ',') AS positions FROM documents",
    "minhash_sketches": f"WITH {SKETCHED} SELECT doc_id, array_to_string(k, ',') AS sketch FROM documents LEFT JOIN ks USING (doc_id)",
    "minhash_candidate_pairs": f"WITH {SKETCHED} SELECT a, b FROM pr",
    "near_dup_greedy_kept": f"WITH RECURSIVE {SKETCHED}, {GREEDY} SELECT first FROM ok",
    "build_curriculum": f"WITH RECURSIVE {PLACED} SELECT * FROM cu",
    "curriculum_phase_stats": f"WITH RECURSIVE {PLACED} SELECT phase_index, band, count(*) AS n, sum(position)::bigint AS positions, max(position) AS last FROM cu GROUP BY ALL",
}
