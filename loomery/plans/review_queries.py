"""Queries on taxonomies, progressions, samples and reviewers, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import hashing as H
from loomery.operators import reviews as V
from loomery.sources.tables import table

DOMAINS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "OCEANIA"]
TOP = [f"t{i}" for i in range(6)]


def concepts(s, d):
    """Nations as concepts: each needs the one five below it, and some rows are faulty."""
    i = F.col("n_nationkey")
    name = lambda k: F.concat(F.lit("c"), k.cast("string"))
    needs = F.when(i == 7, F.array(name(i))).when(i == 9, F.array(name(i + 90))).when(i == 11, F.array(name(i - 5), name(i - 5))).when(i >= 5, F.array(name(i - 5))).otherwise(F.array().cast("array<string>"))
    return table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.when(i == 13, "c12").otherwise(name(i)).alias("concept"), F.when(i == 3, " ").otherwise(F.col("n_name")).alias("name"), F.when(F.col("r_name") == "MIDDLE EAST", "ASIA").otherwise(F.col("r_name")).alias("domain"),
        needs.alias("prerequisites"), F.when(i == 15, 0).when(i >= 5, 2).otherwise(0).alias("least_prior"),
    )


def edges(s, d):
    i = F.col("n_nationkey")
    return table(s, d, "nation").filter("n_nationkey >= 5").select((i - 5).cast("string").alias("a"), i.cast("string").alias("b"), (i % 4 + 1).cast("int").alias("least"))


def looped(s, d):
    """The same edges, and one back from 20 to 0 and one from 3 to itself."""
    more = s.createDataFrame([("20", "0"), ("3", "3")], "a string, b string")
    return edges(s, d).select("a", "b").unionByName(more)


def exposures(s, d):
    """Two concepts a document; the phase follows the document's number, and falls back in some."""
    i = F.col("doc_id")
    every = F.array((i % 23).cast("string"), (i % 7 + 10).cast("string"))
    phase = F.floor(i / 300).cast("int") - F.when(i % 97 == 96, 1).otherwise(0)
    return table(s, d, "documents").select(i.alias("doc"), phase.alias("phase"), F.explode(F.array_distinct(every)).alias("concept"))


def required(s, d):
    i = F.col("n_nationkey")
    return table(s, d, "nation").select(i.cast("string").alias("concept"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("phase")).withColumn("least", F.when(F.col("concept").cast("int") % 3 > F.col("phase"), 0).otherwise(F.col("concept").cast("int") % 20).cast("int"))


def reviewer(s, d, shift):
    i = F.col("doc_id")
    return table(s, d, "documents").select(
        "doc_id", F.slice(F.array(*map(F.lit, TOP)), ((i + F.when(i % 19 == 0, shift).otherwise(0)) % 3 + 1).cast("int"), 2).alias("taught"),
        F.slice(F.array(*map(F.lit, TOP)), (i % 4 + 1).cast("int"), (1 + F.when(i % 31 == 0, shift).otherwise(0)).cast("int")).alias("assumed"),
        (500000 + (i % 50) * 1000 + shift * F.when(i % 13 == 0, 150000).otherwise(50000)).alias("quality"),
    )


def compared(s, d):
    return V.differences(reviewer(s, d, 0), reviewer(s, d, 1), "doc_id", ["taught", "assumed"], {"quality": 100000})


def stratified(s, d):
    rows = table(s, d, "documents").select("doc_id", (F.col("doc_id") % 4).alias("phase"), F.when(F.col("doc_id") % 4 == 0, 0).otherwise(F.col("doc_id") % 3).alias("band"))
    return V.sampled(rows, ["phase", "band"], "sample:", "doc_id", 8)


def attempts(s, d):
    e = table(s, d, "events")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select("user_id", (n + F.when((F.col("user_id") % 7 == 0) & (n > 1), 1).otherwise(0)).alias("attempt"), (F.col("event_type") != "purchase").alias("failed"))


def same(s, d, other):
    """Records before and after a reordering that keeps, loses or repeats one."""
    before = table(s, d, "documents").select(H.sha(F.col("text")).alias("record"))
    after = before.repartition(3, "record")
    after = {"kept": after, "lost": after.join(after.agg(F.min("record").alias("record")), "record", "left_anti"), "again": after.unionByName(after.limit(1))}[other]
    return V.same_multiset(before, after)


def sources(s, d):
    docs = table(s, d, "documents").select("doc_id", "text", F.lit(0).alias("source_order"))
    more = table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit(1).alias("source_order"))
    return docs.unionByName(more)


def split_rows(s, d):
    identity = H.sha(F.col("text"))
    return table(s, d, "documents").select("doc_id", identity.alias("identity"), (H.bucket(identity, 16, 100) == 0).alias("development"), (F.col("doc_id") % 4).alias("phase"))


def blind_round_trip(s, d):
    """Blind rows annotated under their salted names and restored by the key."""
    blind, key = V.blinded(table(s, d, "documents").select("doc_id", "lang", "source", "n_chars"), "packet:", "doc_id", ["lang", "n_chars"])
    notes = blind.select("blind_id", (F.col("n_chars") % 5).alias("note"))
    return V.restored(notes, key).select("doc_id", "source", "blind_id", "note")


QUERIES = {
    "taxonomy_validate": lambda s, d: V.taxonomy_faults(concepts(s, d), DOMAINS),
    "cycle_check": lambda s, d: V.cyclic(looped(s, d)),
    "prior_exposures": lambda s, d: V.prior_exposures(exposures(s, d), edges(s, d)),
    "progression_violations": lambda s, d: V.prior_exposures(exposures(s, d), edges(s, d)).filter("prior < least"),
    "new_concept_density": lambda s, d: V.new_concepts(exposures(s, d)),
    "phase_coverage_faults": lambda s, d: V.coverage_faults(exposures(s, d), required(s, d)),
    "premature_exposures": lambda s, d: V.premature(exposures(s, d), required(s, d)).select("doc", "concept", "phase", "earliest"),
    "phase_monotonic": lambda s, d: V.not_monotone(exposures(s, d).select("doc", "phase").distinct(), "doc", "phase"),
    "missing_concepts": lambda s, d: table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("concept")).join(exposures(s, d).select("concept"), "concept", "left_anti"),
    "stratified_phase_band_sample": stratified,
    "blind_packet_restored": blind_round_trip,
    "reviewer_differences": lambda s, d: compared(s, d),
    "adjudication_agreement": lambda s, d: V.agreement(compared(s, d), "doc_id"),
    "disagreement_priority": lambda s, d: V.by_priority(compared(s, d), "doc_id", {"taught_differs": 3, "assumed_differs": 2, "quality_differs": 1}, 50),
    "review_qualification": lambda s, d: V.qualified(table(s, d, "labels").select((F.col("quality") == 1).alias("truth"), ((F.col("quality") == 1) & (F.col("doc_id") % 40 != 0)).alias("label"))),
    "shard_completeness": lambda s, d: V.complete(table(s, d, "nation").select("n_nationkey", F.length(F.lit("v1")).alias("policy")), "n_nationkey", ["policy"]),
    "attempt_log_replay": lambda s, d: V.attempts_sound(attempts(s, d), "user_id", "attempt", "failed"),
    "multiset_equality": lambda s, d: s.createDataFrame([(k, same(s, d, k)) for k in ("kept", "lost", "again")], "change string, same boolean"),
    "canonical_list_hash": lambda s, d: exposures(s, d).groupBy("phase").agg(V.list_digest(F.sort_array(F.collect_set("concept"))).alias("digest")),
    "union_sources": lambda s, d: sources(s, d).groupBy("source_order").agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")),
    "split_curriculum": lambda s, d: split_rows(s, d).groupBy("phase", "development").agg(F.count("*").alias("n"), F.min("identity").alias("first")),
    "disjoint_split": lambda s, d: split_rows(s, d).groupBy("identity").agg(F.count_distinct("development").alias("sides")).agg(F.count("*").alias("identities"), F.count_if(F.col("sides") > 1).alias("on_both_sides")),
    "distinct_identity_assert": lambda s, d: split_rows(s, d).agg(F.count("*").alias("rows"), F.count_distinct("identity").alias("identities"), (F.count("*") == F.count_distinct("doc_id")).alias("unique_ids")),
}

CONCEPTS = """co AS (SELECT n_nationkey AS i, CASE WHEN n_nationkey = 13 THEN 'c12' ELSE 'c' || n_nationkey END AS concept, CASE WHEN n_nationkey = 3 THEN ' ' ELSE n_name END AS name, CASE WHEN r_name = 'MIDDLE EAST' THEN 'ASIA' ELSE r_name END AS domain,
  CASE WHEN n_nationkey = 7 THEN ['c7'] WHEN n_nationkey = 9 THEN ['c99'] WHEN n_nationkey = 11 THEN ['c6', 'c6'] WHEN n_nationkey >= 5 THEN ['c' || (n_nationkey - 5)] ELSE []::varchar[] END AS needs,
  CASE WHEN n_nationkey = 15 THEN 0 WHEN n_nationkey >= 5 THEN 2 ELSE 0 END AS least FROM nation JOIN region ON n_regionkey = r_regionkey)"""
EDGES = "ed AS (SELECT (n_nationkey - 5)::varchar AS a, n_nationkey::varchar AS b, n_nationkey % 4 + 1 AS least FROM nation WHERE n_nationkey >= 5)"
EXPOSED = "xp AS (SELECT doc_id AS doc, doc_id // 300 - CASE WHEN doc_id % 97 = 96 THEN 1 ELSE 0 END AS phase, unnest(list_distinct([(doc_id % 23)::varchar, (doc_id % 7 + 10)::varchar])) AS concept FROM documents)"
PRIOR = f"{EDGES}, {EXPOSED}, pr AS (SELECT x.doc, x.concept, ed.a AS needs, ed.least, (SELECT count(*) FROM xp y WHERE y.concept = ed.a AND y.doc < x.doc) AS prior FROM xp x JOIN ed ON x.concept = ed.b)"
REQUIRED = "rq AS (SELECT n_nationkey::varchar AS concept, p.range AS phase, CASE WHEN n_nationkey % 3 > p.range THEN 0 ELSE n_nationkey % 20 END AS least FROM nation, range(3) p)"
SIDE = "SELECT doc_id, {t}[(doc_id + CASE WHEN doc_id % 19 = 0 THEN {s} ELSE 0 END) % 3 + 1:(doc_id + CASE WHEN doc_id % 19 = 0 THEN {s} ELSE 0 END) % 3 + 2] AS taught, {t}[doc_id % 4 + 1:doc_id % 4 + 1 + CASE WHEN doc_id % 31 = 0 THEN {s} ELSE 0 END] AS assumed, 500000 + doc_id % 50 * 1000 + {s} * CASE WHEN doc_id % 13 = 0 THEN 150000 ELSE 50000 END AS quality FROM documents"
FLAGS = f"fl AS (SELECT l.doc_id, l.taught <> r.taught AS taught_differs, l.assumed <> r.assumed AS assumed_differs, abs(l.quality - r.quality) > 100000 AS quality_differs FROM ({SIDE.format(t=TOP, s=0)}) l JOIN ({SIDE.format(t=TOP, s=1)}) r USING (doc_id))"
SPLIT = "sp AS (SELECT doc_id, sha256(text) AS identity, (('0x' || substr(sha256(text), 1, 16))::ubigint % 100) = 0 AS development, doc_id % 4 AS phase FROM documents)"

ORACLES = {
    "taxonomy_validate": f"""WITH {CONCEPTS} SELECT concept, 'repeated' AS fault FROM (SELECT concept, count(*) OVER (PARTITION BY concept) AS n FROM co) WHERE n > 1
UNION ALL SELECT concept, 'unnamed' FROM co WHERE trim(name) = '' UNION ALL SELECT concept, 'domain' FROM co WHERE domain NOT IN ({", ".join(f"'{x}'" for x in DOMAINS)})
UNION ALL SELECT concept, 'own_prerequisite' FROM co WHERE list_contains(needs, concept) UNION ALL SELECT concept, 'repeated_prerequisite' FROM co WHERE len(list_distinct(needs)) < len(needs)
UNION ALL SELECT concept, 'threshold' FROM co WHERE (len(needs) > 0) <> (least > 0) UNION ALL SELECT concept, 'absent_prerequisite' FROM (SELECT concept, unnest(needs) AS n FROM co) WHERE n NOT IN (SELECT concept FROM co)
UNION ALL SELECT NULL, 'uncovered:' || x FROM (SELECT unnest({DOMAINS}) AS x) WHERE x NOT IN (SELECT domain FROM co)""",
    "cycle_check": f"WITH RECURSIVE {EDGES}, e AS (SELECT a, b FROM ed UNION ALL VALUES ('20', '0'), ('3', '3')), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node FROM r WHERE a = b",
    "prior_exposures": f"WITH {PRIOR} SELECT * FROM pr",
    "progression_violations": f"WITH {PRIOR} SELECT * FROM pr WHERE prior < least",
    "new_concept_density": f"WITH {EXPOSED} SELECT doc, count(*) AS new FROM (SELECT min(doc) AS doc FROM xp GROUP BY concept) GROUP BY doc",
    "phase_coverage_faults": f"WITH {EXPOSED}, {REQUIRED}, se AS (SELECT concept, phase, count(DISTINCT doc) AS seen FROM xp GROUP BY ALL) SELECT concept, phase, least, coalesce(seen, 0) AS seen FROM rq LEFT JOIN se USING (concept, phase) WHERE coalesce(seen, 0) < least",
    "premature_exposures": f"WITH {EXPOSED}, {REQUIRED}, ea AS (SELECT concept, min(phase) AS earliest FROM rq WHERE least > 0 GROUP BY concept) SELECT doc, concept, phase, earliest FROM xp JOIN ea USING (concept) WHERE phase < earliest",
    "phase_monotonic": f"WITH {EXPOSED} SELECT doc, phase FROM (SELECT doc, phase, lag(phase) OVER (ORDER BY doc) AS p FROM (SELECT DISTINCT doc, phase FROM xp)) WHERE phase < p",
    "missing_concepts": f"WITH {EXPOSED} SELECT n_nationkey::varchar AS concept FROM nation WHERE n_nationkey::varchar NOT IN (SELECT concept FROM xp)",
    "stratified_phase_band_sample": """WITH x AS (SELECT doc_id, doc_id % 4 AS phase, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 3 END AS band FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY phase, band ORDER BY sha256('sample:' || doc_id), doc_id) AS p, count(*) OVER (PARTITION BY phase, band) >= 8 AS enough FROM x) SELECT doc_id, phase, band, enough FROM r WHERE p <= 8""",
    "blind_packet_restored": "SELECT doc_id, source, sha256('packet:' || doc_id) AS blind_id, n_chars % 5 AS note FROM documents",
    "reviewer_differences": f"WITH {FLAGS} SELECT * FROM fl",
    "adjudication_agreement": f"WITH {FLAGS}, u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS dimension, count_if({c}) AS differing, count(*) AS rows FROM fl" for c in ("taught_differs", "assumed_differs", "quality_differs")) + f") SELECT *, ((differing * 1000000 + rows - 1) // rows)::bigint AS ppm, (differing * 1000000 + rows - 1) // rows <= {V.MOST_DIFFERENT} AS within FROM u",
    "disagreement_priority": f"WITH {FLAGS}, p AS (SELECT doc_id, 3 * taught_differs::int + 2 * assumed_differs::int + quality_differs::int AS priority FROM fl) SELECT * FROM p WHERE priority > 0 ORDER BY priority DESC, doc_id LIMIT 50",
    "review_qualification": f"""WITH r AS (SELECT quality = 1 AS t, quality = 1 AND doc_id % 40 <> 0 AS l FROM labels), x AS (SELECT count(*) AS reviewed, count_if(t) AS positive, count_if(NOT t) AS negative, count_if(t AND NOT l) AS missed, count_if(NOT t AND l) AS wrong FROM r),
y AS (SELECT *, CASE WHEN positive > 0 THEN ((missed * 1000000 + positive - 1) // positive)::bigint END AS missed_ppm, CASE WHEN negative > 0 THEN ((wrong * 1000000 + negative - 1) // negative)::bigint END AS wrong_ppm FROM x)
SELECT *, reviewed >= 100 AND positive >= 100 AND negative >= 100 AND missed_ppm <= {V.MOST_DIFFERENT} AND wrong_ppm <= {V.MOST_DIFFERENT} AS qualified FROM y""",
    "shard_completeness": "SELECT count(*) AS shards, min(n_nationkey) = 0 AND max(n_nationkey) = count(*) - 1 AND count(DISTINCT n_nationkey) = count(*) AS complete FROM nation",
    "attempt_log_replay": """WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, event_type <> 'purchase' AS failed FROM events),
b AS (SELECT user_id, n + CASE WHEN user_id % 7 = 0 AND n > 1 THEN 1 ELSE 0 END AS n, failed FROM a),
g AS (SELECT user_id, count(*) AS attempts, min(n) AS lo, max(n) AS hi, count(DISTINCT n) AS k, count_if(NOT failed) AS good, arg_max(failed, n) AS last FROM b GROUP BY user_id)
SELECT user_id, attempts, lo = 0 AND hi = attempts - 1 AND k = attempts AND good = CASE WHEN last THEN 0 ELSE 1 END AS sound FROM g""",
    "multiset_equality": "SELECT * FROM (VALUES ('kept', true), ('lost', false), ('again', false)) v(change, same)",
    "canonical_list_hash": f"""WITH {EXPOSED} SELECT phase, sha256('["' || string_agg(concept, '","' ORDER BY concept) || '"]') AS digest FROM (SELECT DISTINCT phase, concept FROM xp) GROUP BY phase""",
    "union_sources": "SELECT 0 AS source_order, count(*) AS rows, count(DISTINCT doc_id) AS ids FROM documents UNION ALL SELECT 1, count(*), count(DISTINCT item_id) FROM benchmark",
    "split_curriculum": f"WITH {SPLIT} SELECT phase, development, count(*) AS n, min(identity) AS first FROM sp GROUP BY ALL",
    "disjoint_split": f"WITH {SPLIT} SELECT count(*) AS identities, count_if(k > 1) AS on_both_sides FROM (SELECT count(DISTINCT development) AS k FROM sp GROUP BY identity)",
    "distinct_identity_assert": f"WITH {SPLIT} SELECT count(*) AS rows, count(DISTINCT identity) AS identities, count(*) = count(DISTINCT doc_id) AS unique_ids FROM sp",
}
