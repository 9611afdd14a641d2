"""Queries on whole flows, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import hashing as H
from loomery.functions import text as T
from loomery.operators import contracts as K
from loomery.operators import flows as L
from loomery.operators import ordering as O
from loomery.operators import quality as Q
from loomery.operators import reviews as V
from loomery.plans import contract_queries as CQ
from loomery.plans.order_queries import BANDED
from loomery.plans.parsing_queries import META, TOKENS, pick
from loomery.plans.text_queries import GRAMS, NORM, SIMPLE, _n
from loomery.sources.tables import table

HOSTS = ["math.org", "www.chegg.com", "a.jiskha.com", "", "chegg.com.org"]
ADDED = ["", " We define x = 2 because the proof of the theorem follows; hence, for example, y = 3.", " click here", " $a + b$ is an equation, suppose a solution"]


def math_rows(s, d):
    """Texts as scored pages: hosts, metadata, scores and language shares by number, some with a sentence added."""
    host = F.element_at(F.array(*map(F.lit, HOSTS)), (F.col("doc_id") % 5 + 1).cast("int"))
    url = F.when(host != "", F.concat(F.lit("https://"), host, F.lit("/x"))).otherwise("no address")
    added = F.element_at(F.array(*map(F.lit, ADDED)), (F.col("doc_id") % 4 + 1).cast("int"))
    meta = F.element_at(F.array(*map(F.lit, META[:3])), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = table(s, d, "documents").select("doc_id", F.concat("text", added).alias("text"), url.alias("url"), meta.alias("metadata"), (5 - F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("int_score"), (1 - (F.col("doc_id") % 17) / 100).alias("language_score"))
    return rows.withColumn("reasons", L.math_reasons(T.host(F.col("url"))))


def climbed(s, d):
    return L.ladder(math_rows(s, d), "doc_id")


def candidates(s, d):
    return climbed(s, d).filter("size(filter(reasons, r -> r not in ('found_math_absent', 'under_160_words', 'denied_answer_farm_host', 'url_host_absent_or_malformed', 'upstream_score_below_5'))) = 0")


def role_rows(s, d):
    """Turns as training rows of four roles; some prompts are benchmark items, some repeat earlier ones."""
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"), F.max_by("text", "turn").alias("answer"))
    b = table(s, d, "benchmark").select((F.col("item_id") * 20).alias("conv_id"), F.col("text").alias("item"))
    rows = c.join(b, "conv_id", "left")
    order = F.col("conv_id") % 4 * 1_000_000 + F.col("conv_id")
    role = F.element_at(F.array(*map(F.lit, sorted(K.ROLE_MODES))), (F.col("conv_id") % 4 + 1).cast("int"))
    response = F.when(role == "rl_prompts", None).otherwise(F.when(F.col("conv_id") % 40 == 20, F.col("item")).otherwise(F.col("answer")))
    prompt = F.when(F.col("conv_id") % 40 == 0, F.coalesce("item", "prompt")).otherwise(F.concat("prompt", F.when(F.col("conv_id") % 6 == 0, "").otherwise(F.concat(F.lit(" "), F.floor(F.col("conv_id") / 3).cast("string")))))
    return rows.select(order.alias("ord"), role.alias("role"), prompt.alias("prompt"), response.alias("response"), (F.col("conv_id") % 23 == 0).alias("malformed"))


def receipts(s, d):
    """A receipt a language, one of them altered afterwards."""
    sums = table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("characters"))
    return L.sound_receipts(L.receipt(sums).withColumn("rows", F.col("rows") + F.when(F.col("lang") == "de", 1).otherwise(0)))


def learn_rows(s, d):
    return table(s, d, "documents").select((F.col("doc_id") % 4).alias("phase"), F.floor(F.col("n_chars") / 4000).alias("band"), F.col("n_chars").alias("nll")).filter("band < 4")


def matrix(s, d):
    """Orders by customer group and priority as a policy of four phases and bands."""
    o = table(s, d, "orders").select((F.col("o_custkey") % 4).alias("phase"), (F.col("o_orderkey") % 4).alias("band"))
    return o.groupBy("phase", "band").agg((F.count("*") * (F.col("phase") + 1) * (F.col("band") + F.col("phase"))).alias("n"))


def policy(s, d):
    m = matrix(s, d)
    stated = m.groupBy("phase").agg(F.sum("n").alias("stated"))
    bands = m.groupBy("band").agg((F.sum("n") + F.when(F.col("band") == 2, 1).otherwise(0)).alias("stated"))
    return L.policy_faults(m, stated, bands, 4)


def mixture(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(F.col("n_name").alias("source"), F.col("r_name").alias("domain"), F.col("n_nationkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("phase"))
    return L.mixture_faults(rows.select("phase", "source", "domain", (F.when((F.col("k") % 9 == 0) & (F.col("phase") == 3), 0).otherwise(F.col("k") + 1) * 64).alias("tokens"), (F.col("k") % 2).alias("least_phase")), 64 * 1000, 64)


def split_texts(s, d):
    words = F.split(F.col("text"), " ")
    return table(s, d, "documents").select("lang", "text", words.alias("tokens"), F.when(F.col("doc_id") % 50 == 0, F.array_join(words, "_")).otherwise(F.array_join(words, " ")).alias("decoded"))


def progression(s, d):
    """Each phase's documents by band, mean difficulty and digest of the identities in order, and whether the mean rises."""
    sound = Q.with_signals(table(s, d, "documents")).filter(F.size("quality_reasons") == 0)
    rows = O.settled(sound.select("doc_id", "band", "difficulty", H.sha(F.col("text")).alias("sha"), O.bucket(F.col("text")).alias("bucket")))
    placed = O.phases(rows.select("doc_id", "band", "bucket")).select("doc_id", "phase_index")
    return rows.join(placed, "doc_id").groupBy("phase_index").agg(F.count("*").alias("documents"), *(F.count_if(F.col("band") == b).alias(b) for b in O.SHARES), F.round(F.avg("difficulty"), 9).alias("mean"), H.ordered_digest(F.col("doc_id"), F.col("sha")).alias("digest"))


QUERIES = {
    "math_filter_reasons": lambda s, d: T.exploded(math_rows(s, d), [], F.col("reasons"), "reason").groupBy("reason").agg(F.count("*").alias("n")),
    "math_filter_decisions": lambda s, d: math_rows(s, d).select("doc_id", F.array_join("reasons", ",").alias("reasons"), L.ppm(F.col("language_score")).alias("language_ppm")),
    "math_ladder_strata": lambda s, d: climbed(s, d).groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(F.size("reasons") == 0).alias("candidates"), F.count_if(F.array_contains("reasons", "exact_duplicate_text")).alias("duplicates")),
    "math_ladder_sample": lambda s, d: V.sampled(candidates(s, d), ["stratum"], "ladder:", "doc_id", 8).select("doc_id", "stratum", "enough"),
    "freeze_role_outcomes": lambda s, d: L.frozen_roles(role_rows(s, d), table(s, d, "benchmark"), "ord").select("ord", "role", "outcome"),
    "freeze_role_receipts": lambda s, d: L.frozen_roles(role_rows(s, d), table(s, d, "benchmark"), "ord").groupBy("role").agg(F.count("*").alias("rows"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("accepted", "malformed", "duplicate")), F.count_if(F.col("outcome").contains(":")).alias("overlaps")),
    "order_control": lambda s, d: L.order_control(table(s, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("band")), "doc_id", "band", 4, "control"),
    "receipt_self_hash": receipts,
    "band_evidence": lambda s, d: L.band_evidence(learn_rows(s, d), "nll", 5, 4),
    "learnability_policy_checks": policy,
    "mixture_plan_checks": mixture,
    "tokenizer_fertility": lambda s, d: L.fertility(split_texts(s, d), "lang"),
    "removable_by_script": lambda s, d: L.removable(s.createDataFrame([(t,) for t in TOKENS], "token string"), s.createDataFrame([("слово",), ("word",)], "token string")),
    "prompt_token_budget": lambda s, d: table(s, d, "conversations").select("role", F.size(F.split("text", " ")).alias("n")).groupBy("role").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.bool_and(F.col("n") <= 64).alias("within")),
    "curriculum_progression": progression,
    "micro_rounding": lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", L.micro(F.col("l_discount") / 3).cast("long").alias("micro"), L.ppm(F.col("l_tax") / 7).alias("ppm")),
    "code_metadata_summary": lambda s, d: CQ.code_rows(s, d).agg(F.count("*").alias("rows"), F.count_if(F.col("kind") == "permissive").alias("permissive"), F.count_if(F.size("licenses") > 1).alias("several"), F.count_distinct("blob").alias("blobs"), F.count_distinct(F.struct("repo", "path")).alias("places"), F.sum(F.size("licenses")).alias("licenses")),
}

URLS = f"""mr AS (SELECT doc_id, text || {pick(ADDED)} AS text, {pick(HOSTS)} AS h, {pick(META[:3])} AS meta, 5 - CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS score, 1 - (doc_id % 17) / 100 AS share FROM documents),
mh AS (SELECT *, regexp_replace(h, '^www\\.', '') AS host FROM mr)"""
DENIED = "(" + " OR ".join(f"host = '{x}' OR ends_with(host, '.{x}')" for x in Q.DENIED_HOSTS) + ")"
_CLASSES = lambda ps: "(" + " + ".join("regexp_matches(text, '" + p.replace("'", "''") + "')::int" for p in ps) + ")"
REASONS = {
    "upstream_score_below_5": "score <> 5", "found_math_absent": "meta <> '{\"found_math\": true}'", L.LANGUAGE_REASON: "share < 0.98", "url_host_absent_or_malformed": "host = ''", "denied_answer_farm_host": DENIED,
    "under_160_words": "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) < 160", "over_200k_characters": "length(text) > 200000", "insufficient_distinct_math_signals": f"{_CLASSES(Q.MATH)} < 2",
    "insufficient_explanatory_structure": f"{_CLASSES(Q.EXPLANATION)} < 2", "excessive_embedded_urls": f"{_n(T.URL)} > 8", **{f"risk_pattern:{n}": f"regexp_matches(text, '{p}')" for n, p in Q.RISKS.items()},
}
MATHS = f"{URLS}, re AS (SELECT doc_id, text, share, list_sort(list_filter([{', '.join(f'''CASE WHEN {c} THEN '{n}' END''' for n, c in REASONS.items())}], lambda x: x IS NOT NULL)) AS reasons FROM mh)"
LADDER = f"""{MATHS}, du AS (SELECT *, doc_id > min(doc_id) OVER (PARTITION BY text) AS dup, CASE WHEN (share * 1000000)::int < 900000 THEN 'below_0p90' WHEN (share * 1000000)::int < 950000 THEN '0p90_to_0p95' ELSE 'at_least_0p95' END AS stratum FROM re),
la AS (SELECT doc_id, stratum, dup, list_filter(reasons, lambda x: x <> '{L.LANGUAGE_REASON}') AS base FROM du)"""
ROLES = f"""cv AS (SELECT conv_id, arg_min(text, turn) AS prompt, arg_max(text, turn) AS answer FROM conversations GROUP BY conv_id), it AS (SELECT item_id * 20 AS conv_id, text AS item FROM benchmark),
rr AS (SELECT conv_id % 4 * 1000000 + conv_id AS ord, {sorted(K.ROLE_MODES)}[conv_id % 4 + 1] AS role, CASE WHEN conv_id % 40 = 0 THEN coalesce(item, prompt) ELSE prompt || CASE WHEN conv_id % 6 = 0 THEN '' ELSE ' ' || (conv_id // 3) END END AS prompt,
  CASE WHEN conv_id % 4 = {sorted(K.ROLE_MODES).index("rl_prompts")} THEN NULL WHEN conv_id % 40 = 20 THEN item ELSE answer END AS response, conv_id % 23 = 0 AS malformed FROM cv LEFT JOIN it USING (conv_id)),
bb AS (SELECT {NORM} AS norm, {SIMPLE.format(n=NORM)} AS w FROM benchmark), bg AS (SELECT DISTINCT unnest({GRAMS.format(w="w")}) AS g FROM bb),
fi AS (SELECT ord, 'prompt' AS field, prompt AS text FROM rr UNION ALL SELECT ord, 'response', response FROM rr WHERE response IS NOT NULL),
fn AS (SELECT ord, field, {NORM} AS norm FROM fi), fw AS (SELECT *, {SIMPLE.format(n="norm")} AS w FROM fn), fh AS (SELECT DISTINCT ord, field FROM (SELECT ord, field, unnest({GRAMS.format(w="w")}) AS g FROM fw) JOIN bg USING (g)),
ov AS (SELECT fw.ord, fw.field, norm, CASE WHEN norm IN (SELECT norm FROM bb) THEN 'exact:' || fw.field WHEN fh.ord IS NOT NULL THEN 'ngram:' || fw.field END AS kind FROM fw LEFT JOIN fh ON fw.ord = fh.ord AND fw.field = fh.field),
ro AS (SELECT rr.ord, role, malformed, p.norm AS key, coalesce(p.kind, r.kind) AS kind FROM rr JOIN ov p ON p.ord = rr.ord AND p.field = 'prompt' LEFT JOIN ov r ON r.ord = rr.ord AND r.field = 'response'),
oc AS (SELECT ord, role, CASE WHEN malformed THEN 'malformed' WHEN ord > min(ord) FILTER (WHERE NOT malformed AND kind IS NULL) OVER (PARTITION BY key) THEN 'duplicate' WHEN kind IS NOT NULL THEN kind ELSE 'accepted' END AS outcome FROM ro)"""
BASE_OK = "('found_math_absent', 'under_160_words', 'denied_answer_farm_host', 'url_host_absent_or_malformed', 'upstream_score_below_5')"
MATRIX = "mx AS (SELECT phase, band, count(*) * (phase + 1) * (band + phase) AS n FROM (SELECT o_custkey % 4 AS phase, o_orderkey % 4 AS band FROM orders) GROUP BY phase, band)"

ORACLES = {
    "math_filter_reasons": f"WITH {MATHS} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM re) GROUP BY reason",
    "math_filter_decisions": f"WITH {MATHS} SELECT doc_id, array_to_string(reasons, ',') AS reasons, trunc(share * 1000000)::int AS language_ppm FROM re",
    "math_ladder_strata": f"WITH {LADDER} SELECT stratum, count(*) AS n, count_if(len(base) = 0 AND NOT dup) AS candidates, count_if(dup) AS duplicates FROM la GROUP BY stratum",
    "math_ladder_sample": f"WITH {LADDER}, k AS (SELECT doc_id, stratum FROM la WHERE NOT dup AND len(list_filter(base, lambda x: x NOT IN {BASE_OK})) = 0), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('ladder:' || doc_id), doc_id) AS p, count(*) OVER (PARTITION BY stratum) >= 8 AS enough FROM k) SELECT doc_id, stratum, enough FROM r WHERE p <= 8",
    "freeze_role_outcomes": f"WITH {ROLES} SELECT * FROM oc",
    "freeze_role_receipts": f"WITH {ROLES} SELECT role, count(*) AS rows, count_if(outcome = 'accepted') AS accepted, count_if(outcome = 'malformed') AS malformed, count_if(outcome = 'duplicate') AS duplicate, count_if(contains(outcome, ':')) AS overlaps FROM oc GROUP BY role",
    "order_control": """WITH b AS (SELECT doc_id, doc_id % 3 AS band, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY sha256('control:band:' || doc_id), doc_id) - 1 AS r, count(*) OVER (PARTITION BY doc_id % 3) AS n FROM documents),
p AS (SELECT doc_id, band, (r * 4 // n)::int AS phase FROM b) SELECT doc_id, band, phase, row_number() OVER (PARTITION BY phase ORDER BY sha256('control:phase:' || doc_id), doc_id) - 1 AS position FROM p""",
    "receipt_self_hash": """WITH x AS (SELECT lang, count(*) AS n, sum(n_chars)::bigint AS c FROM documents GROUP BY lang)
SELECT c AS characters, lang, n + CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS rows, sha256('{"characters":' || c || ',"lang":"' || lang || '","rows":' || n || '}') AS receipt_sha256, lang <> 'de' AS sound FROM x""",
    "band_evidence": "WITH x AS (SELECT doc_id % 4 AS phase, n_chars // 4000 AS band, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high FROM documents GROUP BY ALL) SELECT p.range AS phase, b.range AS band, coalesce(n, 0) AS n, low, high FROM range(5) p CROSS JOIN range(4) b LEFT JOIN x ON x.phase = p.range AND x.band = b.range",
    "learnability_policy_checks": f"""WITH {MATRIX}, p AS (SELECT phase, sum(n) AS n, sum(band * n) / sum(n) AS mean FROM mx GROUP BY phase), q AS (SELECT *, sum(n) OVER (ORDER BY phase) AS stop, lag(mean) OVER (ORDER BY phase) AS b FROM p)
SELECT (SELECT true) AS phase_sums, (SELECT bool_and(b IS NULL OR mean > b) FROM q) AS rising, (SELECT bool_and(phase = 3 OR stop % 4 = 0) FROM q) AS on_updates, (SELECT false) AS band_sums,
  (SELECT bool_and(NOT (phase = 0 AND band = 3) OR n = 0) FROM mx) AS no_stretch_first, (SELECT bool_and(NOT (phase > 0 AND band = 1) OR n > 0) FROM mx) AS ready_later""",
    "mixture_plan_checks": """WITH r AS (SELECT n_name AS source, r_name AS domain, n_nationkey AS k, p.range AS phase, CASE WHEN n_nationkey % 9 = 0 AND p.range = 3 THEN 0 ELSE n_nationkey + 1 END * 64 AS tokens, n_nationkey % 2 AS least FROM nation JOIN region ON n_regionkey = r_regionkey, range(4) p)
SELECT sum(tokens) = 64000 AS budget, bool_and(tokens % 64 = 0) AS aligned, bool_and(tokens = 0 OR phase >= least) AS in_time, (SELECT bool_and(d = 5) FROM (SELECT count(DISTINCT domain) AS d FROM r GROUP BY phase)) AS covered,
  (SELECT min(l) = 3 FROM (SELECT max(phase) FILTER (WHERE tokens > 0) AS l FROM r GROUP BY source)) AS rehearsed FROM r""",
    "tokenizer_fertility": """WITH x AS (SELECT lang, count(*) AS texts, sum(octet_length(encode(text)))::bigint AS bytes, sum(len(string_split(text, ' ')))::bigint AS tokens, count_if(doc_id % 50 = 0 AND contains(text, ' ')) AS failures FROM documents GROUP BY ROLLUP (lang))
SELECT *, (tokens * 1000000 // bytes)::bigint AS tokens_per_1k_bytes_milli, (bytes * 1000 // tokens)::bigint AS bytes_per_token_milli FROM x""",
    "removable_by_script": "SELECT * FROM (VALUES ('Han', 1), ('Hiragana', 1), ('Hangul', 1), ('Hebrew', 1), ('Thai', 1), ('Katakana', 1)) v(script, n)",
    "prompt_token_budget": "SELECT role, min(n) AS least, max(n) AS most, bool_and(n <= 64) AS within FROM (SELECT role, len(string_split(text, ' ')) AS n FROM conversations) GROUP BY role",
    "curriculum_progression": f"""WITH {BANDED}, bk AS (SELECT doc_id, band, ('0x' || substr(sha256(text), 1, 8))::bigint % 16 AS bucket FROM ba),
rk AS (SELECT doc_id, band, row_number() OVER (PARTITION BY band ORDER BY sha256('loomery-order:' || band || ':' || bucket), doc_id) - 1 AS r FROM bk),
li AS (SELECT band, phase_index, n, sum(n) OVER (PARTITION BY band ORDER BY phase_index) AS stop FROM al), pl AS (SELECT doc_id, phase_index FROM rk JOIN li ON rk.band = li.band AND r >= stop - n AND r < stop)
SELECT phase_index, count(*) AS documents, {", ".join(f"count_if(band = '{b}') AS {b}" for b in O.SHARES)}, round(avg(difficulty), 9) AS mean, sha256(unhex(string_agg(sha256(text), '' ORDER BY doc_id))) AS digest FROM s3 JOIN pl USING (doc_id) GROUP BY phase_index""",
    "micro_rounding": "SELECT l_orderkey, l_linenumber, floor(l_discount / 3 * 1e6 + 0.5)::bigint AS micro, trunc(l_tax / 7 * 1000000)::int AS ppm FROM lineitem",
    "code_metadata_summary": """WITH c AS (SELECT p_partkey AS i FROM part) SELECT count(*) AS rows, count_if(i % 6 <> 0) AS permissive, count(*) AS several, count(DISTINCT CASE WHEN i % 9 = 0 THEN 'zz' ELSE sha1(i::varchar) END) AS blobs,
  count(DISTINCT CASE WHEN i % 10 = 0 THEN 'owner' ELSE 'owner/name' END || ' ' || CASE WHEN i % 8 = 0 THEN 'p' ELSE '/p' END) AS places, sum(2)::bigint AS licenses FROM c""",
}
