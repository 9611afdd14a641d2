"""Queries on metadata, graphs, reviews, evaluation results, event streams and the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomery.operators import evaluation as E
from loomery.operators import metadata as M
from loomery.operators import ordering as O
from loomery.operators import quality as Q
from loomery.sources.tables import table
from loomery.streaming import events as S


#: Every licence of the policy, alone or with another, others, and none.
LICENSES_SEEN = [*([x] for x in M.LICENSES), ["MIT", "0BSD"], ["MIT", "GPL-3.0"], ["PSF-2.0"], ["GPL-3.0"], []]


def code_rows(s, d):
    """Code metadata derived from the part table."""
    p, key = table(s, d, "part"), F.col("p_partkey")
    licenses = F.element_at(F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in LICENSES_SEEN)), (key % len(LICENSES_SEEN) + 1).cast("int"))
    return p.select(
        F.sha1((key % 1500).cast("string").cast("binary")).alias("blob"), F.concat(F.lit("owner/r"), (key % 97).cast("string")).alias("repo"), F.concat(F.lit("/p"), key.cast("string")).alias("path"), licenses.alias("licenses"),
        F.when(key % 3 == 0, "no_license").otherwise("permissive").alias("kind"), (F.col("p_size") % 6).alias("score"), F.when(key % 11 == 0, "latin-1").otherwise("UTF-8").alias("encoding"), (F.col("p_size") * 40).alias("size"), key.alias("row"),
    )


def with_policy(s, d):
    return code_rows(s, d).withColumn("accepted", M.accepted(*(F.col(c) for c in ("licenses", "kind", "score", "encoding", "size"))))


def aligned(s, d):
    current = code_rows(s, d).filter(F.col("row") % 7 != 0).select("blob", "repo", "path", F.col("row").alias("place"), (F.col("row") % 11 == 0).alias("generated"), (F.col("row") % 13 == 0).alias("vendor"))
    return M.align(with_policy(s, d).filter("size >= 128"), current, ["repo", "path", "blob"], "place")


def arms(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.select("doc_id", "lang", F.col("quality").alias("correct")), rows.select("doc_id", "lang", (1 - F.col("toxic")).alias("correct"))


def pairs(s, d):
    return E.paired(*arms(s, d), ["doc_id", "lang"])


def edges(s):
    return s.createDataFrame([("view", "click"), ("click", "cart"), ("cart", "purchase"), ("view", "search")], "a string, b string")


def stream(s, d):
    return S.stream(s, f"{d}/events.parquet")


def revenue():
    return F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4)


def running(s, d):
    e = table(s, d, "events")
    return M.prior_counts(e.select("event_id", "event_type", "user_id"), "user_id", "event_id")


def nation_edges(s, d):
    k = F.col("n_nationkey")
    return table(s, d, "nation").select(k.cast("long").alias("a"), ((k * 2 + 1) % 25).cast("long").alias("b"))


def losses(s, d):
    """Losses a target and a byte, and perplexity, by stratum and, with a null stratum, over all."""
    rows = table(s, d, "lineitem").select(F.col("l_returnflag").alias("stratum"), (F.col("l_extendedprice") / 20000).alias("nll"), "l_quantity", (F.col("l_quantity") * (2 + F.col("l_linenumber") % 3)).alias("size"))
    sums = rows.rollup("stratum").agg(F.sum("nll").alias("nll"), F.sum("l_quantity").alias("targets"), F.sum("size").alias("bytes"))
    each = F.col("nll") / F.col("targets")
    return sums.select("stratum", F.round(each, 9).alias("nll_per_target"), F.round(F.exp(each), 9).alias("perplexity"), F.round(F.col("nll") / F.col("bytes"), 9).alias("nll_per_byte"))


def family_pairs(s, d):
    """All pairs, left before right, of three arms, matched by document: an equi-join with an order on the arm."""
    arms = F.array(F.col("quality").cast("int"), (1 - F.col("toxic")).cast("int"), (F.col("doc_id") % 3 == 0).cast("int"))
    rows = table(s, d, "labels").select("doc_id", F.posexplode(arms).alias("arm", "c"))
    x, y = (rows.select("doc_id", F.col("arm").alias(f"{n}_arm"), F.col("c").alias(n)) for n in ("left", "right"))
    pairs = x.join(y, "doc_id").filter("left_arm < right_arm")
    return pairs.groupBy("left_arm", "right_arm").agg(F.sum(F.col("left") - F.col("right")).alias("delta"), F.count_if(F.col("left") > F.col("right")).alias("wins"))


def zipped(s, d):
    """Two ordered tables side by side by their rows' ordinals; the longer one's rest meets nothing."""
    a = O.ranked(table(s, d, "labels").select(F.col("doc_id").alias("question")), ["question"], "i")
    b = O.ranked(table(s, d, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("assessor"), "lang"), ["assessor"], "i")
    return a.join(b, "i", "full_outer").select("i", "question", "assessor", "lang")


def running_stream(s, d):
    counts = S.running_counts(S.stream(s, f"{d}/events.parquet"))
    return counts.groupBy("event_type").agg(F.sum("prior").alias("prior"), F.max("prior").alias("most"))


def resumed_batches(s, d):
    """Records taken by a cursor in batches, each once."""
    records, cursor, out = table(s, d, "documents").select(F.col("doc_id").alias("sequence"), "n_chars"), 0, None
    for turn in range(3):
        batch, cursor = S.resumed(records, cursor, 70)
        part = batch.groupBy().agg(F.lit(turn).alias("turn"), F.count("*").alias("n"), F.sum("n_chars").alias("characters"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    "running_progression_stream": running_stream,
    "resumable_cursor": resumed_batches,
    "shannon_entropy_tokens": lambda s, d: table(s, d, "documents").select("doc_id", F.substring(F.md5("text"), 1, 32).alias("token")).select("doc_id", Q.entropy_milli(F.col("token")).alias("milli")),
    "metadata_policy_counts": lambda s, d: with_policy(s, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"), F.sum("size").alias("bytes")),
    "license_explode_counts": lambda s, d: code_rows(s, d).select(F.explode("licenses").alias("license")).groupBy("license").agg(F.count("*").alias("n")),
    "duplicate_group_stats": lambda s, d: M.duplicate_stats(code_rows(s, d), "blob"),
    "two_level_aggregate": lambda s, d: with_policy(s, d).groupBy("repo").agg(F.count("*").alias("n"), F.count_if("accepted").alias("k")).agg(F.count("*").alias("shards"), F.sum("n").alias("rows"), F.sum("k").alias("accepted"), F.expr("sum(k) * 1000000 div sum(n)").alias("ppm")),
    "first_blob_occurrence": lambda s, d: code_rows(s, d).groupBy("blob").agg(F.min("row").alias("row")),
    "candidate_alignment": lambda s, d: aligned(s, d).select("row", "occurrences", "chosen", "reason"),
    "alignment_removed_reasons": lambda s, d: aligned(s, d).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n")),
    "geometry_consistency": lambda s, d: code_rows(s, d).groupBy("blob").agg(F.count_distinct("size").alias("sizes")).filter("sizes > 1"),
    "quantiles_lower": lambda s, d: O.ranked(table(s, d, "documents").select("n_chars"), ["n_chars"], "i").crossJoin(F.broadcast(table(s, d, "documents").agg(F.count("*").alias("n")))).filter("i in (floor((n - 1) * 0.1), floor((n - 1) * 0.5), floor((n - 1) * 0.9), floor((n - 1) * 0.99))").select("i", "n_chars"),
    "audit_summary": lambda s, d: table(s, d, "documents").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"), F.sum("n_chars").alias("chars"), F.count_if(F.length("text") == F.col("n_chars")).alias("sized")),
    "zip_ordinal_join": zipped,
    "prompt_response_pairs": lambda s, d: table(s, d, "conversations").withColumn("next", F.lead(F.struct("role", "text")).over(Window.partitionBy("conv_id").orderBy("turn", "text"))).filter((F.col("role") == "user") & (F.col("next.role") == "assistant")).groupBy("conv_id").agg(F.count("*").alias("pairs"), F.sum(F.length("next.text")).alias("chars")),
    "record_intersect": lambda s, d: table(s, d, "documents").filter("doc_id % 2 = 0").select("text").intersect(table(s, d, "documents").filter("doc_id % 2 = 1").select("text")).agg(F.count("*").alias("n")),
    "semi_anti_boundary": lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n")),
    "prerequisite_closure": lambda s, d: M.closure(nation_edges(s, d)),
    "prerequisite_violations": lambda s, d: (lambda e: e.join(F.broadcast(edges(s)), e["event_type"] == F.col("b")).join(e.groupBy(F.col("user_id").alias("u"), F.col("event_type").alias("t")).agg(F.min("event_id").alias("first")), (F.col("u") == F.col("user_id")) & (F.col("t") == F.col("a")), "left").filter("first is null or first >= event_id").groupBy("event_type").agg(F.count("*").alias("n")))(table(s, d, "events").select("event_id", "user_id", "event_type")),
    "first_exposure_density": lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first")).groupBy(F.floor(F.col("first") / 500).alias("slice")).agg(F.count("*").alias("n")),
    "phase_range_join": lambda s, d: table(s, d, "documents").join(F.broadcast(s.createDataFrame([("short", 0, 500), ("middle", 500, 3000), ("long", 3000, 1 << 40)], "phase string, low long, high long")), F.col("n_chars").between(F.col("low"), F.col("high") - 1)).groupBy("phase").agg(F.count("*").alias("n")),
    "agreement_ppm_floor_ceil": lambda s, d: M.disagreement(table(s, d, "labels"), "quality", "toxic"),
    "accuracy_rollup_domain": lambda s, d: E.accuracy(arms(s, d)[0], "lang").withColumn("accuracy", F.round("accuracy", 9)),
    "paired_win_loss_tie": lambda s, d: pairs(s, d).agg(F.count_if(F.col("delta") > 0).alias("win"), F.count_if(F.col("delta") < 0).alias("loss"), F.count_if(F.col("delta") == 0).alias("tie")),
    "paired_normal_ci": lambda s, d: E.interval(pairs(s, d)).select("n", *(F.round(c, 9).alias(c) for c in ("mean", "low", "high"))),
    "macro_gate_checks": lambda s, d: pairs(s, d).groupBy("lang").agg(F.avg("delta").alias("m")).agg(F.round(F.avg("m"), 9).alias("macro"), F.round(F.min("m"), 9).alias("worst"), F.bool_and(F.col("m") >= -0.01).alias("passed")),
    "family_pairs_theta": family_pairs,
    "bootstrap_hash_rng": lambda s, d: E.bootstrap(pairs(s, d), "doc_id", "lang", 50).select("replicate", F.round("mean", 9).alias("mean")),
    "nll_by_stratum": lambda s, d: losses(s, d),
    "argmax_first_tie": lambda s, d: table(s, d, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("best")),
    "tumbling_window_counts": lambda s, d: S.finished(S.tumbling(stream(s, d))),
    "dedup_stream": lambda s, d: S.finished(S.deduplicated(stream(s, d))),
    "session_windows": lambda s, d: S.finished(S.sessions(stream(s, d))).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events")),
    "running_progression": lambda s, d: running(s, d).groupBy("event_type").agg(F.sum("prior").alias("prior"), F.max("prior").alias("most")),
    "pricing_summary": lambda s, d: table(s, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), revenue().alias("revenue"), F.count("*").alias("n")),
    "revenue_by_nation": lambda s, d: table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(revenue().alias("revenue")),
    "top_orders": lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderkey", "c_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("total"), "o_orderkey").limit(20),
}

CODE = """c AS (SELECT sha1((p_partkey % 1500)::varchar) AS blob, 'owner/r' || (p_partkey % 97) AS repo, '/p' || p_partkey AS path,
  CASE p_partkey % 14 """ + " ".join(f"WHEN {i} THEN {x}::varchar[]" for i, x in enumerate(LICENSES_SEEN)) + """ END AS licenses,
  CASE WHEN p_partkey % 3 = 0 THEN 'no_license' ELSE 'permissive' END AS kind, p_size % 6 AS score, CASE WHEN p_partkey % 11 = 0 THEN 'latin-1' ELSE 'UTF-8' END AS encoding, p_size * 40 AS size, p_partkey AS row FROM part),
a AS (SELECT *, kind = 'permissive' AND len(licenses) > 0 AND list_has_all(['0BSD', 'Apache-2.0', 'BSD-2-Clause', 'BSD-3-Clause', 'CC0-1.0', 'ISC', 'MIT', 'Unlicense', 'Zlib'], licenses) AND score IN (4, 5) AND encoding = 'UTF-8' AND size BETWEEN 128 AND 1000000 AS accepted FROM c)"""
ALIGN = CODE + """, u AS (SELECT blob, repo, path, row AS place, row % 11 = 0 AS generated, row % 13 = 0 AS vendor FROM c WHERE row % 7 <> 0),
h AS (SELECT repo, path, blob, count(*) AS occurrences, min(place) FILTER (WHERE NOT vendor AND NOT generated) AS chosen, bool_and(vendor) AS av FROM u GROUP BY ALL),
j AS (SELECT a.row, occurrences, chosen, CASE WHEN occurrences IS NULL THEN 'absent' WHEN chosen IS NOT NULL THEN NULL WHEN av THEN 'vendor' ELSE 'generated' END AS reason FROM a LEFT JOIN h USING (repo, path, blob) WHERE size >= 128)"""
ARMS = "p AS (SELECT doc_id, lang, quality AS a, 1 - toxic AS b, quality - (1 - toxic) AS delta FROM labels JOIN documents USING (doc_id))"
EDGES = "e(a, b) AS (VALUES ('view', 'click'), ('click', 'cart'), ('cart', 'purchase'), ('view', 'search'))"
REV = "round(sum(l_extendedprice * (1 - l_discount)), 4)"

ORACLES = {
    "running_progression_stream": "WITH r AS (SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS prior FROM events) SELECT event_type, sum(prior)::bigint AS prior, max(prior) AS most FROM r GROUP BY event_type",
    "resumable_cursor": "SELECT (doc_id // 70)::int AS turn, count(*) AS n, sum(n_chars)::bigint AS characters FROM documents WHERE doc_id < 210 GROUP BY 1",
    "shannon_entropy_tokens": "WITH c AS (SELECT doc_id, unnest(string_split(md5(text), '')) AS c FROM documents), p AS (SELECT doc_id, count(*)::double / 32 AS p FROM c GROUP BY doc_id, c) SELECT doc_id, round_even(-sum(p * log2(p)) * 1000, 0)::int AS milli FROM p GROUP BY doc_id",
    "metadata_policy_counts": f"WITH {CODE} SELECT kind, count(*) AS n, count_if(accepted) AS accepted, sum(size)::bigint AS bytes FROM a GROUP BY kind",
    "license_explode_counts": f"WITH {CODE} SELECT license, count(*) AS n FROM (SELECT unnest(licenses) AS license FROM c) GROUP BY 1",
    "duplicate_group_stats": f"WITH {CODE}, g AS (SELECT count(*) AS n FROM c GROUP BY blob) SELECT sum(n)::bigint AS rows, count(*) AS keys, sum(n - 1)::bigint AS repeats, count_if(n > 1) AS groups FROM g",
    "two_level_aggregate": f"WITH {CODE}, g AS (SELECT repo, count(*) AS n, count_if(accepted) AS k FROM a GROUP BY repo) SELECT count(*) AS shards, sum(n)::bigint AS rows, sum(k)::bigint AS accepted, (sum(k) * 1000000 // sum(n))::bigint AS ppm FROM g",
    "first_blob_occurrence": f"WITH {CODE} SELECT blob, min(row) AS row FROM c GROUP BY blob",
    "candidate_alignment": f"WITH {ALIGN} SELECT * FROM j",
    "alignment_removed_reasons": f"WITH {ALIGN} SELECT reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY reason",
    "geometry_consistency": f"WITH {CODE} SELECT blob, count(DISTINCT size) AS sizes FROM c GROUP BY blob HAVING count(DISTINCT size) > 1",
    "quantiles_lower": "WITH r AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT i, n_chars FROM r WHERE i IN (floor((n - 1) * 0.1), floor((n - 1) * 0.5), floor((n - 1) * 0.9), floor((n - 1) * 0.99))",
    "audit_summary": "SELECT count(*) AS n, count(DISTINCT text) AS texts, sum(n_chars)::bigint AS chars, count_if(length(text) = n_chars) AS sized FROM documents",
    "zip_ordinal_join": "WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM labels), b AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE doc_id % 2 = 0) SELECT i, a.doc_id AS question, b.doc_id AS assessor, lang FROM a FULL JOIN b USING (i)",
    "prompt_response_pairs": "WITH n AS (SELECT conv_id, role, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)) SELECT conv_id, count(*) AS pairs, sum(length(nt))::bigint AS chars FROM n WHERE role = 'user' AND nr = 'assistant' GROUP BY conv_id",
    "record_intersect": "SELECT count(*) AS n FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1)",
    "semi_anti_boundary": "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang",
    "prerequisite_closure": "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 2 + 1) % 25 AS b FROM nation), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT * FROM r",
    "prerequisite_violations": f"WITH {EDGES}, f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) SELECT ev.event_type, count(*) AS n FROM events ev JOIN e ON ev.event_type = e.b LEFT JOIN f ON f.user_id = ev.user_id AND f.event_type = e.a WHERE first IS NULL OR first >= ev.event_id GROUP BY 1",
    "first_exposure_density": "SELECT first // 500 AS slice, count(*) AS n FROM (SELECT min(event_id) AS first FROM events GROUP BY user_id) GROUP BY 1",
    "phase_range_join": "SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'middle' ELSE 'long' END AS phase, count(*) AS n FROM documents GROUP BY 1",
    "agreement_ppm_floor_ceil": "WITH x AS (SELECT count(*) AS n, count_if(quality IS DISTINCT FROM toxic) AS k FROM labels) SELECT n, k, k * 1000000 // n AS ppm_floor, (k * 1000000 + n - 1) // n AS ppm_ceil FROM x",
    "accuracy_rollup_domain": f"WITH {ARMS} SELECT lang, sum(a)::bigint AS correct, count(*) AS rows, round(sum(a) / count(*), 9) AS accuracy FROM p GROUP BY ROLLUP (lang)",
    "paired_win_loss_tie": f"WITH {ARMS} SELECT count_if(delta > 0) AS win, count_if(delta < 0) AS loss, count_if(delta = 0) AS tie FROM p",
    "paired_normal_ci": f"WITH {ARMS}, x AS (SELECT count(*) AS n, avg(delta) AS mean, {E.NORMAL} * sqrt(var_samp(delta) / count(*)) AS half FROM p) SELECT n, round(mean, 9) AS mean, round(mean - half, 9) AS low, round(mean + half, 9) AS high FROM x",
    "macro_gate_checks": f"WITH {ARMS}, m AS (SELECT lang, avg(delta) AS m FROM p GROUP BY lang) SELECT round(avg(m), 9) AS macro, round(min(m), 9) AS worst, bool_and(m >= -0.01) AS passed FROM m",
    "family_pairs_theta": "WITH f AS (SELECT doc_id, 0 AS arm, quality AS c FROM labels UNION ALL SELECT doc_id, 1, 1 - toxic FROM labels UNION ALL SELECT doc_id, 2, (doc_id % 3 = 0)::int FROM labels) SELECT x.arm AS left_arm, y.arm AS right_arm, sum(x.c - y.c)::bigint AS delta, count_if(x.c > y.c) AS wins FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.arm < y.arm GROUP BY ALL",
    "bootstrap_hash_rng": f"""WITH {ARMS}, s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS slot, count(*) OVER (PARTITION BY lang) AS size FROM p),
d AS (SELECT r.range AS replicate, lang, ('0x' || substr(sha256(r.range || ':' || lang || ':' || slot), 1, 12))::bigint % size AS slot FROM s, range(50) r)
SELECT d.replicate, round(avg(s.delta), 9) AS mean FROM d JOIN s USING (lang, slot) GROUP BY 1""",
    "nll_by_stratum": "WITH x AS (SELECT l_returnflag AS stratum, sum(l_extendedprice / 20000) AS nll, sum(l_quantity) AS targets, sum(l_quantity * (2 + l_linenumber % 3)) AS bytes FROM lineitem GROUP BY ROLLUP (l_returnflag)) SELECT stratum, round(nll / targets, 9) AS nll_per_target, round(exp(nll / targets), 9) AS perplexity, round(nll / bytes, 9) AS nll_per_byte FROM x",
    "argmax_first_tie": "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings",
    "tumbling_window_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "dedup_stream": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "session_windows": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events) SELECT user_id, sum(new)::bigint AS sessions, count(*) AS events FROM g GROUP BY user_id",
    "running_progression": "WITH r AS (SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS prior FROM events) SELECT event_type, sum(prior)::bigint AS prior, max(prior) AS most FROM r GROUP BY event_type",
    "pricing_summary": f"SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, {REV} AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "revenue_by_nation": f"SELECT n_name, {REV} AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    "top_orders": "SELECT o_orderkey, c_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY total DESC, o_orderkey LIMIT 20",
}
