"""Queries on row contracts, with their DuckDB twins. Inputs are derived from the tables, some rows of them broken."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomery.functions import hashing as H
from loomery.operators import contracts as K
from loomery.sources.tables import table

DOMAIN_OF = ["english", "code", "math", "science", "technical", "poetry"]


def texts(s, d):
    return table(s, d, "documents")


def raw_rows(s, d):
    """Raw documents: every 11th without text, every 13th without a revision, every 17th with a negative row index."""
    i = F.col("doc_id")
    domain = F.element_at(F.array(*map(F.lit, DOMAIN_OF)), (i % 6 + 1).cast("int"))
    source = F.struct(
        F.col("source").alias("dataset"), F.when(i % 13 == 0, "").otherwise(F.concat(F.lit("r"), (i % 5).cast("string"))).alias("revision"), F.lit("part-0").alias("source_file"),
        (i % 17 - 1).alias("row_index"), F.when(i % 19 != 0, "MIT").alias("license"), domain.alias("domain"),
    )
    return texts(s, d).select("doc_id", F.when(i % 11 != 0, F.col("text")).alias("text"), source.alias("source"))


def identified(s, d):
    """Raw documents with the canonical digest of what names them."""
    named = F.to_json(F.struct(F.col("doc_id").alias("line_number"), F.lit(0).alias("shard"), H.sha(F.col("text")).alias("text_sha256")), {"ignoreNullFields": "false"})
    return raw_rows(s, d).withColumn("identity", H.sha(named))


def documents(s, d):
    i = F.col("doc_id")
    proof = F.struct((i % 7 != 0).alias("benchmark_disjoint"), F.when(i % 23 == 0, "short").otherwise(F.col("identity")).alias("evidence_sha256"))
    return identified(s, d).withColumns({"verification": proof, "declared": F.when(i % 3 == 0, F.col("identity")).when(i % 29 == 0, "other")})


def training_rows(s, d):
    c = table(s, d, "conversations")
    key = F.col("conv_id") * 10 + F.col("turn")
    role = F.element_at(F.array(*map(F.lit, [*K.ROLE_MODES, "other"])), (key % 5 + 1).cast("int"))
    mode = F.element_at(F.array(*map(F.lit, [*K.ROLE_MODES.values(), "other"])), ((key + F.when(key % 31 == 0, 1).otherwise(0)) % 5 + 1).cast("int"))
    response = F.when(key % 4 == 0, "").when(key % 9 == 0, None).otherwise(F.col("role"))
    kind = F.element_at(F.array(*map(F.lit, [*K.VERIFIERS, "guess"])), (key % 8 + 1).cast("int"))
    return c.select(key.alias("key"), role.alias("role"), mode.alias("mode"), F.col("text").alias("prompt"), response.alias("response"), kind.alias("kind"), (key % 12 != 0).alias("passed"))


def code_rows(s, d):
    i = F.col("p_partkey")
    return table(s, d, "part").select(
        i.alias("row"), F.when(i % 9 == 0, "zz").otherwise(F.sha1(i.cast("string").cast("binary"))).alias("blob"), F.when(i % 10 == 0, "owner").otherwise("owner/name").alias("repo"),
        F.when(i % 8 == 0, "p").otherwise("/p").alias("path"), F.when(i % 7 == 0, F.array(F.lit("MIT"), F.lit("MIT"))).otherwise(F.array(F.lit("MIT"), F.lit("ISC"))).alias("licenses"),
        F.when(i % 6 == 0, "unknown").otherwise("permissive").alias("kind"),
    )


def audit_rows(s, d):
    i = F.col("doc_id")
    share = F.when(i % 15 == 0, F.lit(float("nan"))).when(i % 16 == 0, 1.5).otherwise((i % 100) / 100)
    return texts(s, d).select("doc_id", "text", (i % 4 + 2).alias("score"), (i % 21).alias("token_count"), F.when(i % 14 == 0, 1).otherwise(F.length("text")).alias("char_count"), F.col("lang").alias("language"), share.alias("language_score"))


def choice_rows(s, d):
    i, words = F.col("doc_id"), F.split(F.col("text"), " ")
    return texts(s, d).select("doc_id", F.element_at(words, 1).alias("question"), F.slice(words, 2, (i % 18 + 1).cast("int")).alias("choices"), (i % 7 - 1).alias("answer"))


CONCEPTS = [f"c{i}" for i in range(8)]


def review_rows(s, d):
    i = F.col("doc_id")
    listed = F.array(*map(F.lit, CONCEPTS))
    assumed = F.slice(listed, (i % 5 + 1).cast("int"), (i % 3).cast("int"))
    taught = F.when(i % 13 == 0, F.array(F.lit("c9"))).when(i % 11 == 0, F.array(F.lit("c7"), F.lit("c1"))).otherwise(F.slice(listed, (i % 7 + 1).cast("int"), (i % 2).cast("int")))
    return texts(s, d).select("doc_id", ((i % 30) * 40000 - 1000).alias("quality"), (700000 + (i % 40) * 10000).alias("confidence"), assumed.alias("assumed"), taught.alias("taught"), (i % 3 == 0).alias("admit"))


def span_rows(s, d):
    """Two spans a text: some overlap, some are short, some carry another digest, some end beyond the text."""
    i, text = F.col("doc_id"), F.col("text")
    cut = lambda start, end: F.struct(start.alias("start"), end.alias("end"), F.when(i % 9 == 0, "x").otherwise(H.sha(F.substring(text, start + 1, end - start))).alias("sha"))
    first, second = cut(F.lit(0), (10 + i % 20).cast("int")), cut((20 + i % 11).cast("int"), (60 + i % 13).cast("int"))
    return texts(s, d).select("doc_id", "text", F.array(first, second).alias("found"))


def oracle_rows(s, d):
    i = F.col("doc_id")
    mode = F.when(i % 2 == 0, "forced_slow").otherwise("forced_fast")
    return table(s, d, "labels").select("doc_id", (F.col("quality") + F.when(i % 21 == 0, 1).otherwise(0)).cast("double").alias("score"), (i % 12).alias("weight"), (i * 1000).alias("flops"), mode.alias("mode"), F.when((i % 2 == 0) != (i % 25 == 0), "d").alias("diagnostics"))


def report_rows(s, d):
    i = F.col("doc_id")
    return texts(s, d).select("doc_id", ((i % 111) * 1.0).alias("candidate"), F.when(i % 10 == 0, float("inf")).otherwise(50.0).alias("original"), F.when(i % 8 == 0, "f").otherwise(H.sha(i.cast("string"))).alias("plan"), (i % 6).alias("rows"))


def member_names(s, d):
    i = F.col("p_partkey")
    name = F.format_string("%s/train-%05d-of-%05d.%s", F.when(i % 7 == 0, "C 1").otherwise("Python"), i % 90, F.lit(80), F.when(i % 5 == 0, "csv").otherwise("parquet"))
    return table(s, d, "part").select(i.alias("row"), name.alias("name"), K.member(name).alias("m"))


def score_rows(s, d):
    i = F.col("doc_id")
    return texts(s, d).select("doc_id", F.when(i == 5, 4).otherwise(i).alias("sequence_index"), (100000 + i % 997).alias("weak"), F.lit(100000).alias("strong"))


def nll_rows(s, d):
    """Line numbers as strata of an order; the stated total is what 1, 2, ... would give, and one more for some."""
    last = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    total = last * (last + 1) / 2 + F.when(F.col("l_orderkey") % 5 == 0, 1).otherwise(0)
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("double").alias("nll"), total.alias("total"))


def broken_counts(rows, rules, *keys):
    """How often each rule is broken, and how many rows break none."""
    name = F.explode(F.when(F.size("broken") == 0, F.array(F.lit("none"))).otherwise(F.col("broken")))
    return K.checked(rows, rules).select(*keys, name.alias("rule")).groupBy(*keys, "rule").agg(F.count("*").alias("n"))


def listed(rows, rules, key):
    return K.checked(rows, rules).select(key, F.array_join("broken", ",").alias("broken"))


QUERIES = {
    "contract_raw_rows": lambda s, d: listed(raw_rows(s, d), K.raw_row(), "doc_id"),
    "raw_identity_sha256": lambda s, d: identified(s, d).select("doc_id", "identity"),
    "contract_documents": lambda s, d: listed(documents(s, d), K.document(), "doc_id"),
    "contract_training_rows": lambda s, d: broken_counts(training_rows(s, d), K.training_row(), "role"),
    "contract_code_rows": lambda s, d: listed(code_rows(s, d), K.code_row(), "row"),
    "contract_audit_rows": lambda s, d: listed(audit_rows(s, d), K.audit_row(), "doc_id"),
    "contract_choices": lambda s, d: listed(choice_rows(s, d), K.choice_row(), "doc_id"),
    "contract_reviews": lambda s, d: listed(review_rows(s, d), K.review_row(F.array(*map(F.lit, CONCEPTS))), "doc_id"),
    "contract_spans": lambda s, d: span_rows(s, d).select("doc_id", K.spans(F.col("text"), F.col("found")).alias("sound")),
    "contract_oracle_rows": lambda s, d: listed(oracle_rows(s, d), K.oracle_row(), "doc_id"),
    "contract_reports": lambda s, d: listed(report_rows(s, d), K.report_row(["candidate", "original"], ["plan"]), "doc_id"),
    "contract_scores_dense": lambda s, d: K.dense_index(score_rows(s, d), "sequence_index").select("doc_id", "dense", (F.col("weak") - F.col("strong")).alias("delta")),
    "contract_nll_strata": lambda s, d: K.strata_match(nll_rows(s, d), ["run"], F.col("nll"), F.col("total")).groupBy("matches").agg(F.count("*").alias("n")),
    "member_names": lambda s, d: member_names(s, d).select("row", F.col("m.language").alias("language"), F.col("m.index").alias("index"), F.col("m.count").alias("count")),
    "score_predicate": lambda s, d: audit_rows(s, d).select("doc_id", K.score_at_least(F.col("language_score"), 0.5).alias("kept")),
    "prompt_extract": lambda s, d: texts(s, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("source")).alias("question"), F.when(F.col("doc_id") % 5 == 0, " p ").alias("prompt"), F.substring("text", 1, 40).alias("text")).transform(lambda x: x.select("doc_id", K.first_prompt(x).alias("prompt"))),
}

D = "CASE WHEN {c} THEN NULL ELSE '{n}' END"


def sql_broken(rules: dict[str, str]) -> str:
    """DuckDB expression of the sorted names of broken rules, joined."""
    parts = ", ".join(D.format(c=f"coalesce({c}, false)", n=n) for n, c in rules.items())
    return f"array_to_string(list_sort(list_filter([{parts}], lambda x: x IS NOT NULL)), ',')"


RAW = """r AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN text END AS text, source AS dataset, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'r' || (doc_id % 5) END AS revision,
  doc_id % 17 - 1 AS row_index, CASE WHEN doc_id % 19 <> 0 THEN 'MIT' END AS license, ['english', 'code', 'math', 'science', 'technical', 'poetry'][doc_id % 6 + 1] AS domain FROM documents),
i AS (SELECT *, sha256('{"line_number":' || doc_id || ',"shard":0,"text_sha256":' || coalesce('"' || sha256(text) || '"', 'null') || '}') AS identity FROM r)"""
DOMAIN = "domain IN ('english', 'code', 'math', 'science', 'technical')"
FILLED = {f: f"length({f}) > 0" for f in ("dataset", "revision", "license")}
HEX = "regexp_full_match({c}, '[0-9a-fA-F]{{64}}')"

ORACLES = {
    "contract_raw_rows": f"WITH {RAW} SELECT doc_id, {sql_broken({'text': 'length(text) > 0', **FILLED, 'row_index': 'row_index >= 0', 'domain': DOMAIN})} AS broken FROM r",
    "raw_identity_sha256": f"WITH {RAW} SELECT doc_id, identity FROM i",
    "contract_documents": f"""WITH {RAW}, v AS (SELECT *, doc_id % 7 <> 0 AS disjoint, CASE WHEN doc_id % 23 = 0 THEN 'short' ELSE identity END AS evidence,
  CASE WHEN doc_id % 3 = 0 THEN identity WHEN doc_id % 29 = 0 THEN 'other' END AS declared FROM i)
SELECT doc_id, {sql_broken({"text": "length(text) > 0", **FILLED, "domain": DOMAIN, "disjoint": "disjoint", "evidence": HEX.format(c="evidence"), "identity": "declared IS NULL OR declared = identity"})} AS broken FROM v""",
    "contract_training_rows": f"""WITH k AS (SELECT conv_id * 10 + turn AS key, role AS speaker, text AS prompt FROM conversations),
t AS (SELECT *, {list(K.ROLE_MODES) + ["other"]}[key % 5 + 1] AS role, {list(K.ROLE_MODES.values()) + ["other"]}[(key + CASE WHEN key % 31 = 0 THEN 1 ELSE 0 END) % 5 + 1] AS mode,
  CASE WHEN key % 4 = 0 THEN '' WHEN key % 9 = 0 THEN NULL ELSE speaker END AS response, {K.VERIFIERS + ["guess"]}[key % 8 + 1] AS kind, key % 12 <> 0 AS passed FROM k),
b AS (SELECT role, {sql_broken({"mode": "mode = CASE role " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.ROLE_MODES.items()) + " END", "prompt": "length(trim(prompt)) > 0", "response": "CASE WHEN role = 'rl_prompts' THEN coalesce(response, '') = '' ELSE length(trim(response)) > 0 END", "kind": "kind <> 'guess'", "passed": "passed"})} AS broken FROM t),
u AS (SELECT role, unnest(CASE WHEN broken = '' THEN ['none'] ELSE string_split(broken, ',') END) AS rule FROM b)
SELECT role, rule, count(*) AS n FROM u GROUP BY ALL""",
    "contract_code_rows": f"""WITH c AS (SELECT p_partkey AS row, CASE WHEN p_partkey % 9 = 0 THEN 'zz' ELSE sha1(p_partkey::varchar) END AS blob, CASE WHEN p_partkey % 10 = 0 THEN 'owner' ELSE 'owner/name' END AS repo,
  CASE WHEN p_partkey % 8 = 0 THEN 'p' ELSE '/p' END AS path, CASE WHEN p_partkey % 7 = 0 THEN ['MIT', 'MIT'] ELSE ['MIT', 'ISC'] END AS licenses, CASE WHEN p_partkey % 6 = 0 THEN 'unknown' ELSE 'permissive' END AS kind FROM part)
SELECT row, {sql_broken({"blob": "regexp_full_match(blob, '[0-9a-f]{40}')", "repo": "regexp_full_match(repo, '[^/]+/[^/]+')", "path": "path[1] = '/'", "licenses": "len(list_distinct(licenses)) = len(licenses)", "kind": "kind IN ('permissive', 'no_license')"})} AS broken FROM c""",
    "contract_audit_rows": f"""WITH a AS (SELECT doc_id, text, doc_id % 4 + 2 AS score, doc_id % 21 AS token_count, CASE WHEN doc_id % 14 = 0 THEN 1 ELSE length(text) END AS char_count, lang AS language,
  CASE WHEN doc_id % 15 = 0 THEN NULL WHEN doc_id % 16 = 0 THEN 1.5 ELSE (doc_id % 100) / 100 END AS share FROM documents)
SELECT doc_id, {sql_broken({"text": "length(text) > 0", "score": "score IN (4, 5)", "token_count": "token_count > 0", "char_count": "char_count = length(text)", "language": "language = 'en'", "language_score": "share BETWEEN 0 AND 1"})} AS broken FROM a""",
    "contract_choices": f"""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), c AS (SELECT doc_id, w[1] AS question, w[2:doc_id % 18 + 2] AS choices, doc_id % 7 - 1 AS answer FROM w)
SELECT doc_id, {sql_broken({"question": "length(trim(question)) > 0", "choices": "len(choices) BETWEEN 2 AND 16 AND len(list_filter(choices, lambda x: x <> trim(x) OR x = '')) = 0", "answer": "answer >= 0 AND answer < len(choices)"})} AS broken FROM c""",
    "contract_reviews": f"""WITH r AS (SELECT doc_id, doc_id % 30 * 40000 - 1000 AS quality, 700000 + doc_id % 40 * 10000 AS confidence, {CONCEPTS}[doc_id % 5 + 1:doc_id % 5 + doc_id % 3] AS assumed,
  CASE WHEN doc_id % 13 = 0 THEN ['c9'] WHEN doc_id % 11 = 0 THEN ['c7', 'c1'] ELSE {CONCEPTS}[doc_id % 7 + 1:doc_id % 7 + doc_id % 2] END AS taught, doc_id % 3 = 0 AS admit FROM documents)
SELECT doc_id, {sql_broken({"quality": "quality BETWEEN 0 AND 1000000", "confidence": "confidence BETWEEN 800000 AND 1000000", "assumed": f"list_sort(list_distinct(assumed)) = assumed AND list_has_all({CONCEPTS}, assumed)", "taught": f"list_sort(list_distinct(taught)) = taught AND list_has_all({CONCEPTS}, taught)", "apart": "NOT list_has_any(taught, assumed)", "admitted": "NOT admit OR len(taught) > 0"})} AS broken FROM r""",
    "contract_spans": """WITH p AS (SELECT doc_id, text, 0 AS s1, 10 + doc_id % 20 AS e1, 20 + doc_id % 11 AS s2, 60 + doc_id % 13 AS e2 FROM documents)
SELECT doc_id, doc_id % 9 <> 0 AND e1 <= length(text) AND e2 <= length(text) AND e1 - s1 >= 16 AND e2 - s2 >= 16 AND s2 >= e1 AS sound FROM p""",
    "contract_oracle_rows": f"""WITH o AS (SELECT doc_id, quality + CASE WHEN doc_id % 21 = 0 THEN 1 ELSE 0 END AS score, doc_id % 12 AS weight, doc_id * 1000 AS flops, doc_id % 2 = 0 AS slow, (doc_id % 2 = 0) <> (doc_id % 25 = 0) AS diagnostics FROM labels)
SELECT doc_id, {sql_broken({"score": "score BETWEEN 0 AND 1", "weight": "weight > 0", "flops": "flops > 0", "diagnostics": "slow = diagnostics"})} AS broken FROM o""",
    "contract_reports": f"""WITH o AS (SELECT doc_id, doc_id % 111 AS candidate, doc_id % 10 <> 0 AS original, CASE WHEN doc_id % 8 = 0 THEN 'f' ELSE sha256(doc_id::varchar) END AS plan, doc_id % 6 AS rows FROM documents)
SELECT doc_id, {sql_broken({"candidate": "candidate <= 100", "original": "original", "plan": HEX.format(c="plan"), "rows": "rows > 0"})} AS broken FROM o""",
    "contract_scores_dense": """WITH x AS (SELECT doc_id, CASE WHEN doc_id = 5 THEN 4 ELSE doc_id END AS i FROM documents), t AS (SELECT count(*) AS n, min(i) AS low, max(i) AS high FROM x)
SELECT doc_id, low = 0 AND high = n - 1 AND count(*) OVER (PARTITION BY i) = 1 AS dense, doc_id % 997 AS delta FROM x, t""",
    "contract_nll_strata": """WITH x AS (SELECT l_orderkey, sum(l_linenumber) AS a, max(l_linenumber) * (max(l_linenumber) + 1) / 2 + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS b FROM lineitem GROUP BY 1)
SELECT abs(a - b) <= greatest(1e-4, 1e-9 * greatest(abs(a), abs(b))) AS matches, count(*) AS n FROM x GROUP BY 1""",
    "member_names": r"""WITH m AS (SELECT p_partkey AS row, printf('%s/train-%05d-of-%05d.%s', CASE WHEN p_partkey % 7 = 0 THEN 'C 1' ELSE 'Python' END, p_partkey % 90, 80, CASE WHEN p_partkey % 5 = 0 THEN 'csv' ELSE 'parquet' END) AS name FROM part),
g AS (SELECT row, regexp_extract(name, '^([A-Za-z0-9+#-]+)/train-(\d{5})-of-(\d{5})\.parquet$', ['l', 'i', 'c']) AS x FROM m),
h AS (SELECT row, x.l AS l, try_cast(x.i AS int) AS i, try_cast(x.c AS int) AS c FROM g)
SELECT row, CASE WHEN i < c THEN l END AS language, CASE WHEN i < c THEN i END AS index, CASE WHEN i < c THEN c END AS count FROM h""",
    "score_predicate": "SELECT doc_id, doc_id % 15 <> 0 AND (doc_id % 16 = 0 OR doc_id % 100 >= 50) AS kept FROM documents",
    "prompt_extract": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'p' ELSE coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE source END), ''), nullif(trim(text[1:40], ' '), '')) END AS prompt FROM documents",
}
