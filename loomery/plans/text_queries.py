"""Queries on text, quality, contamination and deduplication, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import hashing as H
from loomery.functions import text as T
from loomery.operators import contamination as C
from loomery.operators import quality as Q
from loomery.sources.tables import table

NORM = "trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'))"
WORDS = r"regexp_extract_all({n}, '[\p{{L}}\p{{N}}]+(?:[''’-][\p{{L}}\p{{N}}]+)*')"
CODES = r"regexp_extract_all({n}, '[A-Za-z_][\p{{L}}\p{{N}}_]*|\p{{Nd}}+(?:\.\p{{Nd}}+)?|==|!=|<=|>=|:=|->|\*\*|//|<<|>>|&&|\|\||\S')"
MATCH = "len(regexp_extract_all({t}, '{p}'))"


def _count(pattern: str, text: str = "text") -> str:
    return MATCH.format(t=text, p=pattern.replace("'", "''"))


def _grams(words: str, k: int) -> str:
    return f"list_distinct(list_transform(range(1, len({words}) - {k - 2}), lambda i: array_to_string({words}[i:i + {k - 1}], chr(31))))"


NORMALISED = f"n AS (SELECT *, {NORM} AS norm FROM documents), b AS (SELECT *, {NORM} AS norm FROM benchmark)"


def _overlap(words: str, k: int, name: str) -> str:
    return f"""{name}_d AS (SELECT doc_id, unnest({_grams('w', k)}) AS g FROM (SELECT doc_id, {words.format(n='norm')} AS w FROM n) WHERE len(w) >= {k}),
{name}_b AS (SELECT DISTINCT unnest({_grams('w', k)}) AS g FROM (SELECT {words.format(n='norm')} AS w FROM b) WHERE len(w) >= {k}),
{name} AS (SELECT doc_id, count(*) AS hits FROM {name}_d WHERE g IN (SELECT g FROM {name}_b) GROUP BY doc_id)"""


DECONTAMINATED = f"""WITH {NORMALISED}, {_overlap(WORDS, 13, 'wo')}, {_overlap(CODES, 8, 'co')},
seen AS (SELECT *, doc_id > min(doc_id) OVER (PARTITION BY norm) AS duplicate FROM n),
flagged AS (SELECT s.doc_id, s.source, s.lang, s.duplicate, coalesce(wo.hits, 0) AS hits, coalesce(co.hits, 0) AS code_hits
            FROM seen s LEFT JOIN wo USING (doc_id) LEFT JOIN co USING (doc_id))
"""


def decontaminated(spark, sf_dir):
    return C.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def signals(spark, sf_dir):
    return Q.with_signals(docs(spark, sf_dir))


def _safety(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *(c.alias(k) for k, c in Q.safety(F.col("text")).items()))


#: Phrases that are put into some texts, since the tables hold none.
PHRASES = ["See the ANSWER KEY.", "a Casino night", "we write my paper", "click here now", "none of these"]


def risky(s, d):
    return docs(s, d).withColumn("text", F.concat("text", F.lit(" "), F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % 5 + 1).cast("int"))))


QUERIES = {
    "decontaminate_accepted": lambda s, d: decontaminated(s, d).filter("accepted").select("doc_id", "source", "lang"),
    "decontaminate_summary": lambda s, d: decontaminated(s, d).agg(F.count("*").alias("scanned"), F.count_if("accepted").alias("accepted"), F.count_if("duplicate").alias("duplicates"), F.count_if((F.col("hits") > 0) | (F.col("code_hits") > 0)).alias("contaminated")),
    "contamination_13gram": lambda s, d: C.overlap_counts(docs(s, d), C.boundary(table(s, d, "benchmark"))),
    "contamination_code_8gram": lambda s, d: C.overlap_counts(docs(s, d), C.boundary(table(s, d, "benchmark"), width=8, code=True), width=8, code=True),
    "overlap_kind_exact_or_ngram": lambda s, d: C.overlap_kind(docs(s, d), table(s, d, "benchmark")),
    "exact_dup_all_scanned": lambda s, d: C.first_occurrence(docs(s, d), H.sha(T.nfkc_casefold(F.col("text"))), "doc_id").select("doc_id", "duplicate"),
    "exact_dup_after_quality": lambda s, d: C.first_occurrence(Q.with_web_quality(docs(s, d)).filter("accepted"), H.sha(T.nfkc_casefold(F.col("text"))), "doc_id").filter("not duplicate").select("doc_id"),
    "word_tokens_stats": lambda s, d: docs(s, d).select("doc_id", T.words(T.nfkc_casefold(F.col("text"))).alias("w")).select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_unique")),
    "code_token_counts": lambda s, d: docs(s, d).select("doc_id", F.size(T.code_tokens(T.nfkc_casefold(F.col("text")))).alias("n")),
    "char_class_fractions": lambda s, d: docs(s, d).select("doc_id", F.round(T.share(F.col("text"), r"\p{L}"), 9).alias("alpha"), F.round(T.share(F.col("text"), r"\p{Nd}"), 9).alias("digit"), F.round(T.share(F.col("text"), r"[^\p{L}\p{N}\s]"), 9).alias("symbol")),
    "repeated_line_fraction": lambda s, d: docs(s, d).select("doc_id", F.round(T.repeated_line_fraction(F.col("text")), 9).alias("fraction")),
    "boilerplate_flags": lambda s, d: docs(s, d).select("doc_id", Q.web_quality(F.col("text"))["boilerplate"].alias("markers")),
    "web_quality_accept": lambda s, d: Q.with_web_quality(docs(s, d)).groupBy("lang").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted")),
    "longest_char_run": lambda s, d: docs(s, d).select("doc_id", T.longest_run(F.col("text")).alias("run")),
    "reading_ease": lambda s, d: signals(s, d).select("doc_id", "words", "sentences", "syllables", F.round("reading_ease", 6).alias("reading_ease")),
    "quality_reasons_histogram": lambda s, d: T.exploded(signals(s, d), [], F.col("quality_reasons"), "reason").groupBy("reason").agg(F.count("*").alias("n")),
    "difficulty_band_counts": lambda s, d: signals(s, d).filter(F.size("quality_reasons") == 0).groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("difficulty"), 9).alias("mean")),
    "document_signals": lambda s, d: signals(s, d).select("doc_id", "words", "unique_words", "sentences", *(F.round(c, 9).alias(c) for c in ("average_word_characters", "long_word_fraction", "symbol_fraction", "digit_fraction", "difficulty")), "band"),
    "math_signal_classes": lambda s, d: docs(s, d).select("doc_id", Q.classes(F.col("text"), Q.MATH).alias("math"), Q.classes(F.col("text"), Q.EXPLANATION).alias("explanation")),
    "risk_signal_counts": lambda s, d: T.exploded(risky(s, d), ["lang"], Q.risk_reasons(F.col("text")), "risk").groupBy("lang", "risk").agg(F.count("*").alias("n")),
    "safety_scan_counts": lambda s, d: _safety(s, d).select(Q.decision(F.col("reject"), F.col("review")).alias("decision")).groupBy("decision").agg(F.count("*").alias("n")),
    "safety_signals": lambda s, d: _safety(s, d).select("doc_id", "repeated_ppm", "longest_line"),
    "email_candidates": lambda s, d: _safety(s, d).filter("emails > 0").select("doc_id"),
    "url_host_top25": lambda s, d: table(s, d, "pages").groupBy(T.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.min("page_id").alias("first")).orderBy(F.desc("n"), "first").limit(25),
    "url_host_denied": lambda s, d: table(s, d, "pages").select("page_id", Q.host_denied(T.host(F.col("url"))).alias("denied")),
    "shingle_counts": lambda s, d: docs(s, d).select("doc_id", T.words(T.nfkc_casefold(F.col("text"))).alias("w")).select("doc_id", F.size(T.shingles(F.col("w"), 5)).alias("n")),
    "text_digests": lambda s, d: docs(s, d).select("doc_id", H.sha(F.col("text")).alias("sha"), H.salted_rank("salt", H.sha(F.col("text"))).alias("rank")),
    "git_blob_ids": lambda s, d: docs(s, d).select("doc_id", H.git_blob(F.col("text")).alias("blob")),
    "source_digest": lambda s, d: docs(s, d).groupBy("lang", F.pmod("doc_id", F.lit(16)).alias("part")).agg(H.ordered_digest(F.col("doc_id"), H.sha(F.col("text"))).alias("digest"), F.count("*").alias("n")),
}

FILLED = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: x <> '')"
W = f"(SELECT doc_id, text, lang, {WORDS.format(n=NORM)} AS w FROM documents)"
QUALITY = f"""q AS (SELECT *, length(text) AS characters, len({FILLED}) AS nl, len(list_distinct({FILLED})) AS ul,
  {" + ".join(f"contains(lower(text), '{x}')::int" for x in Q.BOILERPLATE)} AS markers,
  {_count(chr(92) + 'p{L}')}::double / length(text) AS alphabetic,
  {_count('[' + chr(92) + 'x00-' + chr(92) + 'x08' + chr(92) + 'x0b' + chr(92) + 'x0c' + chr(92) + 'x0e-' + chr(92) + 'x1f' + chr(92) + 'x7f-' + chr(92) + 'x{9f}]')}::double / length(text) AS control,
  (length(text) - length(replace(text, chr(65533), '')))::double / length(text) AS replacement FROM documents),
qa AS (SELECT *, characters BETWEEN 400 AND 100000 AND (CASE WHEN nl > 0 THEN (nl - ul)::double / nl ELSE 0 END) <= 0.30 AND markers <= 1 AND alphabetic >= 0.55 AND control <= 0.001 AND replacement <= 0.0005 AS accepted FROM q)"""
SYL = "greatest(1, len(regexp_extract_all(x, '[aeiouy]+')))"
SIGNALS = f"""s0 AS (SELECT doc_id, text, w, len(w) AS words, greatest(1, {_count('[.!?]+(?:' + chr(92) + 's+|$)')}) AS sentences, len(list_distinct(w)) AS unique_words,
  coalesce(list_sum(list_transform(w, lambda x: {SYL} - CASE WHEN length(x) > 3 AND ends_with(x, 'e') AND {SYL} > 1 THEN 1 ELSE 0 END)), 0)::bigint AS syllables FROM {W})"""

def _n(pattern):
    """DuckDB expression: how often ``pattern`` matches the text."""
    return "len(regexp_extract_all(text, '" + pattern.replace("'", "''") + "'))"


def _clamped(value, low, high):
    return f"greatest(0.0, least(1.0, ({value} - {low}) / ({high} - {low})))"


RUNS = "WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS i FROM documents), g AS (SELECT doc_id, ch, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS grp FROM c WHERE ch <> chr(10)), r AS (SELECT doc_id, count(*) AS run FROM g GROUP BY doc_id, ch, grp) SELECT doc_id, max(run) AS run FROM r GROUP BY doc_id"
CODE_LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')"
SCORED = f"""{SIGNALS}, runs AS ({RUNS}),
s1 AS (SELECT s0.*, greatest(words, 1) AS filled_words, coalesce(run, 1) AS run, {_n(chr(92) + "p{L}")} AS letters, {_n(chr(92) + "p{Latin}")} AS latin, {_n(T.URL)} AS urls,
  CASE WHEN words > 0 THEN list_sum(list_transform(w, lambda x: length(x)))::double / words ELSE 0 END AS average_word_characters,
  CASE WHEN words > 0 THEN len(list_filter(w, lambda x: length(x) >= 9))::double / words ELSE 0 END AS long_word_fraction,
  CASE WHEN length(text) > 0 THEN {_n("[^" + chr(92) + "p{L}" + chr(92) + "p{N}" + chr(92) + "s]")}::double / length(text) ELSE 0 END AS symbol_fraction,
  CASE WHEN length(text) > 0 THEN {_n(chr(92) + "p{Nd}")}::double / length(text) ELSE 0 END AS digit_fraction,
  CASE WHEN len({CODE_LINES}) > 0 THEN len(list_filter({CODE_LINES}, lambda x: regexp_matches(x, '{T.CODE_LINE}')))::double / len({CODE_LINES}) ELSE 0 END AS code,
  {_n(T.REASONING)} AS reasoning, {_n(T.TECHNICAL)} AS technical FROM s0 LEFT JOIN runs ON s0.doc_id = runs.doc_id),
s2 AS (SELECT *, list_filter([CASE WHEN run > 40 THEN 'character_run_high' END, CASE WHEN letters >= 100 AND latin::double / letters < 0.80 THEN 'latin_coverage_low' END,
    CASE WHEN unique_words::double / filled_words < 0.10 THEN 'lexical_repetition_high' END, CASE WHEN words < 80 THEN 'too_few_words' END, CASE WHEN urls::double / filled_words > 0.02 THEN 'url_density_high' END], lambda x: x IS NOT NULL) AS reasons,
  least(1.0, greatest(0.0, 0.21 * {_clamped("words::double / sentences", 8.0, 32.0)} + 0.15 * {_clamped("average_word_characters", 4.0, 7.0)} + 0.13 * {_clamped("long_word_fraction", 0.04, 0.28)}
    + 0.08 * {_clamped("unique_words / sqrt(filled_words)", 4.0, 16.0)} + 0.08 * {_clamped("symbol_fraction", 0.015, 0.16)} + 0.07 * {_clamped("digit_fraction", 0.005, 0.12)}
    + 0.09 * {_clamped("code", 0.0, 0.35)} + 0.08 * {_clamped("reasoning::double / filled_words", 0.0, 0.025)} + 0.07 * {_clamped("technical::double / filled_words", 0.0, 0.035)}
    + 0.04 * {_clamped("log10(greatest(length(text), 400))", 2.6, 5.0)})) AS difficulty FROM s1),
s3 AS (SELECT *, CASE WHEN difficulty < 0.13 THEN 'foundation' WHEN difficulty < 0.22 THEN 'composition' WHEN difficulty < 0.42 THEN 'reasoning' ELSE 'specialization' END AS band FROM s2)"""
_KEY = Q.CREDENTIAL.split("(['", 1)[0]
#: RE2 has no back-references: the two quotes apart.
QUOTED = [(_KEY + q + "([^'\"\r\n]{12,})" + q).replace("'", "''") for q in ("'", '"')]
CREDENTIALS = "len(list_filter(list_concat(" + ", ".join(f"regexp_extract_all(text, '{x}', 1)" for x in QUOTED) + f"), lambda x: NOT regexp_matches(x, '{Q.PLACEHOLDER}')))"
SIMPLE = "regexp_extract_all({n}, '[" + chr(92) + "p{{L}}" + chr(92) + "p{{N}}_]+')"
GRAMS = "CASE WHEN len({w}) >= 13 THEN list_transform(range(1, len({w}) - 11), lambda i: array_to_string({w}[i:i + 12], ' ')) WHEN len({w}) > 0 THEN [array_to_string({w}, ' ')] ELSE [] END"
SCAN = f"""t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_+/=-]{{32,}}')) AS token FROM documents),
ch AS (SELECT doc_id, token, unnest(string_split(token, '')) AS c FROM t WHERE NOT regexp_matches(token, '{Q.PLACEHOLDER}')),
en AS (SELECT doc_id, token, -sum(p * log2(p)) AS bits FROM (SELECT doc_id, token, count(*)::double / length(token) AS p FROM ch GROUP BY doc_id, token, c) GROUP BY ALL),
hi AS (SELECT doc_id, count(*) AS tokens FROM en WHERE round(bits * 1000) >= 4000 GROUP BY doc_id),
sc AS (SELECT doc_id, text, {" OR ".join("regexp_matches(text, '" + x + "')" for x in Q.SECRETS.values())} AS secret,
  {CREDENTIALS} > 0 AS credential,
  regexp_matches(text, '{Q.CONTROL}') AS control, regexp_matches(text, '{Q.JWT}') AS jwt, {" OR ".join(f"contains(lower(text), '{x}')" for x in Q.GENERATED)} AS generated,
  list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 2000 AS long_line, len({FILLED}) > 0 AND (len({FILLED}) - len(list_distinct({FILLED}))) * 1000000 // len({FILLED}) > 500000 AS repeated FROM documents)"""

EMAILS = r"SELECT doc_id FROM documents WHERE len(list_filter(regexp_extract_all(text, '(?:^|[^A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})(?:$|[^A-Za-z0-9.-])', 1), lambda x: lower(regexp_extract(x, '@([^@]*)$', 1)) NOT IN ('example.com', 'example.net', 'example.org', 'localhost', 'users.noreply.github.com'))) > 0"

ORACLES = {
    "decontaminate_accepted": DECONTAMINATED + "SELECT doc_id, source, lang FROM flagged WHERE NOT duplicate AND hits = 0 AND code_hits = 0",
    "decontaminate_summary": DECONTAMINATED + "SELECT count(*) AS scanned, count_if(NOT duplicate AND hits = 0 AND code_hits = 0) AS accepted, count_if(duplicate) AS duplicates, count_if(hits > 0 OR code_hits > 0) AS contaminated FROM flagged",
    "contamination_13gram": f"WITH {NORMALISED}, {_overlap(WORDS, 13, 'wo')} SELECT * FROM wo",
    "contamination_code_8gram": f"WITH {NORMALISED}, {_overlap(CODES, 8, 'co')} SELECT * FROM co",
    "exact_dup_all_scanned": f"WITH {NORMALISED} SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY norm) AS duplicate FROM n",
    "exact_dup_after_quality": f"WITH {QUALITY} SELECT min(doc_id) AS doc_id FROM qa WHERE accepted GROUP BY {NORM}",
    "word_tokens_stats": f"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_unique FROM {W}",
    "code_token_counts": f"SELECT doc_id, len({CODES.format(n=NORM)}) AS n FROM documents",
    "char_class_fractions": r"SELECT doc_id, round(len(regexp_extract_all(text, '\p{L}'))::double / length(text), 9) AS alpha, round(len(regexp_extract_all(text, '\p{Nd}'))::double / length(text), 9) AS digit, round(len(regexp_extract_all(text, '[^\p{L}\p{N}\s]'))::double / length(text), 9) AS symbol FROM documents",
    "repeated_line_fraction": f"SELECT doc_id, round(CASE WHEN len({FILLED}) > 0 THEN (len({FILLED}) - len(list_distinct({FILLED})))::double / len({FILLED}) ELSE 0 END, 9) AS fraction FROM documents",
    "boilerplate_flags": f"SELECT doc_id, {' + '.join(f'''contains(lower(text), '{x}')::int''' for x in Q.BOILERPLATE)} AS markers FROM documents",
    "web_quality_accept": f"WITH {QUALITY} SELECT lang, count(*) AS n, count_if(accepted) AS accepted FROM qa GROUP BY lang",
    "reading_ease": f"WITH {SIGNALS} SELECT doc_id, words, sentences, syllables, round(206.835 - 1.015 * (words / sentences) - 84.6 * syllables / greatest(words, 1), 6) AS reading_ease FROM s0",
    "math_signal_classes": "SELECT doc_id, " + " + ".join("regexp_matches(text, '" + p.replace("'", "''") + "')::int" for p in Q.MATH) + " AS math, " + " + ".join("regexp_matches(text, '" + p.replace("'", "''") + "')::int" for p in Q.EXPLANATION) + " AS explanation FROM documents",
    "risk_signal_counts": f"WITH t AS (SELECT lang, text || ' ' || {PHRASES}[doc_id % 5 + 1] AS text FROM documents) SELECT lang, risk, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT lang, '{k}' AS risk FROM t WHERE regexp_matches(text, '{p}')" for k, p in Q.RISKS.items()) + ") GROUP BY ALL",
    "safety_signals": f"SELECT doc_id, (CASE WHEN len({FILLED}) > 0 THEN (len({FILLED}) - len(list_distinct({FILLED}))) * 1000000 // len({FILLED}) ELSE 0 END)::bigint AS repeated_ppm, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS longest_line FROM documents",
    "email_candidates": EMAILS,
    "url_host_top25": "SELECT regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS host, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1 ORDER BY n DESC, first LIMIT 25",
    "url_host_denied": "WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages) SELECT page_id, (" + " OR ".join(f"host = '{x}' OR ends_with(host, '.{x}')" for x in Q.DENIED_HOSTS) + ") AS denied FROM h",
    "shingle_counts": f"SELECT doc_id, CASE WHEN len(w) >= 5 THEN len({_grams('w', 5)}) ELSE 0 END AS n FROM {W}",
    "text_digests": "SELECT doc_id, sha256(text) AS sha, sha256('salt'::blob || unhex(sha256(text))) AS rank FROM documents",
    "source_digest": "SELECT lang, doc_id % 16 AS part, sha256(unhex(string_agg(sha256(text), '' ORDER BY doc_id))) AS digest, count(*) AS n FROM documents GROUP BY lang, doc_id % 16",
    "longest_char_run": RUNS,
    "document_signals": f"WITH {SCORED} SELECT doc_id, words, unique_words, sentences, round(average_word_characters, 9) AS average_word_characters, round(long_word_fraction, 9) AS long_word_fraction, round(symbol_fraction, 9) AS symbol_fraction, round(digit_fraction, 9) AS digit_fraction, round(difficulty, 9) AS difficulty, band FROM s3",
    "quality_reasons_histogram": f"WITH {SCORED} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM s3) GROUP BY reason",
    "difficulty_band_counts": f"WITH {SCORED} SELECT band, count(*) AS n, round(avg(difficulty), 9) AS mean FROM s3 WHERE len(reasons) = 0 GROUP BY band",
    "git_blob_ids": "SELECT doc_id, sha1(('blob ' || octet_length(encode(text)))::blob || '\\x00'::blob || encode(text)) AS blob FROM documents",
    "overlap_kind_exact_or_ngram": f"""WITH {NORMALISED}, m AS (SELECT doc_id, norm, {SIMPLE.format(n="norm")} AS w FROM n), bb AS (SELECT {NORM} AS norm, {SIMPLE.format(n=NORM)} AS w FROM benchmark),
x AS (SELECT DISTINCT unnest({GRAMS.format(w="w")}) AS g FROM bb), h AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({GRAMS.format(w="w")}) AS g FROM m) JOIN x USING (g))
SELECT m.doc_id, CASE WHEN norm IN (SELECT norm FROM bb) THEN 'exact' WHEN h.doc_id IS NOT NULL THEN 'ngram' END AS kind FROM m LEFT JOIN h USING (doc_id)""",
    "safety_scan_counts": f"""WITH {SCAN}, mail AS ({EMAILS})
SELECT CASE WHEN secret OR credential OR control THEN 'rejected' WHEN mail.doc_id IS NOT NULL OR jwt OR hi.tokens > 0 OR long_line OR repeated OR generated THEN 'review' ELSE 'clean' END AS decision, count(*) AS n
FROM sc LEFT JOIN mail USING (doc_id) LEFT JOIN hi USING (doc_id) GROUP BY 1""",
}
