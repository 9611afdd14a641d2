"""Queries on structure read out of text and on schedules, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import parsing as G
from loomery.functions import schedules as S
from loomery.sources.tables import table


def docs(s, d, *columns):
    return table(s, d, "documents").select("doc_id", *columns)


def quoted(s, d):
    """Texts with a quote of them; some quotes occur twice, some are broken differently."""
    text = F.col("text")
    quote = F.when(F.col("doc_id") % 7 == 0, F.lit("not in any of the texts")).otherwise(F.substring(text, (F.col("doc_id") % 50 + 1).cast("int"), F.lit(20)))
    return docs(s, d, F.when(F.col("doc_id") % 5 == 0, F.concat(text, F.lit(" "), quote)).otherwise(text).alias("text"), quote.alias("quote"))


def optioned(s, d):
    """Texts of options: some begin wrongly, some skip a letter, some have lines that go on."""
    word = F.regexp_extract("text", r"[a-z]+", 0)
    letters = F.concat(F.when(F.col("doc_id") % 11 == 0, "x\n").otherwise(""), F.lit("A. first "), word, F.lit("\n"), F.when(F.col("doc_id") % 3 == 0, "and more\n").otherwise(""), F.when(F.col("doc_id") % 13 == 0, "C. ").otherwise("B. "), F.when(F.col("doc_id") % 17 == 0, " ").otherwise(word))
    return docs(s, d, letters.alias("letters"), F.concat(F.lit("1 - "), word, F.lit("\nmore\n"), F.when(F.col("doc_id") % 9 == 0, "3").otherwise("2"), F.lit(" - two")).alias("numbers"))


def answered(s, d):
    body = F.concat(F.lit('{"a": '), F.col("doc_id").cast("string"), F.lit("}"))
    return docs(s, d, F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```\n"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```"), body, F.lit("```"))).otherwise(body).alias("response"))


def jsons(s, d):
    return docs(s, d, F.concat(F.lit('{"z":["short","a longer string '), F.col("doc_id").cast("string"), F.lit('"],"a":{"k":"nested string","n":5},"m":"é'), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 10 == 0, "").otherwise('"}')).alias("json"))


TOKENS = ["слово", "漢字", "ひらがな", "mixед", "word", "한글", "עברית", "12", "ไทย", "カタカナ1"]
CODE = ["x = 1\n# note\n", "def f(:\n  pass\n# a\n# b", "if True:\n    y = 2", "  # only\n", "x = = 1"]
META = ['{"found_math": true}', '{"found_math": false}', "{}", "[1]", "not json", '{"found_math": "true"}']
TIMES = ["2025-01-02T03:04:05Z", "2025-01-02T03:04:05+02:00", "2025-01-02T03:04:05", "2025-13-02T03:04:05Z", "2025-01-02"]


def one_of(values):
    return F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))


def summaries(s, d):
    line = lambda pad, k: F.concat(F.lit(pad), F.lit("- [Part "), F.col("doc_id").cast("string"), F.lit(k), F.lit("](ch0"), (F.col("doc_id") % 9).cast("string"), F.lit(f"-{k}.md)"))
    return docs(s, d, F.concat(F.lit("# Summary\n\n"), line("", "a"), F.lit("\n"), line("  ", "b"), F.lit("\nplain text\n"), line("    ", "c")).alias("text"))


def manuals(s, d):
    entry = lambda k: F.concat(F.lit(f"   {k}"), (F.col("doc_id") % 100).cast("string"), F.lit(".rst\n"))
    title = F.concat(F.lit("Chapter "), F.col("doc_id").cast("string"))
    return docs(s, d, F.concat(title, F.lit("\n"), F.repeat(F.lit("="), F.when(F.col("doc_id") % 6 == 0, 3).otherwise(20)), F.lit("\n\n.. toctree::\n   :maxdepth: 1\n\n"), entry("a"), entry("b"), F.lit("\nThe end\n-------\n   c.rst\n")).alias("text"))


def models(s):
    return s.createDataFrame([("a", 50000, 512, 12, 1_048_576, 100_000_000), ("b", 32000, 768, 10, 2_359_296, 120_000_000), ("c", 64000, 640, 8, 1_638_400, 90_000_000)], "family string, vocabulary long, hidden long, layers long, mixer long, target long")


def fitted(s):
    c = F.col
    return models(s).withColumn("inner", S.fitted_inner(c("vocabulary"), c("hidden"), c("layers"), c("mixer"), c("target")))


def ledger(s):
    return fitted(s).select("family", "inner", S.parameters(*(F.col(x) for x in ("vocabulary", "hidden", "inner", "layers", "mixer"))).alias("p")).select("family", "inner", "p.*")


FLOPS = [("a", 1200), ("b", 1800), ("c", 1000)]

QUERIES = {
    "unique_quote_span": lambda s, d: quoted(s, d).select("doc_id", G.unique_quote(F.col("text"), F.col("quote")).alias("q")).select("doc_id", "q.start", "q.end", "q.sha"),
    "whitespace_tolerant_quote": lambda s, d: docs(s, d, F.substring("text", 1, 300).alias("text")).withColumn("quote", F.concat_ws("  \n", F.slice(F.split("text", " "), 2, 4))).select("doc_id", G.tolerant_quote(F.col("text"), F.col("quote")).alias("quote")),
    "fenced_json_strip": lambda s, d: answered(s, d).select("doc_id", G.unfenced(F.col("response")).alias("body")),
    "normalized_prompt_identity": lambda s, d: docs(s, d, G.prompt_identity(F.col("lang"), F.col("doc_id"), F.col("text")).alias("identity")),
    "lettered_choice_parse": lambda s, d: optioned(s, d).select("doc_id", F.array_join(G.lettered_choices(F.col("letters")), "|").alias("choices")),
    "numbered_choice_parse": lambda s, d: optioned(s, d).select("doc_id", F.array_join(G.numbered_choices(F.col("numbers")), "|").alias("choices")),
    "prompt_template": lambda s, d: docs(s, d, F.md5(G.question_prompt(F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 50)).otherwise(""), F.col("lang")).cast("binary")).alias("prompt")),
    "script_classifier": lambda s, d: docs(s, d, one_of(TOKENS).alias("token")).select("doc_id", G.script_of(F.col("token")).alias("script")),
    "syntax_check": lambda s, d: docs(s, d, one_of(CODE).alias("code")).select("doc_id", G.python_parses(F.col("code")).alias("parses"), G.comment_line_ppm(F.col("code")).alias("comment_ppm")),
    "json_string_leaves": lambda s, d: jsons(s, d).select("doc_id", F.array_join(G.json_leaves(F.col("json")), "|").alias("leaves")),
    "canonical_json_ascii": lambda s, d: jsons(s, d).select("doc_id", G.canonical_ascii(F.col("json")).alias("json")),
    "json_metadata_flag": lambda s, d: docs(s, d, one_of(META).alias("meta")).select("doc_id", G.found_math(F.col("meta")).alias("found")),
    "iso8601_tz": lambda s, d: docs(s, d, one_of(TIMES).alias("t")).select("doc_id", F.unix_timestamp(G.utc_time(F.col("t"))).alias("seconds")),
    "multi_field_text_scan": lambda s, d: G.text_fields(docs(s, d, F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("prompt"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source")).alias("answer")), "doc_id"),
    "toc_parse_markdown": lambda s, d: G.markdown_contents(summaries(s, d), "doc_id"),
    "toc_parse_rst": lambda s, d: G.toctree(manuals(s, d), "doc_id"),
    "consecutive_headings": lambda s, d: G.headings(manuals(s, d), "doc_id"),
    "lr_schedule": lambda s, d: s.range(1, 1001).select(F.col("id").alias("step"), F.round(S.learning_rate(F.col("id"), 1000, 100, 0.1), 9).alias("warm"), F.round(S.learning_rate(F.col("id"), 1000, 0, 0.0), 9).alias("cold")),
    "micro_batch_partition": lambda s, d: s.range(1, 40).select(F.col("id").alias("update"), F.array_join(S.micro_batches(F.col("id"), 1003, 32, 12).cast("array<string>"), ",").alias("sizes")),
    "parameter_ledger": lambda s, d: ledger(s),
    "scale_fit": lambda s, d: fitted(s).select("family", "inner"),
    "iso_flop_lcm": lambda s, d: S.equal_flops(s.createDataFrame(FLOPS, "family string, flops long"), 1000),
    "experiment_plan_grid": lambda s, d: S.run_grid(models(s).select("family"), table(s, d, "region").select(F.col("r_name").alias("contrast")), s.range(3).withColumnRenamed("id", "seed")),
}


def pick(values):
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + f"][doc_id % {len(values)} + 1]"


WORD = "regexp_extract(text, '[a-z]+', 0)"
OPTIONS = f"op AS (SELECT doc_id, {WORD} AS w FROM documents)"
MODELS = "mo AS (SELECT * FROM (VALUES ('a', 50000, 512, 12, 1048576, 100000000), ('b', 32000, 768, 10, 2359296, 120000000), ('c', 64000, 640, 8, 1638400, 90000000)) v(family, vo, h, l, m, t)), fi AS (SELECT *, greatest(64, 64 * round_even((t - (vo * h + m * l + 2 * h * l + h)) / (3 * h * l) / 64, 0))::bigint AS inner_size FROM mo)"

ORACLES = {
    "unique_quote_span": """WITH q AS (SELECT doc_id, text AS t, CASE WHEN doc_id % 7 = 0 THEN 'not in any of the texts' ELSE substr(text, (doc_id % 50 + 1)::int, 20) END AS quote FROM documents),
x AS (SELECT doc_id, quote, CASE WHEN doc_id % 5 = 0 THEN t || ' ' || quote ELSE t END AS text FROM q), y AS (SELECT *, instr(text, quote) AS a FROM x),
z AS (SELECT *, length(quote) >= 16 AND a > 0 AND instr(substr(text, a + 1), quote) = 0 AS once FROM y)
SELECT doc_id, CASE WHEN once THEN a - 1 END AS start, CASE WHEN once THEN a - 1 + length(quote) END AS "end", CASE WHEN once THEN sha256(quote) END AS sha FROM z""",
    "whitespace_tolerant_quote": r"""WITH t AS (SELECT doc_id, substr(text, 1, 300) AS text FROM documents), q AS (SELECT doc_id, text, array_to_string(string_split(text, ' ')[2:5], '  ' || chr(10)) AS quote FROM t),
w AS (SELECT *, list_filter(regexp_split_to_array(quote, '\s+'), lambda x: x <> '') AS w FROM q), f AS (SELECT *, CASE WHEN len(w) > 0 THEN regexp_extract_all(text, array_to_string(list_transform(w, lambda x: regexp_escape(x)), '\s+')) ELSE [] END AS f FROM w)
SELECT doc_id, CASE WHEN instr(text, quote) > 0 AND instr(substr(text, instr(text, quote) + length(quote)), quote) = 0 THEN quote WHEN len(f) = 1 THEN f[1] ELSE quote END AS quote FROM f""",
    "fenced_json_strip": "SELECT doc_id, '{\"a\": ' || doc_id || '}' AS body FROM documents",
    "normalized_prompt_identity": r"SELECT doc_id, sha256(encode(lang) || '\x00'::blob || encode(doc_id::varchar) || '\x00'::blob || encode(sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))))) AS identity FROM documents",
    "lettered_choice_parse": f"WITH {OPTIONS} SELECT doc_id, CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND w <> '' THEN trim('first ' || w) || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'and more' ELSE '' END || '|' || w END AS choices FROM op",
    "numbered_choice_parse": f"WITH {OPTIONS} SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN trim(w || chr(10) || 'more', ' ' || chr(10)) || '|two' END AS choices FROM op",
    "prompt_template": "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 AND length(text) > 0 THEN 'Passage: ' || substr(text, 1, 50) || chr(10) ELSE '' END || 'Question: ' || lang || chr(10) || 'Answer:') AS prompt FROM documents",
    "script_classifier": "SELECT doc_id, ['Cyrillic', 'Han', 'Hiragana', NULL, NULL, 'Hangul', 'Hebrew', NULL, 'Thai', 'Katakana'][doc_id % 10 + 1] AS script FROM documents",
    "syntax_check": "SELECT doc_id, [true, false, true, true, false][doc_id % 5 + 1] AS parses, [333333, 500000, 0, 500000, 0][doc_id % 5 + 1]::bigint AS comment_ppm FROM documents",
    "json_string_leaves": "SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN 'nested string|a longer string ' || doc_id END AS leaves FROM documents",
    "canonical_json_ascii": """SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN '{"a":{"k":"nested string","n":5},"m":"\\u00e9' || doc_id || '","z":["short","a longer string ' || doc_id || '"]}' END AS json FROM documents""",
    "json_metadata_flag": "SELECT doc_id, [true, false, false, NULL, NULL, false][doc_id % 6 + 1] AS found FROM documents",
    "iso8601_tz": f"SELECT doc_id, CASE WHEN doc_id % 5 < 2 THEN epoch(({pick(TIMES)})::timestamptz)::bigint END AS seconds FROM documents",
    "multi_field_text_scan": "SELECT doc_id, lang AS text FROM documents WHERE doc_id % 3 = 0 AND length(lang) > 0 UNION ALL SELECT doc_id, source FROM documents WHERE doc_id % 4 <> 0 AND length(source) > 0",
    "toc_parse_markdown": "SELECT doc_id, x.line, x.depth, 'Part ' || doc_id || x.k AS title, 'ch0' || (doc_id % 9) || '-' || x.k || '.md' AS path FROM documents, (VALUES (2, 0, 'a'), (3, 1, 'b'), (5, 2, 'c')) x(line, depth, k)",
    "toc_parse_rst": "SELECT doc_id, x.place, x.k || (doc_id % 100) || '.rst' AS path FROM documents, (VALUES (0, 'a'), (1, 'b')) x(place, k)",
    "consecutive_headings": "SELECT doc_id, 0 AS line, 'Chapter ' || doc_id AS title FROM documents WHERE doc_id % 6 <> 0 UNION ALL SELECT doc_id, 9, 'The end' FROM documents",
    "lr_schedule": "SELECT range AS step, round(CASE WHEN range <= 100 THEN range / 100 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (range - 100) / 900)) END, 9) AS warm, round(0.5 * (1 + cos(pi() * (range - 1) / 999)), 9) AS cold FROM range(1, 1001)",
    "micro_batch_partition": "WITH u AS (SELECT range AS update, least(32, 1003 - (range - 1) * 32) AS n FROM range(1, 40)) SELECT update, CASE WHEN n > 0 THEN array_to_string(list_concat(list_transform(range(n // 12), lambda x: 12), CASE WHEN n % 12 > 0 THEN [n % 12] ELSE [] END), ',') END AS sizes FROM u",
    "parameter_ledger": f"WITH {MODELS} SELECT family, inner_size AS inner, vo * h AS embedding, m * l AS mixers, 3 * h * inner_size * l AS feed_forward, 2 * h * l + h AS norms, vo * h + m * l + 3 * h * inner_size * l + 2 * h * l + h AS total FROM fi",
    "scale_fit": f"WITH {MODELS} SELECT family, inner_size AS inner FROM fi",
    "iso_flop_lcm": "WITH f AS (SELECT * FROM (VALUES ('a', 1200), ('b', 1800), ('c', 1000)) v(family, flops)), b AS (SELECT list_reduce(list(flops::bigint), lambda x, y: lcm(x, y)) AS q, min(flops) * 1000 AS most FROM f) SELECT family, flops, (most // q * q)::bigint AS budget, (most // q * q // flops)::bigint AS sequences FROM f, b",
    "experiment_plan_grid": "SELECT f.family, r_name AS contrast, s.range AS seed FROM (VALUES ('a'), ('b'), ('c')) f(family), region, range(3) s",
}
