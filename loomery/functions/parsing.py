"""Column functions that read structure out of text: quotes, choices, tables of contents, JSON, scripts, syntax."""

from __future__ import annotations

import ast
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

# Scripts that a tokenizer need not cover, letters of choices, fields that hold text.
SCRIPTS = ["Han", "Hiragana", "Katakana", "Hangul", "Cyrillic", "Arabic", "Hebrew", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Thai", "Lao", "Myanmar", "Georgian", "Armenian"]
LETTERS = "ABCDEFGHIJ"
TEXT_FIELDS = ["prompt", "instruction", "response", "solution", "completion", "output", "answer", "text"]
LEAST_LEAF = 8


def unique_quote(text: Column, quote: Column, least: int = 16) -> Column:
    """struct<start, end, sha> of a quote of ``least`` characters that occurs exactly once, else null; occurrences may
    overlap."""
    at = F.instr(text, quote)
    rest = F.substring(text, at + 1, F.length(text))
    once = (F.length(quote) >= least) & (at > 0) & (F.instr(rest, quote) == 0)
    return F.when(once, F.struct((at - 1).alias("start"), (at - 1 + F.length(quote)).alias("end"), F.sha2(quote.cast("binary"), 256).alias("sha")))


def tolerant_quote(text: Column, quote: Column) -> Column:
    """The passage of ``text`` that is ``quote`` but for white space, if there is exactly one; else the quote itself."""
    once = F.instr(F.substring(text, F.instr(text, quote) + F.length(quote), F.length(text)), quote) == 0
    words = F.filter(F.split(quote, r"\s+"), lambda w: w != "")
    pattern = F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), r"\s+")
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.when((F.instr(text, quote) > 0) & once, quote).when((F.size(words) > 0) & (F.size(found) == 1), F.get(found, F.lit(0))).otherwise(quote)


def unfenced(response: Column) -> Column:
    """A response without the code fence around it."""
    text = F.btrim(response, F.lit(" \t\r\n"))
    inside = F.regexp_extract(text, r"(?s)^```(?:json)?(.*)```$", 1)
    return F.when(text.rlike(r"(?s)^```.*```$") & (F.length(text) >= 6), F.btrim(inside, F.lit(" \t\r\n"))).otherwise(text)


def one_spaced(text: Column) -> Column:
    """The words of a text with single spaces."""
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def prompt_identity(benchmark: Column, row: Column, prompt: Column) -> Column:
    """Digest of benchmark, row and the digest of the prompt's words, zero bytes between them."""
    digest = F.sha2(one_spaced(prompt).cast("binary"), 256)
    zero = F.unhex(F.lit("00"))
    return F.sha2(F.concat(benchmark.cast("binary"), zero, row.cast("string").cast("binary"), zero, digest.cast("binary")), 256)


def _choices(text: Column, marker: str, label) -> Column:
    """Choices that begin with ``marker`` in the order of ``label``, with the lines that continue them; null if the order
    differs, text stands before the first, or one is empty."""
    start = F.struct(F.lit(True).alias("sound"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, line: Column) -> Column:
        found = state["found"]
        begins = line.rlike(marker)
        expected = F.regexp_extract(line, marker, 1) == label(F.size(found))
        last = F.concat(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.get(found, F.size(found) - 1), F.lit("")), F.lit("\n"), line)))
        grown = F.when(begins, F.concat(found, F.array(F.regexp_extract(line, marker, 2)))).otherwise(last)
        sound = state["sound"] & F.when(begins, expected).otherwise(F.size(found) > 0)
        return F.struct(sound.alias("sound"), grown.alias("found"))

    end = F.aggregate(F.split(text, "\n"), start, step)
    stripped = F.transform(end["found"], lambda c: F.btrim(c, F.lit(" \t\r\n")))
    return F.when(end["sound"] & (F.size(end["found"]) >= 2) & F.forall(stripped, lambda c: c != ""), stripped)


def lettered_choices(text: Column) -> Column:
    """Choices "A. ..." to "J. ..."."""
    return _choices(text, rf"^([{LETTERS}])\. (.*)$", lambda n: F.substring(F.lit(LETTERS), n + 1, F.lit(1)))


def numbered_choices(text: Column) -> Column:
    """Choices "1 - ...", "2 - ..."."""
    return _choices(text, r"^([1-9][0-9]*) - (.*)$", lambda n: (n + 1).cast("string"))


def question_prompt(passage: Column, question: Column) -> Column:
    """The prompt of a question, with its passage if there is one."""
    head = F.when(F.length(passage) > 0, F.concat(F.lit("Passage: "), passage, F.lit("\n"))).otherwise("")
    return F.concat(head, F.lit("Question: "), question, F.lit("\nAnswer:"))


def script_of(text: Column) -> Column:
    """The one script of SCRIPTS that all letters of a text are of, null if there are none or others."""
    letters = F.regexp_replace(text, r"\P{L}+", "")
    whole = lambda s: F.when((F.length(letters) > 0) & ~letters.rlike(rf"[^\p{{Is{s}}}]"), F.lit(s))
    return F.coalesce(*(whole(s) for s in SCRIPTS))


def comment_line_ppm(text: Column) -> Column:
    """Lines that begin with a hash sign, in parts per million of all, rounded down."""
    lines = F.split(text, "\n")
    return F.floor(F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("#"))) * 1000000 / F.size(lines)).cast("long")


def _parses(code: str | None) -> bool | None:
    if code is None:
        return None
    try:
        ast.parse(code)
    except (SyntaxError, ValueError, TypeError, MemoryError, RecursionError):
        return False
    return True


@F.arrow_udf(BooleanType())
def python_parses(values: pa.Array) -> pa.Array:
    """Whether a text is a Python program; only Python's own parser can tell."""
    return pa.array([_parses(v.as_py()) for v in values], pa.bool_())


def _leaves(value: object) -> list[str]:
    if isinstance(value, str):
        return [value] if len(value.strip()) >= LEAST_LEAF else []
    if isinstance(value, list):
        return [x for item in value for x in _leaves(item)]
    return [x for key in sorted(value) for x in _leaves(value[key])] if isinstance(value, dict) else []


@F.arrow_udf(ArrayType(StringType()))
def json_leaves(values: pa.Array) -> pa.Array:
    """All strings of a JSON value of at least LEAST_LEAF characters, by sorted keys; null if it is no JSON. Recursion of
    any depth is what built-in functions do not have."""
    out: list = []
    for value in values:
        try:
            out.append(_leaves(json.loads(value.as_py() or "")))
        except (ValueError, RecursionError):
            out.append(None)
    return pa.array(out, pa.list_(pa.string()))


@F.arrow_udf(StringType())
def canonical_ascii(values: pa.Array) -> pa.Array:
    """JSON again with sorted keys, no spaces, and escapes for all but ASCII; null if it is no JSON."""
    out: list = []
    for value in values:
        try:
            out.append(json.dumps(json.loads(value.as_py() or ""), sort_keys=True, separators=(",", ":")))
        except (ValueError, RecursionError):
            out.append(None)
    return pa.array(out, pa.string())


def found_math(metadata: Column) -> Column:
    """Whether a JSON object says that mathematics was found; null if it is no object."""
    value = F.try_parse_json(metadata)
    is_object = metadata.rlike(r"(?s)^\s*\{.*\}\s*$") & value.isNotNull()
    return F.when(is_object, F.coalesce(F.from_json(metadata, "found_math boolean")["found_math"], F.lit(False)))


def utc_time(text: Column) -> Column:
    """The time that an ISO 8601 text with a time zone names, else null."""
    whole = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    return F.when(whole, F.try_to_timestamp(text))


def text_fields(df: DataFrame, key: str) -> DataFrame:
    """(key, text): every string that is not empty in the fields TEXT_FIELDS that ``df`` has, in their order."""
    values = F.array(*(F.col(c) for c in TEXT_FIELDS if c in df.columns))
    return df.select(key, F.explode(F.filter(values, lambda x: F.length(x) > 0)).alias("text"))


def markdown_contents(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, depth, title, path) of the links "- [title](path.md)" of a summary; two spaces are one level."""
    link = r"^(\s*)(?:[-*]\s+)?\[([^\]]+)\]\(([^)]+\.md)\)\s*$"
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "value")).filter(F.col("value").rlike(link))
    part = lambda i: F.regexp_extract("value", link, i)
    return lines.select(key, "line", F.floor(F.length(part(1)) / 2).cast("int").alias("depth"), part(2).alias("title"), part(3).alias("path"))


def toctree(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, place, path) of the indented entries after the one toctree directive of a text, up to the next line that is
    neither blank nor indented."""
    body = F.regexp_extract(text, r"(?s)\.\. toctree::[^\n]*\n(.*)$", 1)
    inside = F.regexp_extract(body, r"^((?:[ \t]+[^\n]*\n?|[ \t]*\n)*)", 1)
    entries = F.filter(F.transform(F.split(inside, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[A-Za-z0-9_-]+\.rst$"))
    return df.select(key, F.posexplode(entries).alias("place", "path"))


def headings(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, title): lines whose next line underlines them with one sign, at least as long."""
    lines = F.split(text, "\n")
    marked = F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("title"), F.get(lines, i + 1).alias("under")))
    rows = df.select(key, F.explode(marked).alias("x")).select(key, "x.*")
    return rows.filter((F.trim("title") != "") & F.col("under").rlike(r"^(=+|-+|\*+|~+)$") & (F.length("under") >= F.length("title"))).select(key, "line", "title")
