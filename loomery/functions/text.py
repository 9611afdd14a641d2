"""Column functions over text: normal forms, tokens, shingles, character classes, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and phrases that results depend on.
WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
CODE = r"[A-Za-z_][\p{L}\p{N}_]*|\p{Nd}+(?:\.\p{Nd}+)?|==|!=|<=|>=|:=|->|\*\*|//|<<|>>|&&|\|\||\S"
SENTENCE = r"[.!?]+(?:\s+|$)"
URL = r"(?i)https?://|www\."
CODE_LINE = r"(?i)^\s*(?:def |class |function |import |from |#include|SELECT |INSERT |if\s*\(|for\s*\(|while\s*\(|[{}]|```)"
REASONING = r"(?i)\b(?:because|therefore|however|consequently|implies|assume|suppose|derive|proof|hypothesis|evidence|if and only if|for example|in contrast)\b"
TECHNICAL = r"(?i)\b(?:algorithm|function|variable|equation|theorem|molecule|protein|quantum|compiler|database|probability|derivative|integral|vector|matrix|network|protocol|experiment|coefficient|simulation|architecture)\b"
SEPARATOR = "\u001f"
#: White space that NFKC leaves; single characters, which a regular expression looks up in a table, not ranges.
BLANKS = r"[ \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u1680\u2028\u2029]+"


def nfkc_casefold(text: Column) -> Column:
    """NFKC, case folding, one space between words. No built-in function has the first two, but the ICU library that
    Spark's collations use has them as static methods, so texts stay in the JVM and are handled one at a time.

    A call is never moved below or copied into another operator, so it is made once for each time it is written.
    """
    icu = lambda kind, name, x: F.java_method(F.lit(f"com.ibm.icu.{kind}"), F.lit(name), x, F.lit(True))
    folded = icu("lang.UCharacter", "foldCase", icu("text.Normalizer", "compose", text))
    return F.btrim(F.regexp_replace(F.when(text.isNotNull(), folded), BLANKS, " "), F.lit(" "))


def matches(text: Column, pattern: str) -> Column:
    """How often ``pattern`` matches."""
    return F.regexp_count(text, F.lit(pattern))


def words(normal: Column) -> Column:
    """Word tokens of a normalised text."""
    return F.regexp_extract_all(normal, F.lit(WORD), F.lit(0))


def code_tokens(text: Column) -> Column:
    """Identifiers, numbers, operators and other signs of a text."""
    return F.regexp_extract_all(text, F.lit(CODE), F.lit(0))


def shingles(tokens: Column, width: int, short: bool = False) -> Column:
    """Distinct windows of ``width`` tokens; a shorter list has none, or with ``short`` one of all its tokens."""
    n = F.size(tokens)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, width), SEPARATOR))
    whole = F.when(n > 0, F.array(F.array_join(tokens, SEPARATOR))).otherwise(F.array().cast("array<string>")) if short else F.array().cast("array<string>")
    return F.array_distinct(F.when(n >= width, windows).otherwise(whole))


def exploded(df: DataFrame, keep: list[str], values: Column, name: str) -> DataFrame:
    """A row of ``keep`` and ``name`` for each of the ``values``, none of them null. F.explode would have the array made
    twice more, for filters on its size and on nulls that the optimizer puts below it."""
    return df.select(*keep, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())


def characters(text: Column, pattern: str) -> Column:
    """How many characters match a one-character pattern; runs of them are taken out at once."""
    return F.length(text) - F.length(F.regexp_replace(text, f"(?:{pattern})++", ""))


def share(text: Column, pattern: str) -> Column:
    """Share of the text's characters that match a one-character pattern."""
    return F.when(F.length(text) > 0, characters(text, pattern) / F.length(text)).otherwise(0.0)


def lines(text: Column) -> Column:
    """Lines that are not blank, without white space around."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")


def repeated_line_fraction(text: Column) -> Column:
    """Share of non-blank lines that repeat an earlier one."""
    n = F.size(lines(text))
    return F.when(n > 0, (n - F.size(F.array_distinct(lines(text)))) / n).otherwise(0.0)


def longest_run(text: Column) -> Column:
    """Length of the longest run of one character other than a newline, 1 at least."""
    runs = F.regexp_extract_all(text, F.lit(r"((.)\2+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(1))


def syllables(word: Column) -> Column:
    """Vowel groups of a word, less a silent e, 1 at least."""
    groups = F.greatest(F.lit(1), matches(word, "[aeiouy]+"))
    return groups - F.when((F.length(word) > 3) & word.endswith("e") & (groups > 1), 1).otherwise(0)


def syllables_of(line: Column) -> Column:
    """Syllables of all words of ``line``, words with single spaces between: what ``syllables`` gives, word by word, in
    three passes over the line."""
    silent = matches(line, r"(?<![^ ])(?=[^ ]{4})[^ ]*[aeiouy][^ aeiouy][^ ]*e(?![^ ])")
    return matches(line, "[aeiouy]+") + matches(line, r"(?<![^ ])[^ aeiouy]++(?![^ ])") - silent


def clamped(value: Column, low: float, high: float) -> Column:
    """``value`` between ``low`` and ``high`` as 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def host(url: Column, strip_www: bool = True) -> Column:
    """Lower-case host of a url, empty if it has none."""
    found = F.lower(F.coalesce(F.expr("null").cast("string") if url is None else F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return F.regexp_replace(found, "^www\\.", "") if strip_www else found
