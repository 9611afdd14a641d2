"""Document quality, difficulty, audit signals and safety scans as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions import text as T

# Phrases, thresholds, weights and patterns of the rules.
BOILERPLATE = ["cookie policy", "privacy policy", "terms of use", "all rights reserved", "subscribe to our newsletter", "accept cookies"]
RISKS = {
    "answer_key_or_homework_site": r"(?i)answer key|homework answer|chegg|course hero",
    "casino_or_betting": r"(?i)casino|sportsbook|betting|poker",
    "essay_service": r"(?i)write (?:my |a )?paper|essay (?:writer|writing|service)|masterpapers",
    "seo_or_marketing": r"(?i)click here|buy now|free shipping|contact us today",
}
MATH = [
    r"\\(?:frac|sum|int|sqrt|begin|end|mathbf|mathbb)\b",
    r"[$][^$\n]{1,200}[$]",
    r"(?i)\b(?:theorem|lemma|corollary|proof|equation|inequality)\b",
    r"(?:^|\s)[A-Za-z0-9)]\s*[=<>±×÷]\s*[A-Za-z0-9(]",
]
EXPLANATION = [
    r"(?i)\b(?:because|therefore|hence|thus|so that)\b",
    r"(?i)\b(?:let|suppose|assume|given|define)\b",
    r"(?i)\b(?:example|solution|derivation|step|explanation)\b",
    r"(?i)\b(?:we can|we have|it follows|this means)\b",
]
DENIED_HOSTS = ["chegg.com", "coursehero.com", "gradesaver.com", "jiskha.com", "masterpapers.com"]
SECRETS = {
    "aws_access_key_id": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "basic_auth_url": r"https?://[^/\s:@]{1,64}:[^/\s@]{4,128}@",
    "github_token": r"\b(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255})\b",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}\b",
    "private_key_pem": r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "slack_token": r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b",
    "stripe_live_secret": r"\bsk_live_[0-9A-Za-z]{16,}\b",
}
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9.-])"
IGNORED_DOMAINS = ["example.com", "example.net", "example.org", "localhost", "users.noreply.github.com"]
JWT = r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"
LONG_TOKEN = r"(?<![A-Za-z0-9])[A-Za-z0-9_+/=-]{32,}(?![A-Za-z0-9])"
CREDENTIAL = r"(?i)\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|password|passwd|secret[_-]?key)\b\s*(?::|=)\s*[rubf]*(['\"])([^'\"\r\n]{12,})\1"
PLACEHOLDER = r"(?i)(?:example|sample|dummy|fake|placeholder|changeme|replace[_ -]?me|your[_ -]|<[^>]+>|\$\{|xxxxx|000000)"
GENERATED = ["@generated", "auto-generated file", "automatically generated", "code generated by", "do not edit this file"]
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def web_quality(text: Column) -> dict[str, Column]:
    """The signals of the web rule and whether it accepts."""
    low = F.lower(text)
    out = {
        "characters": F.length(text),
        "repeated_lines": T.repeated_line_fraction(text),
        "boilerplate": sum((low.contains(x).cast("int") for x in BOILERPLATE), F.lit(0)),
        "alphabetic": T.share(text, r"\p{L}"),
        "control": T.share(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"),
        "replacement": T.share(text, "\ufffd"),
    }
    accepted = F.col("characters").between(400, 100_000) & (F.col("repeated_lines") <= 0.30) & (F.col("boilerplate") <= 1) & (F.col("alphabetic") >= 0.55) & (F.col("control") <= 0.001) & (F.col("replacement") <= 0.0005)
    return out | {"accepted": accepted}


def with_web_quality(df: DataFrame) -> DataFrame:
    """``df`` with the web rule's columns."""
    *signals, accepted = web_quality(F.col("text")).items()
    return df.withColumns(dict(signals)).withColumn(*accepted)


def with_signals(df: DataFrame) -> DataFrame:
    """``df`` with document signals, quality reasons, difficulty and band."""
    text = F.col("text")
    filled = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    # What reads the text stands beside the normal form, below which no filter is moved: so each is found once.
    read = df.withColumns({
        "__read": F.transform(F.array(T.words(T.nfkc_casefold(text))), lambda w: F.struct(w.alias("words"), F.array_join(w, " ").alias("line"), F.size(F.array_distinct(w)).alias("unique")))[0], "sentences": F.greatest(F.lit(1), T.matches(text, T.SENTENCE)),
        "symbol_fraction": T.share(text, r"[^\p{L}\p{N}\s]"), "digit_fraction": T.share(text, r"\p{Nd}"),
        "code_line_fraction": F.transform(F.array(filled), lambda every: F.when(F.size(every) > 0, F.size(F.filter(every, lambda x: x.rlike(T.CODE_LINE))) / F.size(every)).otherwise(0.0))[0],
        "__reasoning": T.matches(text, T.REASONING), "__technical": T.matches(text, T.TECHNICAL), "__urls": T.matches(text, T.URL),
        "letters": T.characters(text, r"\p{L}"), "__latin": T.characters(text, r"[\p{L}&&\p{IsLatin}]"), "longest_run": T.longest_run(text),
    })
    low = read.withColumns({"__n": F.size("__read.words"), "__line": F.col("__read.line")})
    n = F.col("__n")
    some = F.greatest(n, F.lit(1))
    line = F.col("__line")
    length_sum = F.length(line) - F.greatest(n - 1, F.lit(0))
    base = low.withColumns({
        "words": n, "unique_words": F.col("__read.unique"),
        "average_word_characters": F.when(n > 0, length_sum / n).otherwise(0.0),
        "long_word_fraction": F.when(n > 0, T.matches(line, r"(?<![^ ])[^ ]{9,}+") / n).otherwise(0.0),
        "reasoning_density": F.col("__reasoning") / some, "technical_density": F.col("__technical") / some,
        "syllables": T.syllables_of(line), "latin_fraction": F.when(F.col("letters") > 0, F.col("__latin") / F.col("letters")).otherwise(0.0),
        "url_density": F.col("__urls") / some,
    })
    c = F.col
    some_words = F.greatest(c("words"), F.lit(1))
    derived = base.withColumns({
        "average_sentence_words": c("words") / c("sentences"), "lexical_diversity": c("unique_words") / F.sqrt(some_words), "unique_word_fraction": c("unique_words") / some_words,
    })
    reasons = F.array_compact(F.array(
        F.when(c("words") < 80, F.lit("too_few_words")),
        F.when((c("letters") >= 100) & (c("latin_fraction") < 0.80), F.lit("latin_coverage_low")),
        F.when(c("unique_word_fraction") < 0.10, F.lit("lexical_repetition_high")),
        F.when(c("longest_run") > 40, F.lit("character_run_high")),
        F.when(c("url_density") > 0.02, F.lit("url_density_high")),
    ))
    difficulty = (
        0.21 * T.clamped(c("average_sentence_words"), 8.0, 32.0) + 0.15 * T.clamped(c("average_word_characters"), 4.0, 7.0) + 0.13 * T.clamped(c("long_word_fraction"), 0.04, 0.28)
        + 0.08 * T.clamped(c("lexical_diversity"), 4.0, 16.0) + 0.08 * T.clamped(c("symbol_fraction"), 0.015, 0.16) + 0.07 * T.clamped(c("digit_fraction"), 0.005, 0.12)
        + 0.09 * T.clamped(c("code_line_fraction"), 0.0, 0.35) + 0.08 * T.clamped(c("reasoning_density"), 0.0, 0.025) + 0.07 * T.clamped(c("technical_density"), 0.0, 0.035)
        + 0.04 * T.clamped(F.log10(F.greatest(F.length(text), F.lit(400))), 2.6, 5.0)
    )
    done = derived.withColumns({"quality_reasons": reasons, "difficulty": F.least(F.lit(1.0), F.greatest(F.lit(0.0), difficulty)), "reading_ease": 206.835 - 1.015 * c("average_sentence_words") - 84.6 * c("syllables") / some_words})
    return done.withColumn("band", band(c("difficulty"))).drop("__read", "__n", "__line", "__reasoning", "__technical", "__urls", "__latin")


def band(difficulty: Column) -> Column:
    """Difficulty band."""
    return F.when(difficulty < 0.13, "foundation").when(difficulty < 0.22, "composition").when(difficulty < 0.42, "reasoning").otherwise("specialization")


def classes(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur."""
    return sum((text.rlike(p).cast("int") for p in patterns), F.lit(0))


def risk_reasons(text: Column) -> Column:
    """Names of the risk patterns that occur, sorted."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in sorted(RISKS.items()))))


def host_denied(host: Column) -> Column:
    """Whether a host is a denied one or below it."""
    return F.exists(F.array(*map(F.lit, DENIED_HOSTS)), lambda s: (host == s) | F.endswith(host, F.concat(F.lit("."), s)))


def entropy_milli(token: Column) -> Column:
    """Shannon entropy of a token's characters in thousandths of a bit, rounded half to even."""
    letters = F.split(token, "")
    n = F.length(token)
    parts = F.transform(F.array_distinct(letters), lambda x: F.size(F.filter(letters, lambda y: y == x)) / n)
    return F.bround(-F.aggregate(parts, F.lit(0.0), lambda a, p: a + p * F.log2(p)) * 1000).cast("int")


def safety(text: Column) -> dict[str, Column]:
    """Reject and review reasons, decision and signals of the content scan (the syntax check is apart)."""
    found = {name: T.matches(text, p) for name, p in sorted(SECRETS.items())}
    credentials = F.size(F.filter(F.regexp_extract_all(text, F.lit(CREDENTIAL), F.lit(2)), lambda x: ~x.rlike(PLACEHOLDER)))
    emails = F.size(F.filter(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda x: ~F.lower(F.regexp_extract(x, "@([^@]*)$", 1)).isin(IGNORED_DOMAINS)))
    tokens = F.size(F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(LONG_TOKEN), F.lit(0))), lambda x: ~x.rlike(PLACEHOLDER) & (entropy_milli(x) >= 4000)))
    every = F.split(text, "\n")
    filled = T.lines(text)
    n = F.size(filled)
    repeated = F.when(n > 0, F.floor((n - F.size(F.array_distinct(filled))) * 1000000 / n)).otherwise(0)
    longest = F.coalesce(F.array_max(F.transform(every, F.length)), F.lit(0))
    generated = sum((F.lower(text).contains(x).cast("int") for x in GENERATED), F.lit(0))
    reject = F.array_compact(F.array(*(F.when(c > 0, F.lit(f"secret:{name}")) for name, c in found.items()), F.when(credentials > 0, F.lit("credential")), F.when(T.matches(text, CONTROL) > 0, F.lit("control"))))
    review = F.array_compact(F.array(F.when(emails > 0, F.lit("email")), F.when(T.matches(text, JWT) > 0, F.lit("jwt")), F.when(tokens > 0, F.lit("entropy")), F.when(longest > 2000, F.lit("long_line")), F.when(repeated > 500000, F.lit("repeated_lines")), F.when(generated > 0, F.lit("generated"))))
    return {"reject": reject, "review": review, "emails": emails, "tokens": tokens, "repeated_ppm": repeated.cast("long"), "longest_line": longest}


def decision(reject: Column, review: Column) -> Column:
    """Reject before review before clean."""
    return F.when(F.size(reject) > 0, "rejected").when(F.size(review) > 0, "review").otherwise("clean")
