"""Row contracts: named rules that a row has to satisfy, and the names of those that it breaks.

A contract is a dict of rule name -> boolean Column. Nulls break a rule. Rejected rows are kept apart, never dropped
silently; ``required`` raises on the first broken row where a contract is fatal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rules = dict[str, Column]

# Domains, roles with their modes, kinds of verification, words that files of code are named by.
DOMAINS = ["english", "code", "math", "science", "technical"]
ROLE_MODES = {"skill_direct": "direct", "skill_deliberate": "deliberate", "behavior_replay": "replay", "rl_prompts": "rl_prompt"}
VERIFIERS = ["exact_answer", "execution", "unit_tests", "symbolic", "parent_behavior", "rule_verifier", "human_review"]
PROMPT_FIELDS = ["prompt", "question", "problem", "instruction", "text"]
HEX64, HEX40 = "^[0-9a-fA-F]{64}$", "^[0-9a-f]{40}$"
MEMBER = r"^([A-Za-z0-9+#-]+)/train-(\d{5})-of-(\d{5})\.parquet$"


def broken(rules: Rules) -> Column:
    """Sorted names of the rules that do not hold."""
    return F.array_sort(F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))))


def checked(df: DataFrame, rules: Rules) -> DataFrame:
    """``df`` with ``broken``, the names of the rules that each row breaks."""
    return df.withColumn("broken", broken(rules))


def split(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy all rules, the others with ``broken``)."""
    seen = checked(df, rules)
    return seen.filter(F.size("broken") == 0).drop("broken"), seen.filter(F.size("broken") > 0)


def required(df: DataFrame, rules: Rules) -> DataFrame:
    """``df``; evaluating a row that breaks a rule is an error."""
    seen = checked(df, rules)
    fatal = F.when(F.size("broken") > 0, F.raise_error(F.concat(F.lit("row differs: "), F.array_join("broken", ", ")))).otherwise(F.lit(True))
    return seen.filter(fatal).drop("broken")


def filled(column: str | Column) -> Column:
    """The text is there and not empty."""
    return F.length(F.col(column) if isinstance(column, str) else column) > 0


def raw_row() -> Rules:
    """A raw document: ``text`` and ``source`` (dataset, revision, source_file, row_index, license, domain)."""
    named = {f: filled(f"source.{f}") for f in ("dataset", "revision", "source_file", "license")}
    return {"text": filled("text"), **named, "row_index": F.col("source.row_index") >= 0, "domain": F.col("source.domain").isin(DOMAINS)}


def document() -> Rules:
    """A normalised document: ``text``, four source fields, ``verification`` (benchmark_disjoint, evidence_sha256), and the
    declared identity, if any, equal to the recomputed ``identity``."""
    named = {f: filled(f"source.{f}") for f in ("dataset", "revision", "license")}
    same = F.col("declared").isNull() | (F.col("declared") == F.col("identity"))
    proof = {"disjoint": F.col("verification.benchmark_disjoint"), "evidence": F.col("verification.evidence_sha256").rlike(HEX64)}
    return {"text": filled("text"), **named, "domain": F.col("source.domain").isin(DOMAINS), **proof, "identity": same}


def training_row() -> Rules:
    """A training row: ``role``, ``mode``, ``prompt``, ``response``, ``kind`` and ``passed`` of its verification."""
    mode = F.create_map(*(F.lit(x) for pair in ROLE_MODES.items() for x in pair))[F.col("role")]
    answer = F.when(F.col("role") == "rl_prompts", F.coalesce(F.col("response"), F.lit("")) == "").otherwise(filled(F.trim("response")))
    return {"mode": F.col("mode") == mode, "prompt": filled(F.trim("prompt")), "response": answer, "kind": F.col("kind").isin(VERIFIERS), "passed": F.col("passed")}


def score_at_least(score: Column, least: float) -> Column:
    """The score is a finite number of at least ``least``."""
    return score.isNotNull() & ~F.isnan(score.cast("double")) & (F.abs(score.cast("double")) < float("inf")) & (score >= least)


def code_row() -> Rules:
    """Code metadata: ``blob``, ``repo``, ``path``, ``licenses``, ``kind``."""
    return {
        "blob": F.col("blob").rlike(HEX40),
        "repo": F.col("repo").rlike("^[^/]+/[^/]+$"),
        "path": F.col("path").startswith("/"),
        "licenses": F.size(F.array_distinct("licenses")) == F.size("licenses"),
        "kind": F.col("kind").isin("permissive", "no_license"),
    }


def member(name: Column) -> Column:
    """struct<language, index, count> of a shard's name, null unless it is well-formed and the index below the count."""
    part = lambda i: F.regexp_extract(name, MEMBER, i)
    index, count = part(2).try_cast("int"), part(3).try_cast("int")
    return F.when(name.rlike(MEMBER) & (index < count), F.struct(part(1).alias("language"), index.alias("index"), count.alias("count")))


def audit_row() -> Rules:
    """A scored document: ``text``, ``score``, ``token_count``, ``char_count``, ``language``, ``language_score``."""
    share = F.col("language_score")
    return {
        "text": filled("text"), "score": F.col("score").isin(4, 5), "token_count": F.col("token_count") > 0, "char_count": F.col("char_count") == F.length("text"),
        "language": F.col("language") == "en", "language_score": score_at_least(share, 0) & (share <= 1),
    }


def choice_row() -> Rules:
    """A multiple-choice row: ``question``, ``choices`` (2 to 16, stripped, not empty) and ``answer``, an index of them."""
    stripped = F.forall("choices", lambda c: (c == F.trim(c)) & (c != ""))
    return {"question": filled(F.trim("question")), "choices": F.size("choices").between(2, 16) & stripped, "answer": (F.col("answer") >= 0) & (F.col("answer") < F.size("choices"))}


def review_row(known: Column) -> Rules:
    """A review: ``quality`` and ``confidence`` in parts per million, ``assumed`` and ``taught`` concepts, ``admit``."""
    in_order = lambda c: F.array_sort(F.array_distinct(c)) == F.col(c)
    listed = lambda c: F.size(F.array_except(c, known)) == 0
    return {
        "quality": F.col("quality").between(0, 1_000_000),
        "confidence": F.col("confidence").between(800_000, 1_000_000),
        "assumed": in_order("assumed") & listed("assumed"),
        "taught": in_order("taught") & listed("taught"),
        "apart": ~F.arrays_overlap("taught", "assumed") | (F.size("taught") == 0) | (F.size("assumed") == 0),
        "admitted": ~F.col("admit") | (F.size("taught") > 0),
    }


def spans(text: Column, found: Column, least: int = 16) -> Column:
    """Whether half-open spans (start, end, sha) ascend without overlap, lie in the text, have ``least`` characters and
    carry the digest of what they cut out."""
    inside = F.forall(found, lambda s: (s["start"] >= 0) & (s["end"] <= F.length(text)) & (s["end"] - s["start"] >= least))
    cut = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    hashed = F.forall(found, lambda s: F.sha2(cut(s).cast("binary"), 256) == s["sha"])
    ends = F.transform(found, lambda s: s["end"])
    ordered = F.forall(F.transform(found, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"))), lambda x: (x["i"] == 0) | (x["start"] >= F.get(ends, x["i"] - 1)))
    return (F.size(found) > 0) & inside & hashed & ordered


def oracle_row() -> Rules:
    """A scored evaluation row: ``score`` in 0 to 1, positive ``weight`` and ``flops``, ``diagnostics`` for slow runs alone."""
    slow = F.col("mode") == "forced_slow"
    return {"score": score_at_least(F.col("score"), 0) & (F.col("score") <= 1), "weight": F.col("weight") > 0, "flops": F.col("flops") > 0, "diagnostics": slow == F.col("diagnostics").isNotNull()}


def report_row(scores: list[str], digests: list[str]) -> Rules:
    """A benchmark report: finite ``scores`` in 0 to 100, ``digests`` of 64 hex digits, positive ``rows``."""
    good = {s: score_at_least(F.col(s), 0) & (F.col(s) <= 100) for s in scores}
    return {**good, **{d: F.col(d).rlike(HEX64) for d in digests}, "rows": F.col("rows") > 0}


def dense_index(df: DataFrame, index: str) -> DataFrame:
    """``df`` with ``dense``: whether ``index`` takes each of 0, 1, 2, ... exactly once over the whole table, which a
    count, the extremes and the repeats of a value show without a global order."""
    totals = df.agg(F.count("*").alias("__n"), F.min(index).alias("__low"), F.max(index).alias("__high"))
    repeats = F.count("*").over(Window.partitionBy(index))
    whole = (F.col("__low") == 0) & (F.col("__high") == F.col("__n") - 1)
    return df.withColumn("__times", repeats).crossJoin(F.broadcast(totals)).withColumn("dense", whole & (F.col("__times") == 1)).drop("__times", "__n", "__low", "__high")


def first_prompt(df: DataFrame) -> Column:
    """The first of the prompt fields that ``df`` has whose text is not blank, stripped."""
    return F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in PROMPT_FIELDS if c in df.columns))


def strata_match(df: DataFrame, keys: list[str], parts: Column, total: Column, rel: float = 1e-9, absolute: float = 1e-4) -> DataFrame:
    """For each of ``keys``, whether the sum of the strata equals the stated total within the tolerance."""
    sums = df.groupBy(*keys).agg(F.sum(parts).alias("summed"), F.max(total).alias("stated"))
    room = F.greatest(F.lit(absolute), rel * F.greatest(F.abs("summed"), F.abs("stated")))
    return sums.withColumn("matches", F.abs(F.col("summed") - F.col("stated")) <= room)
