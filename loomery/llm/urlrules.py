"""URL filters with redirect equivalence.

Rules on host and path judge a url; pages that redirect or name a canonical link are aliases of their targets, and a
block spreads over a component of aliases unless one of them is explicitly allowed. DataFrame functions only.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and the verdict allow; repeated
rows are judged alike. A page that no rule fits takes its component's verdict: allow if an alias is explicitly allowed,
else block if an alias is blocked, else allow. A page's own rule always stands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import cut
from loomery.llm.components import components

#: Rows up to which judged aliases are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule (verdict, host, path) that fits, nulls if none does."""
    ranked = sorted(rules, key=lambda x: (-len(x[1] + x[2]), x[1] + x[2]))
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, name, start in reversed(ranked):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """What urls of one resource share: host, path and query; null without a host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v): urls of pages and what their canonical link or refresh redirect names."""
    some = pages.filter(F.col("html").rlike("(?i)canonical|refresh")).select("url", "html")
    canonical = F.regexp_extract("html", r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    refresh = F.regexp_extract("html", r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    targets = F.array(
        F.regexp_extract(canonical, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1),
        F.regexp_extract(refresh, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1),
    )
    found = some.select("url", F.explode(targets).alias("target")).filter("target <> ''")
    origin = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract("url", r"(?s)^(.*?:)//", 1)
    whole = (
        F.when(F.col("target").contains("://"), F.col("target"))
        .when(F.col("target").startswith("//"), F.concat(scheme, "target"))
        .when(F.col("target").startswith("/"), F.concat(origin, "target"))
        .otherwise(F.concat(origin, F.regexp_extract(path_of(F.col("url")), r"(?s)^(.*/)", 1), "target"))
    )
    return found.select(F.col("url").alias("u"), whole.alias("v"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; ``redirects`` (u, v) are further alias edges of urls."""
    url = F.col("url")
    judged = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("u", "v"))
    nodes = cut(edges.select(node_of(F.col("u")).alias("u"), node_of(F.col("v")).alias("v")).filter("u <> v").distinct())
    none = F.lit(None).cast("string")
    if nodes.isEmpty():
        spread = judged.withColumn("spread", none)
    else:
        member = components(nodes)
        full = F.concat(F.lit("any://"), "node")
        marked = member.withColumn("own", rule_of(host_of(full), path_of(full), rules)["verdict"])
        verdicts = marked.groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked")).filter("blocked and not allowed")
        blocked = cut(member.join(verdicts, "component").select("node", F.lit("block").alias("spread")))
        small = blocked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        spread = judged.withColumn("node", node_of(url)).join(F.broadcast(blocked) if small else blocked, "node", "left")
    return spread.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "spread", F.lit("allow")).alias("verdict"))
