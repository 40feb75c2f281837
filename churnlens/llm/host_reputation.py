"""Operator 6, URL filter by rules and empirical-Bayes host reputation (DataFrame functions only).

Labelled page outcomes (good or not) are counted per host. Each level of the tree suffix ->
registered domain -> host shrinks its good rate towards its parent's through a beta prior whose
strength is fitted to the level's overdispersion (method of moments of the beta-binomial), so a
host with few outcomes follows its domain and one with many follows itself. A page is blocked when
the upper posterior bound of its host's good rate stays below ``MIN_GOOD``. Host rules, where one
fits, come first: the longest decides.

Counts are partial aggregates, so one host may hold most rows; only three fitted strengths and the
overall rate reach the driver.

Defined edge cases: null urls and those without ``://`` have empty host and path, and belong to the
empty host; without any outcome all rates are 1; repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.graph import stored

#: (verdict, host and path) of the standing rules
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: public suffixes of two labels; any other suffix is the last label (fixed values)
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "co.in", "co.kr", "co.za")
MIN_GOOD, Z = 0.5, 1.645
LEAST_SHARE, MOST_SHARE = 0.001, 0.5  # bounds of the fitted overdispersion
BROADCAST_HOSTS = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[0] == "block")):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        text, verdict = F.when(fits, F.lit(r)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    long = two.isin(*TWO_LABEL_SUFFIXES)
    return F.when(long, F.substring_index(bare, ".", -3)).otherwise(two), F.when(long, two).otherwise(F.substring_index(bare, ".", -1))


def _strength(rows: DataFrame, parent: str) -> float:
    """Pseudo-count of the parent's rate, from how much more the groups vary than binomial counts."""
    m, n, good = F.col(parent), F.col("n"), F.col("good")
    got = rows.agg(F.sum((good - n * m) * (good - n * m) - n * m * (1 - m)).alias("over"), F.sum(n * (n - 1) * m * (1 - m)).alias("base")).first()
    share = (got["over"] / got["base"]) if got["base"] else 0.0
    share = min(max(share, LEAST_SHARE), MOST_SHARE)
    return 1 / share - 1


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, rate, upper) of every host of ``pages`` (page_id, host); ``outcomes``: page_id, good (0 or 1)."""
    known = outcomes.where("page_id is not null and good is not null").groupBy("page_id").agg(F.max("good").alias("good"))
    counts = pages.join(known, "page_id", "left").groupBy("host").agg(
        F.count("good").cast("double").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("good"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = stored(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "good"), "hosts")
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    overall = (total[1] or 0.0) / total[0] if total[0] else 1.0

    def level(rows: DataFrame, name: str, parent: str) -> DataFrame:
        k = _strength(rows, parent)
        shrunk = (F.col("good") + F.lit(k) * F.col(parent)) / (F.col("n") + F.lit(k))
        return rows.withColumn(name, shrunk).withColumn("weight", F.col("n") + F.lit(k))

    def sums(*keys: str) -> DataFrame:
        return hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))

    suffixes = level(sums("suffix").withColumn("all", F.lit(overall)), "suffix_rate", "all").select("suffix", "suffix_rate")
    domains = level(sums("domain", "suffix").join(suffixes, "suffix"), "domain_rate", "suffix_rate").select("domain", "domain_rate")
    rated = level(hosts.join(domains, "domain"), "rate", "domain_rate")
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    return rated.select("host", "rate", (F.col("rate") + Z * spread).alias("upper"))


def url_verdicts(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    host, path = host_and_path(F.col("url").cast("string"))
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    rated = stored(reputation(p, outcomes), "reputation")
    known = rated.where(F.col("upper") < MIN_GOOD).select("host", F.lit("block").alias("by_host"))
    judged = p.join(F.broadcast(known) if known.count() <= BROADCAST_HOSTS else known, "host", "left")
    rule, verdict = longest_rule(F.col("host"), F.col("path"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("by_host"), F.lit("allow")).alias("verdict"))
