"""URL filters: exact rules first, then empirical-Bayes host reputation (native: DataFrame functions only).

Reputation: the labelled outcomes of pages (bad or not) are counted per host; each host's rate is a beta-binomial
posterior whose prior is the posterior of its registered domain, whose prior is that of its suffix, whose prior is
the whole table's rate. The prior strength of each level is the method-of-moments estimate of the overdispersion of
the groups below it. A host is blocked where the lower posterior bound of its bad rate exceeds the threshold, so a
host with few or no outcomes follows its domain and suffix and needs strong evidence to be blocked.

User names and ports do not part domains; a numeric address is a domain of its own, under the suffix ''.

A null url, or one without "://", has empty host and path, fits no rule and shares one reputation entry. Repeated
pages count once per row; a page whose outcomes disagree counts as bad. Without any outcome all rates are the
prior's (below the threshold), so everything is allowed. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm import work

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level labels that form a suffix with a two-letter country code.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "or", "org"]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; rules are (verdict, host/path), few enough for one expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == F.lit(own)) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    labels = F.split(host, r"\.")
    n = F.size(labels)
    second = (n >= 3) & F.length(F.element_at(labels, -1)).eqNullSafe(2) & F.try_element_at(labels, F.lit(-2)).isin(SECOND_LEVEL)
    return F.when(second, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def _top(host: Column) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host."""
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    suffix = suffix_of(name)
    two, three = F.substring_index(name, ".", -2), F.substring_index(name, ".", -3)
    address = name.rlike(r"^[0-9]+(\.[0-9]+){3}$") | name.startswith("[")
    return F.when(address, "").otherwise(suffix), F.when(address, name).when(F.instr(suffix, ".") > 0, three).otherwise(two)


def _strength(groups: DataFrame, n: str, k: str, parent: str) -> float:
    """Prior strength of groups around their parents' rates: (1 - rho) / rho for the overdispersion rho."""
    p = F.least(F.greatest(F.col(parent), F.lit(1e-6)), F.lit(1 - 1e-6))
    got = groups.where(F.col(n) > 0).agg(
        F.sum(F.col(n) * F.pow(F.col(k) / F.col(n) - p, 2) / (p * (1 - p))).alias("q"),
        F.count("*").alias("g"),
        F.sum(F.col(n) - 1).alias("w"),
    ).first()
    if not got["w"]:
        return 10.0
    rho = min(max((got["q"] - got["g"]) / got["w"], 0.001), 0.5)
    return round((1 - rho) / rho, 6)


def reputation(pages: DataFrame, outcomes: DataFrame, page_key: str = "page_id", url: str = "url", z: float = 1.645, threshold: float = 0.5) -> DataFrame:
    """One row per host: outcome counts, posterior mean and lower bound of the bad rate, verdict.

    outcomes: (page_id, bad int 0/1). One row per host is written as a work table; rates of domains and suffixes
    come from it, so the pages are read once.
    """
    marks = outcomes.where(F.col("bad").isNotNull() & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    seen = pages.select(F.col(page_key).alias("page_id"), host_of(F.col(url)).alias("host")).join(marks, "page_id", "left")
    hosts = seen.groupBy("host").agg(F.count("bad").alias("n_h"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k_h"))
    suffix, domain = _top(F.col("host"))
    hosts = work.table(hosts.withColumn("suffix", suffix).withColumn("domain", domain), "hosts")
    total = hosts.agg(F.sum("n_h").alias("n"), F.sum("k_h").alias("k")).first()
    rate = ((total["k"] or 0) + 0.5) / ((total["n"] or 0) + 10.0)
    suffixes = hosts.groupBy("suffix").agg(F.sum("n_h").alias("n_s"), F.sum("k_h").alias("k_s")).withColumn("p0", F.lit(rate))
    s = _strength(suffixes, "n_s", "k_s", "p0")
    suffixes = suffixes.select("suffix", ((F.col("k_s") + F.lit(s * rate)) / (F.col("n_s") + F.lit(s))).alias("p_s"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n_h").alias("n_d"), F.sum("k_h").alias("k_d")).join(suffixes, "suffix")
    s = _strength(domains, "n_d", "k_d", "p_s")
    domains = domains.select("domain", ((F.col("k_d") + F.lit(s) * F.col("p_s")) / (F.col("n_d") + F.lit(s))).alias("p_d"))
    hosts = hosts.join(domains, "domain")
    s = _strength(hosts, "n_h", "k_h", "p_d")
    a, b = F.col("k_h") + F.lit(s) * F.col("p_d"), F.col("n_h") - F.col("k_h") + F.lit(s) * (1 - F.col("p_d"))
    mean = a / (a + b)
    scored = hosts.select("host", "n_h", "k_h", mean.alias("bad_rate"), (mean - F.lit(z) * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("bad_rate_low"))
    return scored.withColumn("host_verdict", F.when(F.col("bad_rate_low") > F.lit(threshold), F.lit("block")).otherwise(F.lit("allow")))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], page_key: str = "page_id", url: str = "url", **knobs) -> DataFrame:
    """Verdict of every page's url: that of the longest fitting rule, else that of its host's reputation."""
    hosts = reputation(pages, outcomes, page_key, url, **knobs).select("host", "host_verdict", "bad_rate", "bad_rate_low")
    split = pages.select(F.col(page_key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = split.withColumn("rule", rule).withColumn("__v", verdict).join(hosts, "host", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("__v", "host_verdict").alias("verdict"), "bad_rate", "bad_rate_low")
