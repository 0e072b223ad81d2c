"""Empirical-Bayes host reputation over page outcomes, with URL rules before it.

Outcomes (page judged bad or not) are summed per host, registered domain and suffix.  A suffix's bad rate is
shrunk towards the overall rate, a domain's towards its suffix's and a host's towards its domain's, each as
the mean of a beta prior whose strength is fitted by the method of moments from the spread of that level's
rates.  A host is blocked where the lower bound of its posterior (mean minus `z` deviations) exceeds
`block_above`.  Only the blocked hosts meet the pages again.

Cases: null urls and urls without `://` have empty host and path and no outcome of their own kind; ties between
rules of equal length go to the first given; repeated rows count; empty tables give no rows; clashing columns
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import cut, drop_clashing

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels below which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.uk")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWERED)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2).isin(*TWO_LABEL_SUFFIXES)
    return F.when(two, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does.  rules: (verdict, host, path)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # tested from the last to the first: longest first, then in the order given
    for kind, h, p in reversed(sorted(rules, key=lambda r: -len(r[1]) - len(r[2]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _posterior(level: DataFrame, prior: str) -> DataFrame:
    """Add strength, alpha and beta of each row's beta posterior; prior: column of the prior mean."""
    rate = F.col("bad") / F.col("n")
    expected = F.col(prior) * (1 - F.col(prior))
    fit = level.agg(
        F.sum(F.col("n") * (rate - F.col(prior)) ** 2).alias("spread"), F.sum(expected).alias("noise"), F.sum(F.col("n") * expected).alias("scale")
    )
    fit = fit.first()  # one row
    # E[sum n (rate - m)^2] = sum m(1-m) (1 + (n - 1) / (strength + 1))
    excess = ((fit.spread or 0.0) - (fit.noise or 0.0)) / max((fit.scale or 0.0) - (fit.noise or 0.0), 1e-9)
    strength = min(1000.0, max(2.0, 1 / max(excess, 1e-6) - 1))
    return level.withColumn("alpha", strength * F.col(prior) + F.col("bad")).withColumn("beta", strength * (1 - F.col(prior)) + F.col("n") - F.col("bad"))


def reputation(outcomes: DataFrame, host_col: str = "host", bad_col: str = "bad", z: float = 1.645) -> DataFrame:
    """(host, domain, suffix, n, bad, alpha, beta, mean, lower) of every host with outcomes; bad_col is 0 or 1."""
    hosts = outcomes.filter(F.col(bad_col).isNotNull() & (F.col(host_col) != "")).groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n"), F.sum(bad_col).alias("bad"))
    hosts = cut(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    total = lambda df, key: df.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    first = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()  # one row
    overall = ((first.bad or 0) + 0.5) / ((first.n or 0) + 1.0)
    mean_of = (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("m")
    suffixes = _posterior(total(hosts, ["suffix"]).withColumn("m", F.lit(overall)), "m").select("suffix", mean_of)
    domains = _posterior(total(hosts, ["domain", "suffix"]).join(suffixes, "suffix"), "m").select("domain", "suffix", mean_of)
    made = _posterior(hosts.join(domains, ["domain", "suffix"]), "m")
    both = F.col("alpha") + F.col("beta")
    mean = F.col("alpha") / both
    return made.select("host", "domain", "suffix", "n", "bad", "alpha", "beta", mean.alias("mean"), F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (both + 1))).alias("lower"))


def judge(
    pages: DataFrame, bad: Column, rules: list[tuple[str, str, str]], url_col: str = "url", block_above: float = 0.5, z: float = 1.645
) -> DataFrame:
    """pages with host, path, rule and verdict.  bad: 1 or 0 where a page has an outcome, else null."""
    url = F.col(f"`{url_col}`").cast("string")
    outcomes = pages.select(host_of(url).alias("host"), bad.alias("bad"))
    blocked = reputation(outcomes, z=z).filter(F.col("lower") > block_above).select(F.col("host").alias("__host"))
    base = drop_clashing(pages, ["host", "path", "rule", "verdict"]).withColumns({"host": host_of(url), "path": path_of(url)})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = base.join(blocked, F.col("host") == F.col("__host"), "left")
    method = F.when(F.col("__host").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumns({"rule": rule, "verdict": F.coalesce(verdict, method)}).drop("__host")
