"""URL filter: fixed rules, then an empirical-Bayes reputation of hosts.

Labelled pages vote on their host. A host's rate of bad outcomes is shrunk through beta-binomial priors in levels: all
pages to a suffix, a suffix to a registered domain, a domain to a host. A level's prior has the posterior mean of the
level above; its strength is fitted to how far the children's rates scatter beyond sampling. A host is blocked if
the lower posterior bound of its rate is above the limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
LIMIT, TAIL = 0.5, 0.05


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    after = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(after, "(?s)^[^/?#]*", 0)
    path = F.regexp_extract(after, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and a beginning of the path, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # later, longer ones override
        name, start = text.split("/", 1)
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Public suffix (one label, or two of the list) and registered domain (one label more) of a host without port."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    labels = F.split(name, "\\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.lit(1), n - k + 1), F.least(F.lit(k), n)), ".")
    two = last(2).isin(*TWO_LABEL_SUFFIXES)
    return F.when(two, last(2)).otherwise(last(1)), F.when(two, last(3)).otherwise(last(2))


def beta_quantile(a: np.ndarray, b: np.ndarray, q: float) -> np.ndarray:
    """Quantile of Beta(a, b) by bisection on its distribution function (continued fraction, Lentz)."""
    from math import lgamma

    log_b = np.array([lgamma(x) + lgamma(y) - lgamma(x + y) for x, y in zip(a, b)])

    def below(x: np.ndarray) -> np.ndarray:
        flip = x > (a + 1) / (a + b + 2)
        p, r, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
        tiny = 1e-300
        c, d = np.ones_like(z), 1 / np.where(abs(v := 1 - (p + r) * z / (p + 1)) < tiny, tiny, v)
        h = d.copy()
        for m in range(1, 200):
            for num in (m * (r - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + r + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(abs(c) < tiny, tiny, c)
                h = h * d * c
        with np.errstate(divide="ignore"):
            f = np.exp(p * np.log(np.maximum(z, tiny)) + r * np.log(np.maximum(1 - z, tiny)) - log_b) * h / p
        return np.where(flip, 1 - f, f)

    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(50):
        mid = (low + high) / 2
        under = below(mid) < q
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def _lower_bound(a: Column, b: Column, tail: float):
    @F.arrow_udf("double")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(beta_quantile(x.to_numpy(zero_copy_only=False).astype(float), y.to_numpy(zero_copy_only=False).astype(float), tail) if len(x) else np.empty(0))

    return of(a, b)


def _strength(children: DataFrame, mean: str) -> float:
    """Strength of a beta prior whose means stand in column mean, by moments over children (n, bad); sums of one row only."""
    m = F.col(mean)
    v = F.sum(m * (1 - m))
    s = children.agg(F.sum(F.col("n") * (F.col("bad") / F.col("n") - m) ** 2), v, F.sum(F.col("n") * m * (1 - m)), F.count("*")).first()
    scatter, sampling, weight, groups = (float(x or 0.0) for x in s)
    if groups < 2 or weight - sampling <= 0:
        return 10.0
    rho = (scatter - sampling) / (weight - sampling)  # E = (1 - rho) * sampling + rho * weight
    return 1 / min(max(rho, 1e-3), 0.5) - 1


def reputation(pages: DataFrame, outcomes: DataFrame, limit: float = LIMIT, tail: float = TAIL) -> DataFrame:
    """host, n, bad, rate, bound, blocked for each host with labelled pages. pages: page_id, host; outcomes: page_id, bad (0, 1)."""
    votes = pages.join(outcomes, "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = checkpoint(votes.withColumn("suffix", suffix).withColumn("domain", domain))
    domains = checkpoint(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    overall = ((total[1] or 0) + 0.5) / ((total[0] or 0) + 1)
    level = suffixes.withColumn("m", F.lit(overall))
    s = _strength(level, "m")
    suffixes = level.select("suffix", ((F.col("bad") + s * F.col("m")) / (F.col("n") + s)).alias("m"))
    level = domains.join(suffixes, "suffix")
    s = _strength(level, "m")
    domains = checkpoint(level.select("suffix", "domain", ((F.col("bad") + s * F.col("m")) / (F.col("n") + s)).alias("m")))
    level = hosts.join(domains, ["suffix", "domain"])
    s = _strength(level, "m")
    a, b = F.col("bad") + s * F.col("m"), F.col("n") - F.col("bad") + s * (1 - F.col("m"))
    level = level.select("host", "n", "bad", a.alias("a"), b.alias("b")).withColumn("rate", F.col("a") / (F.col("a") + F.col("b")))
    return level.withColumn("bound", _lower_bound(F.col("a"), F.col("b"), tail)).select("host", "n", "bad", "rate", "bound", (F.col("bound") > limit).alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, host_rate.

    A null url, or one without ://, has an empty host and path, fits no rule and is allowed like any host without labelled
    pages; repeated rows come out once each; null page ids have no outcome; an empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    known = checkpoint(reputation(rows.filter("host <> ''").dropDuplicates(["page_id", "host"]), outcomes))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    out = rows.join(known.select("host", "rate", "blocked"), "host", "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), F.round("rate", 6).alias("host_rate"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: labels of the same id, bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels").filter("doc_id is not null")
    bad = ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")
    outcomes = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    return judge(table(spark, sf_dir, "pages"), outcomes)
