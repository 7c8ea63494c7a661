"""Inference over paired documents: intervals, permutation and sign tests, ranks, agreement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inference import paired_inference
from .ranking import running


def one_group(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("stream", F.lit(0))


def bootstrap(pairs: DataFrame, resamples: int = 10_000, seed: int = 2026) -> DataFrame:
    """Mean of document means with its percentile interval. pairs: document_id, diff."""
    got = paired_inference(one_group(pairs), [], resamples, 0, seed)
    return got.select(F.col("documents").alias("n"), F.col("macro_effect").alias("mean"), F.col("macro_low").alias("low"), F.col("macro_high").alias("high"))


def cluster_ratio(pairs: DataFrame, resamples: int = 10_000, seed: int = 2026) -> DataFrame:
    """Mean of all differences with the interval from documents resampled whole: a replicate is its sums over its counts."""
    got = paired_inference(one_group(pairs), [], resamples, 0, seed)
    return got.select("documents", "paragraphs", F.col("weighted_effect").alias("effect"), F.col("weighted_low").alias("low"), F.col("weighted_high").alias("high"))


def sign_flip(pairs: DataFrame, permutations: int = 50_000, seed: int = 2026) -> DataFrame:
    """Two-sided p of the mean of document means under random signs: (extreme + 1) / (permutations + 1)."""
    got = paired_inference(one_group(pairs), [], 0, permutations, seed)
    return got.select(F.col("macro_effect").alias("observed"), F.col("sign_flip_p").alias("p_value"))


def sign_test(positive: Column, negative: Column) -> Column:
    """Exact two-sided p of a sign test; 1 without differences. Binomial terms are kept as logarithms, so no number of pairs overflows."""
    n, k = positive + negative, F.least(positive, negative)
    start = F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.lit(0.0).alias("sum"))
    step = lambda a, i: F.struct((a["log"] + F.when(i < k, F.log((n - i) / (i + 1))).otherwise(0.0)).alias("log"), (a["sum"] + F.exp(a["log"])).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), start, step, lambda a: a["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def paired_table(pairs: DataFrame, *keys: str) -> DataFrame:
    """pairs: before, after. Means, improved share of the changed, and the exact sign test."""
    up, down = F.count_if(F.col("after") > F.col("before")), F.count_if(F.col("after") < F.col("before"))
    g = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("before"), 6).alias("mean_before"), F.round(F.avg("after"), 6).alias("mean_after"), F.round(F.avg(F.col("after") - F.col("before")), 6).alias("mean_diff"), up.alias("up"), down.alias("down"))
    return g.withColumn("improved_fraction", F.round(F.col("up") / F.col("n"), 6)).withColumn("sign_p", F.round(sign_test(F.col("up"), F.col("down")), 6))


#: Measures of which less is better.
LESS_IS_BETTER = ("lir", "omission_rate")


def paired_documents(rows: DataFrame, baseline: str, metrics: list[str], resamples: int = 10_000, seed: int = 2026) -> DataFrame:
    """A row for each method and metric against the baseline: documents that have both, means, difference with its interval, improved share, sign test.

    rows: document_id, method and the metrics. A document improves by less of a metric in LESS_IS_BETTER, by more of any
    other. A document without the metric (null) in either method is left out of that metric.
    """
    long = rows.select("document_id", "method", F.stack(F.lit(len(metrics)), *[x for i, m in enumerate(metrics) for x in (F.lit(m), F.lit(i), F.col(m))]).alias("metric", "_i", "value")).filter("value is not null")
    before = long.filter(F.col("method") == baseline).select("document_id", "metric", F.col("value").alias("before"))
    both = long.filter(F.col("method") != baseline).join(before, ["document_id", "metric"]).withColumn("diff", F.col("value") - F.col("before"))
    better = F.when(F.col("metric").isin(*LESS_IS_BETTER), -F.col("diff")).otherwise(F.col("diff"))
    up, down = F.count_if(F.col("diff") > 0), F.count_if(F.col("diff") < 0)
    keys = ["method", "metric"]
    stream = F.col("_i") + 100 * F.pmod(F.crc32(F.col("method").cast("binary")), F.lit(1 << 20)).cast("int")
    limits = paired_inference(both.withColumn("stream", stream), keys, resamples, 0, seed).select(*keys, F.col("macro_low").alias("low"), F.col("macro_high").alias("high"))
    table = both.groupBy(*keys).agg(F.count("*").alias("documents"), F.round(F.avg("before"), 6).alias("mean_before"), F.round(F.avg("value"), 6).alias("mean_after"), F.round(F.avg("diff"), 6).alias("mean_diff"), F.round(F.count_if(better > 0) / F.count("*"), 6).alias("improved_fraction"), up.alias("up"), down.alias("down"))
    return table.withColumn("sign_p", F.round(sign_test(F.col("up"), F.col("down")), 6)).join(limits, keys)


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """Signed-rank statistic with mid-ranks, zeros dropped, and its two-sided p by the normal approximation with ties."""
    rows = pairs.filter("diff <> 0").groupBy(F.abs("diff").alias("d")).agg(F.count("*").alias("t"), F.count_if(F.col("diff") > 0).alias("up"))
    ranked = running(rows, ["d"], F.col("t")).withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    s = ranked.agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n, w = F.col("n").cast("double"), F.col("w_plus")  # the cube of n is no long from two million rows on
    z = F.abs(w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return s.select("n", F.round("w_plus", 6).alias("w_plus"), F.round(z, 6).alias("z"), F.round(2 * (1 - normal_cdf(z)), 4).alias("p_value"))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution for z >= 0 (Zelen and Severo's polynomial, error below 1e-7)."""
    k = 1 / (1 + 0.2316419 * z)
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    return 1 - F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def kappa(ratings: DataFrame) -> DataFrame:
    """Cohen's kappa and raw agreement of two raters (columns a, b); 1 where chance agreement is complete."""
    table = ratings.groupBy("a", "b").agg(F.count("*").alias("n"))
    left, right = table.groupBy("a").agg(F.sum("n").alias("x")), table.groupBy("b").agg(F.sum("n").alias("y"))
    chance = left.join(right, left.a == right.b).agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("c"))
    same = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("s"))
    both = same.join(F.broadcast(chance)).select("n", F.try_divide("s", "n").alias("o"), F.try_divide(F.coalesce("c", F.lit(0.0)), F.col("n").cast("double") * F.col("n")).alias("e"))  # one row each
    return both.select("n", F.round("o", 6).alias("agreement"), F.round(F.when(F.col("e") == 1, 1.0).otherwise((F.col("o") - F.col("e")) / (1 - F.col("e"))), 6).alias("kappa"))


def document_effect(rows: DataFrame) -> DataFrame:
    """Mean of document means, and mean over all rows. rows: document_id, diff."""
    docs = rows.groupBy("document_id").agg(F.avg("diff").alias("m"), F.sum("diff").alias("s"), F.count("*").alias("n"))
    return docs.agg(F.count("*").alias("documents"), F.sum("n").alias("paragraphs"), F.round(F.avg("m"), 6).alias("macro_effect"), F.round(F.sum("s") / F.sum("n"), 6).alias("weighted_effect"))
