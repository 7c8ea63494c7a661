"""Host-level quality rules: failures by source, shrunk by an empirical beta prior; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

#: Per-document rules beyond the base: shares of words.
MAX_SYMBOLS, MAX_DUP_LINES, MIN_WORD, MAX_WORD = 0.1, 0.3, 3.0, 10.0
#: A host is rejected if its shrunken failure rate, less this many standard deviations, is still above the limit.
HOST_LIMIT, HOST_DEVIATIONS = 0.8, 2.0


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: sort the windows, keep those equal to a neighbour, join their spans."""
    windows = F.when(
        F.size(words) >= 3,
        F.array_sort(F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.struct(F.concat_ws(" ", F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("w"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<w:string,i:int>>"))
    return windows


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("t"))
    rows = rows.select(
        "doc_id",
        "host",
        F.filter(F.split("t", "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("words"),
        F.length(F.regexp_replace("t", "[\\x20\\x09-\\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda line: F.rlike(line, F.lit("[^\\x20\\x09-\\x0D]"))).alias("lines"),
    )
    rows = rows.select("doc_id", "host", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _repeated_words(F.col("words")).alias("windows"))
    twice = F.filter("windows", lambda x, i: (F.get(F.col("windows"), i - 1)["w"] == x["w"]).__or__(F.get(F.col("windows"), i + 1)["w"] == x["w"]))
    rows = rows.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    spans = F.transform("starts", lambda s, i: F.least(F.lit(3), F.coalesce(F.get(F.col("starts"), i + 1) - s, F.lit(3))))
    return rows.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.aggregate(spans, F.lit(0).cast("long"), lambda a, v: a + v).alias("n_repeat_words"))


def host_verdicts(rows: DataFrame) -> DataFrame:
    """host, n, failed, rate (shrunk), deviation, rejected: one row a host, failures shrunk by a beta prior fitted to all hosts.

    The prior's mean is the hosts' overall failure rate, its strength follows by moments from how far host rates
    scatter beyond sampling; one row of sums does it, so nothing grows on the driver.
    """
    host = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failed"))
    host = checkpoint(host)
    p = host.agg(F.sum("n").alias("n"), F.sum("failed").alias("f"), F.count("*").alias("h"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    n, f, h, nn = (float(v or 0) for v in p)
    mean = (f + 0.5) / (n + 1)
    spread = host.agg(F.sum(F.col("n") * (F.col("failed") / F.col("n") - F.lit(mean)) ** 2)).first()[0] or 0.0
    # E[sum n (r - m)^2] = m (1 - m) ((h - 1) + rho (n - nn / n - (h - 1))), rho = 1 / (strength + 1)
    free = max(h - 1, 0.0)
    rho = (spread / (mean * (1 - mean)) - free) / max(n - (nn / n if n else 0) - free, 1e-9) if free else 0.5
    strength = 1 / min(max(rho, 1e-4), 0.5) - 1
    a, b = F.col("failed") + mean * strength, F.col("n") - F.col("failed") + (1 - mean) * strength
    rate = a / (a + b)
    host = host.withColumn("rate", rate).withColumn("deviation", F.sqrt(rate * (1 - rate) / (a + b + 1)))
    return host.withColumn("rejected", F.col("rate") - HOST_DEVIATIONS * F.col("deviation") > HOST_LIMIT)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of docs: the five counts, base_failed, kept, and the host's rate.

    A document fails the base rules as the columns say; beyond that it is kept unless its host is rejected. Rules
    that count against a host: the base ones, symbols, repeated lines and mean word length. Null texts have no words
    (and fail); null hosts are one host; repeated rows count and come out once each; an empty table gives no rows.
    """
    rows = features(docs, id_col, text_col, host_col)
    n = F.col("n_words")
    rows = rows.withColumn("base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n))
    mean = F.col("word_chars") / F.greatest(n, F.lit(1))
    rows = rows.withColumn("failed", F.col("base_failed") | (F.col("n_symbols") > MAX_SYMBOLS * n) | (F.col("n_dup_lines") > MAX_DUP_LINES * n) | ~mean.between(MIN_WORD, MAX_WORD))
    rows = checkpoint(rows.withColumn("host", F.coalesce(F.concat(F.lit("h"), "host"), F.lit("null"))))
    verdicts = host_verdicts(rows).select("host", "rate", "rejected")
    out = rows.join(verdicts, "host")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("rejected")).alias("kept"), F.round("rate", 6).alias("host_rate"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
