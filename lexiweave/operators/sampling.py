"""Deterministic samples, orders and top-k: by hash, so that they never depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digest_fraction
from .ranking import require_enough, running, top_of_each


def digest(seed: int, *columns: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", F.lit(str(seed)), *[c.cast("string") for c in columns]), 256)


def evaluation_selection(rows: DataFrame, scope: str, rate: float, seed: int) -> DataFrame:
    """Paragraphs to judge: all, those with terms, or these and a hashed share of the others."""
    hit = digest_fraction(F.lit(str(seed)), F.col("document_id").cast("string"), F.col("paragraph_id").cast("string")) < rate
    keep = {"all": F.lit(True), "term-bearing": F.col("has_terms"), "term-bearing-plus-sample": F.col("has_terms") | hit}[scope]
    return rows.filter(keep)


KEY = ("document_id", "paragraph_id")


def by_digest(seed: int) -> list[Column]:
    return [digest(seed, *map(F.col, KEY)), *map(F.col, KEY)]


def top_by_digest(rows: DataFrame, sizes: dict, stratum: str, seed: int, enough: bool = False) -> DataFrame:
    """The first rows of each stratum in the order of their digests, with rank. enough: a stratum that is too small fails the query."""
    picked = top_of_each(rows, stratum, sizes, by_digest(seed))
    return require_enough(picked, rows, stratum, sizes) if enough else picked


def _filled(rows: DataFrame, first: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows: those of first, in the order of a digest, then others. Both sides are bounded by n before they meet."""
    order = by_digest(seed)
    rest = rows.join(F.broadcast(first.select(*KEY)), list(KEY), "left_anti").orderBy(*order).limit(n)  # first: a few times n rows at most
    both = first.withColumn("_first", F.lit(1)).unionByName(rest.withColumn("_first", F.lit(0)))
    return both.orderBy(F.desc("_first"), *order).limit(n).drop("_first")


def balanced(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows, a third of each winner by digest, filled up from the rest by another digest."""
    rank = F.row_number().over(Window.partitionBy("winner").orderBy(*by_digest(seed)))
    first = rows.withColumn("_r", rank).filter(F.col("_r") <= n // 3).drop("_r")
    return _filled(rows, first, n, seed + 999)


def blind(rows: DataFrame, seed: int) -> DataFrame:
    """Sample ids in hash order, and which method stands as A: the digest's first byte is odd."""
    d = digest(seed, F.col("document_id"), F.col("paragraph_id"))
    ranked = rows.withColumn("_d", d).withColumn("_n", F.row_number().over(Window.orderBy("_d", "document_id", "paragraph_id")))
    swap = F.conv(F.substring("_d", 1, 2), 16, 10).cast("int").bitwiseAND(1) == 1
    return ranked.select("document_id", "paragraph_id", F.concat(F.lit("H"), F.lpad(F.col("_n").cast("string"), 4, "0")).alias("sample_id"), F.when(swap, "placeholder").otherwise("glossary").alias("method_a"))


def even_ranks(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """n rows (all, if there are fewer) at even distances in an order, the ends included, each once; places that fall together are filled up from the end."""
    ranked = running(rows, list(order), name="_i")
    total = ranked.agg(F.count("*").alias("_n"))
    step = F.explode(F.sequence(F.lit(0), F.least(F.lit(n).cast("long"), F.col("_n")) - 1))
    least = F.greatest(F.lit(1).cast("long"), F.least(F.lit(n).cast("long"), F.col("_n")) - 1)
    even = total.filter("_n > 0").select(step.alias("_k"), "_n", least.alias("_d")).select(F.bround(F.col("_k") * (F.col("_n") - 1) / F.col("_d")).cast("long").alias("_i")).distinct()
    late = total.filter("_n > 0").select(F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(2 * n).cast("long"), F.col("_n")))).alias("_k"), "_n").select((F.col("_n") - F.col("_k")).alias("_i"))
    places = even.withColumn("_late", F.lit(0)).unionByName(late.join(even, "_i", "left_anti").withColumn("_late", F.lit(1))).orderBy("_late", F.desc("_i")).limit(n)
    return ranked.join(F.broadcast(places.select("_i")), "_i").drop("_i")  # n places


def risk_sample(rows: DataFrame, n: int, risky_share: float, seed: int) -> DataFrame:
    """A share of risky rows, then others, in hash order; where either are too few, the rest of the others fill up."""
    want = int(n * risky_share)
    first = top_of_each(rows, "risky", {True: want, False: n - want}, by_digest(seed)).drop("rank")
    return _filled(rows, first, n, seed)


def position_control(rows: DataFrame, mode: str, seed: int) -> DataFrame:
    """Whether A and B change places: never, by a digest's bit, or once each way."""
    if mode == "bidirectional":
        return rows.withColumn("swapped", F.explode(F.array(F.lit(False), F.lit(True))))
    bit = F.conv(F.substring(digest(seed, F.col("document_id"), F.col("paragraph_id")), 1, 2), 16, 10).cast("int").bitwiseAND(1) == 1
    return rows.withColumn("swapped", F.lit(False) if mode == "fixed" else bit)


def limits(rows: DataFrame, max_documents: int, max_paragraphs: int) -> DataFrame:
    """The first documents by id, and of each the first paragraphs."""
    some = rows.select("document_id").distinct().orderBy("document_id").limit(max_documents)
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy("paragraph_id"))
    return rows.join(F.broadcast(some), "document_id", "left_semi").withColumn("_r", rank).filter(F.col("_r") <= max_paragraphs).drop("_r")
