"""Joins and set operations between source, translated and judged paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

KEY = ["document_id", "paragraph_id"]


def pair(occurrences: DataFrame, translations: DataFrame) -> DataFrame:
    """Review rows: each occurrence with its translated paragraph, empty with a note where there is none."""
    rows = occurrences.join(translations.select(*KEY, "translation"), KEY, "left")
    target = F.coalesce("translation", F.lit(""))
    review = F.concat_ws("::", "document_id", "term_id", F.col("occurrence_index").cast("string"), F.col("paragraph_id").cast("string"), F.col("char_start").cast("string"))
    return rows.select(review.alias("occurrence_id"), *occurrences.columns, target.alias("target_paragraph"), F.when(target == "", "No translated paragraph found for this paragraph_id.").alias("notes"))


def document_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each document of left, and whether right has it."""
    return left.select("document_id").distinct().join(right.select("document_id").distinct().withColumn("there", F.lit(True)), "document_id", "left").select("document_id", F.coalesce("there", F.lit(False)).alias("matched"))


def coverage(paragraphs: DataFrame, translations: DataFrame) -> DataFrame:
    """A row a document: missing, extra, empty, source mismatches, Latin warnings, status and quality."""
    a = paragraphs.select(*KEY, F.col("text").alias("a_text"), F.lit(True).alias("a"))
    b = translations.select(*KEY, "source", "translation", F.lit(True).alias("b"))
    both = a.join(b, KEY, "full_outer")
    has, got = F.col("a").isNotNull(), F.col("b").isNotNull()
    latin = F.rlike(F.coalesce("translation", F.lit("")), F.lit("[A-Za-z]"))
    out = both.groupBy("document_id").agg(
        F.count_if(has).alias("expected"), F.count_if(has & ~got).alias("missing"), F.count_if(got & ~has).alias("extra"), F.count_if(has & got & (F.btrim("translation") == "")).alias("empty"),
        F.count_if(has & got & (F.col("source") != F.col("a_text"))).alias("source_mismatch"), F.count_if(has & got & latin).alias("latin_warnings"),
    )
    bad = F.col("missing") + F.col("extra") + F.col("empty") + F.col("source_mismatch")
    return out.withColumn("status", F.when(bad > 0, "invalid").otherwise("valid")).withColumn("quality", F.when(F.col("latin_warnings") > 0, "warning").otherwise("clean"))


def compare_keys(left: DataFrame, right: DataFrame, field: str) -> DataFrame:
    """One row: keys in both, only left, only right, and in both with a different field."""
    both = left.select(*KEY, F.col(field).alias("l"), F.lit(1).alias("a")).join(right.select(*KEY, F.col(field).alias("r"), F.lit(1).alias("b")), KEY, "full_outer")
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return both.agg(F.count_if(a & b).alias("common"), F.count_if(a & ~b).alias("only_left"), F.count_if(b & ~a).alias("only_right"), F.count_if(a & b & ~F.col("l").eqNullSafe(F.col("r"))).alias("mismatched"))


def reusable_judgments(old: DataFrame, new: DataFrame, judgments: DataFrame) -> DataFrame:
    """Judgments of old groups that hold for new ones: same variants, counts and total; variant ids go by rendering.

    old, new: document_id, term_id, variant, variant_id, n; judgments: document_id, term_id, variant_id, label.
    """
    group = ["document_id", "term_id"]
    sign = lambda d: d.groupBy(*group).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("variant", "n")))), 256).alias("signature"))
    same = sign(old).join(sign(new), [*group, "signature"]).select(*group)
    labels = old.join(judgments, [*group, "variant_id"]).select(*group, "variant", "label")
    return new.join(same, group, "left_semi").join(labels, [*group, "variant"]).select(*group, "variant_id", "variant", "label")


def terms_by_paragraph(occurrences: DataFrame, memory: DataFrame) -> DataFrame:
    """The distinct terms of each paragraph, sorted, with their canonical renderings where known."""
    rows = occurrences.select(*KEY, "source_term").distinct().join(memory, "source_term", "left")
    return rows.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "source_term", F.coalesce("canonical", F.lit("?"))))), ";").alias("terms"), F.count("*").alias("n"))


PLACEHOLDER = "【术语[0-9]+(?:_[0-9]+)?】"


def placeholder_difference(rows: DataFrame, expected: str = "expected", text: str = "output") -> DataFrame:
    """Expected against observed placeholders of each row (id): missing, excess of duplicates, unknown, and their sum."""
    want = rows.select("id", F.explode_outer(expected).alias("token")).filter("token is not null").distinct().withColumn("want", F.lit(1))
    seen = rows.select("id", F.explode(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("seen"))
    both = want.join(seen, ["id", "token"], "full_outer")
    missing, unknown = F.count_if(F.col("seen").isNull()), F.sum(F.when(F.col("want").isNull(), F.col("seen")).otherwise(0))
    excess = F.sum(F.when(F.col("want").isNotNull() & F.col("seen").isNotNull(), F.col("seen") - 1).otherwise(0))
    return both.groupBy("id").agg(missing.alias("missing"), excess.alias("duplicates"), unknown.alias("unknown")).withColumn("score", F.col("missing") + F.col("duplicates") + F.col("unknown"))


def pending(work: DataFrame, completed: DataFrame, keys: list[str]) -> DataFrame:
    """Work that no completed row has done with the same signature."""
    return work.join(completed.select(*keys).distinct(), keys, "left_anti")


def paired_cases(left: DataFrame, right: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows of both methods side by side with the difference of each metric and who is ahead in the first."""
    both = left.select(*KEY, *[F.col(m).alias(f"{m}_left") for m in metrics]).join(right.select(*KEY, *[F.col(m).alias(f"{m}_right") for m in metrics]), KEY)
    both = both.withColumns({f"{m}_delta": F.col(f"{m}_right") - F.col(f"{m}_left") for m in metrics})
    d = F.col(f"{metrics[0]}_delta")
    return both.withColumn("advantage", F.when(d > 0, "right").when(d < 0, "left").otherwise("none"))


def presence(occurrences: DataFrame, translations: DataFrame, memory: DataFrame) -> DataFrame:
    """Whether each occurrence's paragraph holds the canonical rendering, white space aside; null without a translation."""
    bare = lambda c: F.regexp_replace(c, "(?U)\\s+", "")
    rows = occurrences.join(translations.select(*KEY, "translation"), KEY, "left").join(memory.select("source_term", "canonical"), "source_term")
    return rows.select(*KEY, "source_term", "char_start", F.contains(bare(F.col("translation")), bare(F.col("canonical"))).alias("present"))


def presence_rates(found: DataFrame) -> DataFrame:
    """Micro rate, and strict rates: terms, paragraphs and documents in which every occurrence is rendered canonically."""
    rows = found.filter("present is not null")
    out = rows.agg(F.count("*").alias("occurrences"), F.round(F.avg(F.col("present").cast("int")), 6).alias("micro_rate"))
    for name, keys in (("term", ["document_id", "source_term"]), ("paragraph", KEY), ("document", ["document_id"])):
        strict = rows.groupBy(*keys).agg(F.bool_and("present").alias("all")).agg(F.round(F.avg(F.col("all").cast("int")), 6).alias(f"strict_{name}_rate"))
        out = out.join(F.broadcast(strict))  # one row each
    return out


def presence_by_method(occurrences: DataFrame, translations: DataFrame, memory: DataFrame, methods: list[str]) -> DataFrame:
    """Each occurrence under each method: whether its paragraph is translated and holds a canonical, acceptable or risky rendering.

    translations has a column method; memory has source_term, canonical, allowed and risky (arrays). White space does not
    count, empty renderings are never present, and a paragraph that a method has not translated holds none.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", "")
    known = memory.select("source_term", F.array(bare(F.col("canonical"))).alias("_c"), F.concat(F.array(bare(F.col("canonical"))), F.transform("allowed", bare)).alias("_a"), F.transform("risky", bare).alias("_r"))
    rows = occurrences.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods]))).join(translations.select(*KEY, "method", bare(F.col("translation")).alias("_t")), [*KEY, "method"], "left").join(known, "source_term")
    target = F.coalesce("_t", F.lit(""))
    holds = lambda names: F.exists(names, lambda r: (r != "") & F.contains(target, r))
    return rows.select("method", *KEY, "source_term", "char_start", (target != "").alias("translated"), holds("_c").alias("canonical"), holds("_a").alias("acceptable"), holds("_r").alias("risky"))


def method_rates(found: DataFrame) -> DataFrame:
    """A row for each method: coverage, micro rates, and the shares of terms, documents and paragraphs whose occurrences all pass."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    out = found.groupBy("method").agg(F.count("*").alias("occurrences"), *[rate(c).alias(f"{c}_rate") for c in ("translated", "canonical", "acceptable", "risky")])
    for name, keys in (("term", ["document_id", "source_term"]), ("document", ["document_id"]), ("paragraph", KEY)):
        every = found.groupBy("method", *keys).agg(F.bool_and("canonical").alias("c"), F.bool_and("acceptable").alias("a"))
        out = out.join(every.groupBy("method").agg(F.count("*").alias(f"{name}s"), rate("c").alias(f"all_canonical_{name}_rate"), rate("a").alias(f"all_acceptable_{name}_rate")), "method")
    return out


def translation_statistics(translations: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Non-empty, empty, remaining paragraphs, attempts and latency of each document."""
    full = F.btrim("translation") != ""
    got = translations.groupBy("document_id").agg(F.count_if(full).alias("nonempty"), F.count_if(~full).alias("empty"), F.sum("attempts").alias("attempts"), F.round(F.avg("latency_seconds"), 6).alias("mean_latency"))
    all_ = paragraphs.groupBy("document_id").agg(F.count("*").alias("paragraphs"))
    return all_.join(got, "document_id", "left").fillna(0, ["nonempty", "empty", "attempts"]).withColumn("remaining", F.greatest(F.lit(0), F.col("paragraphs") - F.col("nonempty")))


def canonical_collisions(memory: DataFrame) -> DataFrame:
    """Canonical renderings that different terms share."""
    return memory.groupBy("canonical").agg(F.count_distinct("term_id").alias("terms"), F.count_distinct("source_term").alias("source_terms")).filter("terms >= 2 and source_terms >= 2")


def complexity(occurrences: DataFrame, paragraphs: DataFrame) -> DataFrame:
    used = occurrences.groupBy("document_id").agg(F.count_distinct("paragraph_id").alias("term_paragraphs"), F.count("*").alias("occurrences"))
    return paragraphs.groupBy("document_id").agg(F.count("*").alias("paragraphs")).join(used, "document_id", "left").fillna(0)


def previous_context(translations: DataFrame, count: int = 3, max_chars: int = 2000) -> DataFrame:
    """The paragraphs before each one with their translations, oldest dropped while too long; a single one keeps its end."""
    from pyspark.sql import Window

    w = Window.partitionBy("document_id").orderBy("paragraph_id").rowsBetween(-count, -1)
    blocks = F.collect_list(F.concat_ws("\n", t.strip(F.col("source")), t.strip(F.col("translation")))).over(w)
    rows = translations.select(*KEY, blocks.alias("blocks"))
    n = F.size("blocks")
    fits: Column = F.lit("")
    for k in range(1, count + 1):  # the most recent k, the largest k that fits wins
        part = F.array_join(F.slice("blocks", F.greatest(F.lit(1), n - k + 1), k), "\n\n")
        fits = F.when((n >= k) & (F.length(part) <= max_chars), part).when((n >= k) if k == 1 else F.lit(False), F.right(part, F.lit(max_chars))).otherwise(fits)
    return rows.select(*KEY, fits.alias("context"))
