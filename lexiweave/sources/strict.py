"""Review files checked line by line: what holds goes on, what does not goes to a quarantine with its line and the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .filings import REVIEW_COLUMNS

# Types of terms and their criticality.
TERM_TYPES = ("PARTY_NAME", "DEFINED_LEGAL_TERM", "RIGHT_OR_OBLIGATION", "LEGAL_CONCEPT", "COMMERCIAL_TERM", "DOCUMENT_REFERENCE", "GENERAL_TERM")
CRITICALITIES = ("CRITICAL", "IMPORTANT", "AUXILIARY", "EXCLUDED")
KEY = ("document_id", "term_id")
MARK = "﻿"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The columns of a review file as strings, with file and line (the header is line 1; a record counts as one line).

    A header without one of the columns fails the query; further columns are left out. Spark drops a byte-order mark.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    lacking = [c for c in REVIEW_COLUMNS if c not in rows.columns]
    if lacking:
        raise ValueError(f"review file without the columns {lacking}")
    named = rows.select(*REVIEW_COLUMNS, F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_id"))
    first = named.groupBy("file").agg(F.min("_id").alias("_first"))  # a row a file; a file with multi-line records is one partition
    return named.join(first, "file").withColumn("line", (F.col("_id") - F.col("_first") + 2).cast("int")).drop("_id", "_first")


def read_text(c: str) -> Column:
    return t.strip(F.coalesce(F.col(c), F.lit("")))


def judged_lines(lines: DataFrame, accept_suggestions: bool = True) -> DataFrame:
    """Lines with the annotation that they stand for, and reason and value of what is wrong (null: nothing).

    Of several lines of a term all but the first are duplicates. Blank fields fall back on the suggestion, if that is
    wanted; EXCLUDED terms are never included.
    """
    upper = lambda c: F.upper(read_text(c))
    fallback = lambda c, s, f: F.when((f(c) == "") & F.lit(accept_suggestions), f(s)).otherwise(f(c))
    blank = F.lit(False)
    for c in ("term_type", "criticality", "include_in_benchmark"):
        blank = blank | (read_text(c) == "")
    rows = lines.withColumns({
        "document_id": read_text("document_id"), "term_id": read_text("term_id"), "source_term": read_text("source_term"), "reviewer_notes": read_text("reviewer_notes"), "_blank": blank,
        "term_type": fallback("term_type", "suggested_term_type", upper), "criticality": fallback("criticality", "suggested_criticality", upper), "_include": fallback("include_in_benchmark", "suggested_include", read_text),
    })
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(*[c for c in ("file", "line") if c in lines.columns]))
    include = t.parse_bool(F.col("_include"))
    faults = (("duplicate", F.col("_place") > 1, F.concat_ws("/", *KEY)), ("term_type", ~F.col("term_type").isin(*TERM_TYPES), F.col("term_type")), ("criticality", ~F.col("criticality").isin(*CRITICALITIES), F.col("criticality")), ("include_in_benchmark", include.isNull(), F.col("_include")))
    reason = value = F.lit(None).cast("string")
    for name, wrong, shown in reversed(faults):
        reason, value = F.when(wrong, name).otherwise(reason), F.when(wrong, shown).otherwise(value)
    rows = rows.withColumn("_place", place).withColumns({"reason": reason, "value": value, "include": F.coalesce(include & (F.col("criticality") != "EXCLUDED"), F.lit(False))})
    return rows.withColumn("used_suggestion", F.col("_blank") & F.lit(accept_suggestions)).drop("_place", "_include", "_blank")


def accepted(judged: DataFrame) -> DataFrame:
    return judged.filter("reason is null").select(*KEY, "source_term", "term_type", "criticality", "include", "reviewer_notes", "used_suggestion")


def quarantine(judged: DataFrame) -> DataFrame:
    """line, document_id, term_id, reason and value of the lines that cannot be used."""
    return judged.filter("reason is not null").select(*[c for c in ("file",) if c in judged.columns], "line", *KEY, "reason", "value")


def strict(judged: DataFrame) -> DataFrame:
    """accepted(), but a line that cannot be used fails the query with its number."""
    stop = F.raise_error(F.concat(F.lit("review line "), F.col("line").cast("string"), F.lit(": "), "reason", F.lit(" "), F.coalesce("value", F.lit("")))).cast("boolean")
    return accepted(judged.filter(F.when(F.col("reason").isNotNull(), stop).otherwise(F.lit(True))))


def apply_lines(terms: DataFrame, review: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotated terms, problems) of terms (document_id, term_id, source_term) and accepted lines.

    A term without a line stays without an annotation. problems: missing lines, lines of another term's wording, and
    stale lines, whose term is not there any more, each with its key.
    """
    lines = review.withColumnRenamed("source_term", "_reviewed").withColumn("_line", F.lit(True))
    both = terms.withColumn("_term", F.lit(True)).join(lines, list(KEY), "full_outer")
    differs = t.normalize_term(F.col("_reviewed")) != t.normalize_term(F.col("source_term"))
    both = both.withColumn("problem", F.when(F.col("_term").isNull(), "stale").when(F.col("_line").isNull(), "missing").when(differs, "source term differs"))
    source = F.when(F.col("_line") & F.col("problem").isNull(), F.when(F.col("used_suggestion"), "accepted-heuristic-suggestion").otherwise("human-review-csv"))
    valid = lambda c: F.when(F.col("problem").isNull(), F.col(c))
    annotated = both.filter("_term").select(*KEY, "source_term", *[valid(c).alias(c) for c in ("term_type", "criticality", "include", "reviewer_notes")], source.alias("annotation_source"))
    return annotated, both.filter("problem is not null").select(*KEY, "problem")


def apply_strict(terms: DataFrame, review: DataFrame) -> DataFrame:
    """Annotated terms; a missing, stale or differing line fails the query."""
    annotated, problems = apply_lines(terms, review)
    found = problems.groupBy(*KEY).agg(F.min("problem").alias("_p"))
    stop = F.raise_error(F.concat(F.lit("review of "), F.concat_ws("/", *KEY), F.lit(": "), F.col("_p"))).cast("boolean")
    rows = annotated.join(found, list(KEY), "full_outer")
    return rows.filter(F.when(F.col("_p").isNotNull(), stop).otherwise(F.lit(True))).drop("_p")
