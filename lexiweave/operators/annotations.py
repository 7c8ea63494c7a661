"""Term review: suggestions, export, application of a review, validation and repair of renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .terms import external_modifier

# Markers of the suggestion rules, in their order, and generic one-character renderings.
COMPANY = "\\b(inc\\.?|incorporated|corp\\.?|corporation|ltd\\.?|limited|llc|plc|company|co\\.?)\\b"
PARTIES = ("buyer", "seller", "purchaser", "vendor", "landlord", "tenant", "licensor", "licensee", "employer", "employee")
CRITICAL = ("effective date", "closing date", "completion date", "termination date", "governing law", "confidential information", "intellectual property", "indemnity", "indemnification", "liability", "warranty", "representation", "force majeure", "breach", "default", "consideration", "term")
RIGHTS = ("right", "rights", "obligation", "obligations", "license", "licenses", "duty", "duties")
DOCUMENTS = ("agreement", "schedule", "exhibit", "appendix", "annex", "statement", "certificate", "notice")
COMMERCIAL = ("price", "payment", "fee", "fees", "royalty", "deposit", "purchase", "product", "services")
GENERIC = ("人", "方", "者", "项", "权", "款", "日", "法", "物", "事", "部", "类", "户", "名")
REPAIRABLE = ("UNTRANSLATED", "POSSIBLY_OVER_WIDE", "AMBIGUOUS_ALIGNMENT", "MIXED_LATIN", "MISSING_RENDERING", "POSSIBLY_NESTED_MODIFIER")


def suggest(term: Column) -> Column:
    """struct<term_type, criticality, include> that a term's wording suggests; the first rule that fits decides."""
    value = t.collapse(term)
    low = F.lower(value)
    holds = lambda words: F.rlike(low, F.lit("|".join(words)))
    out = lambda kind, level, use: F.struct(F.lit(kind).alias("term_type"), F.lit(level).alias("criticality"), F.lit(use).alias("include"))
    capitals = (F.upper(value) == value) & (F.lower(value) != value) & F.length(value).between(2, 8)
    return (
        F.when(F.rlike(value, F.lit("(?i)" + COMPANY)) | capitals, out("PARTY_NAME", "IMPORTANT", False))
        .when(low.isin(*PARTIES), out("PARTY_NAME", "CRITICAL", True))
        .when(holds(CRITICAL), out("DEFINED_LEGAL_TERM", "CRITICAL", True))
        .when(holds(RIGHTS), out("RIGHT_OR_OBLIGATION", "CRITICAL", True))
        .when(holds(DOCUMENTS), out("DOCUMENT_REFERENCE", "IMPORTANT", True))
        .when(holds(COMMERCIAL), out("COMMERCIAL_TERM", "IMPORTANT", True))
        .when(F.rlike(value, F.lit("^\\p{Lu}")), out("DEFINED_LEGAL_TERM", "IMPORTANT", True))
        .otherwise(out("GENERAL_TERM", "AUXILIARY", False))
    )


def export_review(terms: DataFrame, paragraphs: DataFrame, limit: int = 500) -> DataFrame:
    """A review row a term: its definitions' paragraphs joined, and what its wording suggests."""
    places = terms.select("document_id", "term_id", F.explode("definition_paragraph_ids").alias("paragraph_id"))
    found = places.join(paragraphs, ["document_id", "paragraph_id"]).groupBy("document_id", "term_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_id", "text"))), lambda p: p["text"]), " || ").alias("c"))
    rows = terms.join(found, ["document_id", "term_id"], "left").withColumn("s", suggest(F.col("source_term")))
    return rows.select("document_id", "term_id", "source_term", F.col("occurrences").alias("frequency"), "extraction_method", F.concat_ws(";", "definition_paragraph_ids").alias("definition_paragraph_ids"), t.shorten(F.coalesce("c", F.lit("")), limit).alias("definition_context"), F.col("s.term_type").alias("suggested_term_type"), F.col("s.criticality").alias("suggested_criticality"), F.col("s.include").cast("string").alias("suggested_include"), *[F.lit("").alias(c) for c in ("term_type", "criticality", "include_in_benchmark", "reviewer_notes")])


def apply_review(terms: DataFrame, review: DataFrame, accept_suggestions: bool = True) -> DataFrame:
    """Terms with their reviewed annotation; blanks fall back on the suggestion; excluded terms never enter the benchmark."""
    keys = ["document_id", "term_id"]
    pick = lambda c: F.coalesce(F.nullif(F.btrim(c), F.lit("")), F.col(f"suggested_{c.replace('_in_benchmark', '')}") if accept_suggestions else F.lit(None))
    rows = terms.select(*keys, "source_term").join(review.select(*keys, F.col("source_term").alias("reviewed_term"), pick("term_type").alias("term_type"), pick("criticality").alias("criticality"), t.parse_bool(pick("include_in_benchmark")).alias("include")), keys, "left")
    problem = F.when(F.col("reviewed_term").isNull(), "missing").when(t.normalize_term(F.col("reviewed_term")) != t.normalize_term(F.col("source_term")), "source term differs")
    return rows.withColumn("include", F.col("include") & (F.col("criticality") != "EXCLUDED")).withColumn("problem", problem).drop("reviewed_term")


def stale_reviews(terms: DataFrame, review: DataFrame) -> DataFrame:
    return review.join(terms, ["document_id", "term_id"], "left_anti").select("document_id", "term_id")


def annotation_statistics(annotated: DataFrame) -> DataFrame:
    return annotated.groupBy("document_id").agg(F.count("*").alias("terms"), F.count("term_type").alias("reviewed"), F.count_if(F.col("include")).alias("benchmark_terms"), F.count_if(F.col("criticality") == "CRITICAL").alias("critical"), F.count_distinct("term_type").alias("types"))


def annotation_counts(annotated: DataFrame) -> DataFrame:
    """Reviewed terms of each document by type and by criticality: a row for each value (field, value, terms)."""
    pair = lambda f: F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))
    rows = annotated.filter("term_type is not null").select("document_id", F.explode(F.array(pair("term_type"), pair("criticality"))).alias("x"))
    return rows.groupBy("document_id", "x.field", "x.value").agg(F.count("*").alias("terms"))


def benchmark_terms(annotated: DataFrame) -> DataFrame:
    """Annotated terms that are included and not EXCLUDED; without an annotation none."""
    return annotated.filter("include and criticality <> 'EXCLUDED'")


def validate_renderings(rows: DataFrame) -> DataFrame:
    """validation_status, include_in_consistency, needs_rendering_repair and extraction_status of reviewed occurrences.

    Needs text, char_start, source_term, rendering, extraction_status and container (a longer term around it, or null).
    """
    rendering, source = t.surface(F.col("rendering")), t.surface(F.col("source_term"))
    status = (
        F.when(F.col("container").isNotNull(), "NESTED_IN_LONGER_TERM")
        .when(external_modifier(F.col("text"), F.col("char_start")).isNotNull(), "POSSIBLY_NESTED_MODIFIER")
        .when(rendering == "", "MISSING_RENDERING")
        .when(t.same_lexical(source, rendering), "UNTRANSLATED")
        .when(rendering.isin(*GENERIC), "AMBIGUOUS_ALIGNMENT")
        .when(t.over_wide(source, rendering), "POSSIBLY_OVER_WIDE")
        .when(F.rlike(rendering, F.lit("[A-Za-z]")), "MIXED_LATIN")
        .otherwise("VALID")
    )
    out = rows.withColumn("validation_status", status).withColumn("include_in_consistency", F.col("validation_status") != "NESTED_IN_LONGER_TERM")
    return out.withColumn("needs_rendering_repair", F.col("validation_status").isin(*REPAIRABLE)).withColumn("extraction_status", F.when(F.col("validation_status") == "UNTRANSLATED", "TRANSLATION_ERROR").otherwise(F.col("extraction_status")))


def validation_summary(validated: DataFrame) -> DataFrame:
    """Counts by status for each document and for all together (document_id null)."""
    return validated.rollup("document_id").agg(F.count("*").alias("rows"), F.count_if(F.col("include_in_consistency")).alias("included"), F.count_if(F.col("needs_rendering_repair")).alias("repairs"), F.count_if(F.col("validation_status") == "VALID").alias("valid"))


def repair_queue(validated: DataFrame, retry_failed: bool = False, overwrite: bool = False) -> DataFrame:
    done = F.col("repair_status").isNotNull() & (F.lit(not retry_failed) | (F.col("repair_status") != "FAILED"))
    return validated.filter(F.col("needs_rendering_repair") & (F.lit(overwrite) | ~done))


#: What an answer of the repair step makes of a row: rendering kept, extraction status, validation status, included.
REPAIRS = {"MINIMAL": (True, "FOUND", "REPAIRED_MINIMAL", True), "OMITTED": (False, "OMITTED", "REPAIR_OMITTED", True), "IMPLICIT": (False, "IMPLICIT", "REPAIR_IMPLICIT", True), "AMBIGUOUS": (False, "AMBIGUOUS", "REPAIR_AMBIGUOUS", True), "UNTRANSLATED": (True, "TRANSLATION_ERROR", "REPAIR_UNTRANSLATED", True), "FAILED": (True, None, "REPAIR_FAILED_RETAINED", False)}


def apply_repairs(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """rows: occurrence_id, rendering, extraction_status, validation_status, include_in_consistency; repairs: occurrence_id, outcome, repaired."""
    both = rows.join(repairs, "occurrence_id", "left")

    def choose(i: int, current: str) -> Column:
        out = F.col(current)
        for outcome, values in REPAIRS.items():
            new = (F.coalesce("repaired", "rendering") if values[0] else F.lit(None).cast("string")) if i == 0 else F.lit(values[i]) if values[i] is not None else F.col(current)
            out = F.when(F.col("outcome") == outcome, new).otherwise(out)
        return out

    names = ("rendering", "extraction_status", "validation_status", "include_in_consistency")
    return both.select("occurrence_id", *[choose(i, c).alias(c) for i, c in enumerate(names)])


def merge_saved(rows: DataFrame, saved: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of saved rows over those of rows, where they are there."""
    old = saved.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    return rows.join(old, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def flag_low_confidence(rows: DataFrame, threshold: float, note: str) -> DataFrame:
    low = F.col("extraction_confidence") < threshold
    noted = F.contains(F.coalesce("notes", F.lit("")), F.lit(note))
    return rows.withColumn("low_confidence", low).withColumn("notes", F.when(low & ~noted, F.concat_ws(" ", F.nullif(F.col("notes"), F.lit("")), F.lit(note))).otherwise(F.col("notes")))
