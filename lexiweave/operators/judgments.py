"""Checks of model answers, and signatures for resuming; a bad answer becomes a reason, never an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.python_text import recover_substring_of

# Fixed values.
VARIANT_LABELS = ("ACCEPTABLE_VARIANT", "LEGAL_INCONSISTENCY", "UNRESOLVED")
EXTRACTION = ("FOUND", "OMITTED", "IMPLICIT", "AMBIGUOUS", "TRANSLATION_ERROR")
TERM_TYPES = ("PARTY_NAME", "DEFINED_LEGAL_TERM", "RIGHT_OR_OBLIGATION", "DOCUMENT_REFERENCE", "COMMERCIAL_TERM", "GENERAL_TERM")
LEVELS = ("CRITICAL", "IMPORTANT", "AUXILIARY", "EXCLUDED")


def judge_problem(required: Column, dominant: Column, answers: Column) -> Column:
    """Why a judge's answers (array<struct<variant_id,label,confidence,rationale>>) do not do for a group; null if they do."""
    ids = F.transform(F.filter(answers, lambda v: v["variant_id"] != dominant), lambda v: v["variant_id"])
    bad = lambda test: F.exists(answers, test)
    return (
        F.when(F.size(F.array_except(required, ids)) > 0, "missing variant")
        .when(F.size(F.array_except(ids, required)) > 0, "unknown variant")
        .when(F.size(ids) != F.size(F.array_distinct(ids)), "repeated variant")
        .when(bad(lambda v: (v["variant_id"] != dominant) & ~v["label"].isin(*VARIANT_LABELS)), "label")
        .when(bad(lambda v: ~F.coalesce(v["confidence"].between(0, 1), F.lit(False))), "confidence")
        .when(bad(lambda v: F.coalesce(F.btrim(v["rationale"]), F.lit("")) == ""), "rationale")
    )


def group_label(labels: Column) -> Column:
    has = lambda x: F.array_contains(labels, x)
    return F.when(has("LEGAL_INCONSISTENCY"), "LEGAL_INCONSISTENCY").when(has("UNRESOLVED"), "UNRESOLVED").otherwise("ACCEPTABLE_VARIATION")


def extraction_problem(status: Column, rendering: Column, target: Column) -> Column:
    """A rendering must stand word for word in its paragraph if found, and be absent otherwise."""
    explicit = status.isin("FOUND", "TRANSLATION_ERROR")
    return (
        F.when(~F.coalesce(status.isin(*EXTRACTION), F.lit(False)), "status")
        .when(explicit & ~F.coalesce(F.contains(target, rendering) & (rendering != ""), F.lit(False)), "rendering is not in the paragraph")
        .when(~explicit & rendering.isNotNull(), "rendering without being found")
    )


def planner_problem(canonical: Column, confidence: Column) -> Column:
    return F.when(F.coalesce(F.btrim(canonical), F.lit("")) == "", "canonical").when(t.disallowed_latin(canonical), "Latin words").when(~F.coalesce(confidence.between(0, 1), F.lit(False)), "confidence")


def annotation_problems(rows: DataFrame) -> DataFrame:
    """Batches (batch, id, term_type, criticality) whose ids are not 0 to n-1, each once, or whose values are unknown."""
    g = rows.groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.min("id").alias("low"), F.max("id").alias("high"), F.bool_and(F.col("term_type").isin(*TERM_TYPES) & F.col("criticality").isin(*LEVELS)).alias("known"))
    ids = (F.col("d") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)
    return g.select("batch", F.when(~ids, "ids").when(~F.coalesce("known", F.lit(False)), "values").alias("problem"))


def signature(*columns: Column) -> Column:
    """SHA-256 of the columns as JSON in the order of their names, by which a stale result is told."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def paired_reviews(one: DataFrame, two: DataFrame, key: DataFrame, scores: tuple[str, ...] = ("term_correct", "legal_accuracy", "fluency")) -> DataFrame:
    """Samples that both reviewers and the key hold: preferences by method, their consensus, the model's, and differences of scores.

    Reviews: sample_id, preferred (A, B or TIE; else null), and a score of each side; key: method_A, method_B, llm_winner (null: tie).
    """
    named = lambda d, r: d.select("sample_id", *[F.col(c).alias(f"{r}_{c}") for c in ("preferred", *[f"{s}_{x}" for s in scores for x in "AB"])])
    rows = key.join(named(one, "reviewer_1"), "sample_id").join(named(two, "reviewer_2"), "sample_id")

    def label(r: str) -> Column:
        p = F.upper(F.btrim(F.col(f"{r}_preferred")))
        return F.when(p == "TIE", "tie").when(p == "A", F.col("method_A")).when(p == "B", F.col("method_B"))

    def difference(r: str, s: str) -> Column:
        a, b = (F.col(f"{r}_{s}_{x}").try_cast("double") for x in "AB")
        of = lambda method: F.when(F.col("method_A") == method, a).otherwise(b)
        return F.when(a.isNotNull() & b.isNotNull(), of("glossary") - of("placeholder")).alias(f"{r}_{s}_glossary_minus_placeholder")

    first, second = label("reviewer_1"), label("reviewer_2")
    agree = F.coalesce(first == second, F.lit(False))
    model = F.coalesce("llm_winner", F.lit("tie"))
    return rows.select(
        "sample_id", "document_id", "paragraph_id", first.alias("reviewer_1_preference"), second.alias("reviewer_2_preference"), F.when(agree, first).otherwise("disagreement").alias("consensus"),
        model.alias("llm_winner"), agree.alias("reviewers_agree"), F.when(agree, first == model).alias("consensus_matches_llm"), *[difference(r, s) for r in ("reviewer_1", "reviewer_2") for s in scores],
    )


# What a repair can end in, and the endings that need a rendering.
REPAIRED = ("FOUND_MINIMAL", "OMITTED", "IMPLICIT", "AMBIGUOUS", "UNTRANSLATED", "RETAIN_ORIGINAL_REVIEW")
WITH_RENDERING = ("FOUND_MINIMAL", "UNTRANSLATED")


def validate_repairs(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Each row (occurrence_id, rendering, target_paragraph) with its answer (occurrence_id, status, rendering, confidence, rationale), checked.

    A rendering must stand in its paragraph, white space and compatibility forms aside, and is given as it stands there; problem
    is null for a good answer. Rows without an answer and answers without a row have the problem occurrence_id.
    """
    got = answers.select("occurrence_id", "status", F.col("rendering").alias("_answer"), "confidence", F.btrim("rationale").alias("rationale"), F.lit(True).alias("_got"))
    both = rows.select("occurrence_id", F.col("rendering").alias("_old"), F.coalesce("target_paragraph", F.lit("")).alias("_target"), F.lit(True).alias("_row")).join(got, "occurrence_id", "full_outer")
    needs = F.col("status").isin(*WITH_RENDERING)
    there = F.contains("_target", F.col("_answer"))
    # Only renderings that are not in their paragraph word for word go to Python.
    both = both.withColumn("_found", recover_substring_of(F.when(needs & ~there, F.col("_answer")), F.col("_target")))
    rendering = F.when(needs, F.when(there, F.col("_answer")).otherwise(F.col("_found"))).when(F.col("status") == "RETAIN_ORIGINAL_REVIEW", F.nullif("_old", F.lit("")))
    problem = (
        F.when(F.col("_row").isNull() | F.col("_got").isNull(), "occurrence_id")
        .when(~F.coalesce(F.col("status").isin(*REPAIRED), F.lit(False)), "status")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence")
        .when(F.coalesce("rationale", F.lit("")) == "", "rationale")
        .when(needs & (F.coalesce("_answer", F.lit("")) == ""), "rendering is missing")
        .when(needs & rendering.isNull(), "rendering is not in the paragraph")
    )
    return both.select("occurrence_id", F.when(problem.isNull(), rendering).alias("rendering"), "status", "confidence", "rationale", problem.alias("problem"))


# What a rendering of another scope can do.
RISKS = ("SCOPE_NARROWING", "SCOPE_BROADENING", "CATEGORY_SHIFT", "ROLE_CONFUSION", "UNTRANSLATED", "OTHER")
EXTRACTED = "array<struct<occurrence_id:string,rendering:string,status:string,confidence:double,rationale:string>>"
PLANNED = "array<struct<item_id:int,canonical_translation:string,legal_scope_summary:string,allowed_variants:array<struct<rendering:string,condition:string>>,risky_variants:array<struct<rendering:string,risk_type:string,reason:string>>,confidence:double,rationale:string>>"


def _results(answer: Column, kind: str) -> Column:
    """The rows of an answer: a JSON array, or an object with results."""
    return F.coalesce(F.from_json(answer, f"struct<results:{kind}>")["results"], F.when(F.startswith(F.btrim(answer), F.lit("[")), F.from_json(answer, kind)))


def extraction_answer(answer: Column, items: Column) -> Column:
    """struct<problem, rows> of an answer to items (array of occurrence_id, target_paragraph): ids in the same order, known statuses, confidences from 0 to 1, renderings word for word.

    The first row that is wrong names the problem; rows are null then.
    """
    rows = _results(answer, EXTRACTED)
    ids = lambda a: F.transform(a, lambda x: x["occurrence_id"])
    clean = F.transform(rows, lambda r: F.struct(r["occurrence_id"].alias("occurrence_id"), F.btrim(r["rendering"]).alias("rendering"), F.upper(r["status"]).alias("status"), r["confidence"].alias("confidence"), F.btrim(F.coalesce(r["rationale"], F.lit(""))).alias("rationale")))

    def problem(pair: Column) -> Column:
        r, item = pair["r"], pair["i"]
        wrong = F.coalesce(extraction_problem(r["status"], F.nullif(r["rendering"], F.lit("")), item["target_paragraph"]), F.when(~F.coalesce(r["confidence"].between(0, 1), F.lit(False)), "confidence"))
        return F.when(wrong.isNotNull(), F.concat(wrong, F.lit(": "), r["occurrence_id"]))

    faults = F.filter(F.transform(F.zip_with(clean, items, lambda r, i: F.struct(r.alias("r"), i.alias("i"))), problem), lambda p: p.isNotNull())
    why = F.when(rows.isNull(), "no results").when(~F.coalesce(ids(rows) == ids(items), F.lit(False)), "ids are not those asked for, in their order").otherwise(F.get(faults, F.lit(0)))
    return F.struct(why.alias("problem"), F.when(why.isNull(), clean).alias("rows"))


def planner_answer(answer: Column, size: Column) -> Column:
    """struct<problem, rows> of an answer to items 0 to size - 1, in their order: each once, with a canonical rendering without Latin words, scope and rationale.

    Variants lose what is empty, equal to the canonical rendering or there already; what is left needs a condition, or
    a known risk and its reason. The first fault names the problem; rows are null then.
    """
    rows = F.sort_array(F.filter(_results(answer, PLANNED), lambda r: r["item_id"].isNotNull()))
    ids = F.transform(rows, lambda r: r["item_id"])
    text = lambda x: F.btrim(F.coalesce(x, F.lit("")))
    latin = t.disallowed_latin

    def tidy(r: Column) -> Column:
        canonical = text(r["canonical_translation"])

        def variants(array: Column, make) -> Column:
            made = F.filter(F.transform(F.coalesce(array, F.slice(array, 1, 0)), make), lambda v: (v["rendering"] != "") & (v["rendering"] != canonical))
            return F.filter(made, lambda v, i: ~F.exists(F.slice(made, F.lit(1), i), lambda o: o["rendering"] == v["rendering"]))

        allowed = variants(r["allowed_variants"], lambda v: F.struct(text(v["rendering"]).alias("rendering"), text(v["condition"]).alias("condition")))
        risky = variants(r["risky_variants"], lambda v: F.struct(text(v["rendering"]).alias("rendering"), F.upper(text(v["risk_type"])).alias("risk_type"), text(v["reason"]).alias("reason")))
        return F.struct(r["item_id"].alias("item_id"), canonical.alias("canonical"), text(r["legal_scope_summary"]).alias("scope"), F.coalesce(allowed, F.expr("cast(array() as array<struct<rendering:string,condition:string>>)")).alias("allowed"), F.coalesce(risky, F.expr("cast(array() as array<struct<rendering:string,risk_type:string,reason:string>>)")).alias("risky"), r["confidence"].alias("confidence"), text(r["rationale"]).alias("rationale"))

    def problem(r: Column) -> Column:
        why = (
            F.when(r["canonical"] == "", "canonical").when(latin(r["canonical"]), "Latin words").when((r["scope"] == "") | (r["rationale"] == ""), "scope or rationale").when(~F.coalesce(r["confidence"].between(0, 1), F.lit(False)), "confidence")
            .when(F.exists(r["allowed"], lambda v: latin(v["rendering"])), "Latin words in a variant").when(F.exists(r["allowed"], lambda v: v["condition"] == ""), "a variant without a condition")
            .when(F.exists(r["risky"], lambda v: ~v["risk_type"].isin(*RISKS)), "risk type").when(F.exists(r["risky"], lambda v: v["reason"] == ""), "a risk without a reason")
        )
        return F.when(why.isNotNull(), F.concat(why, F.lit(": "), r["item_id"].cast("string")))

    clean = F.transform(rows, tidy)
    wanted = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    why = F.when(rows.isNull(), "no results").when(~F.coalesce(ids == wanted, F.lit(False)), "ids").otherwise(F.get(F.filter(F.transform(clean, problem), lambda p: p.isNotNull()), F.lit(0)))
    return F.struct(why.alias("problem"), F.when(why.isNull(), clean).alias("rows"))
