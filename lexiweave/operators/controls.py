"""Controlled translation: placeholders put in and taken out, glossary compliance, routing of occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

# Words that mark a rendering as informal, and the form of a token.
INFORMAL = "(?i)非正式|口语|内部沟通|内部文件|informal|oral"
TOKEN = "【术语[0-9]+(?:_[0-9]+)?】"


def placeholder(term_id: Column) -> Column:
    """The token of a term: the digits of its id (four at least), or a number from its hash."""
    digits = F.regexp_replace(term_id, "[^0-9]", "")
    digits = F.when(digits == "", F.conv(F.substring(F.sha2(term_id, 256), 1, 8), 16, 10)).otherwise(digits)
    return F.concat(F.lit("【术语"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits), F.lit("】"))


def route(occurrences: DataFrame) -> DataFrame:
    """HARD and SOFT occurrences (no eligibility counts as HARD); SOFT ones over a HARD one are left out."""
    rows = occurrences.withColumn("control", F.upper(F.coalesce("control_eligibility", F.lit("HARD")))).filter("control in ('HARD', 'SOFT')")
    # A paragraph's hard spans are few, so an array beside each row replaces a range join.
    span = F.when(F.col("control") == "HARD", F.struct(F.col("char_start").alias("s"), F.col("char_end").alias("e")))
    rows = rows.withColumn("_hard", F.collect_list(span).over(Window.partitionBy("document_id", "paragraph_id")))
    over = F.exists("_hard", lambda h: (h["s"] < F.col("char_end")) & (F.col("char_start") < h["e"]))
    return rows.filter((F.col("control") == "HARD") | ~over).drop("_hard")


def without_overlaps(spans: DataFrame) -> DataFrame:
    """Of overlapping spans of a paragraph the longest stay, then those that start first."""
    size = F.col("char_end") - F.col("char_start")
    rows = spans.groupBy("document_id", "paragraph_id").agg(F.array_sort(F.collect_list(F.struct((-size).alias("_order"), "char_start", "char_end", F.struct(*spans.columns).alias("row")))).alias("_spans"))
    meets = lambda x: lambda y: (y["char_start"] < x["char_end"]) & (x["char_start"] < y["char_end"])
    kept = F.aggregate("_spans", F.slice("_spans", F.lit(1), F.lit(0)), lambda acc, x: F.when(F.exists(acc, meets(x)), acc).otherwise(F.concat(acc, F.array(x))))
    return rows.select(F.inline(F.transform(kept, lambda x: x["row"])))


def number_placeholders(spans: DataFrame) -> DataFrame:
    """Spans of a paragraph without overlaps, with their tokens: numbered where a term occurs more than once."""
    spans = without_overlaps(spans)
    w = Window.partitionBy("document_id", "paragraph_id", "term_id")
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy("char_start"))
    base = placeholder(F.col("term_id"))
    numbered = F.concat(F.left(base, F.length(base) - 1), F.lit("_"), F.lpad(k.cast("string"), 2, "0"), F.lit("】"))
    return spans.withColumn("_n", n).withColumn("placeholder", F.when(F.col("_n") == 1, base).otherwise(numbered)).drop("_n")


def inject(paragraphs: DataFrame, spans: DataFrame, carry: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Paragraphs with tokens for the spans, put together from the gaps between them in one pass; carry and keep name further columns of spans (in constraints) and of paragraphs."""
    item = F.struct("char_start", "char_end", "placeholder", "canonical", *carry)
    grouped = spans.groupBy("document_id", "paragraph_id").agg(F.array_sort(F.collect_list(item)).alias("constraints"))
    rows = paragraphs.join(grouped, ["document_id", "paragraph_id"], "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, x["char_start"] - a["at"]), x["placeholder"]).alias("out"), x["char_end"].alias("at"))
    done = F.aggregate("constraints", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return rows.select("document_id", "paragraph_id", F.coalesce(done, "text").alias("protected"), "constraints", *keep)


def restore(protected: Column, constraints: Column) -> Column:
    """The text with canonical renderings for its tokens: token by token, longest names cannot clash as all end alike."""
    return F.aggregate(F.coalesce(constraints, F.expr("cast(array() as array<struct<char_start:int,char_end:int,placeholder:string,canonical:string>>)")), protected, lambda text, x: F.replace(text, x["placeholder"], x["canonical"]))


def leftover(text: Column) -> Column:
    return F.rlike(text, F.lit(TOKEN))


def approved_renderings(canonical: Column, allowed: Column, short_forms: Column) -> Column:
    """Canonical rendering, allowed variants but informal ones, and short forms; each once, none empty."""
    formal = F.transform(F.filter(F.coalesce(allowed, F.expr("cast(array() as array<struct<rendering:string,condition:string>>)")), lambda v: ~F.rlike(F.coalesce(v["condition"], F.lit("")), F.lit(INFORMAL))), lambda v: F.btrim(v["rendering"]))
    return F.filter(F.array_distinct(F.concat(F.array(F.btrim(canonical)), formal, F.coalesce(short_forms, F.expr("cast(array() as array<string>)")))), lambda x: F.coalesce(x != "", F.lit(False)))


def compliance(text: Column, canonical: Column, approved: Column) -> Column:
    return F.when(F.contains(text, canonical), "EXACT_CANONICAL").when(F.exists(approved, lambda a: F.contains(text, a)), "APPROVED_VARIANT").otherwise("MISSING_REQUIRED_RENDERING")


def all_renderings(canonical: Column, allowed: Column, risky: Column) -> Column:
    """Every known rendering with where it comes from."""
    kind = lambda name: lambda v: F.struct(v["rendering"].alias("rendering"), F.lit(name).alias("kind"))
    return F.concat(F.array(F.struct(canonical.alias("rendering"), F.lit("canonical").alias("kind"))), F.transform(allowed, kind("allowed")), F.transform(risky, kind("risky")))


def resolution(attempts: Column, fallback: Column, failed: Column) -> Column:
    return F.when(failed, "UNRESOLVED").when(fallback, "GLOSSARY_FALLBACK").when(attempts > 1, "REPAIRED").otherwise("FIRST_PASS")


def strategy(hard: Column, soft: Column, mode: Column, fallback: Column, attempt: Column, repaired: Column) -> Column:
    """How a paragraph came to its translation, one of seven ways. hard and soft: whether it has such terms; attempt from 0."""
    return (
        F.when(~hard, F.when(soft, "conditional_glossary").otherwise("uncontrolled")).when(mode == "glossary", "glossary").when(fallback, "glossary_fallback")
        .when(attempt == 0, "placeholder_exact").when(repaired, "placeholder_repaired").otherwise("placeholder_retry_exact")
    )


def resolution_status(fallback: Column, complies: Column) -> Column:
    return F.when(fallback, F.when(complies, "glossary_fallback_verified").otherwise("glossary_fallback_noncompliant")).otherwise(F.when(complies, "verified").otherwise("noncompliant"))


def renderings(canonical: Column, allowed: Column, short: Column, risky: Column, with_risky: bool = True) -> Column:
    """Every known rendering with its kind, in this order, each once for a kind, empty ones left out. allowed and risky: arrays of structs with rendering; short: of strings."""
    made = lambda kind: lambda x: F.struct(F.btrim(x).alias("rendering"), F.lit(kind).alias("kind"))
    texts = lambda a: F.transform(a, lambda v: v["rendering"])
    none = F.expr("cast(array() as array<string>)")
    parts = [F.transform(F.array(canonical), made("CANONICAL")), F.transform(F.coalesce(texts(allowed), none), made("ALLOWED_VARIANT")), F.transform(F.coalesce(short, none), made("SHORT_FORM"))]
    parts += [F.transform(F.coalesce(texts(risky), none), made("RISKY_VARIANT"))] if with_risky else []
    return F.filter(F.array_distinct(F.concat(*parts)), lambda r: F.coalesce(r["rendering"] != "", F.lit(False)))


def rejection_signature(stage: Column, missing: Column, duplicated: Column, unknown: Column, issues: Column, verdict: Column, error: Column) -> Column:
    """A hash that two rejections share if the same stage found the same faults, whatever their order.

    inventory: missing (array), duplicated and unknown (token to count); context and restored: issues (issue_type, term_id,
    placeholder, side, severity), errors only; semantic: verdict, see semantic_verdict(); any other stage: error. Nulls count as none.
    """
    counts = lambda m: F.array_sort(F.map_entries(F.coalesce(m, F.expr("cast(map() as map<string,int>)"))))
    names = F.array_sort(F.coalesce(missing, F.expr("cast(array() as array<string>)")))
    text = lambda x: F.coalesce(x, F.lit(""))
    errors = F.transform(F.filter(issues, lambda i: F.coalesce(i["severity"] == "ERROR", F.lit(False))), lambda i: F.struct(i["issue_type"].alias("a"), text(i["term_id"]).alias("b"), text(i["placeholder"]).alias("c"), text(i["side"]).alias("d")))
    judged = F.struct(*[verdict[f].alias(f) for f in ("adequacy", "term_semantics", *FLAGS)], F.array_sort(verdict["problematic_terms"]).alias("terms"))
    payload = (
        F.when(stage == "inventory", F.to_json(F.struct(names.alias("m"), counts(duplicated).alias("d"), counts(unknown).alias("u"))))
        .when(stage.isin("context", "restored"), F.to_json(F.struct(F.array_sort(errors).alias("i"))))
        .when(stage == "semantic", F.to_json(judged))
        .otherwise(F.to_json(F.struct(error.alias("e"))))
    )
    return F.sha2(F.concat_ws("\n", stage, payload), 256)


def early_fallback(rejections: DataFrame, limit: int) -> DataFrame:
    """Each paragraph's rejections (attempt, signature), and the attempt at which one signature came for the limit-th time.

    0 where none did; a limit of 0 never gives up early.
    """
    k = F.row_number().over(Window.partitionBy("document_id", "paragraph_id", "signature").orderBy("attempt"))
    rows = rejections.withColumn("_hit", F.when((k == limit) & F.lit(limit > 0), F.col("attempt")))
    out = rows.groupBy("document_id", "paragraph_id").agg(F.count("*").alias("rejections"), F.coalesce(F.min("_hit"), F.lit(0)).alias("fallback_attempt"))
    return out.withColumn("early_fallback", F.col("fallback_attempt") > 0)


# The faults a semantic verifier can report.
FLAGS = ("unsupported_addition", "meaning_omission", "unnatural_attachment", "broken_legal_logic")


def semantic_verdict(answer: Column) -> Column:
    """A verifier's JSON answer as a struct; passed if both judgments are PASS and no fault is set. Null without a JSON object.

    A judgment left out is FAIL and a fault left out is set; null, false, zero and empty values are not set, all others are.
    """
    empty = '^\\{"v":(null|false|""|\\[\\]|\\{\\}|-?0(\\.0+)?([eE][-+]?[0-9]+)?)\\}$'
    grades = ("adequacy", "term_semantics")

    def read(found: Column) -> Column:
        part = lambda f, kind: F.try_variant_get(found, f"$.{f}", kind)
        raw = lambda f: F.to_json(F.struct(part(f, "variant").alias("v")))
        grade = lambda f: F.when(part(f, "variant").isNull(), "FAIL").otherwise(F.upper(F.coalesce(part(f, "string"), F.lit("NONE"))))
        is_set = lambda f: part(f, "variant").isNull() | ~F.rlike(raw(f), F.lit(empty))
        terms = F.coalesce(part("problematic_terms", "array<string>"), F.expr("cast(array() as array<string>)"))
        fields = F.struct(*[grade(f).alias(f) for f in grades], *[is_set(f).alias(f) for f in FLAGS], terms.alias("problematic_terms"), F.coalesce(part("rationale", "string"), F.lit("")).alias("rationale"))
        return F.when(F.coalesce(F.startswith(F.schema_of_variant(found), F.lit("OBJECT")), F.lit(False)), fields)

    def judged(v: Column) -> Column:
        passed = (v["adequacy"] == "PASS") & (v["term_semantics"] == "PASS")
        for f in FLAGS:
            passed = passed & ~v[f]
        return F.when(v.isNotNull(), F.struct(*[v[f].alias(f) for f in (*grades, *FLAGS, "problematic_terms", "rationale")], passed.alias("passed")))

    return F.when(answer.isNotNull(), t.let(t.let(F.try_parse_json(answer), read), judged))
