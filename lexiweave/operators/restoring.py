"""Tokens in model output: wording written beside them, restoration with spans, and the counts of a controlled run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .controls import TOKEN

CONTEXT = 28

# Words before an alias, quotation marks, words that introduce a definition, and a sentence end before a quotation mark.
ALIAS_WORD = "(?:即|即为|简称|下称|以下简称|称为)?"
QUOTES = "[‘’'\"“”]*"
DEFINITION_CUE = "(?i)(?:shall\\s+mean|means?|是指|指的是|应指|含义|以下简称|下称)"
QUOTE_AFTER_STOP = "[。.;；：:]\\s*[‘’'\"“”]"

# Names of the counts of a run, with the column that each sums.
SUMS = {
    "controlled_term_occurrences": "controlled_term_occurrence_count", "hard_controlled_term_occurrences": "hard_controlled_term_occurrence_count",
    "soft_controlled_term_occurrences": "soft_controlled_term_occurrence_count", "excluded_term_occurrences": "excluded_term_occurrence_count",
    "generation_retries": "generation_retry_count", "glossary_compliance_retries": "glossary_compliance_retry_count",
    "placeholder_regeneration_attempts": "placeholder_regeneration_attempts", "placeholder_legacy_repair_attempts": "placeholder_legacy_repair_attempts",
    "placeholder_semantic_verifier_calls": "placeholder_semantic_verifier_calls", "placeholder_contextual_omission_occurrences": "placeholder_contextual_omission_count",
    "definition_alias_normalized_occurrences": "definition_alias_normalized_occurrence_count", "legitimate_definition_repetition_pairs": "legitimate_definition_repetition_count",
    "max_tokens_escalations": "max_tokens_escalations",
}
# Counts of rows in which a summed column is above zero, and counts by strategy and by a rejection's stage.
POSITIVE = {
    "placeholder_contextual_omission_paragraphs": "placeholder_contextual_omission_count",
    "definition_alias_normalized_paragraphs": "definition_alias_normalized_occurrence_count",
    "legitimate_definition_repetition_paragraphs": "legitimate_definition_repetition_count",
}
STRATEGIES = {
    "placeholder_exact_paragraphs": "placeholder_exact", "placeholder_retry_success_paragraphs": "placeholder_retry_exact",
    "placeholder_repaired_paragraphs": "placeholder_repaired", "conditional_glossary_paragraphs": "conditional_glossary", "uncontrolled_paragraphs": "uncontrolled",
}
STAGES = {
    "placeholder_inventory_rejections": "inventory", "placeholder_context_rejections": "context", "placeholder_restored_rejections": "restored",
    "placeholder_semantic_rejections": "semantic", "placeholder_request_or_processing_rejections": "request_or_processing",
}


def quoted(text: Column) -> Column:
    """A pattern that a text alone matches, whatever is in it."""
    return F.regexp_replace(text, "([\\\\\\[\\](){}.*+?^$|])", "\\\\$1")


def pieces(text: Column, token: Column) -> Column:
    """The text cut at every place of a token, itself left out."""
    return F.split(text, quoted(token), -1)


def alias_rules(constraints: Column) -> Column:
    """What collapse_aliases() tries, in order: the pass, the token, its approved renderings from the longest, both directions.

    Each rule has a pattern whose groups are the text before, the match, the rendering with its title marks, and the text after.
    """
    whole = lambda *parts: F.concat(F.lit("(?sU)^(.*?)("), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit(")(.*)$"))
    defined = F.transform(F.filter(constraints, lambda c: c["usage"] == "DEFINIENDUM"), lambda c: c["term_id"])
    titled = lambda r: F.startswith(r["rendering"], F.lit("《")) & F.endswith(r["rendering"], F.lit("》"))
    name = lambda r: F.upper(F.when(r["kind"] == "canonical", "canonical").otherwise("allowed_variant"))
    # What stands between a full form and its alias.
    gap, opened, closed = "\\s*", "\\s*[（(]\\s*" + ALIAS_WORD + "\\s*" + QUOTES + "\\s*", "\\s*" + QUOTES + "\\s*[）)]"

    def of(step: int, keep, forms) -> Column:
        def rules(c: Column) -> Column:
            known = F.array_sort(F.filter(c["renderings"], lambda r: (r["kind"] != "risky") & (r["rendering"] != "") & keep(r)), lambda a, b: F.length(b["rendering"]) - F.length(a["rendering"]))

            def pair(r: Column) -> Column:
                body = quoted(r["rendering"])
                full = F.concat(F.lit("("), F.when(titled(r), body).otherwise(F.concat(F.lit("《\\s*"), body, F.lit("\\s*》|"), body)), F.lit(")"))
                made = [F.struct(F.lit(step).alias("step"), c["placeholder"].alias("placeholder"), c["term_id"].alias("term_id"), r["rendering"].alias("rendering"), label.alias("pattern"), pattern.alias("regex")) for label, pattern in forms(full, quoted(c["placeholder"]), name(r))]
                return F.array(*made)

            return F.flatten(F.transform(known, pair))

        wanted = F.filter(constraints, lambda c: F.array_contains(defined, c["term_id"])) if step < 3 else constraints  # the second follows an event of the first
        return F.flatten(F.transform(wanted, rules))

    every = lambda r: F.lit(True)
    wrapped = lambda f, t, n: [(F.concat(n, F.lit("_THEN_ALIAS")), whole(f, opened, t, closed)), (F.concat(F.lit("ALIAS_THEN_"), n), whole(t, opened, f, closed))]
    sibling = lambda f, t, n: [(F.concat(F.lit("SIBLING_ALIAS_BEFORE_"), n), whole(t, gap, f)), (F.concat(F.lit("SIBLING_ALIAS_AFTER_"), n), whole(f, gap, t))]
    marked = lambda f, t, n: [(F.concat(F.lit("TITLE_MARKED_"), n, F.lit("_BEFORE_PLACEHOLDER")), whole(f, gap, t)), (F.concat(F.lit("PLACEHOLDER_BEFORE_TITLE_MARKED_"), n), whole(t, gap, f))]
    return F.concat(of(1, every, wrapped), of(2, every, sibling), of(3, titled, marked))


def collapse_aliases(text: Column, constraints: Column) -> Column:
    """The text without tokens that only repeat a rendering written out beside them, and an event for each token taken out.

    constraints: array of (placeholder, term_id, usage, renderings). Tokens of a term that is defined here go where a rendering
    and the token stand as full form and alias in brackets; then further tokens of such a term right beside a rendering; then
    tokens beside a rendering that has its own title marks. A token is taken out once. One fold over alias_rules().
    """
    start = F.struct(text.alias("text"), F.expr("cast(array() as array<struct<placeholder:string,term_id:string,rendering:string,pattern:string,context:string>>)").alias("events"))

    def step(acc: Column, r: Column) -> Column:
        done = F.exists(acc["events"], lambda e: e["placeholder"] == r["placeholder"])
        settled = (r["step"] != 2) | F.exists(acc["events"], lambda e: e["term_id"] == r["term_id"])
        part = lambda k: F.call_function("regexp_extract", acc["text"], r["regex"], F.lit(k))
        event = F.struct(r["placeholder"].alias("placeholder"), r["term_id"].alias("term_id"), r["rendering"].alias("rendering"), r["pattern"].alias("pattern"), F.concat(F.right(part(1), F.lit(24)), part(2), F.left(part(4), F.lit(24))).alias("context"))
        after = F.struct(F.concat(part(1), part(3), part(4)).alias("text"), F.concat(acc["events"], F.array(event)).alias("events"))
        return F.when(~done & settled & F.rlike(acc["text"], r["regex"]), after).otherwise(acc)

    return F.aggregate(alias_rules(constraints), start, step)


def context_issues(text: Column, constraints: Column, window: int = CONTEXT) -> Column:
    """Faults beside the tokens that a text holds exactly once, in the order of constraints.

    constraints: array of (placeholder, term_id, canonical, renderings: array of (rendering, kind)). A known rendering that
    ends right before a token or starts right after it would come out twice; the first such rendering counts, the left side
    first. A canonical rendering in title marks whose token stands in title marks would come out in two pairs of them.
    Comparison is without spaces and punctuation. Null text or constraints: null.
    """

    def sides(c: Column) -> Column:
        ends = lambda cut: F.struct(F.size(cut).alias("n"), F.right(F.element_at(cut, 1), F.lit(window)).alias("left"), F.left(F.element_at(cut, -1), F.lit(window)).alias("right"))
        return t.let(pieces(text, c["placeholder"]), ends)

    def of(c: Column, at: Column) -> Column:
        left, right, a, b = (at[n] for n in ("left", "right", "a", "b"))
        around = F.concat(left, c["placeholder"], right)
        side = lambda x: F.when(x == "", None).when(F.endswith(a, x), "LEFT").when(F.startswith(b, x), "RIGHT")

        def issue(name: str, r: Column | None, side: Column) -> Column:
            none = F.lit(None).cast("string")
            return F.struct(
                F.lit("ERROR").alias("severity"), F.lit(name).alias("issue_type"), c["placeholder"].alias("placeholder"), c["term_id"].alias("term_id"),
                (none if r is None else r["rendering"]).alias("rendering"), (none if r is None else r["kind"]).alias("rendering_kind"), side.alias("side"), around.alias("local_context"),
            )

        beside = F.transform(c["renderings"], lambda r: F.struct(r.alias("r"), t.let(t.compact(r["rendering"]), side).alias("side")))
        wrapped = F.transform(F.slice(F.filter(beside, lambda x: x["side"].isNotNull()), 1, 1), lambda x: issue("PLACEHOLDER_WRAPPER_CONTAMINATION", x["r"], x["side"]))
        titled = F.rlike(c["canonical"], F.lit("(?s)^《.*》$")) & F.rlike(left, F.lit("(?U)《\\s*$")) & F.rlike(right, F.lit("(?U)^\\s*》"))
        marks = F.filter(F.array(issue("REDUNDANT_TITLE_MARK_WRAPPER", None, F.lit(None).cast("string"))), lambda _: F.coalesce(titled, F.lit(False)))
        return F.concat(wrapped, marks)

    # A token that is not there exactly once is left out before anything else is looked at.
    placed = F.filter(F.transform(constraints, lambda c: F.struct(c.alias("c"), sides(c).alias("at"))), lambda p: p["at"]["n"] == 2)
    bare = F.transform(placed, lambda p: F.struct(p["c"].alias("c"), F.struct(p["at"]["left"].alias("left"), p["at"]["right"].alias("right"), t.compact(p["at"]["left"]).alias("a"), t.compact(p["at"]["right"]).alias("b")).alias("at")))
    found = F.flatten(F.transform(bare, lambda p: of(p["c"], p["at"])))
    return F.when(text.isNotNull(), found)


def restore_with_spans(text: Column, constraints: Column, strict: bool = False) -> Column:
    """The text with canonical renderings for its tokens, where each of them lies in it, and what is wrong.

    constraints: array of (placeholder, term_id, canonical). problem is CONFLICT if a placeholder has two renderings, LEFTOVER
    if a token stays, else null; strict raises an error instead. Offsets are in characters of the restored text.
    """
    found = F.concat(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array(F.lit("")))
    # A token without a constraint gives null and stays as it is.
    hit = lambda tok: F.try_element_at(F.filter(constraints, lambda c: c["placeholder"] == tok), F.lit(-1))
    part = lambda gap, tok: t.let(hit(tok), lambda c: F.struct(gap.alias("gap"), tok.alias("token"), F.coalesce(c["canonical"], tok).alias("value"), c.alias("c")))
    joined = lambda parts: F.struct(parts.alias("parts"), F.array_join(F.flatten(F.transform(parts, lambda p: F.array(p["gap"], p["value"]))), "").alias("out"))
    made = t.let(F.zip_with(F.split(text, TOKEN, -1), found, part), joined)
    return t.let(made, lambda m: _restored(m["parts"], m["out"], constraints, strict))


def _restored(parts: Column, out: Column, constraints: Column, strict: bool) -> Column:
    none = F.expr("cast(array() as array<struct<placeholder:string,term_id:string,canonical:string,start:int,end:int>>)")
    start = lambda acc, p: acc["at"] + F.length(p["gap"])
    span = lambda acc, p: F.struct(p["token"].alias("placeholder"), p["c"]["term_id"].alias("term_id"), p["value"].alias("canonical"), start(acc, p).alias("start"), (start(acc, p) + F.length(p["value"])).alias("end"))
    step = lambda acc, p: F.struct((start(acc, p) + F.length(p["value"])).alias("at"), F.when(p["c"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span(acc, p)))).alias("spans"))
    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    pairs = F.array_distinct(F.transform(constraints, lambda c: F.struct(c["placeholder"].alias("p"), c["canonical"].alias("v"))))
    conflict = F.size(pairs) > F.size(F.array_distinct(F.transform(constraints, lambda c: c["placeholder"])))
    problem = F.when(conflict, "CONFLICT").when(F.rlike(out, F.lit(TOKEN)), "LEFTOVER")
    if strict:
        problem = F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("restoration: "), problem)).cast("string"))
    return F.struct(out.alias("text"), spans.alias("spans"), problem.alias("problem"))


def between(text: Column, start: Column, end: Column) -> Column:
    """Characters from start to end, both held inside the text."""
    a = F.greatest(F.lit(0), start)
    return F.substring(text, a + 1, F.greatest(F.lit(0), F.least(F.length(text), end) - a))


def restored_issues(text: Column, spans: Column, renderings: Column, window: int = CONTEXT) -> Column:
    """Faults of a restored text around the spans that restore_with_spans() reports, each once.

    A canonical rendering that touches a span but is not a span itself, two spans of a term that touch (white space aside),
    title marks in title marks, a risky rendering beside a span, and as a warning 期 before 期间; a token that stayed.
    renderings: array of (term_id, rendering, kind); only those of kind risky count. Null text or spans: null.
    """
    touch = lambda a, b: F.rlike(between(text, a["end"], b["start"]), F.lit("(?U)^\\s*$")) & (a["end"] <= b["start"])
    near = lambda a, b: touch(a, b) | touch(b, a)
    around = lambda a, b: between(text, F.least(a["start"], b["start"]) - window, F.greatest(a["end"], b["end"]) + window)

    def places(s: Column) -> Column:
        """Where the canonical rendering of a span stands, overlaps left out: from the lengths of the pieces between."""
        size = F.length(s["canonical"])
        lengths = t.let(pieces(text, s["canonical"]), lambda cut: F.transform(F.slice(cut, 1, F.greatest(F.lit(0), F.size(cut) - 1)), F.length))
        last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))
        step = lambda acc, n: F.concat(acc, F.array(F.struct((last(acc) + n).alias("start"), (last(acc) + n + size).alias("end"))))
        return F.aggregate(lengths, F.expr("cast(array() as array<struct<start:int,end:int>>)"), step)

    def of(s: Column) -> Column:
        same = F.filter(spans, lambda o: (o["term_id"] == s["term_id"]) & (o["canonical"] == s["canonical"]))
        return t.let(same, lambda x: around_span(s, x))

    def around_span(s: Column, same: Column) -> Column:
        none = F.lit(None).cast("string")
        issue = lambda name, local, rendering=none, severity="ERROR": F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("issue_type"), s["term_id"].alias("term_id"), s["placeholder"].alias("placeholder"), rendering.alias("rendering"), local.alias("local_context"))
        left, right = between(text, s["start"] - window, s["start"]), between(text, s["end"], s["end"] + window)
        a, b, here = t.compact(left), t.compact(right), between(text, s["start"] - window, s["end"] + window)
        extra = F.filter(places(s), lambda p: ~F.exists(same, lambda o: (p["start"] < o["end"]) & (o["start"] < p["end"])))
        own = t.compact(s["canonical"])
        risky = F.transform(F.filter(renderings, lambda r: (r["kind"] == "risky") & (r["term_id"] == s["term_id"])), lambda r: r["rendering"])
        beside = F.filter(risky, lambda r: (t.compact(r) != "") & (own != "") & (t.compact(r) != own) & (F.endswith(a, t.compact(r)) | F.startswith(b, t.compact(r))))
        titled = F.startswith(s["canonical"], F.lit("《")) & F.endswith(s["canonical"], F.lit("》")) & (F.rlike(left, F.lit("(?U)《\\s*$")) | F.rlike(right, F.lit("(?U)^\\s*》")))
        once = lambda condition, x: F.filter(F.array(x), lambda _: condition)
        found = F.concat(
            F.transform(F.slice(F.filter(extra, lambda p: near(p, s)), 1, 1), lambda p: issue("DUPLICATED_CANONICAL_RENDERING", around(p, s), s["canonical"])),
            F.transform(F.slice(F.filter(same, lambda o: (o["start"] != s["start"]) & near(o, s)), 1, 1), lambda o: issue("ADJACENT_RESTORED_CANONICAL_DUPLICATION", around(o, s), s["canonical"])),
            once(titled, issue("NESTED_TITLE_MARKS", here)),
            F.transform(F.slice(beside, 1, 1), lambda r: issue("RISKY_AND_CANONICAL_ADJACENCY", here, r)),
            once(F.endswith(s["canonical"], F.lit("期")) & F.startswith(right, F.lit("期间")), issue("POSSIBLE_PERIOD_SUFFIX_REDUNDANCY", here, severity="WARNING")),
        )
        return F.when(s["canonical"] != "", found).otherwise(F.slice(found, 1, 0))

    none = F.lit(None).cast("string")
    token = F.regexp_substr(text, F.lit(TOKEN))
    stayed = F.struct(F.lit("ERROR").alias("severity"), F.lit("UNRESTORED_PLACEHOLDER").alias("issue_type"), none.alias("term_id"), none.alias("placeholder"), none.alias("rendering"), token.alias("local_context"))
    return F.array_distinct(F.concat(F.filter(F.array(stayed), lambda x: x["local_context"].isNotNull()), F.flatten(F.transform(spans, of))))


def definition_repetitions(text: Column, spans: Column, window: int = CONTEXT) -> Column:
    """Neighbouring spans of a term that a definition explains: a defining word around them, or a sentence's end and a quotation between."""
    reach = max(96, 4 * window)

    def of(s: Column) -> Column:
        later = F.filter(spans, lambda o: (o["term_id"] == s["term_id"]) & (o["canonical"] == s["canonical"]) & (o["start"] >= s["end"]))
        pair = F.transform(F.slice(F.sort_array(F.transform(later, lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"), o["placeholder"].alias("placeholder")))), 1, 1), lambda o: F.struct(s["term_id"].alias("term_id"), s["placeholder"].alias("left_placeholder"), o["placeholder"].alias("right_placeholder"), between(text, s["start"] - 12, o["end"] + 40).alias("local_context"), between(text, s["end"], o["start"]).alias("gap")))
        return F.filter(pair, lambda p: (F.length(p["gap"]) <= reach) & (F.rlike(p["local_context"], F.lit(DEFINITION_CUE)) | F.rlike(p["gap"], F.lit(QUOTE_AFTER_STOP))))

    return F.flatten(F.transform(F.filter(spans, lambda s: s["canonical"] != ""), of))


def control_statistics(paragraphs: DataFrame, translations: DataFrame, errors: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of a controlled run, a row for each of the keys in paragraphs.

    translations holds the columns named in SUMS (left out or null: 0), constraint_strategy_used, constraint_mode,
    constraint_compliance, restored (taken over from an earlier run), placeholder_fallback_used, placeholder_early_fallback, resolution_status and
    placeholder_quality_gate_rejections, an array of structs with stage. Each relation is aggregated before the joins.
    """
    have = set(translations.columns)
    value = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in have else F.lit(False)
    rejected = "placeholder_quality_gate_rejections"
    at = lambda stage: F.coalesce(F.size(F.filter(rejected, lambda r: r["stage"] == stage)), F.lit(0)) if rejected in have else F.lit(0)
    total = lambda x: F.sum(x.cast("bigint"))
    fallback, complies = flag("placeholder_fallback_used"), flag("constraint_compliance")
    columns = {"translated_paragraphs": F.count("*"), "restored_paragraphs": F.count_if(flag("restored"))}
    columns |= {name: total(value(c)) for name, c in SUMS.items()}
    columns["placeholder_retries"] = columns["generation_retries"]
    columns |= {name: F.count_if(value(c) > 0) for name, c in POSITIVE.items()}
    columns |= {name: F.count_if(text("constraint_strategy_used") == s) for name, s in STRATEGIES.items()}
    columns["placeholder_quality_gate_rejections"] = total(F.greatest(F.size(rejected), F.lit(0)) if rejected in have else F.lit(0))
    columns |= {name: total(F.greatest(at(s), F.lit(0))) for name, s in STAGES.items()}
    columns |= {
        "placeholder_early_fallback_paragraphs": F.count_if(flag("placeholder_early_fallback")),
        "placeholder_fallback_paragraphs": F.count_if(fallback),
        "placeholder_fallback_noncompliance_paragraphs": F.count_if(fallback & ~complies),
        "placeholder_fallback_verified_paragraphs": F.count_if(text("resolution_status") == "glossary_fallback_verified"),
        "glossary_noncompliance_paragraphs": F.count_if((text("constraint_mode") == "glossary") & ~complies),
        "unresolved_paragraphs": F.count_if(text("resolution_status").isin("glossary_fallback_noncompliant", "noncompliant")),
    }
    done = translations.groupBy(*keys).agg(*[x.alias(n) for n, x in columns.items()])
    failed = errors.groupBy(*keys).agg(F.count_distinct("paragraph_id").alias("failed_paragraphs"))
    rows = paragraphs.groupBy(*keys).agg(F.count("*").alias("total_paragraphs")).join(done, keys, "left").join(failed, keys, "left")
    rows = rows.fillna(0, [*columns, "failed_paragraphs"])
    return rows.withColumn("remaining_paragraphs", F.greatest(F.lit(0), F.col("total_paragraphs") - F.col("translated_paragraphs")))
