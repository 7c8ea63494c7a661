"""Controlled translation as a loop: ask, check, ask again or fall back, until no paragraph is open.

A round is one pass over the open paragraphs: requests are written from their state, the answers are stored as Parquet
before anything else is done with them, and checks that are column expressions (tokens, wording beside them, the
restored text, a verifier's verdict) accept a translation or say at which stage it failed. Open paragraphs are fewer
each round; only their number reaches the driver. A run that was broken off goes on from the stored rounds, and
paragraphs done by an earlier run with the same signature are left out by an anti join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from . import controls as c
from . import restoring as rs
from .coverage import pending
from .providers import ChatProvider, answered

KEY = ("document_id", "paragraph_id")
# The most tokens a request may ask for, and the least it grows by.
MOST_TOKENS, LEAST_GROWTH = 8192, 1024
CONSTRAINT = "struct<placeholder:string,term_id:string,source_term:string,canonical:string,approved:array<string>,usage:string,renderings:array<struct<rendering:string,kind:string>>>"
ISSUES = "array<struct<severity:string,issue_type:string,placeholder:string,term_id:string,side:string>>"
REJECTION = "struct<attempt:int,stage:string,signature:string>"


@dataclass(frozen=True)
class Policy:
    """How a paragraph is translated. mode: placeholder or glossary; repair: retry_then_fallback (always from the source) or llm_repair; verifier: never, retry (from the second attempt) or all."""

    mode: str = "placeholder"
    retries: int = 5
    repair: str = "retry_then_fallback"
    quality_gate: bool = True
    verifier: str = "retry"
    verifier_retries: int = 2
    repeat_limit: int = 2
    max_tokens: int = 2048


#: The settings that an ablation compares, each one change of the first.
ABLATIONS = {
    "full": Policy(), "no_quality_gate": Policy(quality_gate=False, verifier="never"), "no_verifier": Policy(verifier="never"),
    "llm_repair": Policy(repair="llm_repair"), "no_early_fallback": Policy(repeat_limit=0),
}


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def opening(paragraphs: DataFrame, policy: Policy) -> DataFrame:
    """The first state of each paragraph. paragraphs: document_id, paragraph_id, text, protected, constraints (array of CONSTRAINT), soft (array of strings)."""
    hard = F.coalesce("constraints", empty(CONSTRAINT))
    phase = F.when(F.size(hard) == 0, "plain").when(F.lit(policy.mode == "glossary"), "glossary").otherwise("placeholder")
    zero = F.lit(0)
    return paragraphs.select(
        *KEY, "text", F.coalesce("protected", "text").alias("protected"), hard.alias("constraints"), F.coalesce("soft", empty("string")).alias("soft"), phase.alias("phase"), zero.alias("attempt"), F.lit(policy.max_tokens).alias("max_tokens"),
        *[zero.alias(n) for n in ("requests", "verifier_calls", "regenerations", "repairs", "escalations", "last_attempt")], F.lit(False).alias("early_fallback"), F.lit("").alias("best_output"), F.lit(2**31 - 1).alias("best_score"),
        F.lit(None).cast("string").alias("kept_output"), empty(REJECTION).alias("rejections"), F.lit(None).cast("string").alias("failure"),
    )


def request(policy: Policy) -> Column:
    """What a provider is asked, as JSON: task, attempt, the source (with tokens, or without), and the rules for its terms."""
    again, repairing = F.col("attempt") > 0, F.lit(policy.repair == "llm_repair") & (F.col("best_output") != "")
    task = F.when(F.col("phase") != "placeholder", F.col("phase")).when(again & repairing, "repair").otherwise("placeholder")
    rule = F.transform("constraints", lambda x: F.struct(x["placeholder"].alias("placeholder"), x["source_term"].alias("source_term"), x["canonical"].alias("canonical")))
    masked = F.col("phase") == "placeholder"
    return F.to_json(F.struct(
        *KEY, task.alias("task"), "attempt", F.when(masked, F.col("protected")).otherwise(F.col("text")).alias("source"), rule.alias("terms"), "soft",
        F.when(task == "repair", F.col("best_output")).alias("faulty"), F.when(again, F.try_element_at("rejections", F.lit(-1))["stage"]).alias("failed_at"),
    ))


def inventory(output: Column, constraints: Column, settled: Column) -> Column:
    """Tokens that are missing (but for settled ones), that came more than once (how often), and that are not asked for (how often)."""
    both = F.struct(F.regexp_extract_all(output, F.lit(c.TOKEN), F.lit(0)).alias("seen"), F.array_distinct(F.transform(constraints, lambda x: x["placeholder"])).alias("want"))
    return t.let(both, lambda x: _faults(x["seen"], x["want"], settled))


def _faults(seen: Column, want: Column, settled: Column) -> Column:
    counts = lambda names: F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.size(F.filter(seen, lambda s: s == n)))))
    twice = F.filter(want, lambda w: F.size(F.filter(seen, lambda s: s == w)) > 1)
    return F.struct(
        F.filter(want, lambda w: ~F.array_contains(seen, w) & ~F.array_contains(settled, w)).alias("missing"),
        counts(twice).alias("duplicated"), counts(F.array_except(F.array_distinct(seen), want)).alias("unknown"),
    )


def mismatch(found: Column) -> Column:
    total = lambda m, less: F.aggregate(F.map_values(m), F.lit(0), lambda a, n: a + n - less)
    return F.size(found["missing"]) + total(found["duplicated"], 1) + total(found["unknown"], 0)


def errors(issues: Column) -> Column:
    return F.exists(F.coalesce(issues, F.slice(issues, 1, 0)), lambda i: i["severity"] == "ERROR")


def checked(rows: DataFrame, policy: Policy, masked_rows: bool = True) -> DataFrame:
    """Answers with output, translation, the facts of each check, and the stage at which one fails (null: none so far)."""
    rows, clean = rows.withColumn("answer", t.clean_translation(F.col("answer"))), F.col("answer")
    rows = rows.withColumn("error", F.when(F.col("error").isNotNull(), F.col("error")).when(clean == "", "empty translation")).withColumn("output", F.when(F.col("error").isNull(), clean))
    if not masked_rows:  # a plan without the checks of tokens
        none = {"found": "struct<missing:array<string>,duplicated:map<string,int>,unknown:map<string,int>>", "beside": ISSUES, "after": ISSUES, "score": "int"}
        facts = {n: F.expr(f"cast(null as {kind})") for n, kind in none.items()} | {"settled": empty("string"), "translation": F.col("output")}
        return rows.withColumns(facts | {"stage": F.when(F.col("error").isNotNull(), "request_or_processing")})
    masked = F.col("phase") == "placeholder"
    rows = rows.withColumn("aliases", F.when(masked, rs.collapse_aliases(F.col("output"), F.col("constraints"))))
    events = F.coalesce(F.col("aliases.events"), F.slice(F.col("aliases.events"), 1, 0))
    rows = rows.withColumn("output", F.when(masked, F.col("aliases.text")).otherwise(F.col("output"))).withColumn("settled", F.coalesce(F.transform(events, lambda e: e["placeholder"]), empty("string"))).drop("aliases")
    rows = rows.withColumn("active", F.filter("constraints", lambda x: ~F.array_contains(F.col("settled"), x["placeholder"])))
    rows = rows.withColumn("found", F.when(masked, inventory(F.col("output"), F.col("constraints"), F.col("settled")))).withColumn("score", mismatch(F.col("found")))
    exact = masked & (F.col("score") == 0)
    gated = exact & F.lit(policy.quality_gate)
    rows = rows.withColumn("beside", F.when(gated, rs.context_issues(F.col("output"), F.col("active"))))
    rows = rows.withColumn("restored", F.when(exact & ~F.coalesce(errors(F.col("beside")), F.lit(False)), rs.restore_with_spans(F.col("output"), F.col("active"))))
    known = F.flatten(F.transform("constraints", lambda x: F.transform(x["renderings"], lambda r: F.struct(x["term_id"].alias("term_id"), r["rendering"].alias("rendering"), r["kind"].alias("kind")))))
    rows = rows.withColumn("after", F.when(gated & F.col("restored").isNotNull(), rs.restored_issues(F.col("restored.text"), F.col("restored.spans"), known)))
    stage = (
        F.when(F.col("error").isNotNull(), "request_or_processing").when(~masked, None).when(F.col("score") > 0, "inventory").when(errors(F.col("beside")), "context")
        .when(F.col("restored.problem").isNotNull(), "request_or_processing").when(errors(F.col("after")), "restored")
    )
    rows = rows.withColumn("error", F.coalesce("error", F.concat(F.lit("restoration: "), F.col("restored.problem"))))
    return rows.withColumn("stage", stage).withColumn("translation", F.when(masked, F.col("restored.text")).otherwise(F.col("output")))


def to_verify(policy: Policy) -> Column:
    late = F.col("attempt") > 0 if policy.verifier == "retry" else F.lit(policy.verifier == "all")
    return (F.col("phase") == "placeholder") & F.col("stage").isNull() & late


def verified(rows: DataFrame, provider: ChatProvider, policy: Policy) -> DataFrame:
    """rows with a verifier's verdict where one is wanted: asked again while the answer holds no JSON object, then an error."""
    ask = F.to_json(F.struct(*KEY, F.lit("verify").alias("task"), "attempt", F.col("text").alias("source"), "translation", F.transform("constraints", lambda x: x["canonical"]).alias("terms")))
    rows = rows.drop("answer", "request").withColumn("_due", to_verify(policy)).withColumn("verdict", c.semantic_verdict(F.lit(None).cast("string"))).withColumn("_limit", F.col("max_tokens")).withColumnRenamed("error", "_error")
    rows = rows.withColumn("max_tokens", F.least(F.greatest("max_tokens", F.lit(1600)), F.lit(2400)))
    for _ in range(policy.verifier_retries):
        rows = rows.withColumn("_got", answered(provider, F.when(F.col("_due") & F.col("verdict").isNull(), ask), F.col("max_tokens")))
        rows = rows.withColumn("verdict", F.coalesce("verdict", c.semantic_verdict(F.col("_got.answer")))).drop("_got")
    rows = rows.withColumn("max_tokens", F.col("_limit")).withColumnRenamed("_error", "error").drop("_limit")
    none = F.col("_due") & F.col("verdict").isNull()
    stage = F.when(F.col("stage").isNotNull(), F.col("stage")).when(none, "request_or_processing").when(F.col("_due") & ~F.col("verdict.passed"), "semantic")
    rows = rows.withColumn("stage", stage).withColumn("error", F.when(none, "no verdict").otherwise(F.col("error")))
    return rows.withColumn("requests", F.col("requests") + F.col("_due").cast("int")).withColumn("verifier_calls", F.col("verifier_calls") + F.col("_due").cast("int")).drop("_due")


def settled(rows: DataFrame, policy: Policy) -> DataFrame:
    """The state after a round: done with a strategy, or open with its next attempt."""
    a, phase, stage = F.col("attempt"), F.col("phase"), F.col("stage")
    masked, last = phase == "placeholder", a + 1 >= policy.retries
    canonical = lambda x: F.when(F.contains("output", x["canonical"]), "EXACT").when(F.exists(x["approved"], lambda v: (v != "") & F.contains("output", v)), "APPROVED").otherwise("MISSING")
    terms = F.when(~masked & stage.isNull(), F.transform("constraints", canonical))
    rows = rows.withColumn("_terms", terms).withColumn("_complies", F.when(masked, True).otherwise(F.coalesce(~F.array_contains("_terms", "MISSING"), F.lit(True))))
    # Tokens doubled on truncation: then the same failure is another one.
    grown = F.least(F.greatest(2 * F.col("max_tokens"), F.col("max_tokens") + LEAST_GROWTH), F.lit(MOST_TOKENS))
    grows = (F.col("error") == "truncated") & (grown > F.col("max_tokens"))
    grows = F.coalesce(grows, F.lit(False))
    issues = F.when(stage == "context", F.transform("beside", lambda i: F.struct(i["issue_type"].alias("issue_type"), i["term_id"].alias("term_id"), i["placeholder"].alias("placeholder"), i["side"].alias("side"), i["severity"].alias("severity"))))
    none = F.lit(None).cast("string")
    issues = issues.otherwise(F.transform("after", lambda i: F.struct(i["issue_type"].alias("issue_type"), i["term_id"].alias("term_id"), i["placeholder"].alias("placeholder"), none.alias("side"), i["severity"].alias("severity"))))
    signature = c.rejection_signature(stage, F.col("found.missing"), F.col("found.duplicated"), F.col("found.unknown"), issues, F.col("verdict"), F.col("error"))
    rows = rows.withColumn("_signature", F.when(masked & stage.isNotNull(), signature)).withColumn("_grows", grows)
    rows = rows.withColumn("rejections", F.when(F.col("_signature").isNotNull(), F.concat("rejections", F.array(F.struct((a + 1).alias("attempt"), stage.alias("stage"), F.col("_signature").alias("signature"))))).otherwise(F.col("rejections")))
    same = F.size(F.filter("rejections", lambda r: r["signature"] == F.col("_signature")))
    repeated = F.coalesce((same >= policy.repeat_limit) & F.lit(policy.repeat_limit > 0), F.lit(False))
    legacy = masked & (a > 0) & F.lit(policy.repair == "llm_repair") & (F.col("best_output") != "")
    better = masked & F.coalesce(F.col("score") < F.col("best_score"), F.lit(False))
    accepted = F.when(masked | (phase == "plain"), stage.isNull()).otherwise(stage.isNull() & (F.col("_complies") | last))
    # A glossary run whose last answer fails keeps the answer before; a fallback does not.
    saved = (phase == "glossary") & last & stage.isNotNull() & F.col("kept_output").isNotNull()
    failed = ~masked & last & stage.isNotNull() & ~saved
    strategy = c.strategy(phase != "plain", F.size("soft") > 0, phase, phase == "fallback", a, F.lit(policy.repair == "llm_repair"))
    to_fallback = masked & stage.isNotNull() & ((repeated & ~F.col("_grows")) | last)
    rows = rows.withColumns({
        "_fallback": to_fallback, "_done": accepted | saved | failed, "status": F.when(failed, "failed").when(accepted | saved, c.resolution_status(phase == "fallback", F.col("_complies") & ~saved)),
        "strategy": F.when(accepted | saved, strategy), "exact": F.when(accepted & ~masked, ~F.exists("_terms", lambda x: x != "EXACT")), "_legacy": legacy, "_repeated": repeated & masked & stage.isNotNull(), "_better": better,
    })
    return rows.select(
        *KEY, "text", "protected", "constraints", "soft", F.when(F.col("_fallback"), "fallback").otherwise(phase).alias("phase"), F.when(F.col("_fallback"), 0).otherwise(a + 1).alias("attempt"),
        F.when(F.col("_grows"), grown).otherwise(F.col("max_tokens")).alias("max_tokens"), (F.col("requests") + 1).alias("requests"), "verifier_calls",
        (F.col("regenerations") + (masked & (a > 0) & ~F.col("_legacy")).cast("int")).alias("regenerations"), (F.col("repairs") + F.col("_legacy").cast("int")).alias("repairs"), (F.col("escalations") + F.col("_grows").cast("int")).alias("escalations"),
        a.alias("last_attempt"), (F.col("early_fallback") | F.col("_repeated")).alias("early_fallback"), F.when(F.col("_better"), F.col("output")).otherwise(F.col("best_output")).alias("best_output"), F.when(F.col("_better"), F.col("score")).otherwise(F.col("best_score")).alias("best_score"),
        F.when((phase == "glossary") & stage.isNull(), F.col("output")).otherwise(F.col("kept_output")).alias("kept_output"), "rejections",
        F.when(stage.isNotNull() & masked, F.concat_ws(": ", stage, F.when(stage == "request_or_processing", F.col("error")))).when(failed, F.col("error")).otherwise(F.col("failure")).alias("failure"),
        F.when(saved, F.col("kept_output")).when(accepted, F.col("translation")).alias("translation"), "strategy", "status", "exact",
        F.when(accepted & masked, F.size("settled")).otherwise(0).alias("settled_tokens"), F.col("_done").alias("done"),
    )


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written whole: its success mark is there."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def translate(paragraphs: DataFrame, provider: ChatProvider, folder: str, policy: Policy = Policy(), completed: DataFrame | None = None) -> DataFrame:
    """A row a paragraph: translation, strategy, status, and what it took. Rounds are kept in folder, so that a broken run goes on there.

    completed: paragraphs of an earlier run (document_id, paragraph_id, signature; the signature is that of the protected
    text and its constraints, see signature()); these are not asked again. An empty table gives no rows.
    """
    spark = paragraphs.sparkSession
    work = paragraphs if completed is None else pending(paragraphs.withColumn("signature", signature()), completed, [*KEY, "signature"]).drop("signature")
    rows, i, parts = opening(work, policy), 0, []
    while True:
        asked, after = f"{folder}/round-{i:02d}/answers", f"{folder}/round-{i:02d}/state"
        if not exists(spark, after):
            if not exists(spark, asked):
                rows.withColumn("_got", answered(provider, request(policy), F.col("max_tokens"))).select(*rows.columns, "_got.answer", "_got.error").write.mode("overwrite").parquet(asked)
            # A paragraph leaves its tokens for the glossary after `retries` rounds at the latest.
            masked = policy.mode == "placeholder" and i < policy.retries
            gates = checked(spark.read.parquet(asked), policy, masked)
            if policy.verifier == "never" or not masked:
                gates = gates.withColumn("verdict", c.semantic_verdict(F.lit(None).cast("string")))
            else:
                gates = verified(gates, provider, policy)
            settled(gates, policy).write.mode("overwrite").parquet(after)
        state = spark.read.parquet(after)
        parts.append(state.filter("done"))
        rows, i = state.filter("not done").drop("translation", "strategy", "status", "exact", "settled_tokens", "done"), i + 1
        if rows.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("signature", signature()).drop("done", "phase", "attempt", "best_output", "best_score", "kept_output")


def signature() -> Column:
    """Of what a translation was made from."""
    return F.sha2(F.to_json(F.struct("text", "protected", F.coalesce("constraints", empty(CONSTRAINT)).alias("constraints"), F.coalesce("soft", empty("string")).alias("soft"))), 256)


def run_totals(paragraphs: DataFrame, results: DataFrame) -> DataFrame:
    """One row: documents, complete ones, paragraphs, failed, unresolved, requests, and the run's status."""
    rows = paragraphs.select(*KEY).join(results.select(*KEY, "status", "requests"), list(KEY), "left")
    docs = rows.groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(F.col("status").isNull() | (F.col("status") == "failed")).alias("open"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isin("glossary_fallback_noncompliant", "noncompliant")).alias("unresolved"), F.sum("requests").alias("requests"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    all_ = docs.agg(F.count("*").alias("documents"), F.count_if(F.col("open") == 0).alias("documents_complete"), total("n").alias("paragraphs"), total("failed").alias("failed_paragraphs"), total("unresolved").alias("unresolved_paragraphs"), total("requests").alias("requests"))
    status = F.when(F.col("documents_complete") < F.col("documents"), "partial").when(F.col("unresolved_paragraphs") > 0, "completed_with_unresolved").otherwise("complete")
    return all_.withColumn("status", status)
