"""Accounts of runs: selections and usage with failed attempts, efficiency and cost, extraction audits, evidence of variants, matching of folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

TOKENS = ("prompt_tokens", "completion_tokens")


def counted(column: str, keys: list[str], rows: DataFrame, name: str) -> DataFrame:
    """keys and a map from each value of column to its count."""
    one = rows.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))


def usage_totals(selection: DataFrame, rows: DataFrame, failures: DataFrame, *keys: str) -> DataFrame:
    """Candidates, selected, judged and failed paragraphs, and tokens of successful and of failed attempts and of both.

    selection: keys, has_terms, selected. rows and failures: keys, prompt_tokens, completion_tokens (null: none). Each
    relation is summed before they meet, so none is multiplied by another.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    terms, picked = F.coalesce("has_terms", F.lit(False)), F.coalesce("selected", F.lit(False))
    chosen = selection.groupBy(*keys).agg(
        F.count("*").alias("candidates"), F.count_if(terms).alias("candidates_with_terms"), F.count_if(~terms).alias("candidates_without_terms"),
        F.count_if(picked).alias("selected"), F.count_if(picked & terms).alias("selected_with_terms"), F.count_if(picked & ~terms).alias("selected_without_terms"),
    )
    both = rows.select(*keys, F.lit(True).alias("ok"), *TOKENS).unionByName(failures.select(*keys, F.lit(False).alias("ok"), *TOKENS))
    used = both.groupBy(*keys).agg(F.count_if("ok").alias("judged"), F.count_if(~F.col("ok")).alias("failed"), *[total(F.when(F.col("ok") == side, F.col(c))).alias(f"{name}_{c}") for name, side in (("successful", True), ("failed", False)) for c in TOKENS])
    out = chosen.join(used, list(keys), "full_outer") if keys else chosen.crossJoin(F.broadcast(used))  # without keys: a row each
    out = out.fillna(0, [c for c in out.columns if c not in keys])
    return out.withColumns({f"total_{c}": F.col(f"successful_{c}") + F.col(f"failed_{c}") for c in TOKENS})


def efficiency(translations: DataFrame, judged: DataFrame, failures: DataFrame, costs: dict[str, float | None], reference: str) -> DataFrame:
    """A row a method: translation time, attempts, strategies; judging tokens, time and attempts; cost as paid or, by the reference method's cost a token, estimated.

    translations: method, document_id, latency_seconds, attempts, generation_retries, verifier_calls, strategy, status, fallback.
    judged: method, document_id, latency_seconds, attempts and the tokens; failures: method and the tokens, which count too.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0))), 6)
    t_ = translations.groupBy("method").agg(
        F.count_distinct("document_id").alias("documents"), F.count("*").alias("paragraphs"), F.round(total("latency_seconds"), 6).alias("latency_sum"), mean("latency_seconds").alias("latency_mean"), mean("attempts").alias("attempts_mean"),
        total("generation_retries").alias("generation_retries"), total("verifier_calls").alias("verifier_calls"), F.count_if("fallback").alias("fallback_paragraphs"), F.count_if(F.col("status").isin("glossary_fallback_noncompliant", "noncompliant")).alias("unresolved_paragraphs"),
    ).join(counted("strategy", ["method"], translations.withColumn("strategy", F.coalesce("strategy", F.lit("unknown"))), "strategy_counts"), "method")
    tokens = judged.select("method", *TOKENS).unionByName(failures.select("method", *TOKENS)).groupBy("method").agg(*[total(c).alias(f"judge_{c}") for c in TOKENS]).withColumn("judge_tokens", F.col("judge_prompt_tokens") + F.col("judge_completion_tokens"))
    j_ = judged.groupBy("method").agg(F.count_distinct("document_id").alias("judge_documents"), F.count("*").alias("judged_paragraphs"), F.round(total("latency_seconds"), 6).alias("judge_latency_sum"), mean("latency_seconds").alias("judge_latency_mean"), mean("attempts").alias("judge_attempts_mean"))
    f_ = failures.groupBy("method").agg(F.count("*").alias("failed_paragraphs"))
    rows = t_.join(j_.join(f_, "method", "left").join(tokens, "method", "left").fillna(0, ["failed_paragraphs"]), "method", "left")
    paid = F.create_map(*[x for k, v in costs.items() if v is not None for x in (F.lit(k), F.lit(float(v)))]) if any(v is not None for v in costs.values()) else F.expr("cast(map() as map<string,double>)")
    rate = rows.filter(F.col("method") == reference).select(F.try_divide(F.lit(costs.get(reference)).cast("double"), F.col("judge_tokens")).alias("_rate"))
    rows = rows.withColumn("_paid", F.try_element_at(paid, F.col("method"))).join(F.broadcast(rate), F.lit(True), "left")  # one row
    cost = F.coalesce(F.col("_paid"), F.col("judge_tokens") * F.col("_rate"))
    rows = rows.withColumn("_cost", F.when(F.col("judge_tokens").isNotNull(), cost))
    return rows.withColumns({
        "tokens_per_paragraph": F.round(F.try_divide("judge_tokens", "judged_paragraphs"), 6), "cost": F.round("_cost", 6), "cost_is_actual": F.when(F.col("judge_tokens").isNotNull(), F.col("_paid").isNotNull()),
        "cost_per_1000": F.round(F.try_divide(F.col("_cost") * 1000, F.col("judged_paragraphs")), 6),
    }).drop("_paid", "_rate", "_cost")


def extraction_audit(rows: DataFrame, usage: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """Occurrences, completed, remaining, of low confidence, counts by status, and tokens of this run, of restored batches and of both.

    rows: keys, extraction_status (null or empty: not done), extraction_confidence. usage: keys, restored, prompt_tokens, completion_tokens.
    """
    rows = rows.withColumn("_status", F.nullif(F.col("extraction_status"), F.lit("")))
    done = F.col("_status").isNotNull()
    low = done & (F.coalesce("extraction_confidence", F.lit(0.0)) < threshold)
    out = rows.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.count_if(done).alias("completed"), F.count_if(~done).alias("remaining"), F.count_if(low).alias("low_confidence"))
    out = out.join(counted("_status", list(keys), rows, "status_counts"), list(keys), "left")
    total = lambda when, c: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    restored = F.coalesce("restored", F.lit(False))
    used = usage.groupBy(*keys).agg(*[total(when, c).alias(f"{name}_{c}") for name, when in (("run", ~restored), ("restored", restored), ("cumulative", F.lit(True))) for c in TOKENS])
    out = out.join(used, list(keys), "left")
    return out.fillna(0, [f"{n}_{c}" for n in ("run", "restored", "cumulative") for c in TOKENS])


def variant_evidence(reviews: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """The renderings of each group that are most frequent over all experiments, at most limit of them: count, experiments, place."""
    raw = reviews.groupBy(*keys, "rendering", "experiment").agg(F.count("*").alias("n"))  # spellings are few: only they are normalised
    one = raw.withColumn("variant", t.normalize_variant(F.col("rendering"))).filter("variant is not null").groupBy(*keys, "variant").agg(F.sum("n").alias("occurrences"), F.count_distinct("experiment").alias("experiments"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("occurrences"), "variant"))
    return one.withColumn("place", place).filter(F.col("place") <= limit)


def folders(first: DataFrame, *others: tuple[str, DataFrame]) -> DataFrame:
    """Each document of first or any other relation: whether each has it (has_<name>), and whether all do (paired). The first is called source."""
    sides = [("source", first), *others]
    rows = None
    for name, df in sides:
        one = df.select("document_id").distinct().withColumn("name", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    out = rows.groupBy("document_id").agg(*[F.bool_or(F.col("name") == name).alias(f"has_{name}") for name, _ in sides])
    paired: Column = F.lit(True)
    for name, _ in sides:
        paired = paired & F.col(f"has_{name}")
    return out.withColumn("paired", paired)


def missing_lists(matched: DataFrame, limit: int = 5) -> DataFrame:
    """For each side: how many documents it lacks, and the first of their ids."""
    sides = [c for c in matched.columns if c.startswith("has_")]
    long = matched.select("document_id", F.explode(F.filter(F.array(*[F.when(~F.col(c), F.lit(c.removeprefix("has_"))) for c in sides]), lambda x: x.isNotNull())).alias("side"))
    rank = F.row_number().over(Window.partitionBy("side").orderBy("document_id"))
    first = long.withColumn("_r", rank).filter(F.col("_r") <= limit).groupBy("side").agg(F.array_sort(F.collect_list("document_id")).alias("first"))
    return long.groupBy("side").agg(F.count("*").alias("missing")).join(first, "side")


def document_counts(documents: DataFrame, key: str, wanted: int | None = None) -> DataFrame:
    """Documents of each experiment, and, if a number is wanted, whether it is there."""
    out = documents.groupBy(key).agg(F.count_distinct("document_id").alias("documents"))
    return out if wanted is None else out.withColumn("complete", F.col("documents") >= wanted)


def markdown_table(table: DataFrame, *order: str) -> DataFrame:
    """position and line: a header, the line below it, and the rows in the order; numbers with four decimals, a dash for null."""
    kind = dict(table.dtypes)
    cell = lambda c: F.when(F.col(c).isNull(), "—").otherwise(F.format_string("%.4f", F.col(c)) if kind[c] in ("double", "float") else F.col(c).cast("string"))
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    place = F.row_number().over(Window.orderBy(*order)) + 1  # a table to be printed
    rows = table.select(place.alias("position"), line([cell(c) for c in table.columns]).alias("line"))
    head = table.sparkSession.createDataFrame([(0, "| " + " | ".join(table.columns) + " |"), (1, "|" + "|".join(["---"] * len(table.columns)) + "|")], "position int, line string")
    return head.unionByName(rows)


def validation_levels(validated: DataFrame) -> DataFrame:
    """Counts by status for each document of an experiment, each experiment, and all together: null where all are meant."""
    rows = validated.rollup("experiment", "document_id").agg(F.grouping_id().alias("_g"), F.count("*").alias("rows"), F.count_if("include_in_consistency").alias("included"), F.count_if("needs_rendering_repair").alias("repairs"), F.count_if(F.col("validation_status") == "VALID").alias("valid"))
    return rows.withColumn("level", F.element_at(F.create_map(F.lit(0), F.lit("document"), F.lit(1), F.lit("experiment"), F.lit(3), F.lit("all")), F.col("_g").cast("int"))).drop("_g")
