"""Blind pairwise judgments: validation, mapping to roles, combination, aggregates, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inference import paired_inference

WINNERS = ("baseline", "controlled", "tie")
# The judge's score and critical-error fields, by the names of their columns.
SCORE_FIELDS = {"fidelity": "semantic_fidelity", "legal": "legal_accuracy", "terminology": "terminology_compliance", "fluency": "fluency", "quality": "overall_quality"}
ERROR_FIELDS = {"omission": "meaning_omission", "addition": "unsupported_addition", "polarity": "polarity_or_modality_error", "party": "party_or_role_error", "number": "number_date_or_reference_error"}
SCORES, ERRORS = tuple(SCORE_FIELDS), tuple(ERROR_FIELDS)


def share(condition: Column) -> Column:
    return F.round(F.count_if(condition) / F.count("*"), 6)


def aggregate(rows: DataFrame, *keys: str) -> DataFrame:
    """Wins and their rates, decisive rate, mean scores and deltas, error and disagreement rates."""
    wins = [F.count_if(F.col("winner") == w).alias(f"{w}_wins") for w in WINNERS]
    rates = [share(F.col("winner") == w).alias(f"{w}_win_rate") for w in WINNERS]
    decisive = F.count_if(F.col("winner") != "tie")
    means = [F.round(F.avg(f"{r}_{s}"), 6).alias(f"{r}_{s}_mean") for r in WINNERS[:2] for s in SCORES]
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("paragraphs"), *wins, *rates, F.coalesce(F.round(F.count_if(F.col("winner") == "controlled") / F.nullif(decisive, F.lit(0)), 6), F.lit(0.0)).alias("decisive_controlled_win_rate"),
        *means, *[share(F.col(f"{r}_{x}")).alias(f"{r}_{x}_rate") for r in WINNERS[:2] for x in ERRORS], share(F.col("position_disagreement")).alias("position_disagreement_rate"),
    )
    return out.withColumns({f"{s}_delta": F.round(F.col(f"controlled_{s}_mean") - F.col(f"baseline_{s}_mean"), 6) for s in SCORES})


def subsets(rows: DataFrame) -> DataFrame:
    """The aggregate over all paragraphs, those with terms, and those without, in one pass."""
    named = rows.withColumn("subset", F.explode(F.array(F.lit("overall"), F.when(F.col("has_terms"), "term").otherwise("non_term"))))
    return aggregate(named, "subset")


def score_table(rows: DataFrame) -> DataFrame:
    """subset, score, baseline, controlled, delta: a row a subset and score."""
    wide = subsets(rows)
    each = F.stack(F.lit(len(SCORES)), *[x for s in SCORES for x in (F.lit(s), F.col(f"baseline_{s}_mean"), F.col(f"controlled_{s}_mean"), F.col(f"{s}_delta"))])
    return wide.select("subset", each.alias("score", "baseline", "controlled", "delta"))


def usage(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))


def cost(rows: DataFrame, total_cost: float, *keys: str) -> DataFrame:
    """Cost shared out by tokens, and a thousand paragraphs' cost."""
    rate = rows.agg((F.lit(total_cost) / F.sum(F.col("prompt_tokens") + F.col("completion_tokens"))).alias("rate"))
    each = usage(rows, *keys).join(F.broadcast(rate))  # one row
    return each.select(*keys, "requests", "total_tokens", F.round(F.col("total_tokens") * F.col("rate"), 6).alias("cost"), F.round(F.col("total_tokens") * F.col("rate") * 1000 / F.col("requests"), 6).alias("cost_per_1000"))


def combine_bidirectional(rows: DataFrame, *keys: str) -> DataFrame:
    """Two judgments of one pair, either order: mean scores, errors both report, the winner they agree on, else a tie."""
    first, last = F.min_by("winner", "swapped"), F.max_by("winner", "swapped")
    return rows.groupBy(*keys).agg(
        *[F.round(F.avg(f"{r}_{s}"), 6).alias(f"{r}_{s}") for r in WINNERS[:2] for s in SCORES], *[F.bool_and(f"{r}_{x}").alias(f"{r}_{x}") for r in WINNERS[:2] for x in ERRORS],
        F.when(first == last, first).otherwise("tie").alias("winner"), (first != last).alias("position_disagreement"), F.round(F.avg("confidence"), 6).alias("confidence"),
    )


def map_roles(rows: DataFrame) -> DataFrame:
    """Scores of A and B, and the winner's letter, to the roles they stand for (A is the baseline unless swapped)."""
    swapped = F.col("swapped")
    pick = lambda yes, no: F.when(swapped, F.col(yes)).otherwise(F.col(no))
    winner = F.when(F.col("letter") == "TIE", "tie").when((F.col("letter") == "A") == ~swapped, "baseline").otherwise("controlled")
    return rows.withColumns({"baseline": pick("score_b", "score_a"), "controlled": pick("score_a", "score_b"), "winner": winner})


def _sides(kind: str, fields: dict[str, str]) -> str:
    one = ",".join(f"{f}:{kind}" for f in fields.values())
    return f"struct<A:struct<{one}>,B:struct<{one}>>"


SCHEMA = f"scores {_sides('double', SCORE_FIELDS)}, critical_errors {_sides('boolean', ERROR_FIELDS)}, winner string, confidence double, rationale string"


def validate_judgment(answer: Column) -> Column:
    """Why a judge's JSON answer is not usable; null if it is."""

    def problem(j: Column) -> Column:
        score = F.array(*[j["scores"][side][field] for side in "AB" for field in SCORE_FIELDS.values()])
        flag = F.array(*[j["critical_errors"][side][field] for side in "AB" for field in ERROR_FIELDS.values()])
        return (
            F.when(j.isNull() | j["winner"].isNull() & j["confidence"].isNull(), "not JSON")
            .when(F.exists(score, lambda x: ~F.coalesce(x.between(1, 5), F.lit(False))), "score")
            .when(F.exists(flag, lambda x: x.isNull()), "critical error")
            .when(~F.coalesce(j["winner"].isin("A", "B", "TIE"), F.lit(False)), "winner")
            .when(~F.coalesce(j["confidence"].between(0, 1), F.lit(False)), "confidence")
            .when(F.coalesce(F.btrim(j["rationale"]), F.lit("")) == "", "rationale")
        )

    # The function's variable holds the parsed answer: as a plain expression it would be parsed again for every field.
    return F.transform(F.array(F.from_json(answer, SCHEMA)), problem)[0]


def error_cases(rows: DataFrame, limit: int = 20) -> DataFrame:
    """For each kind of case the paragraphs with the largest difference, ranked; only those with the kind's sign."""
    from pyspark.sql import Window

    delta = {s: F.col(f"controlled_{s}") - F.col(f"baseline_{s}") for s in SCORES}
    errors = {r: sum((F.col(f"{r}_{x}").cast("int") for x in ERRORS), F.lit(0)) for r in WINNERS[:2]}
    kinds = {f"{s}_loss": -delta[s] for s in SCORES} | {f"{s}_gain": delta[s] for s in SCORES}
    kinds |= {"disagreement": F.when(F.col("position_disagreement"), F.abs(delta["quality"]) + 1), "new_errors": (errors["controlled"] - errors["baseline"]).cast("double")}
    long = rows.select("document_id", "paragraph_id", F.stack(F.lit(len(kinds)), *[x for k, v in kinds.items() for x in (F.lit(k), v)]).alias("category", "severity")).filter("severity > 0")
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("severity"), "document_id", "paragraph_id"))
    return long.withColumn("rank", rank).filter(F.col("rank") <= limit)


def direct_wins(rows: DataFrame) -> DataFrame:
    """Wins and rates of a direct comparison (winner, has_terms): of all paragraphs, with and without terms. A winner not known is a tie."""
    subset = F.array(F.lit("overall"), F.when(F.coalesce("has_terms", F.lit(False)), "term_bearing").otherwise("non_term_bearing"))
    won = {side: F.count_if(F.col("winner") == side) for side in ("baseline", "controlled")}
    g = rows.select("winner", F.explode(subset).alias("subset")).groupBy("subset").agg(F.count("*").alias("paragraphs"), *[n.alias(f"{side}_wins") for side, n in won.items()])
    decisive = F.col("baseline_wins") + F.col("controlled_wins")
    rates = [F.round(F.col(f"{side}_wins") / F.col("paragraphs"), 6).alias(f"{side}_win_rate") for side in won]
    return g.select("*", (F.col("paragraphs") - decisive).alias("ties"), *rates, F.round(F.try_divide("baseline_wins", decisive), 6).alias("decisive_baseline_win_rate"))


SUBSETS = ("overall", "term_bearing", "non_term_bearing")


def by_subset(rows: DataFrame) -> DataFrame:
    """rows (has_terms) once for all paragraphs and once for their subset."""
    return rows.withColumn("subset", F.explode(F.array(F.lit("overall"), F.when(F.coalesce("has_terms", F.lit(False)), "term_bearing").otherwise("non_term_bearing"))))


def stacked(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, metric, stream, value: a row a score, value being what differences() made of it. stream numbers the groups of subset and metric."""
    each = F.stack(F.lit(len(SCORES)), *[x for i, s in enumerate(SCORES) for x in (F.lit(s), F.lit(i), F.col(f"delta_{s}"))])
    long = rows.select(*keys, each.alias("metric", "_i", "diff"))
    place = F.array_position(F.array(*[F.lit(s) for s in SUBSETS]), F.col("subset")).cast("int") - 1
    return long.withColumn("stream", 100 * place + F.col("_i")).drop("_i")


def direct_effects(rows: DataFrame, resamples: int = 10_000, permutations: int = 50_000, seed: int = 2026) -> DataFrame:
    """Baseline less controlled for each subset and score, with intervals and p values over documents; and the subset's wins."""
    deltas = rows.withColumns({f"delta_{s}": F.col(f"baseline_{s}") - F.col(f"controlled_{s}") for s in SCORES})
    found = paired_inference(stacked(by_subset(deltas), "subset", "document_id"), ["subset", "metric"], resamples, permutations, seed)
    return found.join(direct_wins(rows).drop("paragraphs"), "subset")  # three rows


def method_table(rows: DataFrame) -> DataFrame:
    """Wins, rates and mean gains over the baseline, a row a subset and method. rows: method, winner, has_terms, scores."""
    won = {side: F.count_if(F.col("winner") == side) for side in WINNERS[:2]}
    g = by_subset(rows).groupBy("subset", "method").agg(F.count("*").alias("paragraphs"), *[n.alias(f"{side}_wins") for side, n in won.items()], *[F.round(F.avg(F.col(f"controlled_{s}") - F.col(f"baseline_{s}")), 6).alias(f"delta_{s}") for s in SCORES])
    decisive = F.col("baseline_wins") + F.col("controlled_wins")
    return g.withColumns({"ties": F.col("paragraphs") - decisive, "controlled_win_rate": F.round(F.col("controlled_wins") / F.col("paragraphs"), 6), "decisive_controlled_win_rate": F.round(F.try_divide("controlled_wins", decisive), 6)})


def common(rows: DataFrame, methods: tuple[str, str]) -> DataFrame:
    """rows of paragraphs that both methods have; has_terms is the first method's."""
    key = ["document_id", "paragraph_id"]
    both = rows.filter(F.col("method").isin(*methods)).groupBy(*key).agg(F.count_distinct("method").alias("_m"), F.max(F.when(F.col("method") == methods[0], F.col("has_terms"))).alias("_t")).filter("_m = 2")
    return rows.drop("has_terms").join(both.select(*key, F.col("_t").alias("has_terms")), key)


def significance(rows: DataFrame, methods: tuple[str, str], resamples: int = 10_000, permutations: int = 50_000, seed: int = 2026) -> DataFrame:
    """The first method's gain less the second's, paired by paragraph, for each subset and score; documents have equal weight."""
    key = ["document_id", "paragraph_id", "has_terms"]
    sign = F.when(F.col("method") == methods[0], 1.0).otherwise(-1.0)
    paired = common(rows, methods).groupBy(*key).agg(*[F.sum(sign * (F.col(f"controlled_{s}") - F.col(f"baseline_{s}"))).alias(f"delta_{s}") for s in SCORES])
    found = paired_inference(stacked(by_subset(paired), "subset", "document_id"), ["subset", "metric"], resamples, permutations, seed)
    return found.withColumn("significant", F.col("sign_flip_p") < 0.05)


def reliability(run: DataFrame, *keys: str) -> DataFrame:
    """Rates of a controlled run from its counts (restoring.control_statistics()): of paragraphs that are controlled at all."""
    controlled = F.greatest(F.lit(0), F.col("total_paragraphs") - F.col("uncontrolled_paragraphs"))
    exact, retried = F.col("placeholder_exact_paragraphs"), F.col("placeholder_retry_success_paragraphs")
    rates = {"first_pass_rate": exact, "retry_recovery_rate": retried, "placeholder_path_success_rate": exact + retried, "fallback_rate": F.col("placeholder_fallback_paragraphs"), "unresolved_rate": F.col("unresolved_paragraphs")}
    out = run.select(*keys, "total_paragraphs", controlled.alias("controlled_paragraphs"), F.col("placeholder_semantic_verifier_calls").alias("verifier_calls"), *[F.round(F.try_divide(x, controlled), 6).alias(n) for n, x in rates.items()])
    return out.withColumn("final_compliance_rate", F.round(1 - F.col("unresolved_rate"), 6))
