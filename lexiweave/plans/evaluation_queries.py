"""Blind-judgment aggregates over the evaluations relation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as e
from ..sources.contracts import relation, with_clause

E = with_clause("evaluations")
R2 = ("baseline", "controlled")
AGG = "count(*) AS paragraphs, " + ", ".join(
    [f"count(*) FILTER (winner = '{w}') AS {w}_wins, round(count(*) FILTER (winner = '{w}') / count(*), 6) AS {w}_win_rate" for w in e.WINNERS]
    + ["coalesce(round(count(*) FILTER (winner = 'controlled') / nullif(count(*) FILTER (winner <> 'tie'), 0), 6), 0) AS decisive_controlled_win_rate"]
    + [f"round(avg({r}_{s}), 6) AS {r}_{s}_mean" for r in R2 for s in e.SCORES]
    + [f"round(count(*) FILTER ({r}_{x}) / count(*), 6) AS {r}_{x}_rate" for r in R2 for x in e.ERRORS]
    + ["round(count(*) FILTER (position_disagreement) / count(*), 6) AS position_disagreement_rate"]
    + [f"round(round(avg(controlled_{s}), 6) - round(avg(baseline_{s}), 6), 6) AS {s}_delta" for s in e.SCORES]
)
SUB = "sub AS (SELECT *, unnest(['overall', CASE WHEN has_terms THEN 'term' ELSE 'non_term' END]) AS subset FROM evaluations)"
TURN = "turned AS (SELECT *, s AS swapped, CASE WHEN s AND paragraph_id % 5 = 0 THEN 'tie' ELSE winner END AS won FROM evaluations, (VALUES (false), (true)) v(s))"


def on(f):
    return lambda spark, folder: f(relation(spark, folder, "evaluations"))


def both_orders(r):
    """Each pair judged in either order; the second answer differs for every fifth paragraph."""
    twice = r.withColumn("swapped", F.explode(F.array(F.lit(False), F.lit(True))))
    return twice.withColumn("winner", F.when(F.col("swapped") & (F.col("paragraph_id") % 5 == 0), "tie").otherwise(F.col("winner")))


def lettered(r):
    return e.map_roles(r.select("document_id", "paragraph_id", (F.col("paragraph_id") % 2 == 1).alias("swapped"), F.col("baseline_quality").alias("score_a"), F.col("controlled_quality").alias("score_b"), F.when(F.col("winner") == "tie", "TIE").when(F.col("winner") == "baseline", "A").otherwise("B").alias("letter")))


def answers(r):
    """A judge's answer from a row's own numbers: scores run to 5.5, winners to a fourth letter, confidences over 1."""
    of = lambda fields, role, value: F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{f}":'), value(F.col(f"{role}_{n}"), n)) for n, f in fields.items()]), F.lit("}"))
    score = lambda c, n: (c + F.when((F.col("paragraph_id") % 11 == 0) & F.lit(n == "legal"), 0.5).otherwise(0.0)).cast("string")
    flag = lambda c, n: F.when((F.col("paragraph_id") % 59 == 0) & F.lit(n == "party"), "null").otherwise(c.cast("string"))
    pair = lambda fields, value: F.concat(F.lit('{"A":'), of(fields, "baseline", value), F.lit(',"B":'), of(fields, "controlled", value), F.lit("}"))
    winner = F.when(F.col("paragraph_id") % 61 == 0, "C").when(F.col("winner") == "tie", "TIE").when(F.col("winner") == "baseline", "A").otherwise("B")
    text = F.concat(F.lit('{"scores":'), pair(e.SCORE_FIELDS, score), F.lit(',"critical_errors":'), pair(e.ERROR_FIELDS, flag), F.lit(',"winner":"'), winner, F.lit('","confidence":'), (F.col("confidence") * 1.1).cast("string"), F.lit(',"rationale":"'), F.when(F.col("position_disagreement"), " ").otherwise("because"), F.lit('"}'))
    return r.select("document_id", "paragraph_id", e.validate_judgment(F.when(F.col("paragraph_id") % 67 == 0, F.lit("I think A wins")).otherwise(text)).alias("problem"))


HIGH = " OR ".join(f"{r}_{n} + CASE WHEN paragraph_id % 11 = 0 AND '{n}' = 'legal' THEN 0.5 ELSE 0 END NOT BETWEEN 1 AND 5" for r in R2 for n in e.SCORES)
ERRORS_OF = {r: " + ".join(f"CAST({r}_{x} AS INT)" for x in e.ERRORS) for r in R2}
KINDS = " UNION ALL ".join(
    [f"SELECT document_id, paragraph_id, '{s}_{kind}' AS category, {sign}(controlled_{s} - baseline_{s}) AS severity FROM evaluations" for s in e.SCORES for kind, sign in (("loss", "-"), ("gain", ""))]
    + ["SELECT document_id, paragraph_id, 'disagreement', CASE WHEN position_disagreement THEN abs(controlled_quality - baseline_quality) + 1 END FROM evaluations"]
    + [f"SELECT document_id, paragraph_id, 'new_errors', CAST(({ERRORS_OF['controlled']}) - ({ERRORS_OF['baseline']}) AS DOUBLE) FROM evaluations"]
)


QUERIES = {
    "g11_evaluation_aggregate": (on(lambda r: e.aggregate(r)), f"{E} SELECT {AGG} FROM evaluations"),
    "g12_subset_aggregates": (on(e.subsets), f"{E}, {SUB} SELECT subset, {AGG} FROM sub GROUP BY subset"),
    "g12b_score_table": (on(e.score_table), f"{E}, {SUB}, a AS (SELECT subset, {AGG} FROM sub GROUP BY subset) " + " UNION ALL ".join(f"SELECT subset, '{s}' AS score, baseline_{s}_mean AS baseline, controlled_{s}_mean AS controlled, {s}_delta AS delta FROM a" for s in e.SCORES)),
    "g13_usage_totals": (on(lambda r: e.usage(r, "has_terms")), f"{E} SELECT has_terms, count(*) AS requests, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens FROM evaluations GROUP BY 1"),
    "g14_document_statistics": (on(lambda r: e.aggregate(r, "document_id").join(e.usage(r, "document_id").drop("requests"), "document_id").select("document_id", "paragraphs", "baseline_wins", "controlled_wins", "tie_wins", "total_tokens")), f"{E} SELECT document_id, count(*) AS paragraphs, count(*) FILTER (winner = 'baseline') AS baseline_wins, count(*) FILTER (winner = 'controlled') AS controlled_wins, count(*) FILTER (winner = 'tie') AS tie_wins, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens FROM evaluations GROUP BY 1"),
    "g20_cost_table": (on(lambda r: e.cost(r, 26.14, "has_terms")), f"{E}, u AS (SELECT has_terms, count(*) AS requests, sum(prompt_tokens + completion_tokens) AS total_tokens FROM evaluations GROUP BY 1), t AS (SELECT 26.14::DOUBLE / sum(total_tokens) AS rate FROM u) SELECT has_terms, requests, CAST(total_tokens AS BIGINT) AS total_tokens, round(total_tokens * rate, 6) AS cost, round(total_tokens * rate * 1000 / requests, 6) AS cost_per_1000 FROM u, t"),
    "v05_validate_judgment": (on(answers), f"{E} SELECT document_id, paragraph_id, CASE WHEN paragraph_id % 67 = 0 THEN 'not JSON' WHEN {HIGH} THEN 'score' WHEN paragraph_id % 59 = 0 THEN 'critical error' WHEN paragraph_id % 61 = 0 THEN 'winner' WHEN confidence * 1.1 > 1 THEN 'confidence' WHEN position_disagreement THEN 'rationale' END AS problem FROM evaluations"),
    "v06_map_roles": (on(lambda r: lettered(r).select("document_id", "paragraph_id", "baseline", "controlled", "winner")), f"{E} SELECT document_id, paragraph_id, CASE WHEN paragraph_id % 2 = 1 THEN controlled_quality ELSE baseline_quality END AS baseline, CASE WHEN paragraph_id % 2 = 1 THEN baseline_quality ELSE controlled_quality END AS controlled, CASE WHEN winner = 'tie' THEN 'tie' WHEN (winner = 'baseline') = (paragraph_id % 2 = 0) THEN 'baseline' ELSE 'controlled' END AS winner FROM evaluations"),
    "v07_combine_bidirectional": (on(lambda r: e.combine_bidirectional(both_orders(r), "document_id", "paragraph_id")), f"{E}, {TURN} SELECT document_id, paragraph_id, " + ", ".join(f"round(avg({r}_{s}), 6) AS {r}_{s}" for r in R2 for s in e.SCORES) + ", " + ", ".join(f"bool_and({r}_{x}) AS {r}_{x}" for r in R2 for x in e.ERRORS) + ", CASE WHEN arg_min(won, swapped) = arg_max(won, swapped) THEN arg_min(won, swapped) ELSE 'tie' END AS winner, arg_min(won, swapped) <> arg_max(won, swapped) AS position_disagreement, round(avg(confidence), 6) AS confidence FROM turned GROUP BY document_id, paragraph_id"),
    "w08_error_cases": (on(e.error_cases), f"{E}, l AS ({KINDS}) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY severity DESC, document_id, paragraph_id) AS INT) AS rank FROM l WHERE severity > 0) WHERE rank <= 20"),
}
