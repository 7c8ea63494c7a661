"""Statistics over documents at full numbers: 10,000 resamples and 50,000 sign flips, with the SQL that draws the same numbers."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from ..operators import consistency as c
from ..operators import evaluation as ev
from ..operators import statistics as k
from ..sources.contracts import relation, with_clause
from .consistency_queries import JUDGED, R, judged, sql_judged
from .control_queries import control_run, run_sql
from .relational_queries import SIGN_P

E = with_clause("evaluations")
SCORES = ev.SCORES
MASK = 4294967295


def mixed(rows: str, x: str, name: str) -> str:
    """rows with a column more: 32 mixed bits of x."""
    one = f"SELECT *, (xor(_x, _x >> 16) * {0x7FEB352D}) & {MASK} AS _y FROM (SELECT *, CAST({x} AS UBIGINT) & {MASK} AS _x FROM ({rows}))"
    two = f"SELECT *, (xor(_y, _y >> 15) * {0x846CA68B}) & {MASK} AS _z FROM ({one})"
    return f"SELECT * EXCLUDE (_x, _y, _z), xor(_z, _z >> 16) AS {name} FROM ({two})"


def inference(rows: str, keys: str, resamples: int = 10_000, permutations: int = 50_000, seed: int = 2026) -> str:
    """CTEs from `rows` (keys, stream, document_id, diff) to `inferred`."""
    samples = mixed(mixed(mixed(f"SELECT stream, m, r, place FROM seen, (SELECT unnest(range({max(resamples, 1)})) AS r), LATERAL (SELECT unnest(range(m)) AS place)", f"({seed} + stream)", "a"), "a + r", "b"), "b + place", "z")
    words = mixed(mixed(mixed(f"SELECT d.stream, key, mean, w FROM docs d, (SELECT unnest(range({-(-max(permutations, 1) // 32)})) AS w)", f"({seed ^ 0x5F5F5F5F} + stream)", "a"), "a + w", "b"), "b + key", "z")
    return f"""docs AS (SELECT {keys}stream, document_id, sum(diff) AS s, count(*) AS n, sum(diff) / count(*) AS mean, CAST(('0x' || left(sha256(document_id), 8)) AS UBIGINT) AS key FROM ({rows}) WHERE diff IS NOT NULL GROUP BY ALL),
  placed AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY document_id) - 1 AS place FROM docs),
  seen AS (SELECT {keys}stream, count(*) AS m, CAST(sum(n) AS BIGINT) AS paragraphs, avg(mean) AS macro, sum(s) / sum(n) AS weighted FROM docs GROUP BY ALL),
  drawn AS (SELECT stream, r, z % m AS place FROM ({samples})),
  replicates AS (SELECT stream, r, avg(mean) AS macro, sum(s) / sum(n) AS ratio FROM drawn JOIN placed USING (stream, place) GROUP BY ALL),
  limits AS (SELECT stream, round(quantile_cont(macro, 0.025), 6) AS macro_low, round(quantile_cont(macro, 0.975), 6) AS macro_high, round(quantile_cont(ratio, 0.025), 6) AS weighted_low, round(quantile_cont(ratio, 0.975), 6) AS weighted_high FROM replicates GROUP BY 1),
  words AS ({words}),
  flipped AS (SELECT stream, 32 * w + bitno AS p, sum(mean * CASE WHEN (z >> bitno) & 1 = 1 THEN -1 ELSE 1 END) AS total FROM words, (SELECT CAST(unnest(range(32)) AS UBIGINT) AS bitno) GROUP BY ALL),
  extremes AS (SELECT stream, count(*) FILTER (abs(total / m) >= abs(macro) - 1e-12) AS extreme FROM flipped JOIN seen USING (stream) WHERE p < {permutations} GROUP BY 1),
  inferred AS (SELECT {keys}m AS documents, paragraphs, round(macro, 6) AS macro_effect, macro_low, macro_high, round(weighted, 6) AS weighted_effect, weighted_low, weighted_high, round((coalesce(extreme, 0) + 1) / {permutations + 1}, 6) AS sign_flip_p FROM seen JOIN limits USING (stream) LEFT JOIN extremes USING (stream))"""


def pairs(spark, folder):
    return relation(spark, folder, "evaluations").select("document_id", (F.col("controlled_quality") - F.col("baseline_quality")).alias("diff"))


PAIRS = "SELECT 0 AS stream, document_id, controlled_quality - baseline_quality AS diff FROM evaluations"
SUBSET = "(SELECT *, unnest(['overall', CASE WHEN has_terms THEN 'term_bearing' ELSE 'non_term_bearing' END]) AS subset FROM {})"
STREAM = "100 * (list_position(['overall', 'term_bearing', 'non_term_bearing'], subset) - 1)"


def metric_rows(source: str, diff) -> str:
    return " UNION ALL ".join(f"SELECT subset, '{s}' AS metric, CAST({STREAM} + {i} AS INT) AS stream, document_id, {diff(s)} AS diff FROM {SUBSET.format(source)}" for i, s in enumerate(SCORES))


#: Two methods judged against one baseline: the second has other scores, more ties, and lacks some paragraphs.
COLUMNS = ", ".join(f"baseline_{s}" for s in SCORES)
OTHER = ", ".join(f"controlled_{SCORES[(i + 1) % len(SCORES)]} AS controlled_{s}" for i, s in enumerate(SCORES))
METHODS = f"""SELECT document_id, paragraph_id, has_terms, 'glossary' AS method, winner, {COLUMNS}, {', '.join(f'controlled_{s}' for s in SCORES)} FROM evaluations
  UNION ALL SELECT document_id, paragraph_id, has_terms, 'placeholder', CASE WHEN paragraph_id % 5 = 0 THEN 'tie' ELSE winner END, {COLUMNS}, {OTHER} FROM evaluations WHERE paragraph_id % 7 <> 0"""
PAIR = ("glossary", "placeholder")


def methods(spark, folder):
    relation(spark, folder, "evaluations").createOrReplaceTempView("lw_evaluations")
    return spark.sql(METHODS.replace("FROM evaluations", "FROM lw_evaluations"))


BOTH = f"m AS ({METHODS}), pairs AS (SELECT document_id, paragraph_id FROM m GROUP BY ALL HAVING count(DISTINCT method) = 2), cm AS (SELECT m.* FROM m JOIN pairs USING (document_id, paragraph_id))"
DELTAS = ", ".join(f"sum(CASE WHEN method = 'glossary' THEN 1 ELSE -1 END * (controlled_{s} - baseline_{s})) AS delta_{s}" for s in SCORES)
WINS = "count(*) FILTER (winner = 'baseline') AS baseline_wins, count(*) FILTER (winner = 'controlled') AS controlled_wins"


def method_documents(spark, folder):
    """Metrics of a document by size of model as method."""
    exp = ["experiment", "document_id", "term_id"]
    r = relation(spark, folder, "reviews").withColumn("document_id", F.expr("cast(cast(document_id as int) div 2 as string)"))
    return c.document_metrics(judged(r, exp), "experiment").withColumnRenamed("experiment", "method")


PAIRED_REVIEWS = R.replace("SELECT CAST(l_suppkey % 20 AS VARCHAR(10)) AS document_id", "SELECT CAST(CAST(floor(l_suppkey % 20 / 2) AS INT) AS VARCHAR(10)) AS document_id")
DOCUMENT = """SELECT {k}document_id, round(CAST(sum(CAST(dominant_translation_ratio AS DECIMAL(18,6))) AS DOUBLE) / count(dominant_translation_ratio), 6) AS dtr_macro, round(sum(exact + acceptable) / nullif(sum(resolved), 0), 6) AS slcr,
  round(sum(inconsistent) / nullif(sum(resolved), 0), 6) AS lir, round(sum(omitted) / nullif(sum(occurrences), 0), 6) AS omission_rate FROM judged GROUP BY ALL"""
METRICS = ("dtr_macro", "slcr", "lir", "omission_rate")
#: crc32('small__glossary') in its last 20 bits, times 100: the stream of the one method compared.
FIRST = 100 * (zlib.crc32(b"small__glossary") % (1 << 20))
PAIRED = " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({FIRST + i} AS BIGINT) AS stream, a.document_id, b.{m} AS before, a.{m} AS after, a.{m} - b.{m} AS diff FROM d a JOIN d b USING (document_id) WHERE a.experiment = 'small__glossary' AND b.experiment = 'large__placeholder' AND a.{m} IS NOT NULL AND b.{m} IS NOT NULL" for i, m in enumerate(METRICS))
QUERIES = {
    "k02_bootstrap": (lambda s, f: k.bootstrap(pairs(s, f)), f"{E}, {inference(PAIRS, '', permutations=0)} SELECT documents AS n, macro_effect AS mean, macro_low AS low, macro_high AS high FROM inferred"),
    "k02_cluster_ratio": (lambda s, f: k.cluster_ratio(pairs(s, f)), f"{E}, {inference(PAIRS, '', permutations=0)} SELECT documents, paragraphs, weighted_effect AS effect, weighted_low AS low, weighted_high AS high FROM inferred"),
    "k03_sign_flip": (lambda s, f: k.sign_flip(pairs(s, f)), f"{E}, {inference(PAIRS, '', resamples=1)} SELECT macro_effect AS observed, sign_flip_p AS p_value FROM inferred"),
    "k07_paired_documents": (lambda s, f: k.paired_documents(method_documents(s, f), "large__placeholder", list(METRICS)), f"""{PAIRED_REVIEWS}, {sql_judged('experiment, document_id, term_id')}, d AS ({DOCUMENT.format(k='experiment, ')}), p AS ({PAIRED}), {inference('SELECT metric, stream, document_id, diff FROM p', 'metric, ', permutations=0)},
      g AS (SELECT metric, count(*) AS documents, round(avg(before), 6) AS mean_before, round(avg(after), 6) AS mean_after, round(avg(diff), 6) AS mean_diff, round(count(*) FILTER (CASE WHEN metric IN ('lir', 'omission_rate') THEN diff < 0 ELSE diff > 0 END) / count(*), 6) AS improved_fraction, count(*) FILTER (diff > 0) AS up, count(*) FILTER (diff < 0) AS down FROM p GROUP BY 1)
      SELECT 'small__glossary' AS method, g.*, round({SIGN_P}, 6) AS sign_p, macro_low AS low, macro_high AS high FROM g JOIN inferred USING (metric)"""),
    "k10_direct_effects": (lambda s, f: ev.direct_effects(relation(s, f, "evaluations")), f"""{E}, {inference(metric_rows('evaluations', lambda s: f'baseline_{s} - controlled_{s}'), 'subset, metric, ')},
      w AS (SELECT subset, count(*) AS paragraphs, {WINS} FROM {SUBSET.format('evaluations')} GROUP BY 1) SELECT i.*, baseline_wins, controlled_wins, w.paragraphs - baseline_wins - controlled_wins AS ties, round(baseline_wins / w.paragraphs, 6) AS baseline_win_rate, round(controlled_wins / w.paragraphs, 6) AS controlled_win_rate, round(baseline_wins / nullif(baseline_wins + controlled_wins, 0), 6) AS decisive_baseline_win_rate FROM inferred i JOIN w USING (subset)"""),
    "k11_main_table": (lambda s, f: ev.method_table(ev.common(methods(s, f), PAIR)), f"""{E}, {BOTH}, g AS (SELECT subset, method, count(*) AS paragraphs, {WINS}, {', '.join(f'round(avg(controlled_{s} - baseline_{s}), 6) AS delta_{s}' for s in SCORES)} FROM {SUBSET.format('cm')} GROUP BY ALL)
      SELECT *, paragraphs - baseline_wins - controlled_wins AS ties, round(controlled_wins / paragraphs, 6) AS controlled_win_rate, round(controlled_wins / nullif(baseline_wins + controlled_wins, 0), 6) AS decisive_controlled_win_rate FROM g"""),
    "k11_significance": (lambda s, f: ev.significance(methods(s, f), PAIR), f"{E}, {BOTH}, deltas AS (SELECT document_id, paragraph_id, has_terms, {DELTAS} FROM cm GROUP BY ALL), {inference(metric_rows('deltas', lambda s: f'delta_{s}'), 'subset, metric, ')} SELECT *, sign_flip_p < 0.05 AS significant FROM inferred"),
    "k11_reliability": (lambda s, f: ev.reliability(control_run(s, f), "document_id"), f"""WITH run AS ({run_sql()}), x AS (SELECT *, greatest(0, total_paragraphs - uncontrolled_paragraphs) AS controlled_paragraphs FROM run)
      SELECT document_id, total_paragraphs, controlled_paragraphs, placeholder_semantic_verifier_calls AS verifier_calls, round(placeholder_exact_paragraphs / nullif(controlled_paragraphs, 0), 6) AS first_pass_rate, round(placeholder_retry_success_paragraphs / nullif(controlled_paragraphs, 0), 6) AS retry_recovery_rate, round((placeholder_exact_paragraphs + placeholder_retry_success_paragraphs) / nullif(controlled_paragraphs, 0), 6) AS placeholder_path_success_rate,
        round(placeholder_fallback_paragraphs / nullif(controlled_paragraphs, 0), 6) AS fallback_rate, round(unresolved_paragraphs / nullif(controlled_paragraphs, 0), 6) AS unresolved_rate, round(1 - round(unresolved_paragraphs / nullif(controlled_paragraphs, 0), 6), 6) AS final_compliance_rate FROM x"""),
    "g18_document_rates": (lambda s, f: c.document_metrics(judged(relation(s, f, "reviews"))), f"{R}, {JUDGED} {DOCUMENT.format(k='')}"),
}
