"""Rejections, verdicts and paired reviews over the derived relations; expressions in quotes are read by Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import controls as c
from ..operators import evaluation as ev
from ..operators import judgments as jd
from ..sources.contracts import relation, with_clause

E = with_clause("evaluations")

#: A verifier's answers: grades in any case or missing, faults as every kind of JSON value or missing.
GRADES = ('"PASS"', '"pass"', '"FAIL"', "null")
FAULTS = ("false", "0", '""', "null", "[]", '"false"', "true", "1.5", "{}")
GRADE = "CASE paragraph_id % 5 " + " ".join(f"WHEN {i} THEN '\"adequacy\": {g}, '" for i, g in enumerate(GRADES)) + " ELSE '' END"
FAULT = lambda name, step: f"CASE (paragraph_id * {step}) % 10 " + " ".join(f"WHEN {i} THEN ', \"{name}\": {v}'" for i, v in enumerate(FAULTS)) + " ELSE '' END"
ANSWER = f"concat('{{', {GRADE}, '\"term_semantics\": \"PASS\"', {', '.join(FAULT(f, s) for f, s in zip(c.FLAGS, (0, 1, 3, 10)))}, '}}')"
SET = lambda f: f"coalesce(CAST(json_extract(answer, '$.{f}') AS VARCHAR) NOT IN ('null', 'false', '\"\"', '[]', '{{}}', '0'), true) AS {f}"


def verdicts(spark, folder):
    rows = relation(spark, folder, "evaluations").select("paragraph_id", F.expr(ANSWER).alias("answer"))
    return rows.select("paragraph_id", c.semantic_verdict(F.col("answer")).alias("v")).select("paragraph_id", "v.adequacy", *[f"v.{f}" for f in c.FLAGS], "v.passed")


#: Rejections: up to four attempts whose stage and faults repeat in some paragraphs.
STAGE = "CASE (paragraph_id + attempt * (paragraph_id % 3)) % 4 WHEN 0 THEN 'inventory' WHEN 1 THEN 'context' WHEN 2 THEN 'semantic' ELSE 'request' END"
TOKEN_A, TOKEN_B = "concat('T', CAST(attempt % 2 AS VARCHAR(5)))", "concat('T', CAST((attempt + 1) % 2 AS VARCHAR(5)))"
COUNT = "CAST(paragraph_id % 2 * attempt AS INT)"
SIDE = "CASE WHEN paragraph_id % 5 = 0 AND attempt % 2 = 0 THEN 'left' ELSE 'right' END"
GRADED = "CASE WHEN paragraph_id % 7 = attempt THEN 'PASS' ELSE 'FAIL' END"
ERROR = "CASE WHEN paragraph_id % 6 > 2 THEN 'timeout' ELSE concat('error ', CAST(attempt AS VARCHAR(5))) END"


def rejections(spark, folder):
    rows = relation(spark, folder, "evaluations").select("document_id", "paragraph_id", F.explode(F.expr("sequence(1, paragraph_id % 4 + 1)")).alias("attempt"))
    issue = lambda kind, side, severity: F.struct(F.lit(kind).alias("issue_type"), F.lit(None).cast("string").alias("term_id"), F.expr(TOKEN_A if severity == "WARNING" else "'T9'").alias("placeholder"), F.expr(side).alias("side"), F.lit(severity).alias("severity"))
    verdict = F.struct(F.expr(GRADED).alias("adequacy"), F.lit("PASS").alias("term_semantics"), *[F.lit(False).alias(f) for f in c.FLAGS], F.array(F.expr(TOKEN_A), F.expr(TOKEN_B)).alias("problematic_terms"))
    sign = c.rejection_signature(F.expr(STAGE), F.array(F.expr(TOKEN_A), F.expr(TOKEN_B)), F.create_map(F.lit("T5"), F.expr(COUNT)), F.lit(None).cast("map<string,int>"), F.array(issue("near", SIDE, "WARNING"), issue("nested", SIDE, "ERROR")), verdict, F.expr(ERROR))
    return rows.withColumn("signature", sign)


REJECTIONS = f"""{E}, r AS (SELECT document_id, paragraph_id, CAST(unnest(generate_series(1, paragraph_id % 4 + 1)) AS INT) AS attempt FROM evaluations), s AS (SELECT *, {STAGE} AS stage FROM r),
  f AS (SELECT *, concat(stage, '|', CASE stage WHEN 'inventory' THEN concat(array_to_string(list_sort([{TOKEN_A}, {TOKEN_B}]), ','), {COUNT}) WHEN 'context' THEN {SIDE} WHEN 'semantic' THEN {GRADED} ELSE {ERROR} END) AS faults FROM s),
  n AS (SELECT *, row_number() OVER (PARTITION BY document_id, paragraph_id, faults ORDER BY attempt) AS k FROM f)
  SELECT document_id, paragraph_id, count(*) AS rejections, coalesce(min(attempt) FILTER (k = 2), 0) AS fallback_attempt, count(*) FILTER (k = 2) > 0 AS early_fallback FROM n GROUP BY ALL"""

#: Two reviewers' sheets and the key.
SCORES = ("term_correct", "legal_accuracy", "fluency")
SAMPLE = "concat('H', CAST(paragraph_id AS VARCHAR(20))) AS sample_id"
SHEET = lambda r, prefer: [SAMPLE, f"{prefer} AS preferred", *[f"CASE WHEN paragraph_id % {11 + r} = {i} THEN 'n/a' ELSE CAST((paragraph_id * {r + i + j} + {j}) % 5 AS VARCHAR(5)) END AS {s}_{x}" for i, s in enumerate(SCORES) for j, x in enumerate("AB")]]
ONE = SHEET(1, "CASE paragraph_id % 4 WHEN 0 THEN ' a ' WHEN 1 THEN 'B' WHEN 2 THEN 'tie' ELSE '?' END")
TWO = SHEET(2, "CASE paragraph_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'b' WHEN 2 THEN 'TIE' WHEN 3 THEN 'B' END")
HELD = "winner <> 'tie' OR has_terms"
KEY = [SAMPLE, "document_id", "paragraph_id", "CASE WHEN paragraph_id % 2 = 0 THEN 'glossary' ELSE 'placeholder' END AS method_A", "CASE WHEN paragraph_id % 2 = 0 THEN 'placeholder' ELSE 'glossary' END AS method_B", "CASE winner WHEN 'baseline' THEN 'glossary' WHEN 'controlled' THEN 'placeholder' END AS llm_winner"]


def reviews(spark, folder):
    e = relation(spark, folder, "evaluations")
    return jd.paired_reviews(e.selectExpr(*ONE), e.filter(HELD).selectExpr(*TWO), e.selectExpr(*KEY))


LABEL = lambda r: f"CASE upper(trim({r}.preferred)) WHEN 'TIE' THEN 'tie' WHEN 'A' THEN method_A WHEN 'B' THEN method_B END"
DIFFERENCE = lambda r, n, s: f"(TRY_CAST({r}.{s}_A AS DOUBLE) - TRY_CAST({r}.{s}_B AS DOUBLE)) * CASE WHEN method_A = 'glossary' THEN 1 ELSE -1 END AS {n}_{s}_glossary_minus_placeholder"
REVIEWS = f"""{E}, one AS (SELECT {', '.join(ONE)} FROM evaluations), two AS (SELECT {', '.join(TWO)} FROM evaluations WHERE {HELD}), k AS (SELECT {', '.join(KEY)} FROM evaluations),
  x AS (SELECT sample_id, document_id, paragraph_id, {LABEL('one')} AS reviewer_1_preference, {LABEL('two')} AS reviewer_2_preference, coalesce(llm_winner, 'tie') AS llm_winner, {', '.join(DIFFERENCE(r, n, s) for r, n in (('one', 'reviewer_1'), ('two', 'reviewer_2')) for s in SCORES)} FROM k JOIN one USING (sample_id) JOIN two USING (sample_id)),
  y AS (SELECT *, coalesce(reviewer_1_preference = reviewer_2_preference, false) AS reviewers_agree FROM x)
  SELECT *, CASE WHEN reviewers_agree THEN reviewer_1_preference ELSE 'disagreement' END AS consensus, CASE WHEN reviewers_agree THEN reviewer_1_preference = llm_winner END AS consensus_matches_llm FROM y"""

#: Repairs of the paragraphs' renderings: some with other spaces, some not there, some without an answer or a reason.
PT = with_clause("translations")
TARGET = "CASE WHEN paragraph_id % 2 = 0 THEN '本 主体 同意。' ELSE '任何主体' END"
STATUS = "CASE paragraph_id % 7 WHEN 0 THEN 'FOUND_MINIMAL' WHEN 1 THEN 'UNTRANSLATED' WHEN 2 THEN 'OMITTED' WHEN 3 THEN 'RETAIN_ORIGINAL_REVIEW' WHEN 4 THEN 'UNSURE' ELSE 'FOUND_MINIMAL' END"
ANSWERED = "CASE paragraph_id % 3 WHEN 0 THEN '主体' WHEN 1 THEN '本主体' ELSE '' END"


def repairs(spark, folder):
    t = relation(spark, folder, "translations").selectExpr("CAST(paragraph_id AS STRING) AS occurrence_id", "paragraph_id", "'旧' AS rendering", f"{TARGET} AS target_paragraph")
    a = t.filter("paragraph_id % 13 > 0").selectExpr("occurrence_id", f"{STATUS} AS status", f"{ANSWERED} AS rendering", "(paragraph_id % 12) / 10.0D AS confidence", "CASE WHEN paragraph_id % 19 > 0 THEN ' why ' ELSE ' ' END AS rationale")
    return jd.validate_repairs(t, a)


REPAIRS = f"""{PT}, a AS (SELECT CAST(paragraph_id AS VARCHAR) AS occurrence_id, paragraph_id % 13 > 0 AS got, {TARGET} AS target, CASE WHEN got THEN {STATUS} END AS status, {ANSWERED} AS answer, CASE WHEN got THEN (paragraph_id % 12) / 10.0::DOUBLE END AS confidence, CASE WHEN got THEN CASE WHEN paragraph_id % 19 > 0 THEN 'why' ELSE '' END END AS rationale FROM translations),
  b AS (SELECT *, status IN ('FOUND_MINIMAL', 'UNTRANSLATED') AS needs, CASE WHEN contains(target, answer) THEN answer WHEN contains(replace(target, ' ', ''), answer) THEN '本 主体' END AS found FROM a),
  c AS (SELECT *, CASE WHEN NOT got THEN 'occurrence_id' WHEN status NOT IN ('FOUND_MINIMAL', 'OMITTED', 'IMPLICIT', 'AMBIGUOUS', 'UNTRANSLATED', 'RETAIN_ORIGINAL_REVIEW') THEN 'status' WHEN confidence > 1 THEN 'confidence' WHEN rationale = '' THEN 'rationale' WHEN needs AND answer = '' THEN 'rendering is missing' WHEN needs AND found IS NULL THEN 'rendering is not in the paragraph' END AS problem FROM b)
  SELECT occurrence_id, CASE WHEN problem IS NULL THEN CASE WHEN needs THEN found WHEN status = 'RETAIN_ORIGINAL_REVIEW' THEN '旧' END END AS rendering, status, confidence, rationale, problem FROM c"""

WINS = f"""{E}, x AS (SELECT winner, unnest(['overall', CASE WHEN has_terms THEN 'term_bearing' ELSE 'non_term_bearing' END]) AS subset FROM evaluations), g AS (SELECT subset, count(*) AS paragraphs, count(*) FILTER (winner = 'baseline') AS baseline_wins, count(*) FILTER (winner = 'controlled') AS controlled_wins FROM x GROUP BY 1)
  SELECT *, paragraphs - baseline_wins - controlled_wins AS ties, round(baseline_wins / paragraphs, 6) AS baseline_win_rate, round(controlled_wins / paragraphs, 6) AS controlled_win_rate, round(baseline_wins / nullif(baseline_wins + controlled_wins, 0), 6) AS decisive_baseline_win_rate FROM g"""

QUERIES = {
    "c12_early_fallback": (lambda s, f: c.early_fallback(rejections(s, f), 2), REJECTIONS),
    "c15_semantic_verdict": (verdicts, f"{E}, a AS (SELECT paragraph_id, {ANSWER} AS answer FROM evaluations), v AS (SELECT paragraph_id, CASE WHEN json_extract(answer, '$.adequacy') IS NULL THEN 'FAIL' ELSE upper(coalesce(json_extract_string(answer, '$.adequacy'), 'NONE')) END AS adequacy, upper(json_extract_string(answer, '$.term_semantics')) = 'PASS' AS meant, {', '.join(map(SET, c.FLAGS))} FROM a) SELECT * EXCLUDE (meant), adequacy = 'PASS' AND meant AND NOT ({' OR '.join(c.FLAGS)}) AS passed FROM v"),
    "j07_paired_reviews": (reviews, REVIEWS),
    "k10_direct_wins": (lambda s, f: ev.direct_wins(relation(s, f, "evaluations")), WINS),
    "v09_validate_repairs": (repairs, REPAIRS),
}
