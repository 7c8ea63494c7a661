"""Accounts of runs, matching of folders, answers of models and renderings of terms, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import audits as au
from ..operators import controls as c
from ..operators import coverage as j
from ..operators import evaluation as ev
from ..operators import judgments as jd
from ..operators import sampling as w
from ..sources.contracts import relation, with_clause
from ..sources.tables import table
from .consistency_queries import NV, R
from .inference_queries import METHODS, methods
from .relational_queries import DIG, PT, E, paragraphs
from .review_queries import VALID, validated

#: Failed attempts of judged paragraphs, some without tokens.
FAILED = "SELECT document_id, CASE WHEN paragraph_id % 2 = 0 THEN CAST(paragraph_id % 50 AS BIGINT) END AS prompt_tokens, CAST(paragraph_id % 7 AS BIGINT) AS completion_tokens FROM evaluations WHERE paragraph_id % 5 = 2"
#: Translations of three methods with what they took, judged runs of two.
TRANS = """SELECT document_id, CASE paragraph_id % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'glossary' ELSE 'placeholder' END AS method, latency_seconds, attempts, paragraph_id % 3 AS generation_retries, paragraph_id % 4 AS verifier_calls,
  CASE paragraph_id % 5 WHEN 0 THEN 'glossary' WHEN 1 THEN 'placeholder_exact' WHEN 2 THEN 'glossary_fallback' END AS strategy, CASE paragraph_id % 7 WHEN 0 THEN 'noncompliant' WHEN 1 THEN 'glossary_fallback_noncompliant' ELSE 'verified' END AS status, paragraph_id % 5 = 2 AS fallback FROM translations"""
JUDGED = "SELECT CASE WHEN paragraph_id % 3 = 0 THEN 'glossary' ELSE 'placeholder' END AS method, document_id, confidence AS latency_seconds, paragraph_id % 4 AS attempts, prompt_tokens, completion_tokens, paragraph_id % 9 = 1 AS failed FROM evaluations"


def sql(spark, folder, text: str, *names: str):
    for n in names:
        relation(spark, folder, n).createOrReplaceTempView(f"lw_{n}")
        text = text.replace(f"FROM {n}", f"FROM lw_{n}")
    return spark.sql(text)


def usage_totals(spark, folder):
    e = relation(spark, folder, "evaluations")
    picked = w.evaluation_selection(e, "term-bearing-plus-sample", 0.3, 5).select("document_id", "paragraph_id", F.lit(True).alias("selected"))
    return au.usage_totals(e.join(picked, ["document_id", "paragraph_id"], "left"), e.filter("paragraph_id % 5 <> 2"), sql(spark, folder, FAILED, "evaluations"), "document_id")


def flat(column: str):
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias(column)


def efficiency(spark, folder):
    judged = sql(spark, folder, JUDGED, "evaluations")
    out = au.efficiency(sql(spark, folder, TRANS, "translations"), judged.filter("not failed"), judged.filter("failed"), {"glossary": 26.14, "placeholder": None}, "glossary")
    return out.select(*[flat(x) if x == "strategy_counts" else x for x in out.columns])


EFFICIENCY = f"""{with_clause("translations", "evaluations")}, tr AS ({TRANS}), ju AS ({JUDGED}), t AS (SELECT method, count(DISTINCT document_id) AS documents, count(*) AS paragraphs, round(sum(latency_seconds), 6) AS latency_sum, round(avg(latency_seconds), 6) AS latency_mean, round(avg(attempts), 6) AS attempts_mean, CAST(sum(generation_retries) AS BIGINT) AS generation_retries, CAST(sum(verifier_calls) AS BIGINT) AS verifier_calls,
    count(*) FILTER (fallback) AS fallback_paragraphs, count(*) FILTER (status <> 'verified') AS unresolved_paragraphs FROM tr GROUP BY 1), s AS (SELECT method, string_agg(k || '=' || n, ';' ORDER BY k) AS strategy_counts FROM (SELECT method, coalesce(strategy, 'unknown') AS k, count(*) AS n FROM tr GROUP BY ALL) GROUP BY 1),
  g AS (SELECT method, count(DISTINCT document_id) FILTER (NOT failed) AS judge_documents, count(*) FILTER (NOT failed) AS judged_paragraphs, round(sum(latency_seconds) FILTER (NOT failed), 6) AS judge_latency_sum, round(avg(latency_seconds) FILTER (NOT failed), 6) AS judge_latency_mean, round(avg(attempts) FILTER (NOT failed), 6) AS judge_attempts_mean, count(*) FILTER (failed) AS failed_paragraphs, CAST(sum(prompt_tokens) AS BIGINT) AS judge_prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS judge_completion_tokens, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS judge_tokens FROM ju GROUP BY 1),
  x AS (SELECT t.*, strategy_counts, g.* EXCLUDE (method), CASE WHEN t.method = 'glossary' THEN 26.14::DOUBLE WHEN judge_tokens IS NOT NULL THEN judge_tokens * (26.14::DOUBLE / (SELECT judge_tokens FROM g WHERE method = 'glossary')) END AS paid FROM t JOIN s USING (method) LEFT JOIN g USING (method))
  SELECT * EXCLUDE (paid), round(judge_tokens / judged_paragraphs, 6) AS tokens_per_paragraph, round(paid, 6) AS cost, CASE WHEN judge_tokens IS NOT NULL THEN method = 'glossary' END AS cost_is_actual, round(paid * 1000 / judged_paragraphs, 6) AS cost_per_1000 FROM x"""

#: Some occurrences not extracted yet, and tokens of batches, a third of them restored.
AUDITED = "SELECT experiment, CASE WHEN occurrence % 9 = 0 THEN NULL WHEN occurrence % 9 = 1 THEN '' ELSE extraction_status END AS extraction_status, extraction_confidence FROM reviews"
BATCHES = "SELECT CASE WHEN paragraph_id % 2 = 0 THEN 'small__glossary' ELSE 'large__placeholder' END AS experiment, paragraph_id % 3 = 0 AS restored, prompt_tokens, completion_tokens FROM evaluations"


def audit(spark, folder):
    out = au.extraction_audit(sql(spark, folder, AUDITED, "reviews"), sql(spark, folder, BATCHES, "evaluations"), 0.5, "experiment")
    return out.select(*[flat(x) if x == "status_counts" else x for x in out.columns])


USED = ", ".join(f"CAST(coalesce(sum({x}) FILTER ({when}), 0) AS BIGINT) AS {n}_{x}" for n, when in (("run", "NOT restored"), ("restored", "restored"), ("cumulative", "true")) for x in au.TOKENS)
#: Scores that some judgments lack.
HOLES = ", ".join(f"CASE WHEN paragraph_id % {11 + i} = 3 THEN NULL ELSE controlled_{s} END AS controlled_{s}" for i, s in enumerate(ev.SCORES))
KEPT = ", ".join(f"baseline_{s}" for s in ev.SCORES)


def method_subsets(spark, folder):
    m = methods(spark, folder)
    m.createOrReplaceTempView("lw_methods")
    holes = spark.sql(f"SELECT document_id, paragraph_id, has_terms, method, winner, {KEPT}, {HOLES} FROM lw_methods")
    return ev.method_table(w.evaluation_selection(holes, "term-bearing-plus-sample", 0.4, 11))


#: A glossary of the parts: brands as renderings, so that many terms share one.
PART = "(SELECT *, CAST(concat('box ', p_size % 5) AS VARCHAR(20)) AS p_container, CAST(concat('maker ', p_partkey % 20) AS VARCHAR(20)) AS p_mfgr, CAST(concat('comment of ', p_name) AS VARCHAR(200)) AS p_comment FROM part) AS part_with_more"
PARTS = f"SELECT CAST(p_partkey AS VARCHAR(10)) AS term_id, p_name AS source_term, p_brand AS canonical, p_type, p_container, p_mfgr, p_size FROM {PART}"


def parts(spark, folder):
    table(spark, folder, "part").createOrReplaceTempView("lw_part")
    variant = lambda r, when: F.struct(r.alias("rendering"), when.alias("condition"))
    one = lambda r: F.struct(r.alias("rendering"))
    rows = spark.sql(PARTS.replace("FROM part", "FROM lw_part"))
    return rows.withColumns({
        "allowed": F.array(variant(F.concat(F.lit(" "), "p_type"), F.when(F.col("p_size") % 4 == 0, "Informal use").otherwise(F.col("p_container"))), variant(F.col("canonical"), F.lit("always"))),
        "short": F.array(F.col("p_mfgr"), F.lit(""), F.when(F.col("p_size") % 3 == 0, F.col("p_mfgr"))), "risky": F.array(one(F.col("p_container")), one(F.col("p_type"))),
    })


def part_renderings(spark, folder):
    return parts(spark, folder).select("term_id", F.posexplode(c.renderings(F.col("canonical"), F.col("allowed"), F.col("short"), F.col("risky"))).alias("place", "r")).select("term_id", "place", "r.*")


def three_folders(spark, folder):
    p = paragraphs(spark, folder)
    n = F.col("document_id").cast("int")
    extra = relation(spark, folder, "translations").select(F.when(n % 7 == 3, F.concat(F.lit("x"), "document_id")).otherwise(F.col("document_id")).alias("document_id"))
    return au.folders(p, ("translations", extra), ("memory", p.filter(n % 4 > 0)))


THREE = """a AS (SELECT DISTINCT document_id FROM paragraphs), b AS (SELECT DISTINCT CASE WHEN CAST(document_id AS INT) % 7 = 3 THEN 'x' || document_id ELSE document_id END AS document_id FROM translations), m AS (SELECT DISTINCT document_id FROM paragraphs WHERE CAST(document_id AS INT) % 4 > 0),
  f AS (SELECT document_id, a.document_id IS NOT NULL AS has_source, b.document_id IS NOT NULL AS has_translations, m.document_id IS NOT NULL AS has_memory FROM a FULL JOIN b USING (document_id) FULL JOIN m USING (document_id))"""
#: Text with entities and blank lines.
PLAIN = f"SELECT p_partkey, p_name || ' &amp; ' || p_mfgr || ' &lt;' || p_brand || '&gt;' || chr(10) || '  ' || chr(10) || p_comment || chr(10) || chr(10) || p_type || ' &quot;' || p_container || '&quot;' AS text FROM {PART}"

#: Plans of a planner for two items: right ones, and one fault of each kind.
SCOPE = "CASE WHEN p_size % 9 = 3 THEN ' ' ELSE p_mfgr END"
PLAN = f"""SELECT p_partkey, '{{"results": [{{"item_id": ' || CASE WHEN p_size % 9 = 0 THEN '1' ELSE '0' END || ', "canonical_translation": " 术语' || p_partkey || CASE WHEN p_size % 9 = 1 THEN 'term' ELSE '' END || '", "legal_scope_summary": "' || {SCOPE} || '", "rationale": "r", "confidence": ' || CASE WHEN p_size % 9 = 2 THEN '1.5' ELSE '0.5' END
  || ', "allowed_variants": [{{"rendering": "变体", "condition": "' || CASE WHEN p_size % 9 = 4 THEN '' ELSE 'c' END || '"}}, {{"rendering": "变体", "condition": "again"}}, {{"rendering": "术语' || p_partkey || '", "condition": ""}}], "risky_variants": [{{"rendering": "险", "risk_type": "' || CASE WHEN p_size % 9 = 5 THEN 'none' ELSE 'other' END || '", "reason": "' || CASE WHEN p_size % 9 = 6 THEN '' ELSE 'w' END || '"}}]}}, {{"item_id": 1, "canonical_translation": "第二", "legal_scope_summary": "s", "rationale": "r", "confidence": 1}}]}}' AS answer FROM {PART}"""


def plans(spark, folder):
    table(spark, folder, "part").createOrReplaceTempView("lw_part")
    rows = spark.sql(PLAN.replace("FROM part", "FROM lw_part")).withColumn("a", jd.planner_answer(F.col("answer"), F.lit(2)))
    text = F.transform("a.rows", lambda r: F.concat_ws("/", r["canonical"], r["scope"], F.array_join(F.transform(r["allowed"], lambda v: F.concat_ws("+", v["rendering"], v["condition"])), ","), F.array_join(F.transform(r["risky"], lambda v: F.concat_ws("+", v["rendering"], v["risk_type"], v["reason"])), ",")))
    return rows.select("p_partkey", F.col("a.problem").alias("problem"), F.array_join(text, ";").alias("rows"))


#: Answers to an extraction of two occurrences a paragraph: the translation's first words, or one fault of each kind.
WORDS = "replace(left(translation, 12), '\"', '')"
EXTRACTED = f"""SELECT document_id, paragraph_id, translation, '[{{"occurrence_id": "' || CASE WHEN paragraph_id % 8 = 0 THEN 'b' ELSE 'a' END || '", "status": "' || CASE WHEN paragraph_id % 8 = 1 THEN 'lost' ELSE 'found' END || '", "confidence": ' || CASE WHEN paragraph_id % 8 = 2 THEN '-1' ELSE '0.5' END || ', "rendering": "' || CASE WHEN paragraph_id % 8 = 3 THEN 'nowhere' WHEN paragraph_id % 8 = 4 THEN '' ELSE {WORDS} END
  || '"}}, {{"occurrence_id": "b", "status": "omitted", "confidence": 1, "rendering": ' || CASE WHEN paragraph_id % 8 = 5 THEN '"x"' ELSE 'null' END || '}}]' AS answer FROM translations"""


def extractions(spark, folder):
    items = F.array(*[F.struct(F.lit(i).alias("occurrence_id"), F.col("translation").alias("target_paragraph")) for i in "ab"])
    rows = sql(spark, folder, EXTRACTED, "translations").withColumn("a", jd.extraction_answer(F.col("answer"), items))
    return rows.select("document_id", "paragraph_id", F.col("a.problem").alias("problem"), F.array_join(F.transform("a.rows", lambda r: F.concat_ws("/", r["occurrence_id"], r["status"], r["rendering"])), ";").alias("rows"))


STRATEGY = "CASE WHEN paragraph_id % 5 = 0 THEN CASE WHEN paragraph_id % 2 = 0 THEN 'conditional_glossary' ELSE 'uncontrolled' END WHEN paragraph_id % 7 = 1 THEN 'glossary' WHEN paragraph_id % 3 = 1 THEN 'glossary_fallback' WHEN attempts = 1 THEN 'placeholder_exact' WHEN attempts = 2 THEN 'placeholder_repaired' ELSE 'placeholder_retry_exact' END"


def strategies(spark, folder):
    i, r = F.col("paragraph_id"), relation(spark, folder, "translations")
    how = c.strategy(i % 5 > 0, i % 2 == 0, F.when(i % 7 == 1, "glossary").otherwise("placeholder"), i % 3 == 1, F.col("attempts") - 1, F.col("attempts") == 2)
    return r.select("document_id", "paragraph_id", how.alias("strategy"), c.resolution_status(i % 3 == 1, F.col("translation") != "").alias("status"))


QUERIES = {
    "g13_usage_with_failures": (usage_totals, f"""{E}, f AS ({FAILED}), s AS (SELECT *, has_terms OR CAST(('0x' || left({DIG.format(5)}, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616 < 0.3 AS sel FROM evaluations),
      c AS (SELECT document_id, count(*) AS candidates, count(*) FILTER (has_terms) AS candidates_with_terms, count(*) FILTER (NOT has_terms) AS candidates_without_terms, count(*) FILTER (sel) AS selected, count(*) FILTER (sel AND has_terms) AS selected_with_terms, count(*) FILTER (sel AND NOT has_terms) AS selected_without_terms FROM s GROUP BY 1),
      u AS (SELECT document_id, count(*) AS judged, CAST(sum(prompt_tokens) AS BIGINT) AS successful_prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS successful_completion_tokens FROM evaluations WHERE paragraph_id % 5 <> 2 GROUP BY 1), x AS (SELECT document_id, count(*) AS failed, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS failed_prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS failed_completion_tokens FROM f GROUP BY 1),
      z AS (SELECT document_id, c.* EXCLUDE (document_id), {', '.join(f'coalesce({n}, 0) AS {n}' for n in ('judged', 'failed', 'successful_prompt_tokens', 'successful_completion_tokens', 'failed_prompt_tokens', 'failed_completion_tokens'))} FROM c LEFT JOIN u USING (document_id) LEFT JOIN x USING (document_id))
      SELECT *, successful_prompt_tokens + failed_prompt_tokens AS total_prompt_tokens, successful_completion_tokens + failed_completion_tokens AS total_completion_tokens FROM z"""),
    "g20_efficiency": (efficiency, EFFICIENCY),
    "g21_evidence": (lambda s, f: au.variant_evidence(relation(s, f, "reviews"), 3, ["document_id", "term_id"]), f"{R}, x AS (SELECT document_id, term_id, {NV} AS variant, count(*) AS occurrences, count(DISTINCT experiment) AS experiments FROM reviews GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY document_id, term_id ORDER BY occurrences DESC, variant) AS INT) AS place FROM x WHERE variant IS NOT NULL QUALIFY place <= 3"),
    "g23_extraction_audit": (audit, f"""{with_clause("reviews", "evaluations")}, a AS ({AUDITED}), b AS ({BATCHES}), n AS (SELECT *, nullif(extraction_status, '') AS st FROM a), g AS (SELECT experiment, count(*) AS occurrences, count(st) AS completed, count(*) - count(st) AS remaining, count(*) FILTER (st IS NOT NULL AND extraction_confidence < 0.5) AS low_confidence FROM n GROUP BY 1),
      s AS (SELECT experiment, string_agg(st || '=' || k, ';' ORDER BY st) AS status_counts FROM (SELECT experiment, st, count(*) AS k FROM n WHERE st IS NOT NULL GROUP BY ALL) GROUP BY 1), u AS (SELECT experiment, {USED} FROM b GROUP BY 1) SELECT * FROM g JOIN s USING (experiment) JOIN u USING (experiment)"""),
    "g25_method_subsets": (method_subsets, f"""{E}, m AS ({METHODS}), h AS (SELECT document_id, paragraph_id, has_terms, method, winner, {KEPT}, {HOLES} FROM m), k AS (SELECT *, unnest(['overall', CASE WHEN has_terms THEN 'term_bearing' ELSE 'non_term_bearing' END]) AS subset FROM h WHERE has_terms OR CAST(('0x' || left({DIG.format(11)}, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616 < 0.4),
      g AS (SELECT subset, method, count(*) AS paragraphs, count(*) FILTER (winner = 'baseline') AS baseline_wins, count(*) FILTER (winner = 'controlled') AS controlled_wins, {', '.join(f'round(avg(controlled_{s} - baseline_{s}), 6) AS delta_{s}' for s in ev.SCORES)} FROM k GROUP BY ALL)
      SELECT *, paragraphs - baseline_wins - controlled_wins AS ties, round(controlled_wins / paragraphs, 6) AS controlled_win_rate, round(controlled_wins / nullif(baseline_wins + controlled_wins, 0), 6) AS decisive_controlled_win_rate FROM g"""),
    "c13_strategies": (strategies, f"{PT} SELECT document_id, paragraph_id, {STRATEGY} AS strategy, CASE WHEN paragraph_id % 3 = 1 THEN CASE WHEN translation <> '' THEN 'glossary_fallback_verified' ELSE 'glossary_fallback_noncompliant' END WHEN translation <> '' THEN 'verified' ELSE 'noncompliant' END AS status FROM translations"),
    "c09_part_renderings": (lambda s, f: parts(s, f).select("term_id", F.array_join(c.approved_renderings(F.col("canonical"), F.col("allowed"), F.col("short")), "|").alias("approved")), f"SELECT term_id, canonical || CASE WHEN p_size % 4 = 0 THEN '' ELSE '|' || p_type END || '|' || p_mfgr AS approved FROM ({PARTS})"),
    "c11_part_renderings": (part_renderings, f"WITH g AS ({PARTS}) SELECT term_id, CAST(k AS INT) AS place, r AS rendering, kind FROM g, (VALUES (0, 'CANONICAL'), (1, 'ALLOWED_VARIANT'), (2, 'ALLOWED_VARIANT'), (3, 'SHORT_FORM'), (4, 'RISKY_VARIANT'), (5, 'RISKY_VARIANT')) AS v(k, kind), LATERAL (SELECT CASE k WHEN 0 THEN canonical WHEN 1 THEN p_type WHEN 2 THEN canonical WHEN 3 THEN p_mfgr WHEN 4 THEN p_container ELSE p_type END AS r)"),
    "g22_part_collisions": (lambda s, f: j.canonical_collisions(parts(s, f)), f"SELECT canonical, count(DISTINCT term_id) AS terms, count(DISTINCT source_term) AS source_terms FROM ({PARTS}) GROUP BY 1 HAVING count(DISTINCT term_id) > 1"),
    "j02_three_folders": (three_folders, f"{PT}, {THREE} SELECT *, has_source AND has_translations AND has_memory AS paired FROM f"),
    "j02_missing_lists": (lambda s, f: au.missing_lists(three_folders(s, f)).withColumn("first", F.array_join("first", ",")), f"{PT}, {THREE}, l AS (SELECT document_id, unnest(['source', 'translations', 'memory']) AS side, unnest([has_source, has_translations, has_memory]) AS there FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY document_id) AS k FROM l WHERE NOT there) SELECT side, count(*) AS missing, string_agg(document_id, ',' ORDER BY document_id) FILTER (k <= 5) AS first FROM r GROUP BY 1"),
    "a11_levels": (lambda s, f: au.validation_levels(validated(s, f).withColumn("experiment", F.when(F.col("occurrence") % 2 == 0, "even").otherwise("odd"))), f"{R}, {VALID}, e AS (SELECT *, CASE WHEN occurrence % 2 = 0 THEN 'even' ELSE 'odd' END AS experiment FROM x) SELECT experiment, document_id, CASE GROUPING(experiment, document_id) WHEN 0 THEN 'document' WHEN 1 THEN 'experiment' ELSE 'all' END AS level, count(*) AS rows, count(*) FILTER (include_in_consistency) AS included, count(*) FILTER (needs_rendering_repair) AS repairs, count(*) FILTER (validation_status = 'VALID') AS valid FROM e GROUP BY ROLLUP (experiment, document_id)"),
    "s17_markdown_table": (lambda s, f: au.markdown_table(relation(s, f, "evaluations").groupBy("document_id").agg(F.count("*").alias("n"), F.avg(F.when(F.col("document_id") != "3", F.col("baseline_quality"))).alias("quality")), "document_id"), f"{E}, r AS (SELECT document_id, '| ' || document_id || ' | ' || count(*) || ' | ' || CASE WHEN document_id = '3' THEN '—' ELSE printf('%.4f', avg(baseline_quality)) END || ' |' AS line FROM evaluations GROUP BY document_id) SELECT CAST(row_number() OVER (ORDER BY document_id) + 1 AS INT) AS position, line FROM r UNION ALL SELECT 0, '| document_id | n | quality |' UNION ALL SELECT 1, '|---|---|---|'"),
    "s21_complete_experiments": (lambda s, f: au.document_counts(relation(s, f, "reviews").filter("not (experiment = 'small__glossary' and document_id = '4')"), "experiment", 10), f"{R} SELECT experiment, count(DISTINCT document_id) AS documents, count(DISTINCT document_id) >= 10 AS complete FROM reviews WHERE NOT (experiment = 'small__glossary' AND document_id = '4') GROUP BY 1"),
    "p04_plain_blocks": (lambda s, f: (table(s, f, "part").createOrReplaceTempView("lw_part"), s.sql(PLAIN.replace("FROM part", "FROM lw_part")).select("p_partkey", F.posexplode(t.plain_blocks(F.col("text"))).alias("paragraph_id", "text")))[1], f"WITH x AS ({PLAIN}), b AS (SELECT p_partkey, list_filter(list_transform(string_split_regex(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), '\\n\\s*\\n'), lambda p: trim(regexp_replace(p, '[ \\t]+', ' ', 'g'))), lambda p: length(p) >= 8) AS ps FROM x) SELECT p_partkey, unnest(ps) AS text, CAST(generate_subscripts(ps, 1) - 1 AS INT) AS paragraph_id FROM b"),
    "v10_planner_answers": (plans, """SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN 'ids' WHEN 1 THEN 'Latin words: 0' WHEN 2 THEN 'confidence: 0' WHEN 3 THEN 'scope or rationale: 0' WHEN 4 THEN 'a variant without a condition: 0' WHEN 5 THEN 'risk type: 0' WHEN 6 THEN 'a risk without a reason: 0' END AS problem, CASE WHEN p_size % 9 > 6 THEN '术语' || p_partkey || '/' || p_mfgr || '/变体+c/险+OTHER+w;第二/s//' END AS rows FROM """ + PART),
    "v08_extraction_answers": (extractions, f"""{PT}, x AS (SELECT *, {WORDS} AS words, paragraph_id % 8 AS k FROM translations), y AS (SELECT *, CASE WHEN k = 0 THEN 'ids are not those asked for, in their order' WHEN k = 1 THEN 'status: a' WHEN k = 4 OR k <> 3 AND (trim(words) = '' OR NOT contains(translation, trim(words))) OR k = 3 AND NOT contains(translation, 'nowhere') THEN 'rendering is not in the paragraph: a' WHEN k = 2 THEN 'confidence: a' WHEN k = 5 THEN 'rendering without being found: b' END AS problem FROM x)
      SELECT document_id, paragraph_id, problem, CASE WHEN problem IS NULL THEN 'a/FOUND/' || trim(words) || ';b/OMITTED' END AS rows FROM y"""),
}
