"""Review lines, configuration files and experiments made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import experiments as ex
from ..sources import strict as st
from ..sources.tables import table

#: A line a customer: every kind of fault, blank fields that fall back on a suggestion, keys that come twice.
LINES = """SELECT CAST(c_custkey AS INT) + 1 AS line, CAST(c_nationkey AS VARCHAR(10)) AS document_id, ' T' || CAST(CASE WHEN c_custkey % 19 = 0 THEN c_nationkey ELSE 100 + c_custkey END AS VARCHAR(10)) || ' ' AS term_id, c_name AS source_term, '' AS frequency, '' AS extraction_method, '' AS definition_paragraph_ids, '' AS definition_context,
  'general_term' AS suggested_term_type, 'auxiliary' AS suggested_criticality, 'yes' AS suggested_include, CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'PARTY' ELSE ' legal_concept' END AS term_type,
  CASE c_custkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'excluded' ELSE 'Critical' END AS criticality, CASE c_custkey % 13 WHEN 0 THEN '' WHEN 1 THEN 'maybe' WHEN 2 THEN 'N' ELSE 'Include' END AS include_in_benchmark, c_mktsegment AS reviewer_notes FROM customer"""
CHECKED = f"""WITH l AS ({LINES}), n AS (SELECT *, trim(term_id) AS term, CASE WHEN term_type = '' THEN 'GENERAL_TERM' ELSE upper(trim(term_type)) END AS kind, CASE WHEN criticality = '' THEN 'AUXILIARY' ELSE upper(criticality) END AS level, CASE WHEN include_in_benchmark = '' THEN 'yes' ELSE include_in_benchmark END AS used, row_number() OVER (PARTITION BY document_id, term_id ORDER BY line) AS k FROM l),
  j AS (SELECT *, CASE WHEN k > 1 THEN 'duplicate' WHEN kind = 'PARTY' THEN 'term_type' WHEN level = 'HIGH' THEN 'criticality' WHEN used = 'maybe' THEN 'include_in_benchmark' END AS reason FROM n)"""


def lines(spark, folder):
    table(spark, folder, "customer").createOrReplaceTempView("lw_customer")
    return st.judged_lines(spark.sql(LINES.replace("FROM customer", "FROM lw_customer")))


#: Terms to which the accepted lines are applied: some have other wording, some no line, some lines no term.
TERMS = "SELECT CAST(c_nationkey AS VARCHAR(10)) AS document_id, 'T' || CAST(100 + c_custkey AS VARCHAR(10)) AS term_id, CASE WHEN c_custkey % 17 = 0 THEN 'other' ELSE upper(c_name) || ' ' END AS source_term FROM customer WHERE c_custkey % 23 <> 0"


def applied(spark, folder):
    table(spark, folder, "customer").createOrReplaceTempView("lw_customer")
    return st.apply_lines(spark.sql(TERMS.replace("FROM customer", "FROM lw_customer")), st.accepted(lines(spark, folder)))


APPLIED = f"{CHECKED}, good AS (SELECT document_id, term AS term_id, source_term AS reviewed, kind, level, used <> 'N' AND level <> 'EXCLUDED' AS inc, reviewer_notes, term_type = '' OR criticality = '' OR include_in_benchmark = '' AS sug FROM j WHERE reason IS NULL), t AS ({TERMS}), b AS (SELECT *, CASE WHEN t.source_term IS NULL THEN 'stale' WHEN reviewed IS NULL THEN 'missing' WHEN lower(trim(t.source_term)) <> lower(reviewed) THEN 'source term differs' END AS problem FROM t FULL JOIN good USING (document_id, term_id))"

#: A configuration a nation: its suppliers are the experiments.
ENTRY = "'{\"name\": \"' || CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE '' END || s_name || '\"' || CASE s_suppkey % 4 WHEN 0 THEN ', \"enabled\": false' WHEN 1 THEN ', \"max_tokens\": ' || s_suppkey || ', \"extra_body\": {\"a\": 1}' WHEN 2 THEN ', \"model\": \"m' || s_suppkey || '\", \"temperature\": 0.5' ELSE '' END || '}'"
DEFAULTS = "'{\"defaults\": {\"model\": \"m\", \"max_tokens\": 100, \"workers\": ' || n_nationkey || '}, \"experiments\": ['"


def configs(spark, folder):
    s = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", F.expr(ENTRY).alias("e"))
    entries = s.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "e"))), lambda x: x["e"]), ", ").alias("list"))
    n = table(spark, folder, "nation").join(entries, F.col("n_nationkey") == F.col("s_nationkey"))
    return n.select("n_nationkey", F.expr(f"{DEFAULTS} || list || ']}}'").alias("value"))


def matrix(spark, folder):
    return ex.experiment_matrix(configs(spark, folder), "n_nationkey").withColumn("other", F.array_join(F.transform(F.array_sort(F.map_entries("other")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"))


MODELS = "SELECT 'm' || CAST(s_suppkey AS VARCHAR(10)) AS model_key, s_name AS model, CASE WHEN s_suppkey % 3 > 0 THEN 'b' || CAST(s_suppkey AS VARCHAR(10)) END AS baseline_experiment, s_suppkey AS k FROM supplier"


def models(spark, folder):
    table(spark, folder, "supplier").createOrReplaceTempView("lw_supplier")
    rows = spark.sql(MODELS.replace("FROM supplier", "FROM lw_supplier"))
    some = F.when(F.col("k") % 5 > 0, F.array(F.concat(F.lit("c"), F.col("k")), F.concat(F.lit("d"), F.col("k"))))
    there = lambda kind, name, when: rows.filter(when).select(F.lit(kind).alias("kind"), name.alias("name"))
    k = F.col("k")
    existing = there("baseline", F.concat(F.lit("b"), k), k % 2 == 0).union(there("baseline", F.concat(F.lit("c"), k), k % 4 == 1)).union(there("baseline", F.concat(F.lit("d"), k), k % 7 < 5)).union(there("controlled", F.concat_ws("-", "model_key", F.lit("glossary"), F.lit("final")), k % 6 > 1))
    return rows.withColumn("baseline_candidates", some), existing


QUERIES = {
    "s13_review_quarantine": (lambda s, f: st.quarantine(lines(s, f)), f"{CHECKED} SELECT line, document_id, term AS term_id, reason, CASE reason WHEN 'duplicate' THEN document_id || '/' || term WHEN 'term_type' THEN kind WHEN 'criticality' THEN level ELSE used END AS value FROM j WHERE reason IS NOT NULL"),
    "s13_accepted_lines": (lambda s, f: st.accepted(lines(s, f)), f"{CHECKED} SELECT document_id, term AS term_id, source_term, kind AS term_type, level AS criticality, used <> 'N' AND level <> 'EXCLUDED' AS include, reviewer_notes, term_type = '' OR criticality = '' OR include_in_benchmark = '' AS used_suggestion FROM j WHERE reason IS NULL"),
    "a03_applied_lines": (lambda s, f: applied(s, f)[0], f"{APPLIED} SELECT document_id, term_id, source_term, CASE WHEN problem IS NULL THEN kind END AS term_type, CASE WHEN problem IS NULL THEN level END AS criticality, CASE WHEN problem IS NULL THEN inc END AS include, CASE WHEN problem IS NULL THEN reviewer_notes END AS reviewer_notes, CASE WHEN problem IS NULL THEN CASE WHEN sug THEN 'accepted-heuristic-suggestion' ELSE 'human-review-csv' END END AS annotation_source FROM b WHERE source_term IS NOT NULL"),
    "a03_review_problems": (lambda s, f: applied(s, f)[1], f"{APPLIED} SELECT document_id, term_id, problem FROM b WHERE problem IS NOT NULL"),
    "s20_experiment_matrix": (matrix, """WITH s AS (SELECT *, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS position FROM supplier)
      SELECT s_nationkey AS n_nationkey, position, s_name AS name, CASE WHEN s_suppkey % 4 = 2 THEN 'm' || s_suppkey ELSE 'm' END AS model, 'baseline-v1' AS prompt_profile, CASE WHEN s_suppkey % 4 = 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS temperature, CAST(CASE WHEN s_suppkey % 4 = 1 THEN s_suppkey ELSE 100 END AS INT) AS max_tokens, 12000 AS source_chunk_chars, 0 AS context_paragraphs, 12000 AS max_context_chars, 5 AS max_retries, 300.0::DOUBLE AS timeout_seconds, CAST(s_nationkey AS INT) AS workers,
        CASE WHEN s_suppkey % 4 = 1 THEN 'extra_body={"a":1}' ELSE '' END AS other FROM s WHERE s_suppkey % 4 > 0"""),
    "s18_experiment_registry": (lambda s, f: ex.registry(*models(s, f)), f"""WITH m AS ({MODELS}), e AS (SELECT *, CASE WHEN baseline_experiment IS NOT NULL AND k % 2 = 0 THEN 'b' || k WHEN k % 5 > 0 AND k % 4 = 1 THEN 'c' || k WHEN k % 5 > 0 AND k % 7 < 5 THEN 'd' || k END AS found FROM m)
      SELECT model_key || '__baseline' AS experiment_id, model_key, model, 'baseline' AS method, coalesce(found, baseline_experiment) AS source_experiment, found IS NOT NULL AS present FROM e
      UNION ALL SELECT model_key || '__' || w, model_key, model, w, model_key || '-' || w || '-final', w = 'glossary' AND k % 6 > 1 FROM e, (VALUES ('glossary'), ('placeholder')) AS x(w)"""),
}
