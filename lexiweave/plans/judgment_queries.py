"""Validation of model answers over generated ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judgments as v
from ..operators.providers import EchoProvider, ask
from ..sources.contracts import relation, with_clause
from ..sources.tables import table

E, R = with_clause("evaluations"), with_clause("reviews")


def judged_groups(spark, folder):
    k = F.col("p_partkey") % 8
    item = lambda i, label="UNRESOLVED", sure=0.5, why="because": F.struct(F.lit(i).alias("variant_id"), F.lit(label).alias("label"), F.lit(sure).alias("confidence"), F.lit(why).alias("rationale"))
    answers = (
        F.when(k == 0, F.array(item("V001"))).when(k == 1, F.array(item("V001"), item("V002"), item("V003"))).when(k == 2, F.array(item("V001"), item("V002"), item("V002")))
        .when(k == 3, F.array(item("V001", "SURE"), item("V002"))).when(k == 4, F.array(item("V001", sure=2.0), item("V002"))).when(k == 5, F.array(item("V001", why=" "), item("V002")))
        .when(k == 6, F.array(item("V000", "EXACT_CONSISTENT"), item("V001", "LEGAL_INCONSISTENCY"), item("V002"))).otherwise(F.array(item("V001", "ACCEPTABLE_VARIANT"), item("V002", "ACCEPTABLE_VARIANT")))
    )
    rows = table(spark, folder, "part").select("p_partkey", answers.alias("a"))
    return rows.select("p_partkey", v.judge_problem(F.array(F.lit("V001"), F.lit("V002")), F.lit("V000"), F.col("a")).alias("problem"), v.group_label(F.transform("a", lambda x: x["label"])).alias("group_label"))


def extraction(spark, folder):
    k = F.col("p_partkey") % 5
    status = F.when(k == 0, "DONE").when(k == 1, "FOUND").when(k == 2, "OMITTED").when(k == 3, "FOUND").otherwise("IMPLICIT")
    rendering = F.when(k == 1, F.split("p_name", " ")[0]).when(k == 2, "x").when(k == 3, "not there")
    return table(spark, folder, "part").select("p_partkey", v.extraction_problem(status, rendering, F.col("p_name")).alias("problem"))


def asked(spark, folder):
    requests = table(spark, folder, "part").select("p_partkey", F.concat(F.lit("Translate:\n"), "p_name").alias("prompt"))
    return ask(requests, EchoProvider()).select("p_partkey", "answer")


QUERIES = {
    "v03_judge_validation": (judged_groups, "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'missing variant' WHEN 1 THEN 'unknown variant' WHEN 2 THEN 'repeated variant' WHEN 3 THEN 'label' WHEN 4 THEN 'confidence' WHEN 5 THEN 'rationale' END AS problem, CASE p_partkey % 8 WHEN 6 THEN 'LEGAL_INCONSISTENCY' WHEN 7 THEN 'ACCEPTABLE_VARIATION' ELSE 'UNRESOLVED' END AS group_label FROM part"),
    "v08_extraction_validation": (extraction, "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'status' WHEN 2 THEN 'rendering without being found' WHEN 3 THEN 'rendering is not in the paragraph' END AS problem FROM part"),
    "v10_planner_validation": (lambda s, f: table(s, f, "part").select("p_partkey", v.planner_problem(F.element_at(F.array(F.lit("SOFR利率"), F.lit("the 利率"), F.lit(" "), F.lit("计划")), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_size") / 25).alias("problem")), "SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'Latin words' WHEN 2 THEN 'canonical' ELSE CASE WHEN p_size > 25 THEN 'confidence' END END AS problem FROM part"),
    "v11_annotation_validation": (lambda s, f: v.annotation_problems(table(s, f, "part").select((F.col("p_partkey") / 10).cast("long").alias("batch"), F.when(F.col("p_partkey") % 70 == 3, 4).otherwise(F.col("p_partkey") % 10).alias("id"), F.lit("GENERAL_TERM").alias("term_type"), F.when(F.col("p_partkey") % 110 == 5, "HIGH").otherwise("CRITICAL").alias("criticality"))), "SELECT p_partkey // 10 AS batch, CASE WHEN bool_or(p_partkey % 70 = 3) THEN 'ids' WHEN bool_or(p_partkey % 110 = 5) THEN 'values' END AS problem FROM part GROUP BY 1"),
    "v12_signatures": (lambda s, f: table(s, f, "customer").select("c_custkey", v.signature(F.col("c_mktsegment"), F.col("c_nationkey")).alias("signature")), "SELECT c_custkey, sha256('{\"c_mktsegment\":\"' || c_mktsegment || '\",\"c_nationkey\":' || c_nationkey || '}') AS signature FROM customer"),
    "u01_provider_echo": (asked, "SELECT p_partkey, p_name AS answer FROM part"),
}
