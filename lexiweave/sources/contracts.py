"""Contract-like documents, term memory, reviews and judgments derived from the star-schema tables.

The driver's tables hold no contracts, so the same relations are built in Spark and in DuckDB by one SQL text that both
read: a document for each nation, a paragraph for each customer, reviews of renderings from line items, judged paragraphs from orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import views

#: Plain SQL that Spark and DuckDB read alike.
CTES = {
    "glossary": """glossary AS (SELECT * FROM (VALUES
  ('T0001', 'Person', 'PARTY_NAME', 'CRITICAL', '主体'), ('T0002', 'U.S. Person', 'PARTY_NAME', 'IMPORTANT', '美国主体'),
  ('T0003', 'Effective Date', 'DEFINED_LEGAL_TERM', 'CRITICAL', '生效日期'), ('T0004', 'Code', 'DOCUMENT_REFERENCE', 'IMPORTANT', '法典'),
  ('T0005', 'Gilead', 'PARTY_NAME', 'IMPORTANT', '吉利德'), ('T0006', 'Executive', 'PARTY_NAME', 'AUXILIARY', '高管'),
  ('T0007', 'Base Salary', 'COMMERCIAL_TERM', 'IMPORTANT', '基本薪资'), ('T0008', 'Plan', 'DOCUMENT_REFERENCE', 'AUXILIARY', '计划'),
  ('T0009', 'LTIP', 'DOCUMENT_REFERENCE', 'IMPORTANT', '长期激励计划'), ('T0010', 'Cause', 'DEFINED_LEGAL_TERM', 'EXCLUDED', '正当理由')
) AS g(term_id, source_term, term_type, criticality, canonical))""",
    "phrases": """phrases AS (SELECT * FROM (VALUES
  (0, '“Person” means any natural person or entity'), (1, 'Any Person may notify another Person'), (2, 'Each U.S. Person shall comply with the Internal Revenue Code'),
  (3, 'this Agreement takes effect on the Effective Date (the “Effective Date”)'), (4, 'Gilead’s Board and the Gilead Leadership approve it'),
  (5, 'The Chief Executive Officer and the Executive agree'), (6, 'Your Base Salary is paid under the Savings Plan'), (7, 'The Annual LTIP and the Existing LTIP apply'),
  (8, 'a termination for Cause, and no other cause, counts'), (9, '“Base Salary” shall mean the annual pay'), (10, 'The Plan and the Code govern; Gilead Sciences pays'),
  (11, 'Benefits. Gilead will provide coverage to the Executive'), (12, '(“LTIP”) Code has the meaning given by the Bankruptcy Code'), (13, 'POLICY Gilead employees follow any Sanctioned Person rule'),
  (14, '“Code” means the tax law and “Plan” means the Savings Plan'), (15, 'Cause means a breach, and “Gilead” has the meaning stated')
) AS p(k, phrase))""",
    "paragraphs": """paragraphs AS (
  SELECT CAST(c.c_nationkey AS VARCHAR(10)) AS document_id, CAST(c.c_custkey AS INT) AS paragraph_id,
    a.phrase || '. ' || b.phrase || ' for ' || c.c_name || '. ' || d.phrase || '.' AS text
  FROM customer c JOIN phrases a ON a.k = c.c_custkey % 16 JOIN phrases b ON b.k = (c.c_custkey * 7 + 3) % 16 JOIN phrases d ON d.k = (c.c_custkey * 11 + 5) % 16
)""",
    "translations": """translations AS (
  SELECT document_id, paragraph_id, CASE WHEN paragraph_id % 17 = 0 THEN '' ELSE replace(replace(replace(text, 'Person', '主体'), 'Effective Date', '生效日期'), 'Base Salary', CASE WHEN paragraph_id % 3 = 0 THEN '基薪' ELSE '基本薪资' END) END AS translation,
    CASE WHEN paragraph_id % 29 = 0 THEN 'other ' || text ELSE text END AS source, paragraph_id % 4 + 1 AS attempts, CAST((paragraph_id % 50) * 0.25 AS DOUBLE) AS latency_seconds
  FROM paragraphs WHERE paragraph_id % 11 <> 3
)""",
    "reviews": """reviews AS (
  SELECT CAST(l_suppkey % 20 AS VARCHAR(10)) AS document_id, 'T' || CAST(1000 + l_partkey % 60 AS VARCHAR(10)) AS term_id, l_orderkey * 10 + l_linenumber AS occurrence,
    CASE WHEN l_linenumber = 7 THEN CAST(NULL AS VARCHAR(40)) WHEN l_returnflag = 'A' THEN '生效日期' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN ' “生效日” ' WHEN l_returnflag = 'R' THEN '生效' ELSE '生效日期 ' END AS rendering,
    CASE WHEN l_linenumber = 7 THEN 'OMITTED' WHEN l_linenumber = 6 AND l_quantity > 40 THEN 'IMPLICIT' WHEN l_linenumber = 5 AND l_quantity > 45 THEN 'AMBIGUOUS' WHEN l_quantity = 50 THEN 'TRANSLATION_ERROR' ELSE 'FOUND' END AS extraction_status,
    CASE WHEN l_tax > 0.07 THEN false WHEN l_tax > 0.06 THEN CAST(NULL AS BOOLEAN) ELSE true END AS include_in_consistency,
    CASE WHEN l_partkey % 5 = 0 THEN 'CRITICAL' WHEN l_partkey % 5 = 1 THEN 'IMPORTANT' WHEN l_partkey % 5 = 2 THEN 'AUXILIARY' WHEN l_partkey % 5 = 3 THEN 'EXCLUDED' ELSE 'OTHER' END AS criticality,
    CAST(l_discount AS DOUBLE) * 10 AS extraction_confidence, l_shipmode_stub AS experiment
  FROM (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 'small__glossary' ELSE 'large__placeholder' END AS l_shipmode_stub FROM lineitem) l
)""",
    "evaluations": """evaluations AS (
  SELECT CAST(o_custkey % 40 AS VARCHAR(10)) AS document_id, CAST(o_orderkey AS INT) AS paragraph_id, o_custkey % 3 <> 0 AS has_terms,
    CASE o_orderstatus WHEN 'F' THEN 'baseline' WHEN 'O' THEN 'controlled' ELSE 'tie' END AS winner,
    CAST(1 + o_orderkey % 9 / 2.0 AS DOUBLE) AS baseline_fidelity, CAST(1 + (o_orderkey * 7) % 9 / 2.0 AS DOUBLE) AS controlled_fidelity,
    CAST(1 + (o_orderkey * 3) % 9 / 2.0 AS DOUBLE) AS baseline_quality, CAST(1 + (o_orderkey * 5) % 9 / 2.0 AS DOUBLE) AS controlled_quality,
    CAST(1 + (o_orderkey * 2) % 9 / 2.0 AS DOUBLE) AS baseline_legal, CAST(1 + (o_orderkey * 4) % 9 / 2.0 AS DOUBLE) AS controlled_legal,
    CAST(1 + (o_orderkey * 8) % 9 / 2.0 AS DOUBLE) AS baseline_terminology, CAST(1 + (o_orderkey * 10) % 7 / 2.0 AS DOUBLE) AS controlled_terminology,
    CAST(1 + (o_orderkey * 3) % 7 / 2.0 AS DOUBLE) AS baseline_fluency, CAST(1 + (o_orderkey * 5) % 8 / 2.0 AS DOUBLE) AS controlled_fluency,
    o_orderkey % 13 = 0 AS baseline_omission, o_orderkey % 17 = 0 AS controlled_omission, o_orderkey % 23 = 0 AS baseline_addition, o_orderkey % 29 = 0 AS controlled_addition,
    o_orderkey % 31 = 0 AS baseline_polarity, o_orderkey % 37 = 0 AS controlled_polarity, o_orderkey % 41 = 0 AS baseline_party, o_orderkey % 43 = 0 AS controlled_party,
    o_orderkey % 47 = 0 AS baseline_number, o_orderkey % 53 = 0 AS controlled_number, o_orderkey % 19 = 0 AS position_disagreement,
    CAST(o_orderkey % 1000 AS DOUBLE) / 1000 AS confidence, CAST(o_orderkey % 700 AS BIGINT) AS prompt_tokens, CAST(o_orderkey % 90 AS BIGINT) AS completion_tokens
  FROM orders
)""",
}
NEEDS = {"paragraphs": ("phrases",), "translations": ("phrases", "paragraphs")}
TABLES = {"paragraphs": ("customer",), "reviews": ("lineitem",), "evaluations": ("orders",)}


def chain(*names: str) -> list[str]:
    """The relations with those they are built from, in order, each once."""
    out: list[str] = []
    for n in names:
        for m in (*chain(*NEEDS.get(n, ())), n):
            if m not in out:
                out.append(m)
    return out


def with_clause(*names: str) -> str:
    return "WITH " + ",\n".join(CTES[n] for n in chain(*names))


def relation(spark: SparkSession, folder: str, name: str) -> DataFrame:
    needed = chain(name)
    views(spark, folder, *{t for n in needed for t in TABLES.get(n, ())})
    return spark.sql(f"{with_clause(name)} SELECT * FROM {name}")
