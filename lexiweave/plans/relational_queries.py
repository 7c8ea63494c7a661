"""Terms, joins, samples and statistics over the derived relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import coverage as j
from ..operators import sampling as w
from ..operators import statistics as k
from ..operators import terms as tm
from ..operators import validation as val
from ..sources.contracts import relation, with_clause
from .use_sql import USES

P, PT, PG = with_clause("paragraphs"), with_clause("translations"), with_clause("translations", "glossary")
E = with_clause("evaluations")

QUOTE, BODY = tm.QUOTE, tm.BODY.replace("'", "''")
DEFS = " UNION ALL ".join(
    f"SELECT document_id, paragraph_id, '{m}' AS method, {i} AS pattern, unnest(x) AS term, generate_subscripts(x, 1) - 1 AS match FROM (SELECT document_id, paragraph_id, regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', 1) AS x FROM paragraphs)"
    for i, (m, p) in enumerate(tm.PATTERNS)
)
DEFS = f"d0 AS ({DEFS}), d1 AS (SELECT * REPLACE (trim(regexp_replace(term, '\\s+', ' ', 'g'), ' .,:;()[]') AS term) FROM d0), defs AS (SELECT * FROM d1 WHERE length(term) BETWEEN 2 AND 120 AND len(string_split(term, ' ')) <= 11 AND term NOT IN {tm.NO_TERMS})"
TERMS = f"{DEFS}, terms AS (SELECT document_id, lower(term) AS key, arg_min(term, (paragraph_id, pattern, match)) AS source_term, (SELECT string_agg(x, '+' ORDER BY x) FROM (SELECT unnest(list(DISTINCT method)) AS x)) AS extraction_method, list_sort(list(DISTINCT paragraph_id)) AS definition_paragraph_ids FROM defs GROUP BY ALL)"
#: Matches by place, boundaries checked on both sides; overlaps go to the longer term (shorter ones only nest in longer ones here).
OCC = f"""{TERMS}, spots AS (SELECT p.document_id, p.paragraph_id, p.text, t.key, t.source_term, s.i AS char_start, s.i + length(t.source_term) AS char_end FROM paragraphs p JOIN terms t USING (document_id), LATERAL (SELECT unnest(generate_series(0, length(p.text) - length(t.source_term))) AS i) s WHERE contains(lower(p.text), t.key) AND lower(substr(p.text, CAST(s.i AS INT) + 1, length(t.source_term))) = t.key),
  cand AS (SELECT *, substr(text, CAST(char_start AS INT) + 1, length(source_term)) AS surface FROM spots WHERE NOT regexp_matches(substr(text, CAST(char_start AS INT), CAST(least(char_start, 1) AS INT)), '[A-Za-z0-9]') AND NOT regexp_matches(substr(text, CAST(char_end AS INT) + 1, 1), '[A-Za-z0-9]')),
  occ AS (SELECT document_id, paragraph_id, key, source_term, CAST(char_start AS INT) AS char_start, CAST(char_end AS INT) AS char_end, surface, text FROM cand a WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE a.document_id = b.document_id AND a.paragraph_id = b.paragraph_id AND length(b.source_term) > length(a.source_term) AND b.char_end > a.char_start AND a.char_end > b.char_start))"""
NUM = f"{OCC}, cnt AS (SELECT document_id, key, count(*) AS occurrences FROM occ GROUP BY ALL HAVING count(*) >= 3), numbered AS (SELECT t.*, occurrences, 'T' || lpad(CAST(row_number() OVER (PARTITION BY document_id ORDER BY occurrences DESC, key) AS VARCHAR), 4, '0') AS term_id FROM terms t JOIN cnt USING (document_id, key))"
CTX = "substr(text, greatest(char_start - 140, 0) + 1, least(length(text), char_end + 140) - greatest(char_start - 140, 0)) AS context"


def paragraphs(spark, folder):
    return relation(spark, folder, "paragraphs")


def linked(spark, folder):
    p = paragraphs(spark, folder)
    return tm.longest_first(tm.candidate_occurrences(p, tm.canonical_terms(tm.definitions(p))))


def numbered(spark, folder):
    return tm.extract(paragraphs(spark, folder))[0]


def memory(spark, folder):
    return relation(spark, folder, "glossary").select("term_id", "source_term", F.lower("source_term").alias("key"))


def uses(spark, folder):
    """Every use of a glossary term, classified."""
    places = tm.candidate_occurrences(paragraphs(spark, folder), memory(spark, folder).drop("term_id"))
    rows = places.withColumn("is_definition", F.rlike("text", F.concat(F.lit("“"), "source_term", F.lit("”")))).drop("surface", "key")
    return tm.classify_uses(rows).drop("text", "is_definition")


def document_terms(spark, folder):
    """Every document has the whole glossary."""
    return paragraphs(spark, folder).select("document_id").distinct().crossJoin(F.broadcast(relation(spark, folder, "glossary").select("term_id", "source_term")))  # ten terms


def validation_tree(spark, folder):
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias(c)
    return val.tree(uses(spark, folder), document_terms(spark, folder)).select("document_id", "term_count", "occurrence_count", *val.LEVELS, *[flat(c) for c in val.COUNTED])


def stale_documents(spark, folder):
    """Documents against results stored before some of their paragraphs were changed."""
    p, t = paragraphs(spark, folder), document_terms(spark, folder)
    before = p.withColumn("text", F.when(F.col("paragraph_id") % 20 == 7, F.lit("before")).otherwise(F.col("text"))).filter(F.col("document_id").cast("int") % 3 > 0)
    return val.freshness(val.source_signatures(p, t), val.source_signatures(before, t))


def glossary_uses(spark, folder):
    return uses(spark, folder).filter("control_eligibility <> 'NONE'")


def rel(name, f, *more):
    return lambda spark, folder: f(relation(spark, folder, name), *[relation(spark, folder, m) for m in more])


def places(spark, folder):
    """Every place of every glossary term, overlaps resolved. Paragraphs are dealt out first: a table of few files holds many, and what follows is by paragraph."""
    m = memory(spark, folder)
    dealt = paragraphs(spark, folder).repartition("document_id", "paragraph_id")
    return tm.longest_first(tm.candidate_occurrences(dealt, m.drop("term_id"))).join(m.select("key", "term_id"), "key").select("document_id", "paragraph_id", "term_id", "source_term", "char_start")


def occurrences(spark, folder):
    """places(), and occurrence_index, which counts a term's places in a document."""
    rows = places(spark, folder)
    place = F.row_number().over(Window.partitionBy("document_id", "term_id").orderBy("paragraph_id", "char_start")) - 1
    return rows.select("document_id", "paragraph_id", "term_id", "source_term", place.alias("occurrence_index"), "char_start")


FOUND = """spots AS (SELECT document_id, paragraph_id, text, term_id, source_term, unnest(generate_series(0, length(text) - length(source_term))) AS i FROM paragraphs JOIN glossary ON contains(lower(text), lower(source_term))),
  places AS (SELECT *, CAST(i AS INT) AS char_start, CAST(i + length(source_term) AS INT) AS char_end FROM spots WHERE lower(substr(text, CAST(i AS INT) + 1, length(source_term))) = lower(source_term) AND NOT regexp_matches(substr(text, CAST(i AS INT), CAST(least(i, 1) AS INT)), '[A-Za-z0-9]') AND NOT regexp_matches(substr(text, CAST(i AS INT) + length(source_term) + 1, 1), '[A-Za-z0-9]')),
  found AS (SELECT document_id, paragraph_id, term_id, source_term, CAST(row_number() OVER (PARTITION BY document_id, term_id ORDER BY paragraph_id, char_start) - 1 AS INT) AS occurrence_index, char_start FROM places a
    WHERE NOT EXISTS (SELECT 1 FROM places b WHERE a.document_id = b.document_id AND a.paragraph_id = b.paragraph_id AND length(b.source_term) > length(a.source_term) AND b.char_end > a.char_start AND a.char_end > b.char_start))"""


#: Two methods: the translations, and a baseline that leaves some paragraphs out and renders a few terms otherwise.
BASELINE = "SELECT document_id, paragraph_id, 'baseline' AS method, replace(translation, '基本薪资', '基 薪') AS translation FROM translations WHERE paragraph_id % 6 > 0"
METHODS = f"SELECT document_id, paragraph_id, 'controlled' AS method, translation FROM translations UNION ALL {BASELINE}"


def by_method(spark, folder):
    relation(spark, folder, "translations").createOrReplaceTempView("lw_translations")
    pick = lambda term, *v: F.when(F.col("term_id") == term, F.array(*[F.lit(x) for x in v])).otherwise(F.expr("cast(array() as array<string>)"))
    m = relation(spark, folder, "glossary").select("term_id", "source_term", "canonical").withColumns({"allowed": pick("T0007", "基薪", " "), "risky": pick("T0003", "生效", "")})
    return j.method_rates(j.presence_by_method(occurrences(spark, folder), spark.sql(METHODS.replace("FROM translations", "FROM lw_translations")), m, ["baseline", "controlled"]))


RATE = lambda c: f"round(avg(CAST({c} AS INT)), 6)"
GRAIN = lambda name, keys: f"{name} AS (SELECT method, count(*) AS {name}s, {RATE('c')} AS all_canonical_{name}_rate, {RATE('a')} AS all_acceptable_{name}_rate FROM (SELECT method, bool_and(canonical) AS c, bool_and(acceptable) AS a FROM p GROUP BY method, {keys}) GROUP BY 1)"
METHOD_RATES = f"""{PG}, {FOUND}, m AS ({METHODS}), p AS (SELECT w.method, document_id, paragraph_id, f.source_term, coalesce(x, '') <> '' AS translated, contains(coalesce(x, ''), canonical) AS canonical,
    contains(coalesce(x, ''), canonical) OR (f.term_id = 'T0007' AND contains(coalesce(x, ''), '基薪')) AS acceptable, f.term_id = 'T0003' AND contains(coalesce(x, ''), '生效') AS risky
    FROM found f CROSS JOIN (VALUES ('baseline'), ('controlled')) AS w(method) LEFT JOIN (SELECT * RENAME (translation AS t), regexp_replace(translation, '\\s+', '', 'g') AS x FROM m) USING (document_id, paragraph_id, method) JOIN glossary g ON g.term_id = f.term_id),
  total AS (SELECT method, count(*) AS occurrences, {', '.join(f"{RATE(c)} AS {c}_rate" for c in ('translated', 'canonical', 'acceptable', 'risky'))} FROM p GROUP BY 1), {GRAIN('term', 'document_id, source_term')}, {GRAIN('document', 'document_id')}, {GRAIN('paragraph', 'document_id, paragraph_id')}
  SELECT * FROM total JOIN term USING (method) JOIN document USING (method) JOIN paragraph USING (method)"""


DIG = "sha256('{}' || chr(0) || document_id || chr(0) || CAST(paragraph_id AS VARCHAR))"


def tokens(spark, folder):
    """Expected placeholders of each paragraph, and an output with some lost, doubled and made up."""
    i = F.col("paragraph_id")
    one = lambda n: F.concat(F.lit("【术语"), F.lpad((i % 7 + n).cast("string"), 4, "0"), F.lit("】"))
    return paragraphs(spark, folder).select(i.alias("id"), F.array(one(1), one(2), one(3)).alias("expected"), F.concat(one(1), F.when(i % 3 == 0, one(1)).otherwise("，"), F.when(i % 5 > 0, one(2)).otherwise("。"), F.when(i % 4 == 1, F.lit("【术语9999】")).otherwise(""), one(3)).alias("output"))


def registry(spark, folder):
    """Models by methods, and the baseline's folder if it is there."""
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    models = nation.filter("n_nationkey < 5").select(F.concat(F.lit("model"), "n_nationkey").alias("model"))
    methods = spark.createDataFrame([("baseline",), ("glossary",), ("placeholder",)], "method string")
    there = nation.filter("n_nationkey < 3").select(F.concat(F.lit("model"), "n_nationkey").alias("model"), F.lit(True).alias("found"))
    rows = models.crossJoin(F.broadcast(methods)).join(there, "model", "left")  # a few models by three methods
    return rows.select(F.concat_ws("__", "model", "method").alias("experiment"), "model", "method", F.coalesce("found", F.lit(False)).alias("has_baseline"))


def versions(spark, folder):
    from ..operators import consistency as c

    r = relation(spark, folder, "reviews")
    old = c.variants(r)
    new = c.variants(r.filter("not (term_id = 'T1003' and occurrence % 7 = 0)"))
    return j.reusable_judgments(old, new, old.select("document_id", "term_id", "variant_id", F.when(F.col("variant_id") == "V000", "EXACT_CONSISTENT").otherwise("UNRESOLVED").alias("label")))


from .consistency_queries import sql_variants  # noqa: E402

R = with_clause("reviews")
#: Two-sided p of a sign test over counts up and down.
SIGN_P = "CASE WHEN up + down = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(up, down) + 1), lambda i: exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1) - (up + down) * ln(2))))) END"

QUERIES = {
    "t01_definitions": (lambda s, f: tm.definitions(paragraphs(s, f)), f"{P}, {DEFS} SELECT document_id, paragraph_id, method, pattern, CAST(match AS INT) AS match, term FROM defs"),
    "t03_canonical_terms": (lambda s, f: tm.canonical_terms(tm.definitions(paragraphs(s, f))).withColumn("definition_paragraph_ids", F.array_join("definition_paragraph_ids", ",")), f"{P}, {TERMS} SELECT document_id, key, source_term, extraction_method, array_to_string(definition_paragraph_ids, ',') AS definition_paragraph_ids FROM terms"),
    "t05_link_occurrences": (linked, f"{P}, {OCC} SELECT document_id, paragraph_id, key, source_term, char_start, char_end, surface, {CTX} FROM occ"),
    "t07_number_terms": (lambda s, f: numbered(s, f).select("document_id", "key", "term_id", "occurrences"), f"{P}, {NUM} SELECT document_id, key, term_id, occurrences FROM numbered"),
    "t08_document_statistics": (lambda s, f: tm.document_statistics(paragraphs(s, f), numbered(s, f)), f"{P}, {NUM} SELECT * FROM (SELECT document_id, count(*) AS paragraph_count, CAST(sum(length(text)) AS BIGINT) AS character_count FROM paragraphs GROUP BY 1) JOIN (SELECT document_id, count(*) AS term_count, CAST(sum(occurrences) AS BIGINT) AS occurrence_count FROM numbered GROUP BY 1) USING (document_id)"),
    "t09_containing_longer": (lambda s, f: tm.containing_longer(tm.candidate_occurrences(paragraphs(s, f), memory(s, f).drop("term_id"))), f"{PG}, spots AS (SELECT document_id, paragraph_id, source_term, unnest(generate_series(0, length(text) - length(source_term))) AS i, text FROM paragraphs JOIN glossary ON contains(lower(text), lower(source_term))), c AS (SELECT document_id, paragraph_id, source_term, CAST(i AS INT) AS char_start, CAST(i + length(source_term) AS INT) AS char_end FROM spots WHERE lower(substr(text, CAST(i AS INT) + 1, length(source_term))) = lower(source_term) AND NOT regexp_matches(substr(text, CAST(i AS INT), CAST(least(i, 1) AS INT)), '[A-Za-z0-9]') AND NOT regexp_matches(substr(text, CAST(i AS INT) + length(source_term) + 1, 1), '[A-Za-z0-9]')) SELECT a.document_id, a.paragraph_id, a.source_term, a.char_start, a.char_end, arg_max(b.source_term, (b.char_end - b.char_start, b.source_term)) AS container FROM c a JOIN c b ON a.document_id = b.document_id AND a.paragraph_id = b.paragraph_id AND b.char_start <= a.char_start AND b.char_end >= a.char_end AND b.char_end - b.char_start > a.char_end - a.char_start GROUP BY ALL"),
    "t18_classify_uses": (uses, f"{USES} SELECT * FROM uses"),
    "t19_validation_counts": (lambda s, f: uses(s, f).groupBy("document_id", "control_eligibility", "usage_status", "reason").agg(F.count("*").alias("n")), f"{USES} SELECT document_id, control_eligibility, usage_status, reason, count(*) AS n FROM uses GROUP BY ALL"),
    "t19_validation_tree": (validation_tree, f"""{USES}, lv AS (SELECT NULL AS document_id, u.* EXCLUDE (document_id) FROM uses u UNION ALL SELECT document_id, u.* EXCLUDE (document_id) FROM uses u), d AS (SELECT DISTINCT document_id, CAST(10 AS BIGINT) AS term_count FROM paragraphs UNION ALL SELECT NULL, 10 * count(DISTINCT document_id) FROM paragraphs),
      g AS (SELECT document_id, count(*) AS occurrence_count, count(*) FILTER (control_eligibility = 'HARD') AS hard_occurrences, count(*) FILTER (control_eligibility = 'SOFT') AS soft_occurrences, count(*) FILTER (control_eligibility = 'NONE') AS excluded_occurrences FROM lv GROUP BY 1),
      {', '.join(f"{n} AS (SELECT document_id, string_agg(v || '=' || n, ';' ORDER BY v) AS {n} FROM (SELECT document_id, {c} AS v, count(*) AS n FROM lv WHERE {c} IS NOT NULL GROUP BY ALL) GROUP BY 1)" for n, c in val.COUNTED.items())}
      SELECT d.document_id, term_count, coalesce(occurrence_count, 0) AS occurrence_count, coalesce(hard_occurrences, 0) AS hard_occurrences, coalesce(soft_occurrences, 0) AS soft_occurrences, coalesce(excluded_occurrences, 0) AS excluded_occurrences, {', '.join(f"coalesce({n}, '') AS {n}" for n in val.COUNTED)} FROM d LEFT JOIN g ON g.document_id IS NOT DISTINCT FROM d.document_id {' '.join(f'LEFT JOIN {n} ON {n}.document_id IS NOT DISTINCT FROM d.document_id' for n in val.COUNTED)}"""),
    "t19_stale_documents": (stale_documents, f"{P} SELECT document_id, CASE WHEN CAST(document_id AS INT) % 3 = 0 THEN 'new' WHEN bool_or(paragraph_id % 20 = 7) THEN 'stale' ELSE 'valid' END AS state FROM paragraphs GROUP BY 1"),
    "t20_occurrences_by_paragraph": (lambda s, f: occurrences(s, f).groupBy("document_id", "paragraph_id").agg(F.array_join(F.array_sort(F.collect_list("term_id")), ",").alias("terms")), f"{PG}, {FOUND} SELECT document_id, paragraph_id, string_agg(term_id, ',' ORDER BY term_id) AS terms FROM found GROUP BY ALL"),
    "j01_pair_occurrences": (lambda s, f: j.pair(occurrences(s, f), relation(s, f, "translations")), f"{PG}, {FOUND} SELECT concat_ws('::', document_id, term_id, occurrence_index, paragraph_id, char_start) AS occurrence_id, found.*, coalesce(translation, '') AS target_paragraph, CASE WHEN coalesce(translation, '') = '' THEN 'No translated paragraph found for this paragraph_id.' END AS notes FROM found LEFT JOIN translations USING (document_id, paragraph_id)"),
    "j02_document_match": (lambda s, f: j.document_match(paragraphs(s, f), relation(s, f, "translations").filter("document_id <> '7'")), f"{PT} SELECT DISTINCT document_id, document_id <> '7' AS matched FROM paragraphs"),
    "j03_translation_coverage": (rel("paragraphs", j.coverage, "translations"), f"{PT}, m AS (SELECT document_id, p.text IS NOT NULL AS a, t.source IS NOT NULL AS b, t.source, t.translation, p.text FROM paragraphs p FULL JOIN translations t USING (document_id, paragraph_id)), x AS (SELECT document_id, count(*) FILTER (a) AS expected, count(*) FILTER (a AND NOT b) AS missing, count(*) FILTER (b AND NOT a) AS extra, count(*) FILTER (a AND b AND trim(translation) = '') AS empty, count(*) FILTER (a AND b AND source <> text) AS source_mismatch, count(*) FILTER (a AND b AND regexp_matches(translation, '[A-Za-z]')) AS latin_warnings FROM m GROUP BY 1) SELECT *, CASE WHEN missing + extra + empty + source_mismatch > 0 THEN 'invalid' ELSE 'valid' END AS status, CASE WHEN latin_warnings > 0 THEN 'warning' ELSE 'clean' END AS quality FROM x"),
    "j04_compare_keys": (rel("evaluations", lambda e: j.compare_keys(e.filter("paragraph_id % 5 <> 0"), e.filter("paragraph_id % 7 <> 0").withColumn("winner", F.when(F.col("paragraph_id") % 11 == 0, "tie").otherwise(F.col("winner"))), "winner")), f"{E}, l AS (SELECT * FROM evaluations WHERE paragraph_id % 5 <> 0), r AS (SELECT document_id, paragraph_id, CASE WHEN paragraph_id % 11 = 0 THEN 'tie' ELSE winner END AS w FROM evaluations WHERE paragraph_id % 7 <> 0) SELECT count(*) FILTER (l.winner IS NOT NULL AND r.w IS NOT NULL) AS common, count(*) FILTER (r.w IS NULL) AS only_left, count(*) FILTER (l.winner IS NULL) AS only_right, count(*) FILTER (l.winner <> r.w) AS mismatched FROM l FULL JOIN r USING (document_id, paragraph_id)"),
    "j08_reuse_judgments": (versions, f"{R}, old AS ({sql_variants('reviews')}), kept AS (SELECT * FROM reviews WHERE NOT (term_id = 'T1003' AND occurrence % 7 = 0)), new AS ({sql_variants('kept')}), so AS (SELECT document_id, term_id, list(variant || n ORDER BY variant) AS s FROM old GROUP BY ALL), sn AS (SELECT document_id, term_id, list(variant || n ORDER BY variant) AS s FROM new GROUP BY ALL) SELECT document_id, term_id, n.variant_id, variant, CASE WHEN o.variant_id = 'V000' THEN 'EXACT_CONSISTENT' ELSE 'UNRESOLVED' END AS label FROM new n JOIN so USING (document_id, term_id) JOIN sn USING (document_id, term_id) JOIN old o USING (document_id, term_id, variant) WHERE so.s = sn.s"),
    "j09_experiment_registry": (registry, "SELECT m || '__' || method AS experiment, m AS model, method, k < 3 AS has_baseline FROM (SELECT 'model' || n_nationkey AS m, n_nationkey AS k FROM nation WHERE n_nationkey < 5), (VALUES ('baseline'), ('glossary'), ('placeholder')) x(method)"),
    "j10_terms_by_paragraph": (lambda s, f: j.terms_by_paragraph(occurrences(s, f), relation(s, f, "glossary").filter("source_term <> 'Person'").select("source_term", "canonical")), f"{PG}, {FOUND}, d AS (SELECT DISTINCT document_id, paragraph_id, source_term FROM found) SELECT document_id, paragraph_id, string_agg(source_term || '=' || CASE WHEN source_term = 'Person' THEN '?' ELSE canonical END, ';' ORDER BY source_term) AS terms, count(*) AS n FROM d JOIN glossary USING (source_term) GROUP BY ALL"),
    "j11_placeholder_difference": (lambda s, f: j.placeholder_difference(tokens(s, f)), f"{P} SELECT paragraph_id AS id, CAST(paragraph_id % 5 = 0 AS BIGINT) AS missing, CAST(paragraph_id % 3 = 0 AS BIGINT) AS duplicates, CAST(paragraph_id % 4 = 1 AS BIGINT) AS unknown, CAST(paragraph_id % 5 = 0 AS BIGINT) + CAST(paragraph_id % 3 = 0 AS BIGINT) + CAST(paragraph_id % 4 = 1 AS BIGINT) AS score FROM paragraphs"),
    "j12_pending": (rel("paragraphs", lambda p: j.pending(p.withColumn("signature", F.sha2("text", 256)), p.filter("paragraph_id % 3 = 0").withColumn("signature", F.sha2(F.when(F.col("paragraph_id") % 2 == 0, F.col("text")).otherwise("stale"), 256)), ["document_id", "paragraph_id", "signature"]).select("document_id", "paragraph_id")), f"{P} SELECT document_id, paragraph_id FROM paragraphs WHERE paragraph_id % 6 <> 0"),
    "j13_subset": (rel("paragraphs", lambda p, t: p.join(t.filter("attempts = 2").select("document_id", "paragraph_id"), ["document_id", "paragraph_id"], "left_semi"), "translations"), f"{PT} SELECT * FROM paragraphs WHERE (document_id, paragraph_id) IN (SELECT (document_id, paragraph_id) FROM translations WHERE attempts = 2)"),
    "j14_paired_cases": (rel("evaluations", lambda e: j.paired_cases(e.select("document_id", "paragraph_id", F.col("baseline_quality").alias("quality"), F.col("baseline_fidelity").alias("fidelity")), e.filter("paragraph_id % 3 > 0").select("document_id", "paragraph_id", F.col("controlled_quality").alias("quality"), F.col("controlled_fidelity").alias("fidelity")), ["quality", "fidelity"])), f"{E} SELECT document_id, paragraph_id, baseline_quality AS quality_left, baseline_fidelity AS fidelity_left, controlled_quality AS quality_right, controlled_fidelity AS fidelity_right, controlled_quality - baseline_quality AS quality_delta, controlled_fidelity - baseline_fidelity AS fidelity_delta, CASE WHEN controlled_quality > baseline_quality THEN 'right' WHEN controlled_quality < baseline_quality THEN 'left' ELSE 'none' END AS advantage FROM evaluations WHERE paragraph_id % 3 > 0"),
    "g15_translation_statistics": (lambda s, f: j.translation_statistics(relation(s, f, "translations"), paragraphs(s, f)), f"{PT} SELECT document_id, count(*) AS paragraphs, count(*) FILTER (trim(translation) <> '') AS nonempty, count(*) FILTER (trim(translation) = '') AS empty, CAST(coalesce(sum(attempts), 0) AS BIGINT) AS attempts, round(avg(latency_seconds), 6) AS mean_latency, greatest(0, count(*) - count(*) FILTER (trim(translation) <> '')) AS remaining FROM paragraphs LEFT JOIN translations USING (document_id, paragraph_id) GROUP BY 1"),
    "g17_method_rates": (by_method, METHOD_RATES),
    "g17_presence_rates": (lambda s, f: j.presence_rates(j.presence(occurrences(s, f), relation(s, f, "translations"), relation(s, f, "glossary"))), f"{PG}, {FOUND}, p AS (SELECT document_id, paragraph_id, source_term, contains(regexp_replace(translation, '\\s+', '', 'g'), canonical) AS present FROM found JOIN translations USING (document_id, paragraph_id) JOIN glossary USING (source_term)) SELECT (SELECT count(*) FROM p) AS occurrences, (SELECT round(avg(CAST(present AS INT)), 6) FROM p) AS micro_rate, " + ", ".join(f"(SELECT round(avg(CAST(a AS INT)), 6) FROM (SELECT bool_and(present) AS a FROM p GROUP BY {g})) AS strict_{n}_rate" for n, g in (("term", "document_id, source_term"), ("paragraph", "document_id, paragraph_id"), ("document", "document_id")))),
    "g22_canonical_collisions": (rel("glossary", lambda g: j.canonical_collisions(g.withColumn("canonical", F.when(F.col("term_id") > "T0006", "计划").otherwise(F.col("canonical"))))), f"{with_clause('glossary')} SELECT canonical, count(DISTINCT term_id) AS terms, count(DISTINCT source_term) AS source_terms FROM (SELECT * REPLACE (CASE WHEN term_id > 'T0006' THEN '计划' ELSE canonical END AS canonical) FROM glossary) GROUP BY 1 HAVING count(DISTINCT term_id) > 1"),
    "g24_complexity": (lambda s, f: j.complexity(occurrences(s, f), paragraphs(s, f)), f"{PG}, {FOUND} SELECT document_id, paragraphs, coalesce(term_paragraphs, 0) AS term_paragraphs, coalesce(occurrences, 0) AS occurrences FROM (SELECT document_id, count(*) AS paragraphs FROM paragraphs GROUP BY 1) LEFT JOIN (SELECT document_id, count(DISTINCT paragraph_id) AS term_paragraphs, count(*) AS occurrences FROM found GROUP BY 1) USING (document_id)"),
    "p24_previous_context": (rel("translations", lambda t: j.previous_context(t, 3, 900)), f"{PT}, b AS (SELECT document_id, paragraph_id, trim(source) || chr(10) || trim(translation) AS x FROM translations), w AS (SELECT document_id, paragraph_id, lag(x, 1) OVER o AS x1, lag(x, 2) OVER o AS x2, lag(x, 3) OVER o AS x3 FROM b WINDOW o AS (PARTITION BY document_id ORDER BY paragraph_id)) SELECT document_id, paragraph_id, CASE WHEN x1 IS NULL THEN '' WHEN x3 IS NOT NULL AND length(x3) + length(x2) + length(x1) + 4 <= 900 THEN x3 || chr(10) || chr(10) || x2 || chr(10) || chr(10) || x1 WHEN x2 IS NOT NULL AND length(x2) + length(x1) + 2 <= 900 THEN x2 || chr(10) || chr(10) || x1 ELSE right(x1, 900) END AS context FROM w"),
    "w02_evaluation_selection": (rel("evaluations", lambda e: w.evaluation_selection(e, "term-bearing-plus-sample", 0.1, 2026).select("document_id", "paragraph_id")), f"{E} SELECT document_id, paragraph_id FROM evaluations WHERE has_terms OR CAST(('0x' || left({DIG.format(2026)}, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616 < 0.1"),
    "w03_top_by_digest": (rel("evaluations", lambda e: w.top_by_digest(e, {True: 500, False: 200}, "has_terms", 2026).select("document_id", "paragraph_id", "has_terms", "rank")), f"{E}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY has_terms ORDER BY {DIG.format(2026)}, document_id, paragraph_id) AS INT) AS rank FROM evaluations) SELECT document_id, paragraph_id, has_terms, rank FROM r WHERE rank <= CASE WHEN has_terms THEN 500 ELSE 200 END"),
    "w04_balanced": (rel("evaluations", lambda e: w.balanced(e, 100, 2026).select("document_id", "paragraph_id", "winner")), f"{E}, r AS (SELECT *, row_number() OVER (PARTITION BY winner ORDER BY {DIG.format(2026)}, document_id, paragraph_id) AS k FROM evaluations) SELECT document_id, paragraph_id, winner FROM r ORDER BY CASE WHEN k <= 33 THEN 0 ELSE 1 END, {DIG.format(3025)}, document_id, paragraph_id LIMIT 100"),
    "w05_blind_sample": (rel("evaluations", lambda e: w.blind(w.balanced(e, 100, 2026), 7)), f"{E}, r AS (SELECT *, row_number() OVER (PARTITION BY winner ORDER BY {DIG.format(2026)}, document_id, paragraph_id) AS k FROM evaluations), b AS (SELECT * FROM r ORDER BY CASE WHEN k <= 33 THEN 0 ELSE 1 END, {DIG.format(3025)}, document_id, paragraph_id LIMIT 100) SELECT document_id, paragraph_id, 'H' || lpad(CAST(row_number() OVER (ORDER BY {DIG.format(7)}, document_id, paragraph_id) AS VARCHAR), 4, '0') AS sample_id, CASE WHEN CAST(('0x' || left({DIG.format(7)}, 2)) AS INT) % 2 = 1 THEN 'placeholder' ELSE 'glossary' END AS method_a FROM b"),
    "w06_risk_sample": (rel("evaluations", lambda e: w.risk_sample(e.withColumn("risky", F.col("baseline_omission") | F.col("controlled_omission")), 200, 0.6, 5).select("document_id", "paragraph_id", "risky")), f"{E}, r AS (SELECT *, baseline_omission OR controlled_omission AS risky FROM evaluations), k AS (SELECT *, row_number() OVER (PARTITION BY risky ORDER BY {DIG.format(5)}, document_id, paragraph_id) AS k FROM r) SELECT document_id, paragraph_id, risky FROM k WHERE k <= CASE WHEN risky THEN 120 ELSE 80 END"),
    "w07_even_ranks": (rel("evaluations", lambda e: w.even_ranks(e.groupBy("document_id").agg(F.count("*").alias("n")), 9, "n", "document_id")), f"{E}, d AS (SELECT document_id, count(*) AS n FROM evaluations GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n, document_id) - 1 AS i, count(*) OVER () AS m FROM d) SELECT document_id, n FROM r WHERE i IN (SELECT CAST(round_even(k * ((SELECT count(*) FROM d) - 1) / 8, 0) AS INT) FROM (SELECT unnest(generate_series(0, 8)) AS k))"),
    "w12_position_control": (rel("evaluations", lambda e: w.position_control(e, "hashed", 3).select("document_id", "paragraph_id", "swapped")), f"{E} SELECT document_id, paragraph_id, CAST(('0x' || left({DIG.format(3)}, 2)) AS INT) % 2 = 1 AS swapped FROM evaluations"),
    "w13_limits": (rel("evaluations", lambda e: w.limits(e, 10, 5).select("document_id", "paragraph_id")), f"{E}, d AS (SELECT DISTINCT document_id FROM evaluations ORDER BY 1 LIMIT 10) SELECT document_id, paragraph_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY paragraph_id) AS k FROM evaluations WHERE document_id IN (SELECT document_id FROM d)) WHERE k <= 5"),
    "k01_percentiles": (rel("evaluations", lambda e: e.groupBy("document_id").agg(*[F.round(F.percentile("confidence", F.lit(q)), 9).alias(f"q{int(q * 1000)}") for q in (0.025, 0.5, 0.975)])), f"{E} SELECT document_id, " + ", ".join(f"round(quantile_cont(confidence, {q}), 9) AS q{int(q * 1000)}" for q in (0.025, 0.5, 0.975)) + " FROM evaluations GROUP BY 1"),
    "k05_wilcoxon": (lambda s, f: k.wilcoxon(relation(s, f, "evaluations").select((F.col("controlled_quality") - F.col("baseline_quality")).alias("diff"))), f"{E}, x AS (SELECT abs(controlled_quality - baseline_quality) AS d, controlled_quality > baseline_quality AS up FROM evaluations WHERE controlled_quality <> baseline_quality), r AS (SELECT up, d, avg(k) OVER (PARTITION BY d) AS rank FROM (SELECT *, row_number() OVER (ORDER BY d) AS k FROM x)), s AS (SELECT count(*) AS n, sum(rank) FILTER (up) AS w FROM r), t AS (SELECT sum(power(c, 3) - c) AS ties FROM (SELECT count(*) AS c FROM x GROUP BY d)), z AS (SELECT n, w, abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s, t) SELECT n, round(w, 6) AS w_plus, round(z, 6) AS z, round(2 * exp(-z * z / 2) / sqrt(2 * pi()) * (1 / (1 + 0.2316419 * z)) * (0.319381530 + (1 / (1 + 0.2316419 * z)) * (-0.356563782 + (1 / (1 + 0.2316419 * z)) * (1.781477937 + (1 / (1 + 0.2316419 * z)) * (-1.821255978 + (1 / (1 + 0.2316419 * z)) * 1.330274429)))), 4) AS p_value FROM z"),
    "k06_kappa": (rel("evaluations", lambda e: k.kappa(e.select(F.col("winner").alias("a"), F.when(F.col("paragraph_id") % 4 == 0, "tie").otherwise(F.col("winner")).alias("b")))), f"{E}, x AS (SELECT winner AS a, CASE WHEN paragraph_id % 4 = 0 THEN 'tie' ELSE winner END AS b FROM evaluations), n AS (SELECT count(*) AS n, avg(CAST(a = b AS INT)) AS o FROM x), e AS (SELECT sum(p.c * q.c) / any_value(n.n * n.n) AS e FROM (SELECT a, count(*)::DOUBLE AS c FROM x GROUP BY 1) p JOIN (SELECT b, count(*)::DOUBLE AS c FROM x GROUP BY 1) q ON a = b, n) SELECT n, round(o, 6) AS agreement, round((o - e) / (1 - e), 6) AS kappa FROM n, e"),
    "k07_paired_table": (rel("evaluations", lambda e: k.paired_table(e.select("has_terms", F.col("baseline_quality").alias("before"), F.col("controlled_quality").alias("after")), "has_terms")), f"{E}, x AS (SELECT has_terms, baseline_quality AS b, controlled_quality AS a FROM evaluations), g AS (SELECT has_terms, count(*) AS n, round(avg(b), 6) AS mean_before, round(avg(a), 6) AS mean_after, round(avg(a - b), 6) AS mean_diff, count(*) FILTER (a > b) AS up, count(*) FILTER (a < b) AS down, round(count(*) FILTER (a > b) / count(*), 6) AS improved_fraction FROM x GROUP BY 1) SELECT *, round({SIGN_P}, 6) AS sign_p FROM g"),
    "k09_document_effect": (rel("evaluations", lambda e: k.document_effect(e.select("document_id", (F.col("controlled_quality") - F.col("baseline_quality")).alias("diff")))), f"{E}, d AS (SELECT document_id, avg(controlled_quality - baseline_quality) AS m, sum(controlled_quality - baseline_quality) AS s, count(*) AS n FROM evaluations GROUP BY 1) SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS paragraphs, round(avg(m), 6) AS macro_effect, round(sum(s) / sum(n), 6) AS weighted_effect FROM d"),
}
