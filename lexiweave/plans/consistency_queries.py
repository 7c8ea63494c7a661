"""Consistency metrics over the reviews relation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import consistency as c
from ..sources.contracts import relation, with_clause

R = with_clause("reviews")
NV = "nullif(trim(trim(regexp_replace(rendering, '\\s+', ' ', 'g')), ' ' || chr(9) || chr(13) || chr(10) || '\"''“”‘’'), '')"
NR = "nullif(trim(regexp_replace(rendering, '[\\s\\x{3000}]+', '', 'g'), '" + t.RENDERING_EDGES.replace("'", "''") + "'), '')"


def sql_variants(source: str, normal: str = NV, keys: str = "document_id, term_id") -> str:
    return f"SELECT *, 'V' || lpad(CAST(row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, variant) - 1 AS VARCHAR), 3, '0') AS variant_id FROM (SELECT {keys}, {normal} AS variant, count(*) AS n FROM {source} GROUP BY ALL) WHERE variant IS NOT NULL"


def sql_formal(source: str, keys: str = "document_id, term_id") -> str:
    return f"""SELECT {keys}, CAST(total AS BIGINT) AS explicit_occurrences, count(*) AS variant_count, round(max(n) / total, 6) AS dominant_translation_ratio,
      round((count(*) - 1) / greatest(1, total - 1), 6) AS translation_variation_rate, round(sum(-(n / total) * log2(n / total)), 6) AS entropy_bits,
      round(CASE WHEN count(*) > 1 THEN sum(-(n / total) * log2(n / total)) / log2(count(*)) ELSE 0 END, 6) AS normalized_entropy
    FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}) AS total FROM {source}) GROUP BY {keys}, total"""


INCLUDED = "(include_in_consistency IS NULL OR include_in_consistency)"


def sql_groups(keys: str = "document_id, term_id") -> str:
    counts = ", ".join(f"count(*) FILTER ({INCLUDED} AND extraction_status = '{s}') AS {s.lower()}" for s in ("FOUND", "OMITTED", "IMPLICIT", "AMBIGUOUS", "TRANSLATION_ERROR"))
    return f"""inc AS (SELECT * FROM reviews WHERE {INCLUDED}), var AS ({sql_variants('inc', keys=keys)}), formal AS ({sql_formal('var', keys)}),
    counts AS (SELECT {keys}, min(criticality) AS criticality, count(*) AS raw_occurrences, count(*) FILTER ({INCLUDED}) AS occurrences, count(*) FILTER (NOT {INCLUDED}) AS excluded_occurrences, {counts} FROM reviews GROUP BY {keys}),
    groups AS (SELECT c.*, coalesce(f.explicit_occurrences, 0) AS explicit_occurrences, coalesce(f.variant_count, 0) AS variant_count, f.dominant_translation_ratio, f.translation_variation_rate, f.entropy_bits, f.normalized_entropy, v.variant AS dominant_rendering
      FROM counts c LEFT JOIN formal f USING ({keys}) LEFT JOIN (SELECT * FROM var WHERE variant_id = 'V000') v USING ({keys}))"""


#: Labels as a judge would give them, from the variant's place.
def sql_judgments(keys: str = "document_id, term_id") -> str:
    return f"judgments AS (SELECT {keys}, variant_id, CASE variant_id WHEN 'V000' THEN 'EXACT_CONSISTENT' WHEN 'V001' THEN CASE WHEN length(term_id) % 2 = n % 2 THEN 'ACCEPTABLE_VARIANT' ELSE 'LEGAL_INCONSISTENCY' END ELSE 'DUNNO' END AS label FROM var)"


def judgments(reviews, keys=c.GROUP):
    ranked = c.variants(reviews.filter("not include_in_consistency <=> false"), keys=keys)
    label = F.when(F.col("variant_id") == "V000", "EXACT_CONSISTENT").when(F.col("variant_id") == "V001", F.when(F.length("term_id") % 2 == F.col("n") % 2, "ACCEPTABLE_VARIANT").otherwise("LEGAL_INCONSISTENCY")).otherwise("DUNNO")
    return ranked.select(*keys, "variant_id", label.alias("label"))


def sql_judged(keys: str = "document_id, term_id") -> str:
    of = ", ".join(f"v.{k}" for k in keys.split(", "))
    return f"""{sql_groups(keys)}, {sql_judgments(keys)},
  err AS (SELECT {keys}, {NV} AS variant, count(*) AS errors FROM inc WHERE extraction_status = 'TRANSLATION_ERROR' GROUP BY ALL),
  lab AS (SELECT {of}, v.n, coalesce(e.errors, 0) AS errors, CASE WHEN j.label IN ('EXACT_CONSISTENT', 'ACCEPTABLE_VARIANT', 'LEGAL_INCONSISTENCY') THEN j.label ELSE 'UNRESOLVED' END AS label FROM var v LEFT JOIN judgments j USING ({keys}, variant_id) LEFT JOIN err e USING ({keys}, variant)),
  sums AS (SELECT {keys}, sum(CASE WHEN label = 'EXACT_CONSISTENT' THEN n ELSE 0 END) AS exact, sum(CASE WHEN label = 'ACCEPTABLE_VARIANT' THEN n ELSE 0 END) AS acceptable, sum(CASE WHEN label = 'LEGAL_INCONSISTENCY' THEN n ELSE 0 END) AS inconsistent, sum(CASE WHEN label = 'UNRESOLVED' THEN n ELSE 0 END) AS unresolved, sum(CASE WHEN label = 'LEGAL_INCONSISTENCY' THEN errors ELSE 0 END) AS errors_inside FROM lab GROUP BY ALL),
  base AS (SELECT g.*, CAST(coalesce(exact, 0) AS BIGINT) AS exact, CAST(coalesce(acceptable, 0) AS BIGINT) AS acceptable, CAST(coalesce(inconsistent, 0) AS BIGINT) AS inconsistent, CAST(coalesce(unresolved, 0) AS BIGINT) AS unresolved, CAST(coalesce(errors_inside, 0) AS BIGINT) AS errors_inside FROM groups g LEFT JOIN sums USING ({keys})),
  risks AS (SELECT *, exact + acceptable + inconsistent AS resolved, inconsistent + omitted + greatest(0, translation_error - errors_inside) AS risk, greatest(0, occurrences - implicit - ambiguous - unresolved) AS risk_base FROM base),
  judged AS (SELECT *, round((exact + acceptable) / nullif(resolved, 0), 6) AS consistency_rate, round(inconsistent / nullif(resolved, 0), 6) AS inconsistency_rate, round(omitted / nullif(occurrences, 0), 6) AS omission_rate, round(risk / nullif(risk_base, 0), 6) AS risk_rate FROM risks)"""


JUDGMENTS, JUDGED = sql_judgments(), sql_judged()
SUMMARY = """SELECT count(*) AS term_groups, CAST(sum(occurrences) AS BIGINT) AS occurrences, round(avg(dominant_translation_ratio), 6) AS dtr_macro, round(sum(round(dominant_translation_ratio * explicit_occurrences)) / nullif(sum(explicit_occurrences), 0), 6) AS dtr_micro, round(avg(translation_variation_rate), 6) AS tvr_macro, round(avg(entropy_bits), 6) AS entropy_macro_bits, round(avg(normalized_entropy), 6) AS normalized_entropy_macro,
  round(sum(exact + acceptable) / nullif(sum(resolved), 0), 6) AS consistency_micro, round(sum(inconsistent) / nullif(sum(resolved), 0), 6) AS inconsistency_micro, round(sum(omitted) / nullif(sum(occurrences), 0), 6) AS omission_micro, round(sum(explicit_occurrences) / nullif(sum(occurrences), 0), 6) AS explicit_coverage, round(sum(excluded_occurrences) / nullif(sum(raw_occurrences), 0), 6) AS exclusion_rate,
  round(sum(implicit + ambiguous + unresolved) / nullif(sum(occurrences), 0), 6) AS unresolved_rate, round(sum(inconsistent) FILTER (criticality = 'CRITICAL') / nullif(sum(resolved) FILTER (criticality = 'CRITICAL'), 0), 6) AS critical_inconsistency, round(sum(risk) FILTER (criticality = 'CRITICAL') / nullif(sum(risk_base) FILTER (criticality = 'CRITICAL'), 0), 6) AS critical_risk,
  round(1 - sum(w * risk) / nullif(sum(w * risk_base), 0), 6) AS weighted_score
FROM (SELECT *, CASE WHEN risk_base = 0 THEN 0 WHEN criticality = 'CRITICAL' THEN 3.0 WHEN criticality = 'IMPORTANT' THEN 2.0 WHEN criticality = 'EXCLUDED' THEN 0.0 ELSE 1.0 END AS w FROM judged)"""


def on(f):
    return lambda spark, folder: f(relation(spark, folder, "reviews"))


def judged(r, keys=c.GROUP):
    return c.judged_metrics(r, judgments(r, keys), keys)


EXP = ["experiment", "document_id", "term_id"]
#: Reviews with a context, a validation status and a definition.
CONTEXT = "SELECT *, CASE WHEN occurrence % 11 = 0 THEN ' ' ELSE 'context ' || CAST(occurrence % 5 AS VARCHAR(5)) END AS target_paragraph, CASE WHEN occurrence % 3 = 0 THEN 'VALID' WHEN occurrence % 3 = 1 THEN 'REPAIRED' END AS validation_status, CASE WHEN occurrence % 40 = 1 THEN 'definition ' || CAST(occurrence % 2 AS VARCHAR(5)) || CAST(occurrence % 6 AS VARCHAR(5)) END AS definition_context FROM reviews"


def with_contexts(spark, folder):
    relation(spark, folder, "reviews").createOrReplaceTempView("lw_reviews")
    return spark.sql(CONTEXT.replace("FROM reviews", "FROM lw_reviews"))


def details(spark, folder):
    """Maps and lists written out as text."""
    d = c.group_details(with_contexts(spark, folder))
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    one = lambda v: F.concat_ws("/", v["variant_id"], v["variant"], v["count"].cast("string"), F.array_join(v["surfaces"], "+"), F.array_join(v["contexts"], "+"))
    share = F.get(F.transform("variants", lambda v: v["share"]), F.lit(0))
    return d.select("document_id", "term_id", flat("status_counts").alias("status_counts"), flat("validation_counts").alias("validation_counts"), F.array_join(F.transform("variants", one), ";").alias("variants"), share.alias("dominant_share"), F.array_join("definition_contexts", ";").alias("definition_contexts"))


XS = f"x AS (SELECT *, {NV} AS variant FROM ({CONTEXT}))"
INC = "(SELECT * FROM x WHERE (include_in_consistency IS NULL OR include_in_consistency) AND variant IS NOT NULL)"
UNIQUE = f"uq AS (SELECT *, row_number() OVER (PARTITION BY document_id, term_id, variant ORDER BY occurrence, target_paragraph) AS position FROM (SELECT document_id, term_id, variant, target_paragraph, min(occurrence) AS occurrence FROM {INC} WHERE trim(target_paragraph) <> '' GROUP BY ALL) QUALIFY position <= 3)"
MAPS = ", ".join(f"{n} AS (SELECT document_id, term_id, string_agg(k || '=' || n, ';' ORDER BY k) AS {n} FROM (SELECT document_id, term_id, coalesce({c_}, 'UNPROCESSED') AS k, count(*) AS n FROM x GROUP BY ALL) GROUP BY ALL)" for c_, n in (("extraction_status", "status_counts"), ("validation_status", "validation_counts")))
QUERIES = {
    "g01_formal_metrics": (on(lambda r: c.formal_metrics(c.variants(r, t.normalize_rendering))), f"{R}, var AS ({sql_variants('reviews', NR)}) {sql_formal('var')}"),
    "g02_aggregate_renderings": (on(c.aggregate), f"{R}, {sql_groups()} SELECT * FROM groups"),
    "g03_ranked_variants": (on(lambda r: c.variants(r)), f"{R} {sql_variants('reviews')}"),
    "g04_surface_histograms": (on(c.surface_histograms), f"{R}, x AS (SELECT *, {NV} AS variant FROM reviews), a AS (SELECT document_id, term_id, variant, rendering || '=' || count(*) AS s FROM x WHERE variant IS NOT NULL GROUP BY document_id, term_id, variant, rendering), b AS (SELECT document_id, term_id, variant, extraction_status || '=' || count(*) AS s FROM x WHERE variant IS NOT NULL GROUP BY document_id, term_id, variant, extraction_status) SELECT document_id, term_id, variant, rendering_counts, extraction_status_counts FROM (SELECT document_id, term_id, variant, string_agg(s, ';' ORDER BY s) AS rendering_counts FROM a GROUP BY ALL) JOIN (SELECT document_id, term_id, variant, string_agg(s, ';' ORDER BY s) AS extraction_status_counts FROM b GROUP BY ALL) USING (document_id, term_id, variant)"),
    "g05_first_contexts": (on(c.first_contexts), f"{R}, x AS (SELECT document_id, term_id, {NV} AS variant, occurrence FROM reviews), y AS (SELECT *, row_number() OVER (PARTITION BY document_id, term_id, variant ORDER BY occurrence) AS position FROM x WHERE variant IS NOT NULL) SELECT document_id, term_id, variant, CAST(position AS INT) AS position, occurrence FROM y WHERE position <= 3"),
    "g02_group_details": (details, f"""{R}, {XS}, {UNIQUE}, {MAPS}, sf AS (SELECT document_id, term_id, variant, string_agg(rendering, '+' ORDER BY n DESC, rendering) AS surfaces FROM (SELECT document_id, term_id, variant, rendering, count(*) AS n FROM {INC} GROUP BY ALL) GROUP BY ALL), cx AS (SELECT document_id, term_id, variant, string_agg(target_paragraph, '+' ORDER BY position) AS contexts FROM uq GROUP BY ALL),
      va AS (SELECT *, 'V' || lpad(CAST(row_number() OVER (PARTITION BY document_id, term_id ORDER BY n DESC, variant) - 1 AS VARCHAR), 3, '0') AS variant_id, sum(n) OVER (PARTITION BY document_id, term_id) AS total FROM (SELECT document_id, term_id, variant, count(*) AS n FROM {INC} GROUP BY ALL)),
      ls AS (SELECT document_id, term_id, string_agg(variant_id || '/' || variant || '/' || n || '/' || surfaces || '/' || coalesce(contexts, ''), ';' ORDER BY variant_id) AS variants, round(max(n) / any_value(total), 6) AS dominant_share FROM va JOIN sf USING (document_id, term_id, variant) LEFT JOIN cx USING (document_id, term_id, variant) GROUP BY ALL),
      df AS (SELECT document_id, term_id, string_agg(DISTINCT definition_context, ';' ORDER BY definition_context) AS definition_contexts FROM x WHERE definition_context IS NOT NULL GROUP BY ALL)
      SELECT document_id, term_id, status_counts, validation_counts, variants, dominant_share, definition_contexts FROM status_counts JOIN validation_counts USING (document_id, term_id) LEFT JOIN ls USING (document_id, term_id) LEFT JOIN df USING (document_id, term_id)"""),
    "g05_unique_contexts": (lambda s, f: c.unique_contexts(with_contexts(s, f).filter("not include_in_consistency <=> false")).select("document_id", "term_id", "variant", "position", "target_paragraph", "occurrence"), f"{R}, {XS}, {UNIQUE} SELECT document_id, term_id, variant, CAST(position AS INT) AS position, target_paragraph, occurrence FROM uq"),
    "g06_experiment_summary": (on(lambda r: c.experiment_summary(c.aggregate(r, EXP))), f"{R}, {sql_groups('experiment, document_id, term_id')} SELECT experiment, count(*) AS group_count, CAST(sum(raw_occurrences) AS BIGINT) AS raw_occurrence_count, CAST(sum(occurrences) AS BIGINT) AS occurrence_count, CAST(sum(excluded_occurrences) AS BIGINT) AS excluded_occurrence_count, count(*) FILTER (variant_count > 1) AS multi_variant_group_count, count(*) FILTER (variant_count = 0) AS zero_explicit_group_count FROM groups GROUP BY experiment"),
    "g07_aggregate_by_experiment": (on(lambda r: c.aggregate(r, EXP)), f"{R}, {sql_groups('experiment, document_id, term_id')} SELECT * FROM groups"),
    "g08_judged_metrics": (on(judged), f"{R}, {JUDGED} SELECT * FROM judged"),
    "g09_summary_metrics": (on(lambda r: c.summary(judged(r))), f"{R}, {JUDGED} {SUMMARY}"),
    "g10_missing_judgments": (on(lambda r: c.missing_judgments(c.aggregate(r), judgments(r).filter("term_id <> 'T1007'"))), f"{R}, {sql_groups()}, {JUDGMENTS} SELECT document_id, term_id FROM groups g WHERE NOT EXISTS (SELECT 1 FROM judgments j WHERE j.document_id = g.document_id AND j.term_id = g.term_id AND j.term_id <> 'T1007')"),
    "v01_auto_judgment": (on(lambda r: c.auto_judgment(c.aggregate(r)).select("document_id", "term_id", "variant_count", "group_label")), f"{R}, {sql_groups()} SELECT document_id, term_id, variant_count, CASE variant_count WHEN 0 THEN 'NO_EXPLICIT_RENDERING' WHEN 1 THEN 'EXACT_CONSISTENT' END AS group_label FROM groups"),
    "w09_compare_models": (on(lambda r: c.compare_models(judged(r, EXP))), f"{R}, {sql_judged(', '.join(EXP))}, s AS ({SUMMARY.replace('SELECT count', 'SELECT experiment, count', 1)} GROUP BY experiment) SELECT *, CAST(row_number() OVER (ORDER BY consistency_micro DESC NULLS LAST, experiment) AS INT) AS place FROM s"),
}
