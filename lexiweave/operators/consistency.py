"""Consistency of renderings: variants of a term in a document, formal metrics, judged risk, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

# Fixed values.
WEIGHTS = {"CRITICAL": 3.0, "IMPORTANT": 2.0, "AUXILIARY": 1.0, "EXCLUDED": 0.0}
LABELS = ("EXACT_CONSISTENT", "ACCEPTABLE_VARIANT", "LEGAL_INCONSISTENCY", "UNRESOLVED")
GROUP = ["document_id", "term_id"]


def ratio(a: Column, b: Column) -> Column:
    """a / b to six places; null where b is 0."""
    return F.round(a / F.nullif(b, F.lit(0)), 6)


def spelled(reviews: DataFrame, normal=t.normalize_variant, keys: list[str] = GROUP, *more: str) -> DataFrame:
    """keys, rendering, more, n, errors, variant: rows counted by their spelling first, so that only distinct spellings are normalised. Spellings that come to nothing are left out."""
    raw = reviews.groupBy(*keys, "rendering", *more).agg(F.count("*").alias("n"), F.count_if(F.col("extraction_status") == "TRANSLATION_ERROR").alias("errors") if "extraction_status" in reviews.columns else F.lit(0).alias("errors"))
    return raw.withColumn("variant", normal(F.col("rendering"))).filter("variant is not null")


def variants(reviews: DataFrame, normal=t.normalize_variant, keys: list[str] = GROUP, *more: str) -> DataFrame:
    """Counts of each normalised rendering of a group, ranked: most frequent first, then by spelling. more: errors, if they are wanted too."""
    counted = spelled(reviews, normal, keys).groupBy(*keys, "variant").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in more])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "variant"))
    return counted.withColumn("variant_id", F.concat(F.lit("V"), F.lpad((rank - 1).cast("string"), 3, "0")))


def formal_metrics(counted: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Dominant ratio, variation rate, entropy in bits and normalised, of counted variants."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    share = F.col("n") / F.col("total")
    g = counted.withColumn("total", total).groupBy(*keys).agg(F.first("total").alias("explicit"), F.count("*").alias("variant_count"), F.max("n").alias("top"), F.sum(-share * F.log2(share)).alias("h"))
    k, n = F.col("variant_count"), F.col("explicit")
    return g.select(
        *keys, n.alias("explicit_occurrences"), k.alias("variant_count"),
        F.round(F.col("top") / n, 6).alias("dominant_translation_ratio"),
        F.round((k - 1) / F.greatest(F.lit(1), n - 1), 6).alias("translation_variation_rate"),
        F.round(F.col("h"), 6).alias("entropy_bits"),
        F.round(F.when(k > 1, F.col("h") / F.log2(k)).otherwise(0.0), 6).alias("normalized_entropy"),
    )


def aggregate(reviews: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """A row a group: raw, included and excluded occurrences, counts by status, variants, formal metrics, dominant rendering."""
    included = ~(F.col("include_in_consistency").eqNullSafe(False))
    status = F.coalesce("extraction_status", F.lit("UNPROCESSED"))
    counts = reviews.groupBy(*keys).agg(
        F.min("criticality").alias("criticality"), F.count("*").alias("raw_occurrences"), F.count_if(included).alias("occurrences"), F.count_if(~included).alias("excluded_occurrences"),
        *[F.count_if(included & (status == s)).alias(s.lower()) for s in ("FOUND", "OMITTED", "IMPLICIT", "AMBIGUOUS", "TRANSLATION_ERROR")],
    )
    ranked = variants(reviews.filter(included), keys=keys)
    top = ranked.filter("variant_id = 'V000'").select(*keys, F.col("variant").alias("dominant_rendering"))
    return counts.join(formal_metrics(ranked, keys), keys, "left").join(top, keys, "left").fillna(0, ["variant_count", "explicit_occurrences"])


def surface_histograms(reviews: DataFrame) -> DataFrame:
    """Each variant's surface forms, as text form=count sorted by form, and statuses alike."""
    rows = spelled(reviews, t.normalize_variant, GROUP, "extraction_status")

    def histogram(column: str) -> DataFrame:
        one = rows.groupBy(*GROUP, "variant", column).agg(F.sum("n").alias("n"))
        return one.groupBy(*GROUP, "variant").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", column, F.col("n").cast("string")))), ";").alias(f"{column}_counts"))

    return histogram("rendering").join(histogram("extraction_status"), [*GROUP, "variant"])


def first_contexts(reviews: DataFrame, limit: int = 3) -> DataFrame:
    """The first occurrences of each variant, at most limit of them."""
    rows = reviews.withColumn("variant", t.normalize_variant(F.col("rendering"))).filter("variant is not null")
    rank = F.row_number().over(Window.partitionBy(*GROUP, "variant").orderBy("occurrence"))
    return rows.withColumn("position", rank).filter(F.col("position") <= limit).select(*GROUP, "variant", "position", "occurrence")


def unique_contexts(reviews: DataFrame, limit: int = 3, context: str = "target_paragraph", order: str = "occurrence") -> DataFrame:
    """Of each variant the first texts that differ, at most limit of them, with their places among these. Equal texts are one before they are ranked."""
    rows = reviews.groupBy(*GROUP, "rendering", context).agg(F.min(order).alias(order)).withColumn("variant", t.normalize_variant(F.col("rendering"))).filter(F.col("variant").isNotNull() & F.col(context).isNotNull() & (F.btrim(context) != ""))
    one = rows.groupBy(*GROUP, "variant", context).agg(F.min(order).alias(order))
    rank = F.row_number().over(Window.partitionBy(*GROUP, "variant").orderBy(order, context))
    return one.withColumn("position", rank).filter(F.col("position") <= limit)


def group_details(reviews: DataFrame, limit: int = 3, context: str = "target_paragraph") -> DataFrame:
    """A row a group: counts by extraction status and by validation status as maps, its variants from the most frequent with count, share, surfaces and first different contexts, and its definitions' contexts.

    reviews: the columns of aggregate(), occurrence, and, if they are there, validation_status, context and definition_context.
    Only included rows make variants. Each map and list is folded from counted rows, none from single occurrences.
    """
    included = reviews.filter("not include_in_consistency <=> false")

    def counts(column: str, name: str) -> DataFrame:
        if column not in reviews.columns:
            return reviews.select(*GROUP).distinct().withColumn(name, F.expr("cast(map() as map<string,bigint>)"))
        one = reviews.groupBy(*GROUP, F.coalesce(column, F.lit("UNPROCESSED")).alias("k")).agg(F.count("*").alias("n"))
        return one.groupBy(*GROUP).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))

    ranked = variants(included)
    surfaces = spelled(included).groupBy(*GROUP, "variant").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "rendering"))), lambda x: x["rendering"]).alias("surfaces"))
    rows = ranked.join(surfaces, [*GROUP, "variant"])
    if context in reviews.columns:
        seen = unique_contexts(included, limit, context).groupBy(*GROUP, "variant").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", context))), lambda x: x[context]).alias("contexts"))
        rows = rows.join(seen, [*GROUP, "variant"], "left")
    else:
        rows = rows.withColumn("contexts", F.lit(None).cast("array<string>"))
    total = F.sum("n").over(Window.partitionBy(*GROUP))
    item = F.struct("variant_id", "variant", F.col("n").alias("count"), F.round(F.col("n") / F.col("_t"), 6).alias("share"), "surfaces", F.coalesce("contexts", F.expr("cast(array() as array<string>)")).alias("contexts"))
    listed = rows.withColumn("_t", total).groupBy(*GROUP).agg(F.array_sort(F.collect_list(item)).alias("variants"))
    out = counts("extraction_status", "status_counts").join(counts("validation_status", "validation_counts"), GROUP).join(listed, GROUP, "left")
    if "definition_context" in reviews.columns:
        first = reviews.filter("definition_context is not null").groupBy(*GROUP).agg(F.array_sort(F.collect_set("definition_context")).alias("definition_contexts"))
        out = out.join(first, GROUP, "left")
    return out


def experiment_summary(groups: DataFrame) -> DataFrame:
    return groups.groupBy("experiment").agg(F.count("*").alias("group_count"), F.sum("raw_occurrences").alias("raw_occurrence_count"), F.sum("occurrences").alias("occurrence_count"), F.sum("excluded_occurrences").alias("excluded_occurrence_count"), F.count_if(F.col("variant_count") > 1).alias("multi_variant_group_count"), F.count_if(F.col("variant_count") == 0).alias("zero_explicit_group_count"))


def auto_judgment(groups: DataFrame) -> DataFrame:
    """What needs no judge: groups without a rendering, or with one only."""
    k = F.col("variant_count")
    return groups.withColumn("group_label", F.when(k == 0, "NO_EXPLICIT_RENDERING").when(k == 1, "EXACT_CONSISTENT"))


def judged_metrics(reviews: DataFrame, judgments: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Groups with their label counts, consistency and risk. judgments: the keys, variant_id, label.

    A variant without a judgment, or with an unknown label, counts as unresolved.
    """
    included = reviews.filter("not include_in_consistency <=> false")
    ranked = variants(included, t.normalize_variant, keys, "errors")
    label = F.when(F.col("label").isin(*LABELS), F.col("label")).otherwise("UNRESOLVED")
    rows = ranked.join(judgments, [*keys, "variant_id"], "left").withColumn("label", label)
    of = lambda name: F.sum(F.when(F.col("label") == name, F.col("n")).otherwise(0))
    labels = rows.groupBy(*keys).agg(of("EXACT_CONSISTENT").alias("exact"), of("ACCEPTABLE_VARIANT").alias("acceptable"), of("LEGAL_INCONSISTENCY").alias("inconsistent"), of("UNRESOLVED").alias("unresolved"), F.sum(F.when(F.col("label") == "LEGAL_INCONSISTENCY", F.coalesce("errors", F.lit(0))).otherwise(0)).alias("errors_inside"))
    g = aggregate(reviews, keys).join(labels, keys, "left").fillna(0, ["exact", "acceptable", "inconsistent", "unresolved", "errors_inside"])
    resolved = F.col("exact") + F.col("acceptable") + F.col("inconsistent")
    risk = F.col("inconsistent") + F.col("omitted") + F.greatest(F.lit(0), F.col("translation_error") - F.col("errors_inside"))
    base = F.greatest(F.lit(0), F.col("occurrences") - F.col("implicit") - F.col("ambiguous") - F.col("unresolved"))
    g = g.withColumn("resolved", resolved).withColumn("risk", risk).withColumn("risk_base", base)
    return g.withColumns({"consistency_rate": ratio(F.col("exact") + F.col("acceptable"), F.col("resolved")), "inconsistency_rate": ratio(F.col("inconsistent"), F.col("resolved")), "omission_rate": ratio(F.col("omitted"), F.col("occurrences")), "risk_rate": ratio(F.col("risk"), F.col("risk_base"))})


def summary(judged: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """A row for each of by (one for all without): macro means, micro ratios, critical terms' rates, and the weighted score."""
    s = F.sum
    weight = F.coalesce(F.get(F.array(*[F.lit(w) for w in WEIGHTS.values()]), F.array_position(F.array(*[F.lit(k) for k in WEIGHTS]), F.coalesce("criticality", F.lit(""))).cast("int") - 1), F.lit(1.0))
    at = judged.withColumn("w", F.when((F.col("risk_base") > 0), weight).otherwise(0.0))
    critical = lambda c: s(F.when(F.col("criticality") == "CRITICAL", F.col(c)).otherwise(0))
    return at.groupBy(*by).agg(
        F.count("*").alias("term_groups"), s("occurrences").alias("occurrences"), F.round(F.avg("dominant_translation_ratio"), 6).alias("dtr_macro"), ratio(s(F.round(F.col("dominant_translation_ratio") * F.col("explicit_occurrences"))), s("explicit_occurrences")).alias("dtr_micro"),
        F.round(F.avg("translation_variation_rate"), 6).alias("tvr_macro"), F.round(F.avg("entropy_bits"), 6).alias("entropy_macro_bits"), F.round(F.avg("normalized_entropy"), 6).alias("normalized_entropy_macro"),
        ratio(s(F.col("exact") + F.col("acceptable")), s("resolved")).alias("consistency_micro"), ratio(s("inconsistent"), s("resolved")).alias("inconsistency_micro"), ratio(s("omitted"), s("occurrences")).alias("omission_micro"),
        ratio(s("explicit_occurrences"), s("occurrences")).alias("explicit_coverage"), ratio(s("excluded_occurrences"), s("raw_occurrences")).alias("exclusion_rate"),
        ratio(s(F.col("implicit") + F.col("ambiguous") + F.col("unresolved")), s("occurrences")).alias("unresolved_rate"),
        ratio(critical("inconsistent"), critical("resolved")).alias("critical_inconsistency"), ratio(critical("risk"), critical("risk_base")).alias("critical_risk"),
        F.round(1 - s(F.col("w") * F.col("risk")) / F.nullif(s(F.col("w") * F.col("risk_base")), F.lit(0.0)), 6).alias("weighted_score"),
    )


def compare_models(judged: DataFrame, model: str = "experiment") -> DataFrame:
    """The summary of each model with its place: the most consistent first, without a rate last, then by name. Models are few."""
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("consistency_micro"), model))
    return summary(judged, [model]).withColumn("place", place)


def document_metrics(judged: DataFrame, *more: str) -> DataFrame:
    """A row a document: mean dominant ratio of its terms, and its consistency (slcr), inconsistency (lir) and omission rates; null where undefined."""
    s = F.sum
    mean = F.sum(F.col("dominant_translation_ratio").cast("decimal(18,6)")).cast("double") / F.count("dominant_translation_ratio")
    return judged.groupBy(*more, "document_id").agg(
        F.round(mean, 6).alias("dtr_macro"), ratio(s(F.col("exact") + F.col("acceptable")), s("resolved")).alias("slcr"), ratio(s("inconsistent"), s("resolved")).alias("lir"), ratio(s("omitted"), s("occurrences")).alias("omission_rate"),
    )


def require_judgments(groups: DataFrame, judgments: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """groups, unless one with a rendering has no judgment: then the query fails. See missing_judgments() for which."""
    found = judgments.select(*keys).distinct().withColumn("_there", F.lit(True))
    missing = F.col("_there").isNull() & (F.col("variant_count") > 0)
    stop = F.raise_error(F.concat(F.lit("no judgment for "), F.concat_ws("/", *keys))).cast("boolean")
    return groups.join(found, keys, "left").filter(F.when(missing, stop).otherwise(F.lit(True))).drop("_there")


def missing_judgments(groups: DataFrame, judgments: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    return groups.join(judgments, keys, "left_anti").select(*keys)
