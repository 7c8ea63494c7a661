"""What a judge of renderings is asked, and what holds where its answers cannot be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .consistency import GROUP

DOMINANT = "V000"
# The labels a judge may give to a variant.
LABELS = ("ACCEPTABLE_VARIANT", "LEGAL_INCONSISTENCY", "UNRESOLVED")


def judge_payloads(counted: DataFrame, batch: int = 4) -> DataFrame:
    """Requests of up to `batch` groups of a document, as JSON, from ranked variants (see consistency.variants()).

    Groups of a single variant need no judge. Each group names the variants that need a label: all but the dominant one.
    """
    item = F.struct("variant_id", F.col("variant").alias("rendering"), F.col("n").alias("count"), (F.col("variant_id") == DOMINANT).alias("is_dominant"))
    g = counted.groupBy(*GROUP).agg(F.array_sort(F.collect_list(item)).alias("variants")).filter(F.size("variants") > 1)
    required = F.transform(F.filter("variants", lambda v: ~v["is_dominant"]), lambda v: v["variant_id"])
    group = F.struct(
        F.concat_ws("::", *GROUP).alias("group_id"), F.lit(DOMINANT).alias("dominant_variant_id"), F.col("variants")[0]["rendering"].alias("dominant_rendering"),
        required.alias("required_non_dominant_variant_ids"), F.size(required).alias("required_variant_judgment_count"), F.col("variants"),
    )
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("term_id")) - 1
    rows = g.select("document_id", F.floor(place / batch).cast("int").alias("batch"), group.alias("g"))
    groups = F.array_sort(F.collect_list("g"))
    return rows.groupBy("document_id", "batch").agg(F.count("*").cast("int").alias("groups"), F.to_json(F.struct(groups.alias("groups")), {"ignoreNullFields": "false"}).alias("payload"))


def usable(label: Column, confidence: Column) -> Column:
    """Whether an answer is a known label with a confidence from 0 to 1."""
    return F.coalesce(label.isin(*LABELS) & confidence.between(0, 1), F.lit(False))


def merge_variant_answers(counted: DataFrame, answers: DataFrame) -> DataFrame:
    """A verdict for each group from answers for single variants (label, confidence; by document, term and variant).

    A variant whose answer is missing or not usable is kept as UNRESOLVED with confidence 0 and counted in fallbacks. The
    group is inconsistent if one variant is, else unresolved if one is, else acceptable; its confidence is the least one.
    Of several usable answers for a variant the most confident counts, then the first label by name.
    """
    good = answers.filter(usable(F.col("label"), F.col("confidence"))).groupBy(*GROUP, "variant_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col("label").alias("l"))).alias("a"))
    rows = counted.filter(F.col("variant_id") != DOMINANT).select(*GROUP, "variant_id").join(good, [*GROUP, "variant_id"], "left")
    label, sure = F.coalesce("a.l", F.lit("UNRESOLVED")), F.coalesce(-F.col("a.c"), F.lit(0.0))
    verdict = F.when(F.bool_or(label == "LEGAL_INCONSISTENCY"), "LEGAL_INCONSISTENCY").when(F.bool_or(label == "UNRESOLVED"), "UNRESOLVED").otherwise("ACCEPTABLE_VARIATION")
    return rows.groupBy(*GROUP).agg(F.count("*").alias("judged_variants"), F.count_if(F.col("a").isNull()).alias("fallbacks"), verdict.alias("group_label"), F.min(sure).alias("confidence"))
