"""Requests to models as JSON: extraction of renderings, plans of terms, repairs, blind judgments; in batches held by a budget of characters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import text as t
from .evaluation import ERROR_FIELDS, SCORE_FIELDS
from .judgments import EXTRACTION

MIN_SCOPE = 120


def budgeted(rows: DataFrame, keys: list[str], order: list[str], size: Column, max_items: int, max_chars: int) -> DataFrame:
    """rows with batch: within the keys, in order, a batch ends where one more row would pass either bound; a row over the bound stands alone.

    The budget starts anew with each batch, so this is a fold in order: rows of a key are streamed, none is held back.
    """
    names = rows.columns
    sized = rows.withColumn("_size", size.cast("long")).repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, items, chars = None, 0, 0, 0
        for b in batches:
            out = []
            for *k, n in zip(*[b.column(c).to_pylist() for c in keys], b.column("_size").to_pylist()):
                n = n or 0
                if k != key:
                    key, number, items, chars = k, 0, 0, 0
                elif items >= max_items or chars + n > max_chars:
                    number, items, chars = number + 1, 0, 0
                items, chars = items + 1, chars + n
                out.append(number)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(out, pa.int32())], [*names, "batch"])

    return sized.mapInArrow(run, StructType([*rows.schema.fields, StructField("batch", IntegerType())]))


def _batches(rows: DataFrame, keys: list[str], place: list[str], item: Column, head: list[Column], tail: list[Column]) -> DataFrame:
    """keys, batch, items (how many) and request: the batch's items in order between fixed parts."""
    grouped = rows.withColumn("_item", item).groupBy(*keys, "batch").agg(F.array_sort(F.collect_list(F.struct(*place, "_item"))).alias("_x"))
    body = F.to_json(F.struct(*head, F.transform("_x", lambda x: x["_item"]).alias("items"), *tail), {"ignoreNullFields": "false"})
    return grouped.select(*keys, "batch", F.size("_x").alias("items"), body.alias("request"))


def extraction_requests(pairs: DataFrame, max_items: int = 20, max_chars: int = 12_000, max_source: int = 1200, max_target: int = 2400) -> DataFrame:
    """document_id, batch, items, request. pairs: document_id, occurrence_id, source_term, source_context, target_paragraph; long texts lose their middle."""
    cut = pairs.withColumns({c: t.truncate_middle(F.coalesce(c, F.lit("")), n) for c, n in (("source_context", max_source), ("target_paragraph", max_target))})
    rows = budgeted(cut, ["document_id"], ["occurrence_id"], F.length("source_context") + F.length("target_paragraph"), max_items, max_chars)
    shape = F.struct(F.lit("string").alias("occurrence_id"), F.lit("words of the target or null").alias("rendering"), F.lit("|".join(EXTRACTION)).alias("status"), F.lit("0 to 1").alias("confidence"), F.lit("string").alias("rationale"))
    item = F.struct("occurrence_id", "source_term", "source_context", "target_paragraph")
    return _batches(rows, ["document_id"], ["occurrence_id"], item, [F.lit("extract_legal_term_renderings").alias("task")], [F.struct(F.array(shape).alias("results")).alias("output_schema")])


def planner_requests(terms: DataFrame, risk_types: list[str], max_items: int = 8, max_chars: int = 12_000) -> DataFrame:
    """document_id, batch, items, request: items numbered from 0 in each batch.

    terms: document_id, term_id, source_term, term_type, criticality, definition_context, occurrence_contexts (array), candidates (array).
    """
    long = F.length(F.coalesce("definition_context", F.lit(""))) + F.length(F.array_join("occurrence_contexts", ""))
    rows = budgeted(terms, ["document_id"], ["term_id"], long, max_items, max_chars)
    number = (F.row_number().over(Window.partitionBy("document_id", "batch").orderBy("term_id")) - 1).alias("item_id")
    rows = rows.withColumn("_n", number)
    item = F.struct(F.col("_n").alias("item_id"), "term_id", "source_term", "term_type", "criticality", "definition_context", "occurrence_contexts", F.col("candidates").alias("observed_candidate_renderings"))
    return _batches(rows, ["document_id"], ["term_id"], item, [F.lit("plan_terms").alias("task"), F.array(*[F.lit(r) for r in sorted(risk_types)]).alias("allowed_risk_types")], [])


def repair_requests(queue: DataFrame, max_items: int = 10, max_chars: int = 8_000) -> DataFrame:
    """document_id, batch, items, request. queue: document_id, occurrence_id, source_term, rendering, target_paragraph, validation_status."""
    rows = budgeted(queue, ["document_id"], ["occurrence_id"], F.length(F.coalesce("target_paragraph", F.lit(""))), max_items, max_chars)
    item = F.struct("occurrence_id", "source_term", F.col("rendering").alias("current_rendering"), F.col("validation_status").alias("problem"), "target_paragraph")
    return _batches(rows, ["document_id"], ["occurrence_id"], item, [F.lit("repair_renderings").alias("task")], [])


def blind_judge_requests(pairs: DataFrame, terms: DataFrame, scope: int = MIN_SCOPE) -> DataFrame:
    """document_id, paragraph_id, request: a source, translations A and B without names, and the approved terms of the paragraph.

    pairs: document_id, paragraph_id, source, translation_a, translation_b. terms: the keys, source_term, canonical,
    criticality, scope; a paragraph without terms gets an empty list. Scopes are shortened.
    """
    key = ["document_id", "paragraph_id"]
    brief = F.left(t.collapse(F.coalesce("scope", F.lit(""))), F.lit(scope))
    known = terms.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("source_term", "canonical", F.coalesce("criticality", F.lit("")).alias("criticality"), brief.alias("scope")))).alias("terms"))
    rows = pairs.join(known, key, "left")
    listed = F.coalesce("terms", F.expr("cast(array() as array<struct<source_term:string,canonical:string,criticality:string,scope:string>>)"))
    asks = [F.array(*[F.lit(f) for f in fields.values()]).alias(name) for name, fields in (("scores_1_to_5", SCORE_FIELDS), ("critical_errors", ERROR_FIELDS))]
    body = F.struct(F.lit("blind_pairwise_judgment").alias("task"), "source", listed.alias("terms"), "translation_a", "translation_b", *asks, F.array(*[F.lit(w) for w in ("A", "B", "TIE")]).alias("winner"))
    return rows.select(*key, F.to_json(body, {"ignoreNullFields": "false"}).alias("request"))
