"""Variants judged in batches by a scripted judge that refuses batches which are too large for one of their items."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import rebatching as rb
from ..sources.shared import shared_folder
from .consistency_queries import NV, R, sql_variants
from .control_queries import reviewed_variants


class Judge:
    """An item bears batches of up to n % 4 + 1 items, n being its count; every 13th is never answered. Every third document needs 1,200 tokens, every fifth no JSON mode."""

    def reply(self, requests: list[str], max_tokens: list[int]) -> list[tuple[str | None, str | None]]:
        return [self.one(json.loads(r), n) for r, n in zip(requests, max_tokens)]

    def one(self, r: dict, limit: int) -> tuple[str | None, str | None]:
        counts = [int(x["payload"]) for x in r["items"]]
        if int(r["document_id"]) % 3 == 0 and limit < 1200:
            return None, "truncated"
        if int(r["document_id"]) % 5 == 0 and r["json_mode"]:
            return None, "json_mode"
        if len(counts) > min(n % 4 + 1 for n in counts) or any(n % 13 == 0 for n in counts):
            return "[]", None
        return json.dumps([{"item_id": x["item_id"], "label": "LEGAL_INCONSISTENCY" if n % 2 else "ACCEPTABLE_VARIANT", "confidence": n % 10 / 10} for x, n in zip(r["items"], counts)]), None


def asked(split: str, size: int):
    def run(spark, folder):
        v = reviewed_variants(spark, folder).filter("variant_id <> 'V000'")
        items = v.select("document_id", F.concat_ws("/", "term_id", "variant_id").alias("item_id"), F.col("term_id").alias("group_id"), F.col("n").cast("string").alias("payload"))
        return rb.ask_in_batches(items, Judge(), shared_folder(spark, "batches"), rb.Batches(size=size, split=split))

    return run


ITEMS = f"{R}, var AS ({sql_variants('reviews', NV)}), it AS (SELECT document_id, term_id || '/' || variant_id AS item_id, term_id AS group_id, n FROM var WHERE variant_id <> 'V000')"
REFUSED = "(len(xs) > list_min(list_transform(xs, lambda x: x.n % 4 + 1)) OR len(list_filter(xs, lambda x: x.n % 13 = 0)) > 0)"
#: Batches as lists, those refused cut again and again.
TREE = """{items}, first AS (SELECT document_id, {place} // {size} AS b, {{'g': group_id, 'i': item_id, 'n': n}} AS x FROM it), tree AS (
  SELECT document_id, list(x ORDER BY x.g, x.i) AS xs, 0 AS level FROM first GROUP BY document_id, b
  UNION ALL SELECT document_id, unnest({cut}) AS xs, level + 1 FROM tree WHERE len(xs) > 1 AND {refused}
), leaf AS (SELECT document_id, unnest(xs) AS x, level, len(xs) AS size, NOT {refused} AS resolved FROM tree WHERE len(xs) = 1 OR NOT {refused})
SELECT document_id, x.i AS item_id, x.g AS group_id, CASE WHEN NOT resolved THEN 'UNRESOLVED' WHEN x.n % 2 = 1 THEN 'LEGAL_INCONSISTENCY' ELSE 'ACCEPTABLE_VARIANT' END AS label,
  CASE WHEN resolved THEN (x.n % 10) / 10 ELSE 0.0 END AS confidence, level, CAST(size AS INT) AS batch_size, CASE WHEN CAST(document_id AS INT) % 3 = 0 THEN 1200 ELSE 600 END AS max_tokens, resolved FROM leaf"""
HALVES = "[xs[: (len(xs) + 1) // 2], xs[(len(xs) + 1) // 2 + 1 :]]"
GROUPS = "CASE WHEN len(list_distinct(list_transform(xs, lambda x: x.g))) > 1 THEN list_transform(list_distinct(list_transform(xs, lambda x: x.g)), lambda g: list_filter(xs, lambda x: x.g = g)) ELSE list_transform(xs, lambda x: [x]) END"


def tree(place: str, size: int, cut: str) -> str:
    return TREE.format(items=ITEMS.replace("WITH ", "WITH RECURSIVE ", 1), place=place, size=size, cut=cut, refused=REFUSED)


QUERIES = {
    "v13_halved_batches": (asked("halves", 8), tree("(row_number() OVER (PARTITION BY document_id ORDER BY group_id, item_id) - 1)", 8, HALVES)),
    "v04_asked_by_group": (asked("groups", 4), tree("(dense_rank() OVER (PARTITION BY document_id ORDER BY group_id) - 1)", 4, GROUPS)),
}
