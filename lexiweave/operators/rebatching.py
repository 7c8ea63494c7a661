"""Questions asked in batches, and asked again in ever smaller ones where an answer cannot be used.

A batch is a row with its items. A round asks every open batch at once; a batch whose answer is usable is done, a
truncated one gets twice the tokens, one whose provider has no JSON mode goes without, others are tried again and then
split, in halves or by group and then by item. A single item that still fails is kept as unresolved. Splitting is an
explode of the row's own items, so nothing is shuffled after the first batching, and rounds are stored as Parquet
before their answers are used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .closed_loop import exists
from .judging import LABELS
from .providers import ChatProvider, converse

ITEM = "struct<item_id:string,group_id:string,payload:string>"
ANSWER = "array<struct<item_id:string,label:string,confidence:double>>"


@dataclass(frozen=True)
class Batches:
    """split: halves or groups. retries: of a batch before it is split; doublings: of its tokens."""

    size: int = 8
    split: str = "halves"
    retries: int = 1
    max_tokens: int = 600
    doublings: int = 1


def usable_labels(answer: Column, items: Column) -> Column:
    """The answer's rows if it has one for each item, and each is a known label with a confidence from 0 to 1; else null."""
    rows = F.from_json(answer, ANSWER)
    ids = lambda xs: F.array_sort(F.transform(xs, lambda x: x["item_id"]))
    good = F.forall(rows, lambda r: F.coalesce(r["label"].isin(*LABELS) & r["confidence"].between(0, 1), F.lit(False)))
    return F.when(F.coalesce(good & (ids(rows) == ids(items)), F.lit(False)), rows)


def first_batches(items: DataFrame, policy: Batches) -> DataFrame:
    """items: document_id, item_id, group_id, payload. Batches of a document in the order of group and item; groups stay together where they are split by group."""
    order = ("group_id", "item_id")
    w = Window.partitionBy("document_id").orderBy(*order)
    place = F.row_number().over(w) - 1 if policy.split == "halves" else F.dense_rank().over(Window.partitionBy("document_id").orderBy("group_id")) - 1
    rows = items.select("document_id", F.floor(place / policy.size).cast("int").alias("n"), F.struct("group_id", "item_id", "payload").alias("x"))
    made = rows.groupBy("document_id", "n").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["item_id"].alias("item_id"), x["group_id"].alias("group_id"), x["payload"].alias("payload"))).alias("items"))
    zero = F.lit(0)
    return made.select("document_id", F.col("n").cast("string").alias("batch_id"), "items", zero.alias("level"), zero.alias("attempt"), F.lit(policy.max_tokens).alias("max_tokens"), zero.alias("doublings"), F.lit(True).alias("json_mode"), F.lit(None).cast("string").alias("note"))


def smaller(items: Column, split: str) -> Column:
    """The batches that a failed one is cut into."""
    n = F.size(items)
    half = F.ceil(n / 2).cast("int")
    if split == "halves":
        return F.array(F.slice(items, F.lit(1), half), F.slice(items, half + 1, n - half))
    groups = F.array_distinct(F.transform(items, lambda x: x["group_id"]))
    by_group = F.transform(groups, lambda g: F.filter(items, lambda x: x["group_id"] == g))
    return F.when(F.size(groups) > 1, by_group).otherwise(F.transform(items, lambda x: F.array(x)))


def ask_in_batches(items: DataFrame, provider: ChatProvider, folder: str, policy: Batches = Batches(), usable: Callable[[Column, Column], Column] = usable_labels) -> DataFrame:
    """A row an item: document_id, item_id, group_id, label, confidence, level (how often its batch was split), batch_size, max_tokens, resolved.

    Unresolved items have the label UNRESOLVED and confidence 0. Items with one id in a document make their batch unusable
    until they are alone. Rounds stored in folder are not asked again. An empty table gives no rows.
    """
    spark, rows, i, parts = items.sparkSession, first_batches(items, policy), 0, []
    while True:
        asked = f"{folder}/round-{i:02d}"
        if not exists(spark, asked):
            request = F.to_json(F.struct("document_id", "batch_id", "attempt", "json_mode", "note", F.transform("items", lambda x: F.struct(x["item_id"].alias("item_id"), x["group_id"].alias("group_id"), x["payload"].alias("payload"))).alias("items")))
            converse(rows.withColumn("request", request), provider).drop("request").write.mode("overwrite").parquet(asked)
        got = spark.read.parquet(asked).withColumn("good", usable(F.col("answer"), F.col("items")))
        cut, plain = F.coalesce(F.col("error") == "truncated", F.lit(False)), F.coalesce((F.col("error") == "json_mode") & F.col("json_mode"), F.lit(False))
        grow = cut & (F.col("doublings") < policy.doublings)
        ok, alone = F.col("good").isNotNull(), F.size("items") == 1
        again = ~ok & (grow | plain | (F.col("attempt") < policy.retries))
        lost = ~ok & ~again & alone
        answers = F.when(ok, F.col("good")).otherwise(F.transform("items", lambda x: F.struct(x["item_id"].alias("item_id"), F.lit("UNRESOLVED").alias("label"), F.lit(0.0).alias("confidence"))))
        each = F.explode(F.transform("items", lambda x: F.struct(x["item_id"].alias("item_id"), x["group_id"].alias("group_id"), F.element_at(F.filter(answers, lambda r: r["item_id"] == x["item_id"]), F.lit(1)).alias("a")))).alias("x")
        parts.append(got.filter(ok | lost).select("document_id", each, "level", F.size("items").alias("batch_size"), "max_tokens", ok.alias("resolved")))
        moved = got.filter(~ok & ~lost).withColumn("_again", again).withColumn("_grow", grow).withColumn("_plain", plain)
        moved = moved.withColumn("part", F.explode(F.when(F.col("_again"), F.array("items")).otherwise(smaller(F.col("items"), policy.split))))
        counted = ~F.col("_grow") & ~F.col("_plain")
        rows = moved.select(
            "document_id", F.when(F.col("_again"), F.col("batch_id")).otherwise(F.concat_ws("/", "batch_id", F.col("part")[0]["item_id"])).alias("batch_id"), F.col("part").alias("items"), F.when(F.col("_again"), F.col("level")).otherwise(F.col("level") + 1).alias("level"),
            F.when(F.col("_again"), F.col("attempt") + counted.cast("int")).otherwise(0).alias("attempt"), F.when(F.col("_grow"), F.col("max_tokens") * 2).otherwise(F.col("max_tokens")).alias("max_tokens"), (F.col("doublings") + F.col("_grow").cast("int")).alias("doublings"),
            (F.col("json_mode") & ~F.col("_plain")).alias("json_mode"), F.when(F.col("_again"), F.coalesce("error", F.lit("the answer lacks items or holds unknown labels"))).alias("note"),
        )
        i += 1
        if rows.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("document_id", "x.item_id", "x.group_id", "x.a.label", "x.a.confidence", "level", "batch_size", "max_tokens", "resolved")
