"""Contiguous shards of nearly equal bytes by global prefix sums; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows are dealt by range of doc_id (null first; rows with the same id spread by a row number, so none is too
    large), each partition's bytes and counts are totalled, and the running sums of these totals, a row a partition,
    place every row in the global order. A row goes to the shard in whose equal share of all bytes its middle falls,
    so a shard misses its share by less than its largest end rows. Shards are contiguous in doc_id, repeated rows
    and equal texts are placed like any others, a null text has size 1, an empty table gives no rows.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "text_crc32", "size", "row"]
    dealt = checkpoint(checkpoint(rows).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row a partition: the only rows that meet in one task.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0"))
    total = totals.agg(F.sum("bytes")).first()[0] or 1
    within = Window.partitionBy("part").orderBy(*order)
    placed = dealt.join(F.broadcast(starts), "part").select(
        "doc_id", "size", "text_crc32", (F.col("bytes0") + F.sum("size").over(within) - F.col("size")).alias("at"), (F.col("rows0") + F.row_number().over(within) - 1).alias("index")
    )
    middle = (2 * F.col("at").cast("decimal(38,0)") + F.col("size")) * shards
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle / F.lit(2 * total).cast("decimal(20,0)")).cast("int")))
    first = placed.groupBy("shard").agg(F.min("index").alias("index0"))  # a row a shard
    out = placed.join(F.broadcast(first), "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("index") - F.col("index0")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


