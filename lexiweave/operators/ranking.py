"""Global order without a global window: ranges, a total a range, running sums of the totals, and a place inside the range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def running(rows: DataFrame, order: list[str | Column], value: Column | None = None, name: str = "before") -> DataFrame:
    """rows with the sum of value (a count without one) over all rows that come before in the order, which should be total.

    Rows are dealt by range and stored, so that the ranges stay as they are; only a row a range meets in one task.
    """
    dealt = stored(rows.withColumn("_v", F.lit(1).cast("long") if value is None else value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_part").agg(F.sum("_v").alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(starts), "_part")  # a row a range
    return out.withColumn(name, F.col("_start") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_part", "_v", "_start")


def top_of_each(rows: DataFrame, stratum: str, sizes: dict, order: list[Column | str]) -> DataFrame:
    """The first rows of each stratum, as many as sizes says (none of other strata), with rank.

    The largest size is a literal bound, so every task keeps no more rows of a stratum than that before the shuffle.
    """
    most = max(sizes.values(), default=0)
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    limit = F.lit(0)
    for value, n in sizes.items():
        limit = F.when(F.col(stratum) == F.lit(value), n).otherwise(limit)
    wanted = rows.filter(F.col(stratum).isin(*[F.lit(v) for v in sizes]))
    return wanted.withColumn("rank", rank).filter(F.col("rank") <= most).filter(F.col("rank") <= limit)


def shortages(rows: DataFrame, stratum: str, sizes: dict) -> DataFrame:
    """Strata with fewer rows than wanted: stratum, wanted, available."""
    kind = rows.schema[stratum].dataType.simpleString()
    want = rows.sparkSession.createDataFrame([(v, n) for v, n in sizes.items()], f"{stratum} {kind}, wanted long")
    there = rows.groupBy(stratum).agg(F.count("*").alias("available"))
    return want.join(there, stratum, "left").fillna(0, ["available"]).filter("available < wanted")


def require_enough(picked: DataFrame, rows: DataFrame, stratum: str, sizes: dict) -> DataFrame:
    """picked, but the query fails where a stratum of rows is too small."""
    short = shortages(rows, stratum, sizes).agg(F.max(F.concat(F.lit("wanted "), F.col("wanted"), F.lit(" rows of "), F.col(stratum).cast("string"), F.lit(", there are "), F.col("available"))).alias("_short"))
    checked = picked.join(F.broadcast(short))  # one row
    return checked.filter(F.when(F.col("_short").isNotNull(), F.raise_error(F.col("_short")).cast("boolean")).otherwise(F.lit(True))).drop("_short")
