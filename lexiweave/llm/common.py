"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import batch_rows as batch_rows

#: ASCII white space, the class [\x20\x09-\x0D]; bytes.split() cuts at exactly these.
SPACES = " \t\n\x0b\x0c\r"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows where the session has Spark's default of 10,000: texts are long, and Python workers stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder that spark.checkpoint.dir names; see checkpoint_folder()."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one if all runs on this machine, else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexiweave-"))
    return sc.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Let the shuffle files of plans that a checkpoint has cut go now: Spark removes them once the driver's garbage is collected."""
    for _ in range(2):  # the plans first, what they held then
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def arrow_function(ddl: str):
    """An Arrow UDF made when it is first applied, so that importing needs no session."""

    def wrap(f):
        return lambda *columns: F.arrow_udf(f, ddl)(*columns)

    return wrap


def fresh(name: str) -> str:
    """A column name that no input column can clash with."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def utf8(column: str | Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def row_key(id_col: str, text_col: str) -> list[Column]:
    """A key that rows share only if they repeat one another: the id (null-safe) and a hash of the text."""
    return [F.coalesce(F.col(id_col).cast("string"), F.lit("\x00null")), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))]


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str, order: Column | None = None) -> DataFrame:
    """The rows of docs whose row_key is in kept (columns k, x); of rows that repeat one another exactly one.

    The texts are shuffled once; the window reuses that partitioning.
    """
    k, x, n = fresh("k"), fresh("x"), fresh("n")
    key = row_key(id_col, text_col)
    rows = docs.withColumns({k: key[0], x: key[1]}).join(kept.select(F.col("k").alias(k), F.col("x").alias(x)).distinct(), [k, x], "left_semi")
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy(k, x).orderBy(order if order is not None else F.lit(0)))
    return rows.withColumn(n, first).filter(F.col(n) == 1).select(*[f"`{c}`" for c in docs.columns])
