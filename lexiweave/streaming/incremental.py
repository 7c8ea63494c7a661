"""Resumable work: new files of a folder, each handled once, without what earlier runs completed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.coverage import pending


def run_pending(spark: SparkSession, source: str, schema: str, done: str, state: str, work: Callable[[DataFrame], DataFrame], keys: list[str]) -> int:
    """Handle the rows of Parquet files that have come since the last call; rows in done with the same keys are skipped.

    work gets the pending rows of a batch and returns result rows (with the keys), which are appended to done. A call that
    is repeated finds nothing new; one that broke off takes up its batch again. Returns the batches handled.
    """
    schema_of = spark.createDataFrame([], schema).schema
    handled = []

    def batch(rows: DataFrame, number: int) -> None:
        fresh = rows
        if done_exists():
            fresh = pending(rows, spark.read.parquet(done), keys)
        work(fresh).write.mode("append").parquet(done)
        handled.append(number)

    def done_exists() -> bool:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(done)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    stream = spark.readStream.schema(schema_of).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(handled)
