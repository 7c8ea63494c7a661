"""Paragraphs that got no translation, asked again piece by piece: smaller and smaller pieces until each has an answer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.python_text import split_source
from ..functions.text import chunk_limits
from ..sources.shared import batch_rows
from .closed_loop import exists
from .providers import ChatProvider, converse

KEY = ["document_id", "paragraph_id"]
#: Rows and bytes of an Arrow batch: its texts and all their pieces are in a worker at once.
BATCH, SIZE = 200, "2m"
_PIECES = pa.list_(pa.struct([("place", pa.int32()), ("piece", pa.string()), ("text", pa.string())]))


def shapes(text: str, limits: list[int]) -> list[int]:
    """The limits to cut a text by, from the coarsest on; one that gives pieces of the same lengths as one before is left out."""
    seen, out = set(), []
    for limit in limits:
        lengths = tuple(map(len, split_source(text, limit)))
        if lengths not in seen:
            seen.add(lengths)
            out.append(limit)
    return out


def plans(text: Column, configured: int | None) -> Column:
    limits = chunk_limits(configured)

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([None if t.as_py() is None else shapes(t.as_py(), limits) for t in texts], pa.list_(pa.int32()))

    return of(text)


def pieces(text: Column, limit: Column) -> Column:
    """place and piece of each piece of a text; the first one has the text as well."""

    @F.arrow_udf("array<struct<place:int,piece:string,text:string>>")
    def of(texts: pa.Array, limits: pa.Array) -> pa.Array:
        cut = ((t, split_source(t, n)) for t, n in ((t.as_py(), n.as_py()) for t, n in zip(texts, limits)))
        return pa.array(([(i, p, None if i else t) for i, p in enumerate(found)] for t, found in cut), _PIECES)

    return of(text, limit)


def recover(paragraphs: DataFrame, provider: ChatProvider, folder: str, configured: int | None = None, max_tokens: int = 4096) -> DataFrame:
    """A row a paragraph (document_id, paragraph_id, text; each pair once): translation, limit, pieces, attempts; translation null where every cut failed.

    A try is one pass over the pieces of the paragraphs that are still open, without any context; answers are stored before
    they are used, and a broken run goes on from them. Pieces' translations are joined by line ends, in order. A null text is left out.
    A row carries its text and the limits to cut it by, never the pieces of more than one cut; batches hold BATCH rows and SIZE bytes at most.
    """
    spark = paragraphs.sparkSession
    rows = paragraphs.filter("text is not null").select(*KEY, "text", plans(F.col("text"), configured).alias("limits"))
    parts, i = [], 0
    while True:
        asked = f"{folder}/try-{i}"
        if not exists(spark, asked):
            now = rows.select(*KEY, "limits", F.inline(pieces(F.col("text"), F.col("limits")[i])))
            # The limits go along with the first piece alone, as the text does.
            sent = now.select(*KEY, "place", F.when(F.col("place") == 0, F.struct("text", "limits")).alias("whole"), F.to_json(F.struct(*KEY, F.lit("piece").alias("task"), F.lit(i).alias("attempt"), F.col("piece").alias("source"))).alias("request"), F.lit(max_tokens).alias("max_tokens"))
            with batch_rows(spark, BATCH, SIZE):
                converse(sent, provider).drop("request").write.mode("overwrite").parquet(asked)
        got = spark.read.parquet(asked)
        each = got.groupBy(*KEY).agg(F.count("*").alias("pieces"), F.count_if(F.col("error").isNull() & (F.btrim(F.coalesce("answer", F.lit(""))) != "")).alias("_n"), F.max_by("whole", -F.col("place")).alias("whole"), F.array_sort(F.collect_list(F.struct("place", "answer"))).alias("_a"))
        each = each.withColumn("_ok", F.col("_n") == F.col("pieces"))
        limits = F.col("whole.limits")
        done = each.filter(F.col("_ok") | (F.size(limits) == i + 1))
        parts.append(done.select(*KEY, F.when(F.col("_ok"), F.array_join(F.transform("_a", lambda x: x["answer"]), "\n")).alias("translation"), F.when(F.col("_ok"), limits[i]).alias("limit"), F.col("pieces").cast("int").alias("pieces"), F.lit(i + 1).alias("attempts")))
        rows, i = each.filter(~F.col("_ok") & (F.size(limits) > i + 1)).select(*KEY, "whole.text", "whole.limits"), i + 1
        if rows.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
