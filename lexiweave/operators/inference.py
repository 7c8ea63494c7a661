"""Intervals and sign-flip tests over documents, for many groups at once, at full numbers of replicates.

A replicate is a number made by hashing (seed, stream, replicate, document), so results do not depend on partitions and
can be written in SQL. Where every group's documents fit in a row (DRAWS of them), replicates are dealt to tasks in
blocks beside that row, and each is a sample of as many documents as there are. Beyond that, documents stay where they
are: every partition folds its documents into fixed-length arrays, one number a replicate, with Poisson weights for the
samples, and arrays are added up. No row is made for a pair of replicate and document in either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DRAWS = 100_000
BLOCK = 1024
CELLS = 1 << 21  # of replicates times documents that a task holds at once
#: Shares of Poisson(1) up to 0, 1, 2, ... in 32 bits.
POISSON = np.array([min(2**32 - 1, round(2**32 * np.exp(-1) * sum(1 / np.prod(range(1, i + 1)) for i in range(k + 1)))) for k in range(13)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """32 bits to 32 bits, one to one."""
    x = x.astype(np.uint32)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def hashes(seed: int, stream: int, replicates: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number of 32 bits for each replicate (rows) and place (columns)."""
    one = mix(mix(np.array([(seed + stream) & 0xFFFFFFFF], np.uint32)) + replicates.astype(np.uint32))
    return mix(one[:, None] + places.astype(np.uint32)[None, :])


def flips(seed: int, stream: int, first: int, n: int, keys: np.ndarray) -> np.ndarray:
    """Signs of n permutations from the first on (a multiple of 32): 32 of them from the bits of one number."""
    words = hashes(seed ^ 0x5F5F5F5F, stream, np.arange(first // 32, -(-(first + n) // 32)), keys)
    bits = (words[:, None, :] >> np.arange(32, dtype=np.uint32)[None, :, None]) & np.uint32(1)
    return 1.0 - 2.0 * bits.reshape(-1, len(keys))[:n]


def document_key(document: str | Column) -> Column:
    """32 bits of a document's name."""
    return F.conv(F.substring(F.sha2(F.col(document) if isinstance(document, str) else document, 256), 1, 8), 16, 10).cast("long")


def _blocks(n: int) -> list[tuple[int, int]]:
    return [(i, min(BLOCK, n - i)) for i in range(0, n, BLOCK)]


def _replicates(names: list[str], seed: int):
    """Rows of packed documents and a block of replicates: kind 0 samples (means and ratios), kind 1 sign flips (how many are extreme)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[list[float], list[float], int]] = []
            for r in batch.to_pylist():
                s, c = np.array([d["s"] for d in r["_docs"]]), np.array([d["n"] for d in r["_docs"]], float)
                keys, means, n = np.array([d["key"] for d in r["_docs"]], np.uint64), s / c, len(s)
                at, size, extreme = r["_first"], r["_size"], 0
                step = max(1, CELLS // n)
                macro, ratio = [], []
                if r["_kind"]:
                    step = max(32, step // 32 * 32)
                    for i in range(0, size, step):
                        m = flips(seed, r["stream"], at + i, min(step, size - i), keys) @ means / n
                        extreme += int((np.abs(m) >= abs(means.mean()) - 1e-12).sum())
                else:
                    for i in range(0, size, step):
                        draw = hashes(seed, r["stream"], np.arange(at + i, at + i + min(step, size - i)), np.arange(n)) % np.uint32(n)
                        macro += means[draw].mean(axis=1).tolist()
                        ratio += (s[draw].sum(axis=1) / c[draw].sum(axis=1)).tolist()
                out.append((macro, ratio, extreme))
            made = [pa.array([o[0] for o in out], pa.list_(pa.float64())), pa.array([o[1] for o in out], pa.list_(pa.float64())), pa.array([o[2] for o in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *made], [*names, "macro", "ratio", "extreme"])

    return run


def _folded(seed: int, resamples: int, permutations: int):
    """Of a partition's documents (stream, s, n, key): arrays by stream, a number a replicate: weights, weighted means, sums and counts; signed means."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            stream, s, c, key = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("stream", "s", "n", "key"))
            for g in np.unique(stream).tolist():
                t = total.setdefault(g, np.zeros(4 * resamples + permutations))
                rows = np.flatnonzero(stream == g)
                for i in range(0, len(rows), 256):
                    at = rows[i : i + 256]
                    m = s[at] / c[at]
                    for first, n in _blocks(resamples):
                        w = np.searchsorted(POISSON, hashes(seed, g, np.arange(first, first + n), key[at]), side="right").astype(float)
                        for j, v in enumerate((np.ones(len(at)), m, s[at], c[at].astype(float))):
                            t[j * resamples + first : j * resamples + first + n] += w @ v
                    for first, n in _blocks(permutations):
                        t[4 * resamples + first : 4 * resamples + first + n] += flips(seed, g, first, n, key[at]) @ m
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["stream", "t"])

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(pdf["t"].iloc[0]).copy()
    for b in pdf["t"].iloc[1:]:
        total += np.frombuffer(b)
    return pd.DataFrame({"stream": [pdf["stream"].iloc[0]], "t": [total.tobytes()]})


def _finished(resamples: int, permutations: int):
    """Arrays of all documents of a stream, with what was observed: replicates' means and ratios, and the number of extreme flips."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, macro, n = np.frombuffer(pdf["t"].iloc[0]), float(pdf["_macro"].iloc[0]), int(pdf["documents"].iloc[0])
        w, m, s, c = t[: 4 * resamples].reshape(4, resamples)
        extreme = int((np.abs(t[4 * resamples :] / n) >= abs(macro) - 1e-12).sum())
        return pd.DataFrame({"stream": [pdf["stream"].iloc[0]], "macro": [(m / w).tolist()], "ratio": [(s / c).tolist()], "extreme": [extreme]})

    return run


def paired_inference(rows: DataFrame, keys: list[str], resamples: int = 10_000, permutations: int = 50_000, seed: int = 2026, draws: int = DRAWS) -> DataFrame:
    """A row for each of the keys: documents, paragraphs, macro and weighted effect with 95 % intervals, and the two-sided sign-flip p of document means.

    rows: keys, stream (an int a group, which its random numbers come from), document_id, diff. Null differences are left
    out. macro: the mean of document means; weighted: all differences' mean, documents being resampled whole.
    """
    docs = rows.filter("diff is not null").groupBy(*keys, "stream", "document_id").agg(F.sum("diff").alias("s"), F.count("*").alias("n"))
    docs = docs.select(*keys, "stream", F.struct("document_id", document_key(F.coalesce(F.col("document_id").cast("string"), F.lit(""))).alias("key"), "s", "n").alias("d"))
    seen = docs.groupBy(*keys, "stream").agg(F.count("*").alias("documents"), F.sum("d.n").alias("paragraphs"), F.avg(F.col("d.s") / F.col("d.n")).alias("_macro"), (F.sum("d.s") / F.sum("d.n")).alias("_weighted"))
    largest = seen.agg(F.max("documents")).first()[0] or 0
    if largest <= draws:
        packed = docs.groupBy(*keys, "stream").agg(F.array_sort(F.collect_list("d")).alias("_docs"))
        blocks = F.array(*[F.struct(F.lit(kind).alias("k"), F.lit(a).alias("a"), F.lit(n).alias("n")) for kind, m in ((0, resamples), (1, permutations)) for a, n in _blocks(m)])
        dealt = packed.withColumn("_b", F.explode(blocks)).select("stream", "_docs", F.col("_b.k").alias("_kind"), F.col("_b.a").alias("_first"), F.col("_b.n").alias("_size")).repartition("stream", "_kind", "_first")
        made = dealt.mapInArrow(_replicates(["stream"], seed), "stream int, macro array<double>, ratio array<double>, extreme long")
    else:
        flat = docs.select("stream", "d.key", "d.s", "d.n")
        arrays = flat.mapInArrow(_folded(seed, resamples, permutations), "stream int, t binary")
        arrays = arrays.withColumn("_g", F.spark_partition_id() % 64).groupBy("stream", "_g").applyInPandas(_added, "stream int, t binary").groupBy("stream").applyInPandas(_added, "stream int, t binary")
        made = arrays.join(seen.select("stream", "_macro", "documents"), "stream").groupBy("stream").applyInPandas(_finished(resamples, permutations), "stream int, macro array<double>, ratio array<double>, extreme long")
    extreme = made.groupBy("stream").agg(F.sum("extreme").alias("extreme"))
    cut = lambda x, q: F.round(F.percentile(x, F.lit(q)), 6)
    each = made.select("stream", F.explode(F.arrays_zip("macro", "ratio")).alias("x")).groupBy("stream")
    limits = each.agg(*[cut(f"x.{x}", q).alias(f"{n}_{e}") for x, n in (("macro", "macro"), ("ratio", "weighted")) for e, q in (("low", 0.025), ("high", 0.975))])
    out = seen.join(limits, "stream", "left").join(extreme, "stream", "left").fillna(0, ["extreme"])
    return out.select(*keys, "documents", "paragraphs", F.round("_macro", 6).alias("macro_effect"), "macro_low", "macro_high", F.round("_weighted", 6).alias("weighted_effect"), "weighted_low", "weighted_high", F.round((F.col("extreme") + 1) / (permutations + 1), 6).alias("sign_flip_p"))
