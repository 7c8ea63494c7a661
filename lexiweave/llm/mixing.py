"""Mixing to target weights with soft membership.

A softmax classifier over hashed words, fitted to labelled rows, gives every document posteriors over the labels'
domains. Rates r >= floor minimise the least squares sum_k (sum_d a_dk r_d - t_k)^2, with a_dk the document's share of all
tokens times its posterior and t_k the target share, by projected gradient steps from rates of 1: r <- max(floor, r - p.g),
with one number g_k a domain. g is the residual, scaled by the inverse of the K x K second moments of the posteriors of
documents above the floor, so that it falls alike in all directions; where such steps stop helping (a target out of
reach), plain accelerated ones follow until the residual no longer falls. A step is one pass that sums K shares and K x K
moments; a document's rate follows from its posteriors and the few vectors g, and nothing but these sums reaches the driver.
"""

from __future__ import annotations

import uuid
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_function, checkpoint, checkpoint_folder, fresh, row_key, table, utf8

BUCKETS = 2048
#: Domains of the labelled rows, by (toxic, quality).
DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.90, "low": 0.07, "toxic": 0.03}


def hashed(text: bytes) -> tuple[int, np.ndarray]:
    """Words; their hashed counts, damped and scaled to length one, with shares of signs and repeated lines at the end."""
    words = text.lower().split()
    x = np.zeros(BUCKETS + 3, np.float32)
    if words:
        counts = np.bincount(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS, minlength=BUCKETS)
        x[:BUCKETS] = np.log1p(counts)
        x[:BUCKETS] /= np.linalg.norm(x[:BUCKETS])
        lines = text.split(b"\n")
        x[BUCKETS:] = sum(map(text.count, (b"#", b"*", b"%", b"|", b"$", b"<", b">"))) / len(words), 1 - len(set(lines)) / len(lines), min(1.0, 20 / len(words))
    return len(words), x


@dataclass
class Classifier:
    weights: np.ndarray  # features by domains
    bias: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)


def fit_classifier(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, steps: int = 150, decay: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """From at most max_rows labelled rows, the first by a hash of their id; without any, equal posteriors."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    sample = labels.select(F.col(id_col).alias("id"), domain.alias("domain")).filter("id is not null and domain is not null").orderBy(F.xxhash64("id"), "id").limit(max_rows).dropDuplicates(["id"])
    # At most max_rows ids, so they can be sent to every task.
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter("text is not null")
    rows = texts.join(F.broadcast(sample), F.col("doc") == F.col("id")).select(_hashed_sparse(utf8("text")).alias("x"), "domain").collect()
    k = len(DOMAINS)
    rows.sort(key=lambda r: (r["domain"], r["x"]["v"]))
    w, b = np.zeros((BUCKETS + 3, k), np.float32), np.zeros(k, np.float32)
    if not rows:
        return Classifier(w, b)
    x = np.zeros((len(rows), BUCKETS + 3), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["x"]["i"], np.uint16)] = np.frombuffer(r["x"]["v"], np.float32)
    y = np.eye(k, dtype=np.float32)[[r["domain"] for r in rows]]
    m = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    model = Classifier(w, b)
    for step in range(1, steps + 1):
        d = (y - model.posteriors(x)) / np.float32(len(rows))
        for j, (theta, g) in enumerate(((w, x.T @ d - decay * w), (b, d.sum(axis=0)))):
            m[2 * j] = 0.9 * m[2 * j] + 0.1 * g
            m[2 * j + 1] = 0.99 * m[2 * j + 1] + 0.01 * g * g
            theta += 0.1 * m[2 * j] / (1 - 0.9**step) / (np.sqrt(m[2 * j + 1] / (1 - 0.99**step)) + 1e-9)
    return model


@arrow_function("struct<i:binary,v:binary>")
def _hashed_sparse(texts: pa.Array) -> pa.Array:
    """Places (16 bits) and values (32 bits) of what is not zero: a few hundred bytes a text."""
    out = []
    for t in texts:
        x = hashed(t.as_py())[1]
        at = np.flatnonzero(x)
        out.append({"i": at.astype(np.uint16).tobytes(), "v": x[at].tobytes()})
    return pa.array(out, pa.struct([("i", pa.binary()), ("v", pa.binary())]))


def membership(model: Classifier, column):
    @F.arrow_udf("struct<tokens:bigint,p:array<double>>")
    def of(texts: pa.Array) -> pa.Array:
        rows = [hashed(t.as_py()) for t in texts]
        p = model.posteriors(np.array([x for _, x in rows]).reshape(len(rows), -1)) if rows else np.empty((0, 1))
        return pa.array([{"tokens": n, "p": q.tolist()} for (n, _), q in zip(rows, p)], pa.struct([("tokens", pa.int64()), ("p", pa.list_(pa.float64()))]))

    return of(column)


@dataclass
class Steps:
    """Projected gradient steps (momentum, a number for each domain), from which any document's rate follows."""

    moves: list[tuple[float, np.ndarray]]
    floor: float = 0.0

    def rate(self, p: np.ndarray) -> np.ndarray:
        r = last = np.maximum(self.floor, np.ones(len(p)))
        for momentum, g in self.moves:
            r, last = np.maximum(self.floor, r + momentum * (r - last) - p @ g), r
        return r


def _totals(trials: list[Steps]):
    """Of a part and each trial: sums of tokens times rate by domain, and of the second moments of posteriors: of documents above the floor, of all."""
    k = len(DOMAINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(trials), k + 2 * k * k))
        for batch in batches:
            if batch.num_rows:
                n, p = batch.column(0).to_numpy().astype(float), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                every = ((p * n[:, None]).T @ p).ravel()
                for row, steps in zip(total, trials):
                    r = steps.rate(p)
                    row[:k] += (n * r) @ p
                    row[k : k + k * k] += ((p * (n * (r > steps.floor))[:, None]).T @ p).ravel()
                    row[k + k * k :] += every
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["t"])

    return run


def _sum(members: DataFrame, trials: list[Steps]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each trial: tokens by domain at its rates; moments of documents above the floor; moments of all."""
    k = len(DOMAINS)
    width = k + 2 * k * k
    parts = members.select("tokens", "p").mapInArrow(_totals(trials), "t array<double>")
    row = parts.agg(*[F.sum(F.get("t", F.lit(i))) for i in range(width * len(trials))]).first()
    t = np.array([float(v or 0.0) for v in row]).reshape(len(trials), width)
    return [(x[:k], x[k : k + k * k].reshape(k, k), x[k + k * k :].reshape(k, k)) for x in t]


def fit_rates(members: DataFrame, targets: dict[str, float], floor: float = 0.0, max_steps: int = 60, tolerance: float = 1e-6, least_fall: float = 0.05) -> tuple[Steps, dict]:
    """members: tokens, p. What gives the rates, and a report of the domains' shares before and after.

    Targets are shares of the tokens now there; with a floor of 1 (no document may go) the mix grows to the least total at
    which no domain has to shrink. Steps end once every domain is within the tolerance, a share of all tokens. A target
    that is out of reach ends them where five steps together lower the residual by less than least_fall of it, and a warning says
    by how much it is missed: the exact minimum would put all its weight on a few extreme documents.
    """
    k, want = len(DOMAINS), np.array([max(0.0, targets.get(d, 0.0)) for d in DOMAINS])
    steps = Steps([], floor)
    got, free, every = _sum(members, [steps])[0]
    now = _sum(members, [Steps([])])[0][0] if floor > 1 else got
    total = float(now.sum())
    if not total or not want.sum():
        return steps, {"total": total}
    share = want / want.sum()
    goal = share * (1.0 if floor < 1 else max(1.0, float((now[share > 0] / total / share[share > 0]).max())))
    missed, passes = got / total - goal, 1
    norm = lambda t: np.linalg.norm(t[0] / total - goal)
    while abs(missed).max() > tolerance and len(steps.moves) < max_steps:  # scaled steps: of four lengths, tried in one pass, the best
        moments = (free if np.trace(free) > 1e-6 * np.trace(every) else every) / total
        g = np.linalg.solve(moments + 1e-9 * np.trace(every) / total * np.eye(k), missed)
        trials = [Steps([*steps.moves, (0.0, g / 2**i)], floor) for i in range(4)]
        there, new = min(zip(_sum(members, trials), trials), key=lambda x: norm(x[0]))
        passes += 1
        if norm(there) > 0.98 * np.linalg.norm(missed):
            break
        steps, (got, free, every) = new, there
        missed = got / total - goal
    length, theta, before, history = 1 / max(np.linalg.eigvalsh(every / total)[-1], 1e-12), 1.0, missed, [np.linalg.norm(missed)]
    for _ in range(max_steps):  # plain ones, accelerated; a step that does not help starts the acceleration anew
        if abs(missed).max() <= tolerance or len(history) > 5 and history[-1] > (1 - least_fall) * history[-6]:
            break
        ahead = (1 + (1 + 4 * theta * theta) ** 0.5) / 2
        momentum = (theta - 1) / ahead
        new = Steps([*steps.moves, (momentum, length * (missed + momentum * (missed - before)))], floor)
        there = _sum(members, [new])[0]
        passes += 1
        if momentum and norm(there) > np.linalg.norm(missed):
            theta, before = 1.0, missed
            continue
        steps, got, theta, before = new, there[0], ahead, missed
        missed = got / total - goal
        history.append(np.linalg.norm(missed))
    if abs(missed).max() > 1e-4:
        warnings.warn(f"mixing targets out of reach, in shares of all tokens: {dict(zip(DOMAINS, missed.round(6).tolist()))}", stacklevel=2)
    return steps, {"total": total, "passes": passes, "goal": dict(zip(DOMAINS, goal * total)), "before": dict(zip(DOMAINS, now)), "after": dict(zip(DOMAINS, got)), "missed": dict(zip(DOMAINS, missed))}


def rates(steps: Steps, column):
    @F.arrow_udf("double")
    def of(p: pa.Array) -> pa.Array:
        return pa.array(steps.rate(p.flatten().to_numpy().reshape(len(p), -1)) if len(p) else np.empty(0))

    return of(column)


def copies(rate, k, x):
    """Whole copies of a row whose expected number is its rate: the fraction is drawn by a hash of the row's key."""
    draw = F.pmod(F.xxhash64(k, x, F.lit("mix")), F.lit(1 << 30)) / (1 << 30)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("int")


def mix(docs: DataFrame, model: Classifier, targets: dict[str, float], floor: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, tokens, a posterior for each domain, rate, copies.

    A null or empty text has no tokens and the classifier's posteriors of an empty one; rates of repeated rows are equal;
    null doc_ids are drawn alike; an empty table gives no rows.
    """
    m = membership(model, utf8(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), m.alias("m")).select("doc_id", *[c.alias(n) for c, n in zip(row_key("doc_id", "text"), "kx")], F.col("m.tokens").alias("tokens"), F.col("m.p").alias("p"))
    rows = checkpoint(rows)
    steps, _ = fit_rates(rows, targets, floor)
    rows = rows.withColumn("rate", rates(steps, F.col("p")))
    return rows.select("doc_id", "tokens", *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", copies(F.col("rate"), "k", "x").alias("copies"))


def remix(docs: DataFrame, model: Classifier, targets: dict[str, float], floor: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each row as often as its rate says (never dropped at a floor of 1); the texts are not shuffled.

    Posteriors are written next to the rows once, as Parquet in the checkpoint folder; the steps read that column alone.
    Rows with a null or empty text have no tokens and the posteriors of an empty one; rows that repeat one another get equally many
    copies; columns may have any names; an empty table gives no rows.
    """
    spark, names = docs.sparkSession, [f"`{c}`" for c in docs.columns]
    m, n, folder = fresh("m"), fresh("n"), f"{checkpoint_folder(docs.sparkSession)}/mixing-{uuid.uuid4().hex}"
    docs.select(*names, membership(model, utf8(text_col)).alias(m)).write.parquet(folder)
    rows = spark.read.parquet(folder)
    steps, _ = fit_rates(checkpoint(rows.select(f"{m}.tokens", f"{m}.p")), targets, floor)
    out = rows.withColumn(n, copies(rates(steps, F.col(f"{m}.p")), *row_key(id_col, text_col)))
    return out.filter(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*names)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, fit_classifier(docs, table(spark, sf_dir, "labels")), TARGETS)
