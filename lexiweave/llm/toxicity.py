"""Toxicity by a linear-chain conditional random field over the tokens of a line.

Labels are of documents, so tokens get theirs from features (whole words and word beginnings) that occur in toxic
labelled documents and hardly in others: such a token in a toxic document is tagged 1 as far as its feature is
believed (by its likelihood ratio, against one telling feature among all tried), all others 0. The field
learns a weight for each such feature of a token, for the words and telling features of its neighbours, a bias and the four
transitions from segments of labelled documents. In a text, forward-backward runs over each line that holds a telling feature; the
other lines hold only background tokens, whose marginals are taken as 0 (the bias makes them so small that a long clean text's would
add up to nothing but its length). The marginals' sum over the text gives its score through a fitted logistic curve; tokens with a
marginal of a half or more are its offending spans.

Training reads at most `max_toxic` and `max_clean` labelled rows, the first by a hash of their id, and of these `max_segments` segments.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_function, checkpoint, table

TOKEN = re.compile(r"[^\W_]+")
BEGINNINGS = (4, 5, 6)
SEGMENT = 32
THRESHOLD = 0.3
HELD_OUT = 2
#: Beside features that pass, those whose likelihood ratio (a logarithm) falls short by this at most are believed a little.
NEARLY = 2.0


def token_features(word: str) -> list[str]:
    """The word itself, then its beginnings, marked by a trailing star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def neighbours(words: list[str], own: list[list[str]], i: int) -> list[str]:
    """Features of token i from the tokens beside it: their words and their telling features (own)."""
    out = []
    if i:
        out += ["<" + words[i - 1], *("<<" + f for f in own[i - 1])]
    if i + 1 < len(words):
        out += [">" + words[i + 1], *(">>" + f for f in own[i + 1])]
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    transition: tuple = (0.0, 0.0, 0.0, 0.0)  # 00, 01, 10, 11
    context: dict[str, float] = field(default_factory=dict)  # of neighbours: words and telling features, marked < and >
    slope: float = 1.0
    offset: float = -20.0

    def __post_init__(self) -> None:
        self._find = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_find": None}

    def active_lines(self, text: str) -> list[tuple[int, int]]:
        """Spans of the lines in which some token starts with an active feature's letters."""
        if self._find is None:
            import ahocorasick

            self._find = ahocorasick.Automaton()
            for f in self.weights:
                self._find.add_word(f.rstrip("*"), len(f.rstrip("*")))
            self._find.make_automaton()
        lines, end = [], -1
        for at, n in self._find.iter(text):
            s = at - n + 1
            if s > end and (s == 0 or not text[s - 1].isalnum()):
                start = text.rfind("\n", 0, s) + 1
                end = text.find("\n", s)
                end = len(text) if end < 0 else end
                lines.append((start, end))
        return lines

    def marginals(self, unary: list[float]) -> list[float]:
        """P(tag 1) of each token of a chain, from its scores of tag 1 over tag 0: forward-backward on scaled odds."""
        t00, t01, t10, t11 = (math.exp(v) for v in self.transition)
        u = [math.exp(max(-50.0, min(50.0, v))) for v in unary]
        ahead, f = [], None
        for x in u:  # f: odds of tag 1 from the left, this token's own score in
            f = x if f is None else x * (t01 + f * t11) / (t00 + f * t10)
            ahead.append(f)
        out, b = [], 1.0
        for i in range(len(u) - 1, -1, -1):  # b: odds of tag 1 from the right
            odds = ahead[i] * b
            out.append(odds / (1 + odds))
            v = u[i] * b
            b = (t10 + v * t11) / (t00 + v * t01)
        out.reverse()
        return out

    def tag(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Sum of the marginals; (start, end, marginal) of the offending tokens, in code points."""
        if not self.weights:
            return 0.0, []
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer: keep offsets by lowering letter by letter
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        total, spans = 0.0, []
        for start, end in self.active_lines(low):
            tokens = [(m.start(), m.end()) for m in TOKEN.finditer(low, start, end)]
            words = [low[s:e] for s, e in tokens]
            own = [[f for f in token_features(w) if f in self.weights] for w in words]
            if any(own):
                weigh = lambda i: sum(map(self.weights.__getitem__, own[i])) + sum(self.context.get(f, 0.0) for f in neighbours(words, own, i))
                unary = [self.bias + weigh(i) for i in range(len(words))]
                p = self.marginals(unary)
                total += sum(p)
                spans += [(*at, q) for at, q in zip(tokens, p) if q >= 0.5]
        return total, spans

    def score(self, total: float) -> float:
        z = self.slope * math.log(total + 1e-6) + self.offset
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def chain_marginals(unary: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded chains: P(tag 1) of each token, expected transition counts, log normalisers."""
    n, width = unary.shape
    t = transition.reshape(2, 2)
    f = np.zeros((width, n, 2))
    f[0, :, 1] = unary[:, 0]
    for i in range(1, width):
        m = f[i - 1][:, :, None] + t
        f[i] = np.logaddexp(m[:, 0], m[:, 1])
        f[i, :, 1] += unary[:, i]
    b = np.zeros((width, n, 2))
    for i in range(width - 2, -1, -1):
        u = np.stack([np.zeros(n), unary[:, i + 1]], 1) + b[i + 1]
        m = t + u[:, None, :]
        b[i] = np.where((i + 1 < lengths)[:, None], np.logaddexp(m[:, :, 0], m[:, :, 1]), 0.0)
    z = np.logaddexp(*f[lengths - 1, np.arange(n)].T)
    p = np.exp(f[:, :, 1] + b[:, :, 1] - z).T
    p[np.arange(width) >= lengths[:, None]] = 0
    moves = np.zeros(4)
    for i in range(width - 1):
        on = i + 1 < lengths
        u = np.stack([np.zeros(n), unary[:, i + 1]], 1) + b[i + 1]
        moves += np.exp(f[i][:, :, None] + t + u[:, None, :] - z[:, None, None])[on].sum(axis=0).ravel()
    return p, moves, z


def fit_chains(segments: list[tuple[int, list[int], list[int], list[int], list[float]]], n_features: int, steps: int = 200, decay: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transitions of greatest likelihood (Adam). A segment: length, positions and ids of features, tagged positions and how far each is believed."""
    n, lengths = len(segments), np.array([s[0] for s in segments])
    width = int(lengths.max())
    row = np.repeat(np.arange(n), [len(s[1]) for s in segments])
    col, ids = (np.array([x for s in segments for x in s[k]], np.int64) for k in (1, 2))
    gold = np.zeros((n, width))
    for i, s in enumerate(segments):
        gold[i, s[3]] = s[4]
    inside = np.arange(width) < lengths[:, None]
    both = inside[:, 1:]
    tag = (1 - gold, gold)
    want = np.array([(tag[x][:, :-1] * tag[y][:, 1:] * both).sum() for x in (0, 1) for y in (0, 1)])
    theta = np.zeros(n_features + 5)
    theta[n_features] = -4.0
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        unary = np.full((n, width), theta[n_features])
        unary += np.bincount(row * width + col, theta[ids], n * width).reshape(n, width)
        p, moves, _ = chain_marginals(unary, lengths, theta[n_features + 1 :])
        d = (gold - p) * inside
        grad = np.concatenate([np.bincount(ids, d[row, col], n_features), [d.sum()], want - moves]) / n - decay * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta += 0.2 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return theta[:n_features], float(theta[n_features]), theta[n_features + 1 :]


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, decay: float = 0.02) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve by damped Newton steps, slope held back a little."""
    c = float(np.average(x, weights=w))
    a, b = np.column_stack([x - c, np.ones_like(x)]), np.zeros(2)
    ridge = np.diag([decay, 1e-6]) * len(x) / 100
    loss = lambda b: float(w @ (np.logaddexp(0, a @ b) - y * (a @ b)) + b @ ridge @ b / 2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -500, 500)))
        slope = a.T @ (w * (y - p)) - ridge @ b
        move = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge, slope)
        size = 1.0
        while loss(b + size * move) > loss(b) - 1e-4 * size * (slope @ move) and size > 1e-9:  # halved until the loss falls as it should
            size /= 2
        b = b + size * move
        if abs(size * move).max() < 1e-7:
            break
    return float(b[0]), float(b[1] - b[0] * c)


def _batches(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _count(known: frozenset):
    """Documents that hold each feature, those that hold a known one left out; one row a feature and task, "" counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["f", "n"])
            seen.clear()

        for batch in batches:
            for text in batch.column(0):
                found = {f for w in set(TOKEN.findall(text.as_py().lower())) for f in token_features(w)}
                if known.isdisjoint(found):
                    seen.update(found)
                    seen[""] += 1
                if len(seen) > 100_000:  # the counts are added up after the shuffle, so a part may go out early
                    yield from flush()
        yield from flush()

    return run


def _seeds(picked: DataFrame, max_features: int, rounds: int = 8) -> dict[str, float]:
    """Features whose documents are toxic beyond chance, and how far each is believed: 1 where its likelihood ratio over
    the base rate passes the log of the number of features tried, so that few labelled rows give weaker features, not none.
    While any pass, only those are taken, and then the best of the rest if they come near, or if there are no others. A round takes those within a quarter of the best; the next looks only at toxic documents that
    hold none of them, so words that merely stand beside a telling one (in near copies, say) explain nothing more."""
    count = lambda toxic, known, name: picked.filter(F.col("toxic") == toxic).select("text").mapInArrow(_count(frozenset(known)), "f string, n long").groupBy("f").agg(F.sum("n").alias(name))
    clean = checkpoint(count(0, (), "c"))
    c_all = clean.filter("f = ''").first()["c"]
    seeds: dict[str, float] = {}
    for _ in range(rounds):
        seen = checkpoint(count(1, seeds, "t").join(clean, "f", "left").fillna(0, ["c"]))
        total = seen.filter("f = ''").first()
        if total is None:
            break
        t_all, tried = total["t"], seen.count()
        q, n = t_all / (t_all + c_all), F.col("t") + F.col("c")
        ratio = F.col("t") * F.log(F.col("t") / (n * q)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - q)))).otherwise(0)
        precise = F.col("t") / t_all / (F.col("t") / t_all + F.col("c") / c_all)
        held = seen.filter((F.col("f") != "") & (F.col("t") >= min(2, t_all))).withColumn("g", ratio)
        good = held.filter((precise >= 0.985) | (F.col("c") <= 1) & (precise >= 0.9))
        enough = math.log(tried)
        best, strict = good.agg(F.max("g"), F.max(F.when((F.col("t") >= 3) & (F.col("g") >= enough), F.col("g")))).first()
        if strict is not None:
            good = good.filter((F.col("t") >= 3) & (F.col("g") >= max(enough, 0.25 * strict)))
        elif best is not None and (best >= enough - NEARLY or not seeds):
            good = good.filter(F.col("g") >= 0.9 * best)
        elif not seeds:  # no feature is even nearly toxic alone: the most telling ones there are
            good = seen.filter((F.col("f") != "") & (F.col("t") > 0)).withColumn("g", ratio).orderBy(F.desc(precise), F.desc("g"), "f").limit(20)
        else:
            break
        for r in good.orderBy(F.desc("g"), "f").limit(max_features // rounds).select("f", "g").collect():
            seeds[r["f"]] = 1.0 if strict is not None else 1 / (1 + math.exp(min(500.0, max(0.0, enough - r["g"]))))
    return seeds


@arrow_function("array<bigint>")
def _sketch(texts: pa.Array) -> pa.Array:
    """Four min-hashes of a text's five-word shingles."""
    import xxhash

    out = []
    for text in texts:
        w = text.as_py().encode().split()
        grams = [b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
        h = np.array([xxhash.xxh64_intdigest(g) for g in grams], np.uint64)
        out.append([int((h * np.uint64(k)).min() >> np.uint64(1)) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)])
    return pa.array(out, pa.list_(pa.int64()))


def _segments(belief: dict[str, float], background: int):
    """Segments with a telling feature, and one in `background` of the others, by hash: words, tagged places and how far each is believed."""
    schema = pa.schema([("words", pa.list_(pa.string())), ("tags", pa.list_(pa.int32())), ("told", pa.list_(pa.float64())), ("hit", pa.bool_()), ("r", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for text, toxic in zip((x.as_py() for x in batch.column(0)), batch.column(1).to_pylist()):
                for no, line in enumerate(text.lower().split("\n")):
                    words = TOKEN.findall(line)
                    for i in range(0, len(words), SEGMENT):
                        part = words[i : i + SEGMENT]
                        known = [max((belief.get(f, 0.0) for f in token_features(w)), default=0.0) for w in part]
                        tags = [k for k, v in enumerate(known) if v and toxic]
                        r = xxhash.xxh64_intdigest(f"{no} {i} {' '.join(part)}") >> 1
                        if any(known) or r % background == 0:
                            rows.append({"words": part, "tags": tags, "told": [known[k] for k in tags], "hit": any(known), "r": r})
            yield _batches(rows, schema)

    return run


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == HELD_OUT


def fit_field(segments: list[tuple[list[str], list[int], list[float]]], telling: list[str], max_context: int) -> Model:
    """The field of segments (words, tagged places, how far each is believed). Context features are those seen in five segments or more."""
    own = [[[f for f in token_features(w) if f in known] for w in words] for known in (set(telling),) for words, _, _ in segments]
    beside = [[neighbours(words, o, i) for i in range(len(words))] for (words, _, _), o in zip(segments, own)]
    seen = Counter(f for near in beside for f in {f for at in near for f in at})
    context = sorted((f for f, n in seen.items() if n >= 5), key=lambda f: (-seen[f], f))[:max_context]
    ids = {f: i for i, f in enumerate([*telling, *context])}
    rows = []
    for (words, tags, told), o, near in zip(segments, own, beside):
        hits = [(k, ids[f]) for k in range(len(words)) for f in (*o[k], *near[k]) if f in ids]
        rows.append((len(words), [k for k, _ in hits], [f for _, f in hits], tags, told))
    weights, bias, moves = fit_chains(rows, len(ids))
    at = {f: float(weights[i]) for f, i in ids.items()}
    return Model({f: at[f] for f in telling}, bias, tuple(float(v) for v in moves), {f: at[f] for f in context})


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 4000, max_clean: int = 6000, max_segments: int = 6000, max_features: int = 20_000, max_context: int = 4000, background: int = 16, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled rows that are not held out. Without toxic ones (or clean ones) it scores every text near 0.

    Bounds of training: labelled rows by label, segments (two thirds with a telling feature at most; of the others one in `background`),
    telling features, and features of neighbours. Nulls and empty texts teach nothing; of near copies with one label the least by
    hash and id stays, so that the model does not hang on the order of rows.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("id"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return Model()
    of = lambda label, n: known.filter(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(n)
    sample = of(1, max_toxic).union(of(0, max_clean)).dropDuplicates(["id"])
    # At most max_toxic + max_clean ids, so they can be sent to every task.
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter("text is not null")
    picked = texts.join(F.broadcast(sample), F.col("doc") == F.col("id")).select("id", "text", "toxic", F.xxhash64("text").alias("x"))
    picked = checkpoint(picked.withColumn("h", _sketch("text")))
    for i in range(4):  # copies and most near copies of a sampled text say nothing new
        first = F.row_number().over(Window.partitionBy("toxic", F.get("h", F.lit(i))).orderBy("x", "id"))
        picked = picked.withColumn("first", first).filter("first = 1").drop("first")
    picked = checkpoint(picked.select("text", "toxic"))
    size = {r[0]: r[1] for r in picked.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return Model()
    belief = _seeds(picked, max_features)
    if not belief:
        return Model()
    cut = picked.mapInArrow(_segments(belief, background), "words array<string>, tags array<int>, told array<double>, hit boolean, r long")
    part = lambda hit, n: cut.filter(hit).orderBy("r", F.size("tags"), F.concat_ws(" ", "words")).limit(n).collect()
    rows = part(F.col("hit"), max_segments * 2 // 3) + part(~F.col("hit"), max_segments // 3)
    model = fit_field([(r["words"], r["tags"], r["told"]) for r in rows], sorted(belief), max_context)
    raw = picked.select(_tag(model)("text")["total"].alias("x"), "toxic").toPandas().sort_values(["toxic", "x"])  # two numbers for each of the sample's rows
    y = raw["toxic"].to_numpy(float)
    w = np.where(y == 1, counts[1] / n1, counts[0] / n0)
    model.slope, model.offset = fit_logistic(np.log(raw["x"].to_numpy() + 1e-6), y, w / w.mean())
    return model


def _tag(model: Model):
    @F.arrow_udf("struct<total:double,score:double,spans:array<struct<start:int,end:int,p:double>>>")
    def tag(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            total, spans = model.tag(text.as_py() or "")
            out.append({"total": total, "score": model.score(total), "spans": [{"start": s, "end": e, "p": p} for s, e, p in spans]})
        return pa.array(out, pa.struct([("total", pa.float64()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))]))

    return tag


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, spans.

    A null or empty text has no tokens and the lowest score; repeated rows come out once each; a null doc_id is not
    held out; an empty table gives no rows. Only the text is an input of a score.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), _tag(model)(F.col(text_col)).alias("t"))
    return rows.select("doc_id", "held_out", F.col("t.score").alias("score"), (F.col("t.score") >= THRESHOLD).cast("int").alias("predicted"), F.col("t.spans").alias("spans"))


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores under the threshold, with all their columns; null and empty texts stay, repeated rows
    stay or go alike, an empty table gives no rows."""
    return docs.filter(_tag(model)(F.col(text_col))["score"] < THRESHOLD)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
