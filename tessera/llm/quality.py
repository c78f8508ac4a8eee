"""Quality classifier: random-indexing word vectors, pooled per document, feed a
two-layer network whose probabilities are calibrated by a temperature.

1. Corpus pass (all documents): tokens are hashed into ``buckets`` rows, so the
   table has a fixed size whatever the vocabulary. Each bucket owns a sparse
   ternary index vector; its context vector is the sum of the index vectors of
   its neighbours within ``window`` tokens. Tasks emit one integer row per
   bucket they met, summed by an ordinary aggregation (exact, in any order).
2. A document's vector is the frequency-damped mean of its tokens' vectors, and
   their spread. ``max_train`` labelled documents (lowest hashes) are pooled and
   collected; the network and the temperature are fitted on the driver.
3. Every document is scored where it is read. Texts are never shuffled.

Null text counts as empty; an empty text has the zero vector and gets the score
of that vector. Without any usable label, or with labels of one class only, the
score is the (smoothed) share of label 1. Repeated rows are scored alike;
columns ``held_out``, ``score`` and ``predicted`` of the input are replaced.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Remembered, crc_mod, extended, lean

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 48, 4, 2
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
CHUNK = 400_000


class Buckets(Remembered):
    """Token to bucket."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def compute(self, token: bytes) -> int:
        return zlib.crc32(token) % self.buckets


def index_vectors(buckets: int = BUCKETS, dim: int = DIM, nonzero: int = NONZERO):
    """Positions and signs of each bucket's index vector, from a fixed seed."""
    rng = np.random.default_rng(20_011)
    return rng.integers(0, dim, (buckets, nonzero)), rng.choice(np.array([-1, 1]), (buckets, nonzero))


def chunks(texts, lookup: Buckets, gap: int):
    """(ids, lengths) of runs of whole documents, ``gap`` separators after each."""
    ids, lengths, n = [], [], 0
    for text in texts:
        tokens = TOKEN.findall(text.encode("utf-8", "replace")) if text else []
        ids.append(np.fromiter(map(lookup.__getitem__, tokens), np.int32, len(tokens)))
        lengths.append(len(tokens))
        n += len(tokens)
        if n >= CHUNK:
            yield joined(ids, lookup.buckets, gap), np.array(lengths)
            ids, lengths, n = [], [], 0
    if ids:
        yield joined(ids, lookup.buckets, gap), np.array(lengths)


def joined(ids, separator: int, gap: int):
    if not gap:
        return np.concatenate(ids)
    stop = np.full(gap, separator, np.int32)
    return np.concatenate([x for a in ids for x in (a, stop)])


def context_sums(texts, total: np.ndarray, counts: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add the neighbours' index vectors of every token of ``texts`` to ``total``."""
    buckets, dim = total.shape
    lookup = Buckets(buckets)
    for ids, _ in chunks(texts, lookup, WINDOW):
        counts += np.bincount(ids, minlength=buckets + 1)[:buckets]
        for step in range(1, WINDOW + 1):
            for one, other in ((ids[:-step], ids[step:]), (ids[step:], ids[:-step])):
                real = (one < buckets) & (other < buckets)
                a, b = one[real].astype(np.int64) * dim, other[real]
                for k in range(places.shape[1]):
                    total += np.bincount(a + places[b, k], signs[b, k], buckets * dim).reshape(buckets, dim).astype(np.int64)


def corpus_vectors(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, dim: int = DIM):
    """Context vectors (buckets x dim) and token counts over all documents."""
    columns = [f"v{i}" for i in range(dim)]

    def partial(batches):
        places, signs = index_vectors(buckets, dim)
        total, counts = np.zeros((buckets, dim), np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            context_sums(batch.column(0).to_pylist(), total, counts, places, signs)
        met = np.flatnonzero(counts)
        for at in range(0, len(met), 4096):
            own = met[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own]), *(pa.array(np.ascontiguousarray(total[own, i])) for i in range(dim))], ["bucket", "n", *columns])

    schema = ", ".join(f"{c} long" for c in ["bucket", "n", *columns])
    sums = docs.select(F.col(text).cast("string")).mapInArrow(lean(partial), schema).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ["n", *columns])).toArrow()
    vectors, counts = np.zeros((buckets, dim), np.float64), np.zeros(buckets, np.float64)
    at = sums.column("bucket").to_numpy()
    counts[at] = sums.column("n").to_numpy()
    for i, c in enumerate(columns):
        vectors[at, i] = sums.column(c).to_numpy()
    return vectors, counts


def damped(vectors: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Unit vectors, scaled down for frequent tokens; row ``buckets`` is zero."""
    share = counts / max(1.0, counts.sum())
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return np.vstack([unit * (1e-2 / (1e-2 + share))[:, None], np.zeros((1, vectors.shape[1]))]).astype(np.float32)


def pooled(texts, table: np.ndarray) -> np.ndarray:
    """Mean and spread of the token vectors of each text."""
    lookup, out, dim = Buckets(len(table) - 1), [], table.shape[1]
    for ids, lengths in chunks(texts, lookup, 1):
        ends = np.cumsum(lengths + 1)
        starts = ends - lengths - 1
        mean, square = np.zeros((len(lengths), dim), np.float32), np.zeros((len(lengths), dim), np.float32)
        # At most some 50,000 tokens are expanded at once, however long a text is.
        for at in range(0, len(ids), 50_000):
            part = table[ids[at : at + 50_000]]
            first, last = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + len(part), "left")
            cuts = np.maximum(starts[first:last] - at, 0)
            mean[first:last] += np.add.reduceat(part, cuts, axis=0)
            square[first:last] += np.add.reduceat(part * part, cuts, axis=0)
        n = np.maximum(lengths, 1)[:, None]
        mean /= n
        out.append(np.hstack([mean, np.sqrt(np.maximum(square / n - mean * mean, 0))]))
    return np.vstack(out).astype(np.float32) if out else np.zeros((0, 2 * dim), np.float32)


class Network:
    """Standardised input, one tanh layer, a logit, and a temperature."""

    def __init__(self, hidden: int = 24, epochs: int = 60, seed: int = 5, decay: float = 1e-4):
        self.hidden, self.epochs, self.seed, self.decay = hidden, epochs, seed, decay
        self.base, self.weights, self.temperature = 0.5, None, 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        self.base = (y.sum() + 0.5) / (len(y) + 1.0)
        if len(y) < 4 or y.min() == y.max():
            return self
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(y))
        held, used = order[: len(y) // 5], order[len(y) // 5 :]
        if len(np.unique(y[held])) < 2 or len(np.unique(y[used])) < 2:
            held = used = order
        self.mean, self.scale = x[used].mean(0), x[used].std(0) + 1e-6
        z, t = (x - self.mean) / self.scale, y.astype(np.float64)
        d = x.shape[1]
        w = [rng.normal(0, d**-0.5, (d, self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.array(np.log(self.base / (1 - self.base)))]
        m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(self.epochs):
            for at in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
                h = np.tanh(z[at] @ w[0] + w[1])
                g = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - t[at]) / len(at)
                back = np.outer(g, w[2]) * (1 - h * h)
                step += 1
                for i, grad in enumerate((z[at].T @ back + self.decay * w[0], back.sum(0), h.T @ g + self.decay * w[2], g.sum())):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad * grad
                    w[i] = w[i] - 0.004 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.weights = w
        logit, truth = self.logit(x[held]), y[held]
        loss = lambda k: np.logaddexp(0, -logit / k * (2 * truth - 1)).mean()
        self.temperature = min(np.geomspace(0.25, 8, 60), key=loss)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.weights[0] + self.weights[1])
        return h @ self.weights[2] + self.weights[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def training_ids(labels: DataFrame, label: str, usable, max_train: int) -> DataFrame:
    """At most ``max_train`` labelled ids (lowest hashes); one label an id, the least."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & usable)
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", usable=None, held_out=None, threshold: float = 0.3, max_train: int = 12_000, text: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (of label 1) and ``predicted``.

    ``usable`` selects the rows of ``labels`` that may be learnt from;
    ``held_out`` is an expression over ``docs``. ``max_train`` bounds the
    labelled documents the network sees; corpus vectors use all documents.
    """
    spark = docs.sparkSession
    vectors = damped(*corpus_vectors(docs, text))
    shared = spark.sparkContext.broadcast(vectors)
    # Bounded by max_train, so it may be broadcast: texts stay where they are.
    chosen = training_ids(labels, label, F.lit(True) if usable is None else usable, max_train)
    train = docs.select("doc_id", F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), "doc_id").select("_label", "_text")

    def features(batches):
        for batch in batches:
            x = pooled(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array([row.tobytes() for row in x], pa.binary())], ["y", "x"])

    got = train.mapInArrow(lean(features), "y int, x binary").toArrow()
    y = got.column("y").to_numpy()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(len(y), 2 * vectors.shape[1])
    order = np.lexsort((*x.T[:4], y))  # the same model, however the rows arrive
    model = spark.sparkContext.broadcast(Network().fit(x[order], y[order]))
    keep = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    source = docs.select(F.col(text).cast("string").alias("_scored_text"), (F.lit(False) if held_out is None else held_out).alias("held_out"), *(F.col(c) for c in keep))
    schema = extended(docs, T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()))

    def score(batches):
        for batch in batches:
            p = model.value.score(pooled(batch.column(0).to_pylist(), shared.value)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*keep, "held_out", "score", "predicted"])

    return source.mapInArrow(lean(score), schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs.select("doc_id", "text"), labels, "quality", crc_mod("doc_id", 5) != 0, crc_mod("doc_id", 5) == 0).select("doc_id", "held_out", "score", "predicted")
