"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's logit is a bias plus the sum of
the weights of its hashed words; a document is toxic if any sentence is, so the
sentence probabilities are combined by noisy-or, 1 - prod(1 - p). The weights
are trained from document labels alone (gradients of the document's likelihood
reach each sentence in proportion to its share of the blame). Sentences whose
own probability reaches the threshold are then reported with their place.

At most ``max_train`` labelled documents (lowest hashes) are collected, as word
buckets; buckets met in fewer than ``min_df`` of them, or as often in toxic documents as
chance explains (below ``least_z`` standard deviations), get no weight, so that
rare words of a toxic document are not learnt by heart; equal texts count once. Every document is scored where it is read, without a shuffle.

Null text counts as empty; a text without words has no sentence and scores 0.
Without usable labels of both classes every score is 0 for texts without words
and the smoothed share of toxic labels else. Repeated rows are scored alike; columns
``held_out``, ``score``, ``predicted`` and ``offending`` are replaced.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, extended, lean, release
from .quality import Buckets, training_ids

BUCKETS = 1 << 18
#: Words, and the ends of sentences; both over lower-cased UTF-8.
PART = re.compile(rb"[0-9a-z\x80-\xff]+|[.!?\n]")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
CHUNK = 400_000


class Parts(Buckets):
    """As Buckets; the ends of sentences get the bucket after the last."""

    def compute(self, token: bytes) -> int:
        return self.buckets if token in (b".", b"!", b"?", b"\n") else super().compute(token)


def parts(text: str | None, lookup: Parts) -> np.ndarray:
    found = PART.findall(text.encode("utf-8", "replace").lower()) if text else []
    return np.fromiter(map(lookup.__getitem__, found), np.int32, len(found))


def bags(texts, lookup: Parts):
    """(words, sentence of each word, document of each sentence, documents) of runs of documents."""
    held, n = [], 0
    for text in texts:
        held.append(parts(text, lookup))
        n += len(held[-1])
        if n >= CHUNK:
            yield bag(held, lookup.buckets)
            held, n = [], 0
    if held:
        yield bag(held, lookup.buckets)


def bag(held, buckets: int):
    stop = np.array([buckets], np.int32)
    ids = np.concatenate([x for a in held for x in (a, stop)])
    doc = np.repeat(np.arange(len(held)), [len(a) + 1 for a in held])
    word = ids < buckets
    run = np.cumsum(~word)
    _, first, sentence = np.unique(run[word], return_index=True, return_inverse=True)
    return ids[word], sentence, doc[word][first], len(held)


class NoisyOr:
    """Sentence weights and bias, fitted to document labels by Adam."""

    def __init__(self, buckets: int = BUCKETS, epochs: int = 60, min_df: int = 4, least_z: float = 4.5, decay: float = 1e-6, seed: int = 3):
        self.buckets, self.epochs, self.min_df, self.least_z, self.decay, self.seed = buckets, epochs, min_df, least_z, decay, seed
        self.weights, self.bias, self.base = np.zeros(buckets, np.float32), 0.0, 0.5

    def fit(self, docs: list[np.ndarray], y: np.ndarray) -> NoisyOr:
        """docs: word buckets, the ends of sentences as ``buckets``."""
        self.base = (y.sum() + 0.5) / (len(y) + 1.0)
        if not len(y) or y.min() == y.max():
            self.fitted = False
            return self
        self.fitted = True
        df, toxic = np.zeros(self.buckets + 1), np.zeros(self.buckets + 1)
        for d, label in zip(docs, y, strict=True):
            met = np.unique(d)
            df[met] += 1
            toxic[met] += label
        share = y.mean()
        z = (toxic - df * share) / np.sqrt(df * share * (1 - share) + 0.5)
        keep = (df >= self.min_df)[: self.buckets] & (np.abs(z) >= self.least_z)[: self.buckets]
        place = np.full(self.buckets + 1, -1, np.int64)
        place[: self.buckets][keep] = np.arange(keep.sum())
        # Only words that get a weight are held, and how many sentences there are.
        held, sentences, counts, n = [], [], [], len(docs)
        for d in docs:
            word = d < self.buckets
            _, local = np.unique(np.cumsum(~word)[word], return_inverse=True)
            used = keep[d[word]]
            held.append(place[d[word][used]])
            sentences.append(local[used] + sum(counts[-1:]))
            counts.append(sum(counts[-1:]) + (int(local.max()) + 1 if len(local) else 0))
        words, sentence = np.concatenate(held), np.concatenate(sentences)
        owner = np.repeat(np.arange(n), np.diff([0, *counts]))
        first = np.cumsum([0, *map(len, held)])  # words of each document
        rng = np.random.default_rng(self.seed)
        w, b = np.zeros(int(keep.sum())), -6.0
        m, v, mb, vb, step = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
        cuts = np.array([0, *counts])  # sentences of each document
        rate = 0.1
        for epoch in range(self.epochs):
            rate = 0.1 if epoch < self.epochs // 2 else 0.03
            for at in np.array_split(rng.permutation(n), max(1, n // 512)):
                at = np.sort(at)
                own = np.concatenate([np.arange(first[i], first[i + 1]) for i in at])
                sents = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in at])
                if not len(sents):
                    continue
                local = np.searchsorted(sents, sentence[own])
                doc = np.searchsorted(at, owner[sents])
                z = b + np.bincount(local, w[words[own]], len(sents))
                p, keep_log = 1 / (1 + np.exp(-np.clip(z, -30, 30))), -np.logaddexp(0, z)
                none = np.minimum(np.bincount(doc, keep_log, len(at)), -1e-9)
                blame = np.where(y[at] == 1, -np.exp(none) / -np.expm1(none), 1.0)
                g = p * blame[doc] / len(at)
                grad, gb = np.bincount(words[own], g[local], len(w)) + self.decay * w, g.sum()
                step += 1
                m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
                mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
                c1, c2 = 1 - 0.9**step, 1 - 0.999**step
                w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-7)
                b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-7)
        self.weights[keep], self.bias = w, float(b)
        return self

    def logits(self, words: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        return self.bias + np.bincount(sentence, self.weights[words], n)

    def score(self, texts) -> np.ndarray:
        """The probability of each text."""
        lookup, out = Parts(self.buckets), []
        for words, sentence, owner, n in bags(texts, lookup):
            if not self.fitted:
                out.append(np.where(np.bincount(owner, minlength=n) > 0, self.base, 0.0))
                continue
            z = self.logits(words, sentence, len(owner))
            out.append(-np.expm1(-np.bincount(owner, np.logaddexp(0, z), n)))
        return np.concatenate(out) if out else np.zeros(0)

    def offending(self, text: str, threshold: float) -> list[dict]:
        """Sentences of a text whose own probability reaches the threshold; code points, end exclusive."""
        found, lookup = [], Parts(self.buckets)
        for m in SENTENCE.finditer(text):
            ids = parts(m[0], lookup)
            ids = ids[ids < self.buckets]
            if len(ids) and self.fitted and (p := float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[ids].sum(), -40, 40))))) >= threshold:
                found.append({"start": m.start(), "end": m.end(), "p": p})
        return found


def train(docs: DataFrame, labels: DataFrame, usable, label: str = "toxic", max_train: int = 20_000, text: str = "text") -> NoisyOr:
    """Fit on at most ``max_train`` labelled documents; only word buckets reach the driver."""
    # Bounded by max_train, so it may be broadcast: texts stay where they are.
    chosen = F.broadcast(training_ids(labels, label, usable, max_train))

    def buckets(batches):
        lookup = Parts(BUCKETS)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array([zlib.crc32((t or "").encode("utf-8", "replace")) for t in texts], pa.int64()), pa.array([parts(t, lookup).tobytes() for t in texts], pa.binary())], ["y", "h", "x"])

    got = docs.select("doc_id", F.col(text).cast("string").alias("_text")).join(chosen, "doc_id").select("_label", "_text").mapInArrow(lean(buckets), "y int, h long, x binary").toArrow()
    rows = sorted({(h, x): y for y, h, x in zip(*(got.column(c).to_pylist() for c in "yhx"), strict=True)}.items())
    del got
    model = NoisyOr().fit([np.frombuffer(x, np.int32) for (_, x), _ in rows], np.array([y for _, y in rows], np.int32))
    del rows
    release()  # the driver gives back what the training took
    return model


OFFENDING = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))


def score(docs: DataFrame, model: NoisyOr, held_out=None, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """``docs`` with held_out, score, predicted and the offending sentences of predicted documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted", "offending")]
    source = docs.select(F.col(text).cast("string").alias("_scored_text"), (F.lit(False) if held_out is None else held_out).alias("held_out"), *(F.col(c) for c in keep))
    schema = extended(docs, T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("offending", OFFENDING))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            p = shared.value.score(texts)
            where = [shared.value.offending(t, threshold) if q >= threshold else [] for t, q in zip(texts, p, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32)), pa.array(where, kind)], [*keep, "held_out", "score", "predicted", "offending"])

    return source.mapInArrow(lean(run), schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, and where its offending sentences are."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.select("doc_id", "text")
    model = train(docs, labels, crc_mod("doc_id", 3) != 1)
    return score(docs, model, crc_mod("doc_id", 3) == 1).select("doc_id", "held_out", "score", "predicted", F.to_json("offending").alias("offending"))
