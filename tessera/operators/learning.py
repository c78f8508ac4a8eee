"""Models over stored vectors, trained by sums that tasks send: a linear head, a kernel machine, principal components.

Rows stay where they lie. A step sends the model to the tasks (its size is that of
labels x dimensions) and gets back sums over the rows of each, added up by place;
nothing that grows with the rows comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settled


def matrix(column: pa.ListArray) -> np.ndarray:
    """A batch of vectors of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def summed(rows: DataFrame, sums: Callable, size: int) -> np.ndarray:
    """The sum over all rows of what ``sums(batch)`` gives, an array of ``size`` numbers; each task sends one, and they are added by place."""

    def own(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += sums(batch)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["place", "value"])

    got = rows.mapInArrow(own, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[got.column("place").to_numpy()] = got.column("value").to_numpy()
    return out


class Moments(NamedTuple):
    n: int
    mean: np.ndarray
    second: np.ndarray

    def covariance(self) -> np.ndarray:
        return self.second - np.outer(self.mean, self.mean)


def moments(df: DataFrame, vector: str) -> Moments:
    """Rows, means, and mean products of each two dimensions; null and empty vectors count for nothing."""
    rows = df.select(F.col(vector).cast("array<double>").alias("x")).where(F.size("x") > 0)
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return Moments(0, np.zeros(0), np.zeros((0, 0)))
    d = first["d"]

    def sums(batch):
        x = matrix(batch.column(0))
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    total = summed(rows, sums, 1 + d + d * d)
    return Moments(int(total[0]), total[1 : d + 1] / total[0], total[d + 1 :].reshape(d, d) / total[0])


class Components(NamedTuple):
    """Axes of largest variance, a row each, the first largest; the largest entry of each is positive."""

    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray


def principal_components(df: DataFrame, vector: str, k: int = 2) -> Components:
    """A linear projection to ``k`` dimensions, in the place of a neighbour embedding: other coordinates, the same use."""
    m = moments(df, vector)
    if not m.n:
        raise ValueError("no vectors")
    values, axes = np.linalg.eigh(m.covariance())
    axes = axes[:, ::-1].T[:k]
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return Components(m.mean, axes * signs[:, None], values[::-1][:k])


def with_vectors(df: DataFrame, vector: str, new: list[T.StructField], compute: Callable) -> DataFrame:
    """``df`` with the columns that ``compute(vectors)`` gives; null and empty vectors give nulls."""
    taken = {f.name for f in new}
    others = [c for c in df.columns if c not in taken]
    schema = T.StructType([*(df.schema[c] for c in others), *new])

    def run(batches):
        for batch in batches:
            column = batch.column(len(others))
            there = pa.compute.fill_null(pa.compute.greater(pa.compute.list_value_length(column), 0), False)
            found = compute(matrix(column.filter(there))) if there.true_count else [np.zeros(0)] * len(new)
            at = np.flatnonzero(there.to_numpy(zero_copy_only=False))
            place = np.zeros(batch.num_rows, np.int64)
            place[at] = np.arange(len(at))
            take = pa.array(place, mask=~there.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(v).take(take) for v in found)], schema.names)

    return df.select(*others, F.col(vector).cast("array<double>").alias("_vector")).mapInArrow(run, schema)


def projected(df: DataFrame, vector: str, components: Components, names: list[str]) -> DataFrame:
    """``df`` with a column for each component."""
    new = [T.StructField(n, T.DoubleType()) for n in names]
    return with_vectors(df, vector, new, lambda x: list(((x - components.mean) @ components.axes.T).T))


@dataclass
class Features:
    """What a classifier sees of a vector: scaled dimensions, or cosines of random directions of them (a kernel's map)."""

    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    directions: np.ndarray | None = None
    phases: np.ndarray | None = None

    def of(self, x: np.ndarray) -> np.ndarray:
        if self.mean is not None:
            x = (x - self.mean) / self.scale
        if self.directions is not None:
            x = math.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return x

    def size(self, d: int) -> int:
        return d if self.phases is None else len(self.phases)


def kernel_features(df: DataFrame, vector: str, n: int = 512, seed: int = 0, gamma: float | None = None) -> Features:
    """Scaled dimensions, then random Fourier features of the kernel exp(-gamma |x - y|²), gamma 1 / dimensions unless given."""
    m = moments(df, vector)
    spread = np.sqrt(np.maximum(np.diag(m.covariance()), 0))
    rng, d = np.random.default_rng(seed), len(m.mean)
    directions = rng.normal(0, math.sqrt(2 * (gamma or 1 / max(d, 1))), (d, n))
    return Features(m.mean, np.where(spread > 1e-12, spread, 1.0), directions, rng.uniform(0, 2 * math.pi, n))


def cross_entropy(logits: np.ndarray, own: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed loss and its slope by logit."""
    shifted = logits - logits.max(axis=1, keepdims=True)
    p = np.exp(shifted)
    p /= p.sum(axis=1, keepdims=True)
    rows = np.arange(len(own))
    loss = -np.log(np.maximum(p[rows, own], 1e-300)).sum()
    p[rows, own] -= 1
    return float(loss), p


def squared_hinge(logits: np.ndarray, own: np.ndarray) -> tuple[float, np.ndarray]:
    """As ``cross_entropy``: each label against the rest, with a margin of one."""
    sign = -np.ones_like(logits)
    sign[np.arange(len(own)), own] = 1
    short = np.maximum(0, 1 - sign * logits)
    return float((short**2).sum()), -2 * sign * short


LOSSES = {"cross_entropy": cross_entropy, "squared_hinge": squared_hinge}


@dataclass
class Head:
    """A trained classifier: weights (labels x features, the last column the bias), and how it was trained."""

    labels: list
    weights: np.ndarray
    features: Features
    best_epoch: int = -1
    stopped_epoch: int = -1
    log: list[dict] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = self.features.of(x)
        return x @ self.weights[:, :-1].T + self.weights[:, -1]


def macro_f1(counts: np.ndarray) -> float:
    """Of counts by true (rows) and predicted label, over the labels that occur on either side."""
    hit, true, pred = np.diag(counts), counts.sum(axis=1), counts.sum(axis=0)
    there = (true + pred) > 0
    return float((2 * hit[there] / (true + pred)[there]).mean()) if there.any() else 0.0


def train_head(
    df: DataFrame, vector: str, label: str, validation: str, labels: list, loss: str = "cross_entropy", features: Features | None = None,
    lr: float = 0.01, weight_decay: float = 0.01, epochs: int = 50, patience: int = 10, period: int | None = None, seed: int = 0,
) -> Head:
    """A linear classifier over the features of ``df``'s vectors, by full gradients.

    ``validation`` is a boolean column: such rows are not learned from but choose the
    epoch of the best macro F1 (the first on ties), which is kept; training ends after
    ``patience`` epochs without a better one. A step is AdamW, its rate a cosine
    over ``period`` epochs (``epochs`` unless given). One pass over the rows gives
    the slopes of the next step and judges the last one. Rows without a vector or
    with a label that is not listed are not used; without rows to learn from there is an error.
    """
    features = features or Features()
    place = F.coalesce(*(F.when(F.col(label) == v, i) for i, v in enumerate(labels)))
    rows = settled(df.select(F.col(vector).cast("array<double>").alias("x"), place.cast("int").alias("y"), F.col(validation).alias("v")).where("size(x) > 0 and y is not null and v is not null"))
    first = rows.where("not v").select(F.size("x").alias("d")).first()
    if first is None:
        raise ValueError("no rows to learn from")
    k, d, slope_of = len(labels), features.size(first["d"]), LOSSES[loss]
    size = k * (d + 1)
    weights = np.random.default_rng(seed).uniform(-1, 1, (k, d + 1)) / math.sqrt(d)
    held = Head(labels, weights, features)

    def sums(batch, head):
        x, y = matrix(batch.column(0)), batch.column(1).to_numpy()
        v = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        z = head.features.of(x)
        logits = z @ head.weights[:, :-1].T + head.weights[:, -1]
        total, slopes = slope_of(logits[~v], y[~v])
        counts = np.zeros((k, k))
        np.add.at(counts, (y[v], logits[v].argmax(axis=1)), 1)
        slope = np.concatenate([slopes.T @ z[~v], slopes.sum(axis=0)[:, None]], axis=1)
        return np.concatenate([slope.ravel(), [total, (~v).sum()], counts.ravel()])

    def passed(weights):
        head = Head(labels, weights, features)
        out = summed(rows, lambda batch: sums(batch, head), size + 2 + k * k)
        n = out[size + 1]
        return out[:size].reshape(k, d + 1) / n, out[size] / n, macro_f1(out[size + 2 :].reshape(k, k))

    m, v, best, since = np.zeros_like(weights), np.zeros_like(weights), -math.inf, 0
    slope, train_loss, _ = passed(weights)
    for epoch in range(epochs):
        rate = lr * (1 + math.cos(math.pi * epoch / (period or epochs))) / 2
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        weights = weights * (1 - rate * weight_decay) - rate * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        before = train_loss
        slope, train_loss, f1 = passed(weights)
        since = 0 if f1 > best else since + 1
        held.log.append({"epoch": epoch, "train_loss": before, "val_macro_f1": f1, "lr": rate, "is_best": f1 > best, "early_stop_counter": since})
        held.stopped_epoch = epoch
        if f1 > best:
            best, held.weights, held.best_epoch = f1, weights, epoch
        if since >= patience:
            break
    return held


def predictions(df: DataFrame, vector: str, head: Head, pred: str = "pred_label", score: str = "top1_score") -> DataFrame:
    """``df`` with the predicted label (the first on ties) and its softmaxed score."""

    def compute(x):
        logits = head.logits(x)
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        best = logits.argmax(axis=1)
        return [best, p[np.arange(len(x)), best] / p.sum(axis=1)]

    out = with_vectors(df, vector, [T.StructField("_best", T.LongType()), T.StructField(score, T.DoubleType())], compute)
    named = F.coalesce(*(F.when(F.col("_best") == i, F.lit(v)) for i, v in enumerate(head.labels)))
    return out.withColumn(pred, named).drop("_best")
