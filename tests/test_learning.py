"""Models trained by summed slopes against the same algorithms on whole arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import learning, metrics


def blobs(n, d, k, seed, spread=1.0, rings=False):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, n)
    if rings:  # no line separates them
        angle, radius = rng.uniform(0, 2 * math.pi, n), 1 + 2 * y + rng.normal(0, 0.25, n)
        return np.stack([radius * np.cos(angle), radius * np.sin(angle)], 1), y
    return rng.normal(0, 2, (k, d))[y] + rng.normal(0, spread, (n, d)), y


def frame(spark, x, y, part):
    return spark.createDataFrame([(i, [float(v) for v in row], f"c{c}", bool(p)) for i, (row, c, p) in enumerate(zip(x, y, part, strict=True))], "id long, x array<double>, label string, held boolean").repartition(5)


def whole(x, y, part, k, loss, lr, decay, epochs, patience, seed, features):
    """The training loop on arrays."""
    z = features.of(x)
    z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    w = np.random.default_rng(seed).uniform(-1, 1, (k, z.shape[1])) / math.sqrt(z.shape[1] - 1)
    m, v, best, kept, since, log = np.zeros_like(w), np.zeros_like(w), -1.0, w, 0, []
    for e in range(epochs):
        total, slopes = learning.LOSSES[loss](z[~part] @ w.T, y[~part])
        g = slopes.T @ z[~part] / (~part).sum()
        rate = lr * (1 + math.cos(math.pi * e / epochs)) / 2
        w = w - rate * decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** (e + 1))) / (np.sqrt(v / (1 - 0.999 ** (e + 1))) + 1e-8)
        pred, true = (z[part] @ w.T).argmax(axis=1), y[part]
        scores = [2 * ((pred == c) & (true == c)).sum() / ((pred == c).sum() + (true == c).sum()) for c in range(k) if (pred == c).any() or (true == c).any()]
        f1 = float(np.mean(scores)) if scores else 0.0
        since = 0 if f1 > best else since + 1
        if f1 > best:
            best, kept = f1, w
        log.append((total / (~part).sum(), f1))
        if since >= patience:
            break
    return kept, log


@pytest.mark.parametrize(("loss", "rings"), [("cross_entropy", False), ("squared_hinge", True)])
def test_training_is_that_on_whole_arrays(spark, loss, rings):
    x, y = blobs(300, 5, 3, 1, rings=rings)
    part = np.arange(300) % 4 == 0
    df = frame(spark, x, y, part)
    features = learning.kernel_features(df.where("not held"), "x", 40, 3) if rings else learning.Features()
    head = learning.train_head(df, "x", "label", "held", ["c0", "c1", "c2"], loss, features, lr=0.1, weight_decay=0.01, epochs=12, patience=3, seed=7)
    weights, log = whole(x, y, part, 3, loss, 0.1, 0.01, 12, 3, 7, features)
    assert np.abs(head.weights - weights).max() < 1e-6
    assert [(r["train_loss"], r["val_macro_f1"]) for r in head.log] == [pytest.approx(r, abs=1e-9) for r in log]
    assert head.best_epoch == int(np.argmax([f for _, f in log])) and head.stopped_epoch == len(log) - 1


def test_predictions_feed_the_metrics(spark):
    x, y = blobs(400, 6, 4, 2, 0.7)
    df = frame(spark, x, y, np.arange(400) % 3 == 0)
    head = learning.train_head(df, "x", "label", "held", [f"c{i}" for i in range(4)], lr=0.2, epochs=25)
    rows = learning.predictions(df.withColumn("pred_label", F.lit(1)), "x", head).collect()
    assert all(0.25 <= r.top1_score <= 1 for r in rows) and len(rows) == 400
    out = metrics.macro(metrics.confusion(learning.predictions(df, "x", head), "label", "pred_label")).first()
    assert out.num_samples == 400 and out.accuracy == pytest.approx(np.mean([r.label == r.pred_label for r in rows])) and out.accuracy > 0.9


def test_the_kernel_map_comes_near_an_exact_kernel_machine(spark):
    x, y = blobs(700, 2, 3, 5, rings=True)
    part = np.arange(700) % 5 == 0
    df = frame(spark, x, y, part)
    features = learning.kernel_features(df.where("not held"), "x", 300, 1, gamma=2.0)
    head = learning.train_head(df, "x", "label", "held", ["c0", "c1", "c2"], "squared_hinge", features, lr=0.1, weight_decay=0.0, epochs=60, patience=60)
    ours = np.mean([r.label == r.pred_label for r in learning.predictions(df.where("held"), "x", head).collect()])
    u = (x - x[~part].mean(axis=0)) / x[~part].std(axis=0)
    gram = lambda a, b: np.exp(-2.0 * ((a[:, None] - b[None]) ** 2).sum(axis=2))
    exact = gram(u[part], u[~part]) @ np.linalg.solve(gram(u[~part], u[~part]) + 0.1 * np.eye((~part).sum()), np.eye(3)[y[~part]] * 2 - 1)
    assert ours >= (exact.argmax(axis=1) == y[part]).mean() - 0.03
    line = learning.train_head(df, "x", "label", "held", ["c0", "c1", "c2"], "squared_hinge", lr=0.1, epochs=30)
    assert max(r["val_macro_f1"] for r in line.log) < 0.7 < ours


def test_components_are_those_of_numpy(spark):
    x, y = blobs(500, 8, 5, 9)
    df = frame(spark, x, y, np.zeros(500, bool))
    own = learning.principal_components(df, "x", 3)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    assert own.variances == pytest.approx(values[::-1][:3])
    assert np.abs(np.abs((own.axes * axes[:, ::-1].T[:3]).sum(axis=1)) - 1).max() < 1e-9
    got = {r.id: (r.a, r.b) for r in learning.projected(df, "x", own, ["a", "b", "c"]).collect()}
    want = (x - x.mean(axis=0)) @ own.axes[:2].T
    assert np.abs(np.array([got[i] for i in range(500)]) - want).max() < 1e-9


def test_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "c0", False), (2, None, "c0", False), (3, [], "c1", True), (4, [2.0, 1.0], None, False), (5, [3.0, 0.0], "c1", None), (6, [5.0, 5.0], "x", False)], "id long, x array<double>, label string, held boolean")
    m = learning.moments(df, "x")
    assert m.n == 4 and m.mean == pytest.approx([2.75, 2.0])
    head = learning.train_head(df, "x", "label", "held", ["c0", "c1"], epochs=3, patience=5)
    assert len(head.log) == 3 and {r["val_macro_f1"] for r in head.log} == {0.0}
    assert {r.id: r.pred_label is None for r in learning.predictions(df, "x", head).collect()} == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False}
    with pytest.raises(ValueError):
        learning.train_head(df.limit(0), "x", "label", "held", ["c0", "c1"])
    with pytest.raises(ValueError):
        learning.principal_components(df.limit(0), "x")
    assert learning.moments(df.limit(0), "x").n == 0
