"""Evaluation flows: read a run folder, check it is whole, roll it up."""

from __future__ import annotations

import math
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollup
from ..operators.gates import GateError, require
from ..sources import runs

SPLITS = ("val", "test", "external_test")


def grid(spark: SparkSession, **dimensions: list) -> DataFrame:
    """The cross product of small fixed lists."""
    out = spark.range(1).select()
    for name, values in dimensions.items():
        out = out.crossJoin(spark.range(1).select(F.explode(F.array(*(F.lit(v) for v in values))).alias(name)))
    return out


def rolled_up(spark: SparkSession, root: str, methods: list[str], seeds: int = 3, names: list[str] = ("method", "seed"), extra: dict[str, list] | None = None, ratios: dict[str, float] | None = None, layers: bool = False, costs: bool = False) -> dict[str, DataFrame]:
    """Per-run rows, their summary, per-class summary, and costs of a folder of runs.

    ``names`` are the folders between root and files; ``extra`` the values that
    dimensions besides method and seed must have. Raises if a cell of the grid
    has not ``seeds`` seeds.
    """
    by = [n for n in names if n != "seed"]
    metrics = runs.run_metrics(spark, root, list(names))
    wanted = grid(spark, method=list(methods), **(extra or {}), split=list(SPLITS))
    require(rollup.incomplete(metrics, wanted, [*by, "split"], "seed", seeds), "incomplete runs")
    classes = runs.class_metrics(spark, root, list(names))
    if ratios:
        metrics, classes = runs.with_ratio(metrics, ratios), runs.with_ratio(classes, ratios)
        by = [*by, "ratio_value"]
    if layers:
        metrics, classes = runs.with_layer(metrics), runs.with_layer(classes)
        by = [*by, "layer_index", "layer_name"]
    out = {
        "runs": metrics,
        "summary": rollup.mean_std(metrics, [*by, "split"], samples="num_samples"),
        "classes": rollup.mean_std(classes, [*by, "split", "label_id", "label"], ("f1", "precision", "recall")),
    }
    if costs:
        cost = runs.cost_metrics(spark, root, list(names), with_meta=bool(ratios))
        if ratios:
            cost = runs.with_ratio(cost, ratios)
        out["costs"] = rollup.cost_summary(cost, by, runs.COST_MEANS, "peak_device_memory_mb", "memory_metric_available", "total_params", "seed")
        out["curve"] = rollup.curve_points(metrics, cost, by, ("macro_f1", "accuracy"), ("total_method_time_sec",))
    return out


def selected(perf: DataFrame, cost: DataFrame, order: list[str], metric: str = "macro_f1_mean", params: str = "trainable_params") -> DataFrame:
    """The best method: by metric, then fewer parameters, then place in ``order``; raises if it cannot be named."""
    require(rollup.selection_problems(perf, ["method"], order, metric), "method selection")
    rank = F.coalesce(*(F.when(F.col("method") == m, i) for i, m in enumerate(order)), F.lit(99))
    return rollup.best(perf.join(cost, "method").withColumn("method_rank", rank), [F.desc(metric), F.col(params), F.col("method_rank"), F.col("method")])


def gate(checks: dict[str, tuple[bool, str]]) -> tuple[bool, list[str]]:
    """Whether all named checks passed, and a line for each."""
    return all(ok for ok, _ in checks.values()), [f"{'ok' if ok else 'FAILED'} {name}: {detail}" for name, (ok, detail) in checks.items()]


def table_exists(path: str) -> tuple[bool, str]:
    return Path(path).exists(), path


def writable(folder: str) -> tuple[bool, str]:
    """Whether a file can be made in a folder of the driver."""
    try:
        with tempfile.NamedTemporaryFile(dir=folder):
            return True, folder
    except OSError as e:
        return False, str(e)


def finite(value: float | None) -> bool:
    return value is not None and math.isfinite(value)


def steps(named: dict, blocking: set[str]) -> dict[str, str]:
    """Run named functions in order; a failing one ends the run only if it blocks."""
    out = {}
    for name, step in named.items():
        try:
            step()
            out[name] = "completed"
        except Exception as e:
            out[name] = f"failed: {e}"
            if name in blocking:
                raise GateError(f"{name} failed: {e}") from e
    return out


def seeds_in_order(run, first: str, rest: list[str]) -> dict[str, str]:
    """The first seed alone; the others are blocked if it fails."""
    try:
        run(first)
    except Exception as e:
        return {first: f"failed: {e}"} | dict.fromkeys(rest, "blocked")
    out = {first: "completed"}
    for seed in rest:
        try:
            run(seed)
            out[seed] = "completed"
        except Exception as e:
            out[seed] = f"failed: {e}"
    return out
