"""Rollups over seeds, completeness of grids, and selection of the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("accuracy", "macro_f1", "macro_precision", "macro_recall")


def common_or_median(column: str) -> Column:
    """The value all rows share, or else their median cut to an integer."""
    return F.when(F.min(column) == F.max(column), F.min(column)).otherwise(F.median(column).cast("long"))


def mean_std(df: DataFrame, by: list[str], metrics=METRICS, seed: str | None = "seed", samples: str | None = None) -> DataFrame:
    """Mean and sample deviation of every metric per group."""
    aggregates = [f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    if seed:
        aggregates.append(F.count_distinct(seed).alias("seed_count"))
    if samples:
        aggregates.append(common_or_median(samples).alias("num_samples_per_seed"))
    return df.groupBy(*by).agg(*aggregates)


def cost_summary(df: DataFrame, by: list[str], fields: list[str], memory: str, available: str, constant: str | None = None, seed: str | None = None) -> DataFrame:
    """Mean and deviation of costs; memory over rows that have it: deviation 0 for one, null for none."""
    held = F.when(F.col(available), F.col(memory))
    n = F.count_if(F.col(available))
    extra = [F.min(constant).alias(constant)] if constant else []
    extra += [F.count_distinct(seed).alias("seed_count")] if seed else []
    return df.groupBy(*by).agg(
        *(f(c).alias(f"{c}_{s}") for c in fields for f, s in ((F.avg, "mean"), (F.stddev_samp, "std"))),
        F.avg(held).alias(f"{memory}_mean"), F.when(n == 1, F.lit(0.0)).when(n > 1, F.stddev_samp(held)).alias(f"{memory}_std"), n.alias(f"{memory}_runs"), *extra)


def incomplete(df: DataFrame, grid: DataFrame, by: list[str], seed: str, expected: int) -> DataFrame:
    """Cells of ``grid`` with other than ``expected`` distinct seeds: (by..., n)."""
    have = df.groupBy(*by).agg(F.count_distinct(seed).alias("n"))
    return grid.join(have, by, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).where(F.col("n") != expected)


def best(df: DataFrame, order: list[Column], by: list[str] = ()) -> DataFrame:
    """The first row by ``order`` of every group; the order must end in a unique key."""
    if not by:
        return df.orderBy(*order).limit(1)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def selection_problems(perf: DataFrame, on: list[str], methods: list[str], metric: str) -> DataFrame:
    """Why a best method cannot be named: (problem, method)."""
    spark = perf.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*(F.lit(m) for m in methods))).alias("method"))
    key = on[0]
    say = lambda rows, what: rows.select(F.lit(what).alias("problem"), F.col("method").cast("string").alias("method"))
    rows = perf.withColumnRenamed(key, "method") if key != "method" else perf
    return (
        say(wanted.join(rows, "method", "left_anti"), "method_missing")
        .unionByName(say(rows.join(wanted, "method", "left_anti"), "method_not_ordered"))
        .unionByName(say(rows.groupBy("method", *on[1:]).count().where("count > 1"), "method_repeated"))
        .unionByName(say(rows.where(F.col(metric).isNull() | F.isnan(metric)), "metric_missing"))
    )


def ranked(df: DataFrame, by: list[str], score: str, ties: list[str], rank: str = "rank", is_best: str = "is_best") -> DataFrame:
    """Rank within groups by score, highest first; ties by ``ties``."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return df.withColumn(rank, F.row_number().over(w)).withColumn(is_best, F.col(rank) == 1)


def diverse_top_k(df: DataFrame, kind: str, score: str, record: str, k: int, rank: str = "case_rank") -> DataFrame:
    """The ``k`` best rows: first the best of every kind, then the rest by score.

    Only the k best of each kind and the k best firsts can matter, so both are
    cut before the one final sort over at most 2 k rows.
    """
    order = [F.desc(score), F.col(record)]
    firsts = df.groupBy(kind).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(record).alias("r"))).alias("_f"))
    top = firsts.orderBy("_f").limit(k).select(F.col("_f.r").alias(record))
    heads = df.join(firsts.select(F.col("_f.r").alias(record)), record, "left_semi")
    heads = heads.join(top, record, "left_semi").withColumn("_first", F.lit(0))
    rest = df.join(firsts.select(F.col("_f.r").alias(record)), record, "left_anti").orderBy(*order).limit(k).withColumn("_first", F.lit(1))
    both = heads.unionByName(rest).orderBy("_first", *order).limit(k)
    return both.withColumn(rank, F.row_number().over(Window.orderBy("_first", *order))).drop("_first")


def error_cases(df: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """Rows predicted wrongly, with ``error_pair``."""
    return df.where(F.col(true) != F.col(pred)).withColumn("error_pair", F.concat(F.col(true).cast("string"), F.lit(" → "), F.col(pred).cast("string")))


def pair_summary(errors: DataFrame, score: str = "score") -> DataFrame:
    return errors.groupBy("error_pair").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("score_mean"), F.min(score).alias("score_min"), F.max(score).alias("score_max")).orderBy(F.desc("n"), "error_pair")


def status_rollup(df: DataFrame, by: str, status: str = "status", expected: int = 12) -> DataFrame:
    """completed (all, and as many as expected), failed (any failed or blocked), else partial."""
    done, bad = F.bool_and(F.col(status) == "completed"), F.bool_or(F.col(status).isin("failed", "blocked"))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), F.when(done & (F.count(F.lit(1)) == expected), "completed").when(bad, "failed").otherwise("partial").alias("status"))


def curve_points(perf: DataFrame, cost: DataFrame, by: list[str], metrics, costs) -> DataFrame:
    """Points of a learning curve: performance per group and split, the costs of its group beside it."""
    left = mean_std(perf, [*by, "split"], metrics)
    return left.join(mean_std(cost, by, costs, seed=None), by, "left")


def layer_table(df: DataFrame, layer: str = "layer_index", split: str = "split", mean: str = "macro_f1_mean", std: str = "macro_f1_std", splits=("test", "external_test")) -> DataFrame:
    """A row per layer, the splits side by side as mean±std, each split's best (first) layer in bold."""
    from ..functions.text import mean_std as shown

    tops = df.groupBy(split).agg(F.max(F.struct(F.col(mean), (-F.col(layer)).alias("l"))).alias("t")).select(split, (-F.col("t.l")).alias("_best"))
    cells = df.join(F.broadcast(tops.where(F.col(split).isin(*splits))), split).withColumn("_cell", shown(F.col(mean), F.col(std), F.col(layer) == F.col("_best")))
    return cells.groupBy(layer).agg(*(F.coalesce(F.max(F.when(F.col(split) == s, F.col("_cell"))), F.lit("-")).alias(s) for s in splits))


def grouping_sizes(df: DataFrame, columns: list[str], value: str) -> DataFrame:
    """Rows and distinct values by each column alone and overall, in one pass."""
    names = [F.col(c) for c in columns]
    return df.groupingSets([*([c] for c in names), []], *names).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(value).alias("n_distinct"))


def extremes(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """The worst and the best label of every group, the least on ties."""
    key = lambda s: F.struct((s * F.col(score)).alias("s"), F.col(label).alias("l"))
    return df.groupBy(*by).agg(F.min(key(F.lit(1.0))).alias("w"), F.min(key(F.lit(-1.0))).alias("b")).select(*by, F.col("w.l").alias("worst"), F.col("b.l").alias("best"))


def run_costs(runs: DataFrame, epochs: DataFrame, steps: DataFrame, by: list[str]) -> DataFrame:
    """Cost rows of runs from their timings, rounded as cost files are.

    ``runs``: by, total_params, trainable_params, feature_prep_time_sec,
    train_wall_time_sec, peak_memory_mb (null: not measured), best_epoch,
    stopped_epoch. ``epochs(by, seconds)``, ``steps(by, ms)``; without any, 0.
    """
    three = lambda c: F.round(c, 3)
    mean = lambda df, c, out: df.groupBy(*by).agg(F.avg(c).alias(out))
    held = runs.join(mean(epochs, "seconds", "_epoch"), by, "left").join(mean(steps, "ms", "_step"), by, "left")
    return held.select(
        *by, "total_params", "trainable_params",
        F.coalesce(F.try_divide(F.col("trainable_params").cast("double"), F.col("total_params").cast("double")), F.lit(0.0)).alias("trainable_ratio"),
        three(F.col("feature_prep_time_sec")).alias("feature_prep_time_sec"), three(F.col("train_wall_time_sec")).alias("train_wall_time_sec"),
        three(F.col("feature_prep_time_sec") + F.col("train_wall_time_sec")).alias("total_method_time_sec"),
        three(F.coalesce("_epoch", F.lit(0.0))).alias("mean_epoch_time_sec"), three(F.coalesce("_step", F.lit(0.0))).alias("mean_train_step_time_ms"),
        F.round("peak_memory_mb", 2).alias("peak_device_memory_mb"), F.col("peak_memory_mb").isNotNull().alias("memory_metric_available"), "best_epoch", "stopped_epoch",
    )
