"""Classification metrics from (true, pred) labels; every number comes from confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, true: str, pred: str, by: list[str] = ()) -> DataFrame:
    """Counts of the cells that occur: (by..., true_label, pred_label, n)."""
    return df.groupBy(*by, F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))


def dense(cells: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Every cell over a fixed list of labels, 0 where none occurs, with the rate within its row."""
    grid = labels.select(F.col(label).alias("true_label")).crossJoin(labels.select(F.col(label).alias("pred_label")))
    full = grid.join(cells, ["true_label", "pred_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return full.withColumn("rate", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("true_label"))))


def wide(cells: DataFrame, labels: list, prefix: str = "pred_") -> DataFrame:
    """A row per true label, a column per predicted label."""
    out = cells.groupBy("true_label").pivot("pred_label", labels).agg(F.sum("n"))
    return out.select("true_label", *(F.coalesce(F.col(str(v)), F.lit(0)).cast("long").alias(f"{prefix}{v}") for v in labels))


def melted(matrix: DataFrame, prefix: str = "pred_") -> DataFrame:
    """The cells of a wide matrix."""
    return matrix.unpivot("true_label", [c for c in matrix.columns if c.startswith(prefix)], "pred_label", "n").withColumn("pred_label", F.substring("pred_label", len(prefix) + 1, 1_000))


def per_label(cells: DataFrame) -> DataFrame:
    """(label, tp, support, predicted) of every label that occurs on either side."""
    ends = F.array(F.struct(F.col("true_label").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("pred_label").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))
    return cells.select(F.explode(ends).alias("x")).select("x.*").groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))


def scored(counts: DataFrame) -> DataFrame:
    return counts.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support"))).withColumn("f1", ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")))


def per_class(cells: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Precision, recall, F1 and support of every label of a fixed list."""
    full = labels.select(F.col(label).alias("label")).join(per_label(cells), "label", "left").na.fill(0, ["tp", "support", "predicted"])
    return scored(full).select("label", "precision", "recall", "f1", "support")


def macro(cells: DataFrame) -> DataFrame:
    """One row: accuracy, and means of F1, precision and recall over labels seen on either side."""
    return scored(per_label(cells)).agg(
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"), F.sum("support").alias("num_samples"))


def support_errors(classes: DataFrame, cells: DataFrame) -> DataFrame:
    """A row if the supports do not add up to the samples."""
    return classes.agg(F.sum("support").alias("support")).crossJoin(cells.agg(F.sum("n").alias("n"))).where("support <> n")


def mean_cells(cells: DataFrame, by: list[str], seed: str = "seed") -> DataFrame:
    """Mean and deviation over seeds of every cell's count and rate; rates are within rows of a run."""
    run = [*by, seed, "true_label"]
    rated = cells.withColumn("rate", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*run))))
    return rated.groupBy(*by, "true_label", "pred_label").agg(F.avg("n").alias("n_mean"), F.stddev_samp("n").alias("n_std"), F.avg("rate").alias("rate_mean"), F.stddev_samp("rate").alias("rate_std"), F.count_distinct(seed).alias("seed_count"))


def nearest_centroid(df: DataFrame, vector: str, label: str, record: str) -> DataFrame:
    """Predicted label of every row: the centroid nearest to it, the least label on ties.

    Centroids are as many as labels are, times the vector's size.
    """
    flat = df.select(F.col(label).alias("label"), F.posexplode(vector).alias("i", "x"))
    means = flat.groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("centre"))
    every = means.agg(F.array_sort(F.collect_list(F.struct("label", "centre"))).alias("centres"))
    distance = lambda c, v: F.aggregate(F.zip_with(v, c, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, d: a + d)
    best = F.array_min(F.transform(F.col("centres"), lambda c: F.struct(F.round(distance(c["centre"], F.col(vector)), 9).alias("d"), c["label"].alias("label"))))
    return df.crossJoin(F.broadcast(every)).select(record, F.col(label).alias("true_label"), best["label"].alias("pred_label"))


def averaged_predictions(scores: DataFrame, item: str, label: str, score: str, digits: int = 9) -> DataFrame:
    """(item, pred_label, score): the label whose scores, one a template, have the largest mean; the least on ties."""
    means = scores.groupBy(item, label).agg(F.round(F.avg(score), digits).alias("score"))
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col(label).alias("l")))
    return means.groupBy(item).agg(best.alias("b")).select(item, F.col("b.l").alias("pred_label"), (-F.col("b.s")).alias("score"))


def last_layer(embeddings: DataFrame, layer: str = "layer_index") -> DataFrame:
    """The rows of the largest layer; its number is one row, whatever the input."""
    return embeddings.join(F.broadcast(embeddings.agg(F.max(layer).alias(layer))), layer)


def mean_matrix(cells: DataFrame, by: list[str]) -> DataFrame:
    """Rates within rows of the mean counts of ``mean_cells``."""
    row = F.sum("n_mean").over(Window.partitionBy(*by, "true_label"))
    return cells.withColumn("rate_of_means", ratio(F.col("n_mean"), row))
