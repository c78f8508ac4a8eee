"""Run folders ``<root>/<method>/<seed>/[<extra>/]<file>``: metrics, classes, costs and confusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gates import GateError

#: The fields of a cost file, those whose mean and deviation are reported, and the counts a run's metadata adds.
COST_FIELDS = {
    "model": "string", "device_type": "string", "total_params": "long", "trainable_params": "long", "trainable_ratio": "double", "feature_prep_time_sec": "double", "train_wall_time_sec": "double", "total_method_time_sec": "double",
    "mean_epoch_time_sec": "double", "mean_train_step_time_ms": "double", "peak_device_memory_mb": "double", "memory_metric_available": "boolean", "best_epoch": "long", "stopped_epoch": "long",
}
COST_MEANS = ["trainable_params", "trainable_ratio", "feature_prep_time_sec", "train_wall_time_sec", "total_method_time_sec", "mean_epoch_time_sec", "mean_train_step_time_ms"]
META_COUNTS = ("subset_train_group_count", "subset_train_segment_count")


def metrics_file(split: Column) -> Column:
    """Validation files carry the suffix of the best checkpoint."""
    return F.when(split == "val", "val_metrics_best.json").otherwise(F.concat(split, F.lit("_metrics.json")))


def classes_file(split: Column) -> Column:
    return F.when(split == "val", "val_per_class_metrics_best.csv").otherwise(F.concat(split, F.lit("_per_class_metrics.csv")))


def path_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The folders above a file as columns, the last of ``names`` next to it; and the split in its name."""
    steps = F.split(F.col("_metadata.file_path"), "/")
    out = df.select("*", steps.alias("_steps"))
    n = len(names)
    for i, name in enumerate(names):
        out = out.withColumn(name, F.element_at("_steps", i - n - 1))
    return out.withColumn("split", F.coalesce("split", F.regexp_extract(F.element_at("_steps", -1), "^(val|test|external_test|train)_", 1)) if "split" in df.columns else F.regexp_extract(F.element_at("_steps", -1), "^(val|test|external_test|train)_", 1)).drop("_steps")


def run_metrics(spark: SparkSession, root: str, names: list[str] = ("method", "seed"), extra: list[str] = ()) -> DataFrame:
    """A row per metrics file that exists; macro precision and recall are NaN where missing."""
    glob = "/".join([root, *["*"] * len(names), "{val_metrics_best,test_metrics,external_test_metrics}.json"])
    schema = "accuracy double, macro_f1 double, macro_precision double, macro_recall double, num_samples long, model string"
    df = spark.read.schema(schema).option("multiLine", True).json(glob)
    nan = F.lit(float("nan"))
    return path_columns(df, list(names)).withColumn("macro_precision", F.coalesce("macro_precision", nan)).withColumn("macro_recall", F.coalesce("macro_recall", nan))


def with_ratio(df: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """Adds ``ratio_value`` by name."""
    pairs = [x for k, v in ratios.items() for x in (F.lit(k), F.lit(float(v)))]
    return df.withColumn("ratio_value", F.element_at(F.create_map(*pairs), F.col("ratio_name")))


def with_layer(df: DataFrame, column: str = "layer") -> DataFrame:
    """layer_index from a folder's name, and its name; layer 0 is the embedding output."""
    index = F.regexp_extract(column, r"(\d+)$", 1).cast("int")
    return df.withColumn("layer_index", index).withColumn("layer_name", F.when(index == 0, "embedding_output").otherwise(F.format_string("transformer_layer_%d", index)))


def class_metrics(spark: SparkSession, root: str, names: list[str] = ("method", "seed")) -> DataFrame:
    glob = "/".join([root, *["*"] * len(names), "*_per_class_metrics*.csv"])
    schema = "label_id int, label string, precision double, recall double, f1 double, support long"
    return path_columns(spark.read.schema(schema).option("header", True).csv(glob), list(names))


def cost_metrics(spark: SparkSession, root: str, names: list[str] = ("method", "seed"), with_meta: bool = False) -> DataFrame:
    """Cost files, with group and segment counts of the run's metadata where there are any."""
    schema = ", ".join(f"{c} {kind}" for c, kind in COST_FIELDS.items())
    costs = path_columns(spark.read.schema(schema).option("multiLine", True).json("/".join([root, *["*"] * len(names), "cost_metrics.json"])), list(names)).drop("split")
    if not with_meta:
        return costs
    meta = spark.read.schema(", ".join(f"{c} long" for c in META_COUNTS)).option("multiLine", True).json("/".join([root, *["*"] * len(names), "run_meta.json"]))
    return costs.join(path_columns(meta, list(names)).drop("split"), list(names), "left")


def confusion_cells(spark: SparkSession, root: str, labels: list[str], names: list[str] = ("method", "seed"), expected: DataFrame | None = None) -> DataFrame:
    """Wide confusion files as cells (names..., split, true_label, pred_label, n).

    ``expected(names..., split)`` lists the files there must be; one that is
    missing is an error.
    """
    schema = ", ".join(["true_label string", *(f"`{c}` long" for c in labels)])
    rows = path_columns(spark.read.schema(schema).option("header", True).csv("/".join([root, *["*"] * len(names), "*_confusion_matrix.csv"])), list(names))
    if expected is not None:
        keys = [*names, "split"]
        require_files(expected.join(rows.select(*keys).distinct(), keys, "left_anti").select(F.concat_ws("/", *keys).alias("path")))
    return rows.unpivot([*names, "split", "true_label"], list(labels), "pred_label", "n")


def missing_files(spark: SparkSession, root: str, dimensions: list[DataFrame], path: Column) -> DataFrame:
    """Cells of a grid whose file does not exist below ``root``."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", r"^[a-z]+:/*", "/").alias("path"))
    grid = _grid(dimensions)
    return grid.withColumn("path", F.concat_ws("/", F.lit(root.rstrip("/")), path)).join(there, "path", "left_anti")


def _grid(dimensions: list[DataFrame]) -> DataFrame:
    out = dimensions[0]
    for d in dimensions[1:]:
        out = out.crossJoin(d)
    return out


def require_files(missing: DataFrame) -> None:
    if rows := missing.limit(5).collect():
        raise GateError(f"missing files: {[r['path'] for r in rows]}")
