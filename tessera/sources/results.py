"""What a run writes: metrics, class and confusion tables, costs, its configuration and metadata; caches and exports."""

from __future__ import annotations

import json
import subprocess
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gates import GateError
from . import files

#: The columns of result files.
PREDICTIONS = ["segment_id", "sample_id", "record_id", "split", "source_dataset", "true_label", "true_label_id", "pred_label", "pred_label_id", "top1_score"]
CLASSES = ["label_id", "label", "precision", "recall", "f1", "support"]


def write_predictions(df: DataFrame, path: str) -> None:
    """The ten columns of a prediction file, by segment."""
    files.write_csv(df.select(*PREDICTIONS).orderBy("segment_id"), path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The one row of a split's metrics as JSON."""
    rows = files.bounded(metrics, 1)
    if not rows:
        raise GateError(f"no metrics for {path}")
    files.write_json(metrics.sparkSession, path, rows[0].asDict(recursive=True))


def write_class_metrics(df: DataFrame, path: str) -> None:
    files.write_csv(df.select(*CLASSES).orderBy("label_id"), path)


def write_confusion(cells: DataFrame, labels: list[str], path: str, true: str = "true_label", pred: str = "pred_label", n: str = "n") -> None:
    """Cells as a wide table: a row and a column for every label, in the order of ``labels``, zeros where nothing was counted."""
    spark = cells.sparkSession
    wide = cells.groupBy(F.col(true).alias("true_label")).pivot(pred, list(labels)).agg(F.sum(n))
    order = spark.createDataFrame([(x, i) for i, x in enumerate(labels)], "true_label string, _place int")
    rows = order.join(wide, "true_label", "left").orderBy("_place").select("true_label", *(F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(x) for x in labels))
    files.write_csv(rows, path)


def write_cost(cost: DataFrame, path: str) -> None:
    """One run's row of costs as JSON; see ``rollup.run_costs``."""
    write_metrics(cost, path)


def config_text(config: dict) -> str:
    """A configuration as YAML, or as JSON (which YAML readers take) without a YAML library."""
    try:
        import yaml
    except ImportError:
        return json.dumps(config, ensure_ascii=False, indent=2, sort_keys=True, default=str)
    return yaml.safe_dump(config, allow_unicode=True, default_flow_style=False)


def write_config(spark: SparkSession, config: dict, path: str) -> None:
    files.write_text(spark, path, config_text(config))


def now() -> str:
    return datetime.now(UTC).isoformat()


def code_version() -> str:
    """The commit of the working folder, if git knows one."""
    try:
        said = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5)
    except (OSError, subprocess.TimeoutExpired):
        return "git_unavailable"
    return said.stdout.strip() if said.returncode == 0 else "git_unavailable"


def write_run_meta(spark: SparkSession, path: str, run_id: str, seed_name: str, seed_index, base_seed, config_version: str, started_at: str, finished_at: str | None = None, extra: dict | None = None) -> None:
    meta = {"run_id": run_id, "seed_name": seed_name, "seed_index": seed_index, "base_seed": base_seed, "config_version": config_version, "code_version": code_version(), "started_at": started_at, "finished_at": finished_at or now()}
    files.write_json(spark, path, meta | (extra or {}))


def merged_config(default: dict, own: dict, deep: bool = True) -> dict:
    """``default`` with what ``own`` says; mappings in both are merged too if ``deep``."""
    out = dict(default)
    for k, v in own.items():
        out[k] = merged_config(out[k], v) if deep and isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def write_selection(spark: SparkSession, selection: dict, path: str) -> None:
    files.write_json(spark, path, selection)


def exported(spark: SparkSession, mapping: dict[str, str], source: str, target: str) -> list[str]:
    """Copy ``mapping`` (file below ``source`` -> file below ``target``); the files that are missing are named, not copied."""
    missing = []
    for own, to in mapping.items():
        if files.exists(spark, f"{source}/{own}"):
            files.copy(spark, f"{source}/{own}", f"{target}/{to}")
        else:
            missing.append(own)
    return missing


def write_embeddings(df: DataFrame, root: str) -> bool:
    """Cache (seed_name, split, layer_index, segment_id, embedding); false if the cache is there already."""
    if files.exists(df.sparkSession, f"{root}/_SUCCESS"):
        return False
    df.write.mode("overwrite").partitionBy("seed_name", "split", "layer_index").parquet(root)
    return True


def layer_embeddings(spark: SparkSession, root: str, seed_name: str, split: str, layer_index: int) -> DataFrame:
    """One layer of the cache: only its folder is read."""
    return spark.read.parquet(root).where((F.col("seed_name") == seed_name) & (F.col("split") == split) & (F.col("layer_index") == layer_index))


def layer_count(spark: SparkSession, root: str, runs: str | None = None) -> int:
    """How many layers there are: by run folders named after them, or else by the cache."""
    found = [int(n.rpartition("_")[2]) for n in files.names(spark, runs) if n.rpartition("_")[2].isdigit()] if runs else []
    if found:
        return max(found) + 1
    return int(spark.read.parquet(root).agg(F.max("layer_index")).first()[0]) + 1


def write_segments(df: DataFrame, root: str, path: str = "segment_path", wave: str = "wave") -> int:
    """Write every row's bytes to its path below ``root``, after the tree was wiped; how many were written.

    Executors write to the store that ``root`` names, each file beside its place
    and then moved, so a task that runs again replaces its own files.
    """
    import pyarrow as pa

    spark = df.sparkSession
    files.remove(spark, root)

    def write(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        n = 0
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                goal = f"{base}/{where}"
                store.create_dir(goal.rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{goal}.part") as out:
                    out.write(content.as_buffer())
                store.move(f"{goal}.part", goal)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return int(df.select(path, wave).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0)


def subset_files(spark: SparkSession, root: str, ratio: str, seed: str) -> tuple[DataFrame, DataFrame, dict]:
    """A frozen subset: listed segments with their position, its groups, its metadata; a missing file is an error."""
    where = f"{root}/{ratio}/{seed}"
    for name in ("train_subset_segments.csv", "train_subset_groups.csv", "subset_meta.json"):
        if not files.exists(spark, f"{where}/{name}"):
            raise GateError(f"missing file: {where}/{name}")
    # The list is a file of its own order: one reader, so lines number themselves.
    listed = spark.read.option("header", True).option("escape", '"').csv(f"{where}/train_subset_segments.csv").coalesce(1).withColumn("position", F.monotonically_increasing_id())
    groups = spark.read.option("header", True).option("escape", '"').csv(f"{where}/train_subset_groups.csv")
    return listed, groups, json.loads(files.read_text(spark, f"{where}/subset_meta.json"))


def class_statistics(rows: DataFrame, primary: str = "source_dataset <> 'ChMusic'") -> DataFrame:
    """Per family: rows of each source, distinct primary groups, and how often each content type occurs (a map)."""
    kinds = rows.where(primary).groupBy("family_label", F.coalesce("content_type", F.lit("")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("family_label").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("content_type_distribution"))
    counts = rows.groupBy("family_label").agg(
        *(F.count_if(F.col("source_dataset") == s).alias(f"{s.lower()}_kept_recordings") for s in ("CCMusic", "External", "ChMusic")),
        F.count_distinct(F.when(F.expr(primary), F.col("recording_group_id"))).alias("primary_unique_groups"),
    )
    return counts.join(kinds, "family_label", "left")


def segment_counts(segments: DataFrame) -> DataFrame:
    """Per seed: segments in all, and per class and split (a map of maps)."""
    cells = segments.groupBy("split_seed", "family_label", "split").agg(F.count(F.lit(1)).alias("n"))
    classes = cells.groupBy("split_seed", "family_label").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "n")))).alias("m"))
    return classes.groupBy("split_seed").agg(F.sum("n").alias("total_segments"), F.map_from_entries(F.collect_list(F.struct("family_label", "m"))).alias("per_class_per_split"))


def drop_reasons(spark: SparkSession, audit_csv: str) -> DataFrame:
    """(drop_reason, n) of the dropped rows in the audit manifest as it was written."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(audit_csv)
    return rows.where("sample_status = 'drop'").groupBy(F.coalesce("drop_reason", F.lit("unknown")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


def write_summary(spark: SparkSession, path: str, config: dict, classes: list[str], **parts: DataFrame) -> None:
    """The final summary: configuration, classes, small frames as lists of rows, and versions."""
    import sys

    import numpy
    import pyarrow
    import pyspark

    versions = {"python": ".".join(map(str, sys.version_info[:3])), "pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__, "numpy": numpy.__version__}
    rows = {k: [r.asDict(recursive=True) for r in files.bounded(v)] for k, v in parts.items()}
    files.write_json(spark, path, {"freeze_config_snapshot": config, "classes": classes, **rows, "versions": versions})
