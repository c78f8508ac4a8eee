"""Contracts of run folders and the gates between phases: each gate is a list of named checks."""

from __future__ import annotations

import importlib.util
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry as registries
from ..operators.gates import GateError, say, union
from ..sources import files, runs, settings
from .evaluation import gate, grid

#: What a finished run leaves, by split and in all.
SPLIT_FILES = {
    "val": ("val_predictions_best.csv", "val_metrics_best.json", "val_per_class_metrics_best.csv", "val_confusion_matrix_best.csv"),
    "test": ("test_predictions.csv", "test_metrics.json", "test_per_class_metrics.csv", "test_confusion_matrix.csv"),
    "external_test": ("external_test_predictions.csv", "external_test_metrics.json", "external_test_per_class_metrics.csv", "external_test_confusion_matrix.csv"),
}
RUN_FILES = ("cost_metrics.json", "artifacts/train_subset_segments.csv", "artifacts/train_subset_groups.csv")
CLASS_FILES = tuple(own[2] for own in SPLIT_FILES.values())


def missing_run_files(spark: SparkSession, root: str, names: tuple[str, ...], **dimensions: list[str]) -> DataFrame:
    """(dimensions..., file, path) of files that runs lack; ``dimensions`` are the folders above them, in order."""
    cells = grid(spark, **dimensions, file=list(names))
    return runs.missing_files(spark, root, [cells], F.concat_ws("/", *dimensions, "file"))


def run_contract(spark: SparkSession, root: str, **dimensions: list[str]) -> DataFrame:
    """Everything that finished runs must have left and have not."""
    return missing_run_files(spark, root, tuple(f for own in SPLIT_FILES.values() for f in own) + RUN_FILES, **dimensions)


def class_contract(spark: SparkSession, root: str, **dimensions: list[str]) -> DataFrame:
    return missing_run_files(spark, root, CLASS_FILES, **dimensions)


def grid_problems(found: DataFrame, dimensions: dict[str, list], seeds: list[str], splits: list[str], seed: str = "seed") -> DataFrame:
    """(check, key, detail): runs that are missing, seeds that cells lack or have too many of, splits that groups lack."""
    spark, by = found.sparkSession, list(dimensions)
    key = F.concat_ws("/", *by)
    runs_ = grid(spark, **dimensions, **{seed: list(seeds)}).join(found.select(*by, seed).distinct(), [*by, seed], "left_anti")
    cells = found.groupBy(*by, "split").agg(F.array_sort(F.collect_set(seed)).alias("have")).where(F.col("have") != F.lit(sorted(seeds)))
    groups = found.groupBy(*by).agg(F.collect_set("split").alias("have")).withColumn("lacks", F.array_except(F.lit(list(splits)), "have")).where(F.size("lacks") > 0)
    return union([
        say(runs_, "run_missing", F.concat_ws("/", *by, seed)),
        say(cells, "seeds_differ", F.concat_ws("/", *by, "split"), F.array_join("have", ",")),
        say(groups, "split_missing", key, F.array_join("lacks", ",")),
    ])


def cost_problems(costs: DataFrame, methods: list[str], expected: int = 3) -> DataFrame:
    """Methods with another number of cost rows than expected."""
    wanted = grid(costs.sparkSession, method=list(methods))
    have = costs.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    return say(wanted.join(have, "method", "left").where(F.coalesce("n", F.lit(0)) != expected), "cost_rows", F.col("method"), F.coalesce("n", F.lit(0)))


def layer_problems(spark: SparkSession, found: DataFrame, root: str, layers: int, seeds: list[str], splits: list[str]) -> DataFrame:
    """Layer probes that are missing, or whose splits or cost files are."""
    names = [f"layer_{i:02d}" for i in range(layers)]
    files_ = missing_run_files(spark, root, ("cost_metrics.json",), layer=names, seed=list(seeds))
    return grid_problems(found, {"layer": names}, seeds, splits).unionByName(say(files_, "cost_missing", F.concat_ws("/", "layer", "seed")))


def pilot_problems(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with a pilot run: missing files, and predictions of another number than its metrics say."""
    lost = [(name, "") for name in (*(f for own in SPLIT_FILES.values() for f in own), *RUN_FILES) if not files.exists(spark, f"{folder}/{name}")]
    wrong = []
    for own in SPLIT_FILES.values():
        if all(files.exists(spark, f"{folder}/{f}") for f in own[:2]):
            n = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/{own[0]}").count()
            said = json.loads(files.read_text(spark, f"{folder}/{own[1]}")).get("num_samples")
            if n != said:
                wrong.append((own[0], f"{n} rows, {said} samples"))
    rows = [("file_missing", k, d) for k, d in lost] + [("rows_differ", k, d) for k, d in wrong]
    return spark.createDataFrame(rows, "check string, key string, detail string")


# ---- gates: each check gives (passed, what it saw) --------------------------------------------


def none_of(found: DataFrame) -> tuple[bool, str]:
    """Passed if a frame of violations is empty."""
    rows = found.limit(5).collect()
    return not rows, "; ".join(str(r.asDict()) for r in rows) or "none"


def runs_completed(registry: DataFrame, expected: list[str]) -> tuple[bool, str]:
    wanted = grid(registry.sparkSession, run_id=list(expected))
    return none_of(registries.not_completed(registry, wanted))


def report_passed(spark: SparkSession, path: str) -> tuple[bool, str]:
    """An audit report whose ``passed`` is true, and not merely something."""
    if not files.exists(spark, path):
        return False, f"no report at {path}"
    return json.loads(files.read_text(spark, path)).get("passed") is True, path


def files_exist(spark: SparkSession, paths: list[str]) -> tuple[bool, str]:
    lost = [p for p in paths if not files.exists(spark, p)]
    return not lost, f"missing {lost[:5]}" if lost else f"{len(paths)} there"


def folders_exist(spark: SparkSession, paths: list[str]) -> tuple[bool, str]:
    lost = [p for p in paths if not files.is_folder(spark, p)]
    return not lost, f"missing {lost[:5]}" if lost else f"{len(paths)} there"


def config_readable(spark: SparkSession, path: str) -> tuple[bool, str]:
    try:
        settings.read_yaml(spark, path)
    except GateError as e:
        return False, str(e)
    return True, path


def can_write(spark: SparkSession, folder: str) -> tuple[bool, str]:
    """Whether a file can be made in a folder of the session's store; it is made and removed."""
    probe = f"{folder.rstrip('/')}/.probe"
    try:
        files.write_text(spark, probe, "")
        files.remove(spark, probe)
    except Exception as e:  # whatever the store raises, the check only says so
        return False, f"{folder}: {str(e).splitlines()[0]}"
    return True, folder


def importable(package: str) -> tuple[bool, str]:
    return importlib.util.find_spec(package) is not None, package


def phase_gate(checks: dict[str, Callable[[], tuple[bool, str]]]) -> tuple[bool, list[str]]:
    """Run every check, whatever the others say; one that raises has failed."""
    seen = {}
    for name, check in checks.items():
        try:
            seen[name] = check()
        except Exception as e:
            seen[name] = (False, str(e))
    return gate(seen)


def phase_one(spark: SparkSession, root: str, reports: list[str], configs: list[str], models: list[str] = ()) -> tuple[bool, list[str]]:
    """Audits passed, configurations readable, models cached."""
    checks = {f"report {p}": lambda p=p: report_passed(spark, f"{root}/{p}") for p in reports}
    checks |= {f"config {p}": lambda p=p: config_readable(spark, f"{root}/{p}") for p in configs}
    return phase_gate(checks | {f"model {p}": lambda p=p: folders_exist(spark, [p]) for p in models})


def later_phase(spark: SparkSession, root: str, registry: DataFrame, expected: dict[str, list[str]], tables: list[str] = (), folders: list[str] = (), configs: list[str] = (), writable: list[str] = (), packages: list[str] = (), models: list[str] = (), confusions: DataFrame | None = None) -> tuple[bool, list[str]]:
    """The gate before phases two to four: earlier runs completed, their tables and files there, configurations, folders and packages fit."""
    checks: dict = {f"runs of {k}": lambda v=v: runs_completed(registry, v) for k, v in expected.items()}
    if tables:
        checks["tables"] = lambda: files_exist(spark, [f"{root}/{t}" for t in tables])
    if confusions is not None:
        checks["confusion files"] = lambda: none_of(confusions)
    if folders:
        checks["run folders"] = lambda: folders_exist(spark, [f"{root}/{f}" for f in folders])
    checks |= {f"config {p}": lambda p=p: config_readable(spark, f"{root}/{p}") for p in configs}
    checks |= {f"writable {p}": lambda p=p: can_write(spark, f"{root}/{p}") for p in writable}
    checks |= {f"package {p}": lambda p=p: importable(p) for p in packages}
    return phase_gate(checks | {f"model {p}": lambda p=p: folders_exist(spark, [p]) for p in models})


def run_names(prefix: str, *parts: list[str]) -> list[str]:
    """Every run's name: the prefix and one of each part."""
    out = [prefix]
    for own in parts:
        out = [f"{a}_{b}" for a in out for b in own]
    return out


def orchestrated(run: Callable[[dict], None], cells: list[dict], first: str | None = None, fail_fast: bool = False, status: Callable[[dict, str, str], None] | None = None) -> dict[tuple, str]:
    """Run every cell of a grid in order; what became of each.

    Cells whose ``seed`` is ``first`` go before the others, which are blocked if
    one of them fails; ``fail_fast`` blocks all that follow any failure. ``status``
    hears of each cell (for a registry).
    """
    ordered = [c for c in cells if first is None or c.get("seed") == first]
    ordered += [c for c in cells if c not in ordered]
    out, stopped = {}, False
    for n, cell in enumerate(ordered):
        if stopped:
            what, note = "blocked", "an earlier run failed"
        else:
            try:
                run(cell)
                what, note = "completed", ""
            except Exception as e:
                what, note = "failed", str(e)
                stopped = fail_fast or (first is not None and cell.get("seed") == first)
        out[tuple(cell.values())] = what
        if status:
            status(cell, what, note)
    return out


def rolled_up_or_stop(rollup: Callable[[], None], update: Callable[[], None]) -> None:
    """The matrix is only updated after the rollup went through."""
    try:
        rollup()
    except Exception as e:
        raise GateError(f"rollup failed, the matrix stays as it is: {e}") from e
    update()
