"""Audits as runs: a report, the errors it counts, metadata, a row of the registry, and an exit code.

What is found stays a frame: reports hold counts and a bounded number of
examples, and the errors file is written by Spark.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates
from ..operators.registry import upserted
from ..session import settled
from ..sources import files, results

#: The columns of the registry, and of the two errors files.
REGISTRY = ("run_id", "experiment_id", "phase", "task_type", "model", "seed_name", "seed_index", "base_seed", "status", "output_dir", "started_at", "finished_at", "notes")
CONTRACT_ERRORS = ("seed", "check", "severity", "detail")
AUDIO_ERRORS = ("seed", "split", "segment_id", "segment_abs_path", "status", "detail")
#: Violations that a report spells out; all of them are in the errors file.
SHOWN = 100


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry as strings, with the place of each row; empty if there is no file yet."""
    schema = ", ".join(f"{c} string" for c in REGISTRY)
    if not files.exists(spark, path):
        return spark.createDataFrame([], schema + ", place long")
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path).na.fill("")
    return settled(rows.withColumn("place", F.monotonically_increasing_id()))


def recorded(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """Write runs into the registry: the first row of a run_id is replaced, new ones come last, by name. The file is replaced at once."""
    old = read_registry(spark, path)
    new = spark.createDataFrame([tuple(str(r.get(c, "")) for c in REGISTRY) for r in rows], ", ".join(f"{c} string" for c in REGISTRY))
    both = upserted(old, new, "run_id", position="place").orderBy(F.col("place").asc_nulls_last(), "run_id")
    files.write_csv(settled(both.select(*REGISTRY)), path)


def recorder(spark: SparkSession, path: str, describe: Callable[[dict], dict]) -> Callable[[dict, str, str], None]:
    """A ``status`` of ``phases.orchestrated``: a failed or blocked run gets a row at once; a completed one writes its own.

    ``describe`` gives a cell's run_id, experiment_id, phase and the like.
    """

    def status(cell: dict, what: str, note: str) -> None:
        if what != "completed":
            now = results.now()
            recorded(spark, path, [describe(cell) | {"status": what, "started_at": now, "finished_at": now, "notes": note}])

    return status


def finished(spark: SparkSession, folder: str, registry: str, run_id: str, experiment: str, phase, task: str, model: str, started: str, notes: str, seed: dict | None = None) -> None:
    """Metadata of a run that went through, and its row of the registry."""
    seed = seed or dict.fromkeys(("seed_name", "seed_index", "base_seed"), "all")
    done = results.now()
    results.write_run_meta(spark, f"{folder}/run_meta.json", run_id, seed["seed_name"], seed["seed_index"], seed["base_seed"], "v1", started, done, extra={"task_type": task, "model": model})
    recorded(spark, registry, [{"run_id": run_id, "experiment_id": experiment, "phase": phase, "task_type": task, "model": model, **seed, "status": "completed", "output_dir": folder, "started_at": started, "finished_at": done, "notes": notes}])


def histogram(df: DataFrame, column: str) -> dict:
    return {str(r[0]): r[1] for r in files.bounded(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column))}


def seed_problems(index: int, seed: dict, listed: list[dict]) -> list[str]:
    """Where a seed's configuration and the data set's list of seeds disagree."""
    found = []
    if seed.get("seed_name") != f"seed{index}":
        found.append(f"seed_name is {seed.get('seed_name')!r}, not 'seed{index}'")
    if seed.get("seed_index") != index:
        found.append(f"seed_index is {seed.get('seed_index')!r}, not {index}")
    if index < len(listed) and seed.get("base_seed") != listed[index].get("base_seed"):
        found.append(f"base_seed is {seed.get('base_seed')!r}, not {listed[index].get('base_seed')!r}")
    return found


def audit_contracts(
    spark: SparkSession, folder: str, registry: str, seeds: dict[int, Callable[[], DataFrame]], labels: DataFrame, allowed: DataFrame, keys: list[str],
    configs: dict[int, dict] | None = None, listed: list[dict] | None = None, listing: DataFrame | None = None, warnings: tuple[str, ...] = (),
) -> int:
    """The data contract of every seed's table: writes ``data_contract_report.json`` and ``data_contract_errors.csv``; 1 if an error blocks, else 0.

    ``seeds`` gives a seed's table; one that cannot be read or joined is an error
    of its own. ``configs`` holds each seed's configuration, which must agree
    with the ``listed`` seeds and with the table. Checks named in ``warnings`` do not block.
    """
    started, found, summaries = results.now(), [], {}
    error = lambda seed, rows: rows.select(F.lit(seed).alias("seed"), "check", F.when(F.col("check").isin(*warnings), "warning").otherwise("blocking_error").alias("severity"), F.concat_ws(": ", F.col("key").cast("string"), "detail").alias("detail"))
    one = lambda seed, check, details: error(seed, spark.createDataFrame([(check, "", d) for d in details], "check string, key string, detail string"))
    for index, load in sorted(seeds.items()):
        config = (configs or {}).get(index, {})
        if wrong := seed_problems(index, config, listed or []) if configs else []:
            found.append(one(index, "seed_mapping_consistency", wrong))
        try:
            table = settled(load())
        except Exception as e:  # the audit says what is wrong with a table, whatever it is
            found.append(one(index, "manifest_load", [str(e).splitlines()[0]]))
            continue
        expected = {k: v for k, v in config.items() if k in table.columns}
        found.append(error(index, gates.contract_audit(table, expected, labels, allowed, keys, listing)))
        summaries[f"seed{index}"] = {"total_segments": table.count(), **{name: histogram(table, c) for name, c in (("splits", "split"), ("classes", "family_label"), ("sources", "source_dataset"))}}
    every = settled(reduce(DataFrame.unionByName, found or [one(0, "", [])]))
    counts = histogram(every, "severity")
    blocking = counts.get("blocking_error", 0)
    ordered = every.select(*CONTRACT_ERRORS).orderBy(*CONTRACT_ERRORS)
    report = {
        "audit_type": "data_contract", "timestamp": results.now(), "num_seeds_audited": len(seeds), "num_blocking_errors": blocking, "num_warnings": counts.get("warning", 0), "passed": blocking == 0,
        "seed_summaries": summaries, "checks": histogram(every, "check"), "errors": [r.asDict() for r in ordered.limit(SHOWN).collect()],
    }
    files.write_json(spark, f"{folder}/data_contract_report.json", report)
    files.write_csv(ordered, f"{folder}/data_contract_errors.csv")
    finished(spark, folder, registry, "run_audit_contract", "smoke_audit", 0, "audit", "data_contract", started, f"{len(seeds)} seeds {'all passed' if not blocking else f'{blocking} blocking errors'}")
    return int(blocking > 0)


def audit_audio(spark: SparkSession, folder: str, registry: str, segments: DataFrame, headers: DataFrame, limits: dict[str, int] | None = None, rate: int = 24_000, channels: int = 1, seconds: float = 5.0) -> int:
    """Whether sampled segment files are what segments must be: writes ``audio_io_audit.json`` and ``audio_io_failures.csv``; 1 on a failure, else 0.

    ``segments(seed, split, segment_id, segment_abs_path)``; of each seed and
    split the first by identifier are checked, as many as ``limits`` says (all
    without). ``headers`` are rows of ``audio.profile`` by path; a file without one cannot be read.
    """
    from ..operators.numbering import first_rows

    started, rows = results.now(), segments.select("seed", "split", "segment_id", "segment_abs_path")
    if limits is not None:
        named = rows.withColumn("cell", F.concat_ws("/", F.col("seed").cast("string"), "split"))
        most = F.coalesce(*(F.when(F.col("split") == s, n) for s, n in limits.items()), F.lit(0))
        rows = first_rows(named, "cell", ["segment_id"], named.select("cell", "split").distinct().select("cell", most.alias("limit"))).drop("cell")
    own = headers.select(F.col("path").alias("segment_abs_path"), "sample_rate_hz", "channels", "duration_sec", "is_decodable")
    checked = rows.join(own, "segment_abs_path", "left")
    detail = (
        F.when(~F.coalesce("is_decodable", F.lit(False)), "decode_error")
        .when(F.col("sample_rate_hz") != rate, F.format_string(f"sample_rate=%d, expected {rate}", "sample_rate_hz"))
        .when(F.col("channels") != channels, F.format_string(f"channels=%d, expected {channels}", "channels"))
        .when(F.abs(F.col("duration_sec") - seconds) > 1.0 / rate, F.format_string(f"duration=%.6fs, expected {seconds}s", "duration_sec"))
    )
    checked = settled(checked.withColumn("detail", F.coalesce(detail, F.lit(""))).withColumn("status", F.when(F.col("detail") == "", "ok").otherwise("blocking_error")).select(*AUDIO_ERRORS))
    failures = checked.where("status <> 'ok'").orderBy("seed", "split", "segment_id")
    counts = histogram(checked, "status")
    n, bad = sum(counts.values()), counts.get("blocking_error", 0)
    report = {"audit_type": "audio_io", "timestamp": results.now(), "num_seeds_audited": len(histogram(checked, "seed")), "total_files_checked": n, "num_blocking_errors": bad, "passed": bad == 0, "expected_spec": {"sample_rate": rate, "channels": channels, "duration_sec": seconds, "tolerance_samples": 1}}
    files.write_json(spark, f"{folder}/audio_io_audit.json", report)
    files.write_csv(failures, f"{folder}/audio_io_failures.csv")
    finished(spark, folder, registry, "run_audit_audio_io", "smoke_audio_io", 0, "audit", "audio_io", started, f"{n} files checked")
    return int(bad > 0)
