"""Gates and audits: every check is a frame of violations, and an empty one passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import duplicate_keys, missing_cells
from .split import leaks


class GateError(ValueError):
    """A fatal check found violations."""


def say(rows: DataFrame, check: str, key: Column, detail: Column | None = None) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), key.cast("string").alias("key"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def require(found: DataFrame, what: str) -> None:
    """Raise with a few examples if there are violations."""
    if rows := found.limit(5).collect():
        raise GateError(f"{what}: {[r.asDict() for r in rows]}")


def replacement_gates(df: DataFrame, families: DataFrame, family: str, group: str, least: int = 25, share: float = 0.40, least_groups: int = 3, wanted_groups: int = 7) -> DataFrame:
    """R01 rows kept, R02 rows against the median of the classes, R03 distinct groups."""
    kept = df.where("sample_status = 'keep'").groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.coalesce(F.col(group).cast("string"), F.lit("")) != "", F.col(group))).alias("groups"))
    full = families.select(family).join(kept, family, "left").na.fill(0, ["n", "groups"])
    middle = full.agg(F.median("n").alias("median"))
    checks = F.array_compact(
        F.array(
            F.when(F.col("n") < least, F.struct(F.lit("R01").alias("check"), F.col("n").cast("double").alias("detail"))),
            F.when(F.col("n") < share * F.col("median"), F.struct(F.lit("R02").alias("check"), F.col("n").cast("double").alias("detail"))),
            F.when(F.col("groups") < least_groups, F.struct(F.lit("R03_hard").alias("check"), F.col("groups").cast("double").alias("detail"))),
            F.when((F.col("groups") >= least_groups) & (F.col("groups") < wanted_groups), F.struct(F.lit("R03").alias("check"), F.col("groups").cast("double").alias("detail"))),
        )
    )
    return full.crossJoin(middle).select(family, F.explode(checks).alias("x")).select(F.col("x.check").alias("check"), F.col(family).cast("string").alias("key"), F.col("x.detail").alias("detail"))


def balance_monitors(df: DataFrame, family: str) -> DataFrame:
    """One row: the share of controlled and technique rows, and the least class over the largest."""
    classes = df.groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("content_type").isin("controlled", "technique")).alias("c"))
    return classes.agg((F.sum("c") / F.sum("n")).alias("controlled_share"), (F.min("n") / F.max("n")).alias("class_ratio"))


def freeze_gates(df: DataFrame, families: DataFrame, family: str, source: str, accepted: DataFrame, external: str = "ChMusic", least: int = 4) -> DataFrame:
    """Open reviews, too few external rows unless accepted, labels that are not active."""
    kept = df.where("sample_status = 'keep'")
    few = families.select(family).join(kept.where(F.col(source) == external).groupBy(family).agg(F.count(F.lit(1)).alias("n")), family, "left").where(F.coalesce("n", F.lit(0)) < least)
    return union([
        say(kept.where("review_status = 'pending'"), "pending_review", F.col("record_id")),
        say(few.join(accepted.select(family), family, "left_anti"), "too_few_external", F.col(family), F.coalesce("n", F.lit(0))),
        say(kept.join(families.select(family), family, "left_anti"), "inactive_label", F.col("record_id"), F.col(family)),
    ])


def final_checks(frozen: DataFrame, split: DataFrame, segments: DataFrame, families: DataFrame, files: DataFrame | None = None, exempt: DataFrame | None = None) -> DataFrame:
    """The last checks over frozen rows, split rows (all seeds) and segments."""
    spark = frozen.sparkSession
    splits = spark.range(1).select(F.explode(F.array(*(F.lit(s) for s in ("train", "val", "test", "external_test")))).alias("split"))
    seeds = split.select("split_seed").distinct()
    cells = missing_cells([seeds, families.select("family_label"), splits], segments, ["split_seed", "family_label", "split"])
    if exempt is not None:
        cells = cells.join(exempt, ["split_seed", "family_label", "split"], "left_anti")
    torn = split.groupBy("split_seed", "recording_group_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")
    found = [
        say(frozen.where("review_status = 'pending'"), "pending_review", F.col("record_id")),
        say(frozen.join(families.select("family_label"), "family_label", "left_anti"), "inactive_label", F.col("record_id")),
        say(frozen.where("not is_decodable"), "not_decodable", F.col("record_id")),
        say(duplicate_keys(frozen, ["audio_sha256"]), "repeated_digest", F.col("audio_sha256"), F.col("n")),
        say(torn, "group_in_several_splits", F.col("recording_group_id"), F.col("split_seed")),
        say(cells, "empty_cell", F.col("family_label"), F.concat_ws("/", F.col("split_seed").cast("string"), "split")),
    ]
    if files is not None:
        named = segments.select(F.col("segment_path").alias("path"))
        found += [say(named.join(files, "path", "left_anti"), "missing_file", F.col("path")), say(files.join(named, "path", "left_anti"), "unlisted_file", F.col("path"))]
    return union(found)


def contract_audit(df: DataFrame, seed: dict, labels: DataFrame, allowed: DataFrame, keys: list[str], files: DataFrame | None = None) -> DataFrame:
    """Violations of one seed's unified table: (check, key, detail).

    ``seed``: the values every row must have; ``allowed(source_dataset, split)``;
    ``labels(family_label, label_id)``; ``keys``: identifiers that must not leak
    (sources outside ``allowed`` are not constrained).
    """
    found = [say(df.where(~F.col(c).eqNullSafe(F.lit(v))), f"wrong_{c}", F.col("segment_id"), F.col(c)) for c, v in seed.items()]
    ruled = df.join(allowed.select("source_dataset").distinct(), "source_dataset", "left_semi")
    pairs = df.select("family_label", "label_id").distinct()
    found += [
        say(df.where(~F.col("split").isin("train", "val", "test", "external_test")), "unknown_split", F.col("segment_id"), F.col("split")),
        say(ruled.join(allowed, ["source_dataset", "split"], "left_anti"), "source_in_wrong_split", F.col("segment_id"), F.col("split")),
        say(labels.join(pairs, "family_label", "left_anti"), "class_missing", F.col("family_label")),
        say(pairs.join(labels, ["family_label", "label_id"], "left_anti"), "label_mismatch", F.col("family_label"), F.col("label_id")),
        say(leaks(df, keys), "leak", F.concat_ws("=", "key_name", "key"), F.array_join("splits", ",")),
        say(duplicate_keys(df, ["segment_id"]), "repeated_segment", F.col("segment_id"), F.col("n")),
    ]
    if files is not None:
        found.append(say(df.select("segment_path").distinct().join(files.select(F.col("path").alias("segment_path")), "segment_path", "left_anti"), "missing_file", F.col("segment_path")))
    return union(found)


def audit_report(found: DataFrame) -> DataFrame:
    """Violations per check."""
    return found.groupBy("check").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("example"))


def batch_violations(df: DataFrame, classes: int, samples: int = 120_000) -> DataFrame:
    """Segments of the wrong length, labels out of range, external rows of other sources."""
    return union([
        say(df.where(F.size("waveform") != samples), "wrong_length", F.col("segment_id"), F.size("waveform")),
        say(df.where(~F.col("label_id").between(0, classes - 1)), "label_out_of_range", F.col("segment_id"), F.col("label_id")),
        say(df.where("split = 'external_test' and source_dataset <> 'ChMusic'"), "external_source", F.col("segment_id"), F.col("source_dataset")),
    ])


def audio_conformance(df: DataFrame, rate: int = 24_000, channels: int = 1, seconds: float = 5.0) -> DataFrame:
    """Header columns that differ from what segments must have; a sample more or less is fine."""
    return union([
        say(df.where(F.col("sample_rate_hz") != rate), "wrong_rate", F.col("path"), F.col("sample_rate_hz")),
        say(df.where(F.col("channels") != channels), "wrong_channels", F.col("path"), F.col("channels")),
        say(df.where(F.abs(F.col("duration_sec") - seconds) > 1.0 / rate), "wrong_duration", F.col("path"), F.col("duration_sec")),
    ])


def subset_audit(full: DataFrame, subsets: DataFrame, labels: DataFrame, group: str = "recording_group_id", segment: str = "segment_id") -> DataFrame:
    """(subset, check, passed) for every subset: contained, train only, whole groups, all classes, no repeats."""
    names = subsets.select("subset").distinct()
    outside = subsets.join(full.where("split = 'train'"), segment, "left_anti").select("subset").distinct()
    rows = subsets.join(full.select(segment, F.col(group).alias("_g"), F.col("family_label").alias("_f")), segment)
    sizes = full.where("split = 'train'").groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("all"))
    torn = rows.groupBy("subset", "_g").agg(F.count(F.lit(1)).alias("n")).join(sizes, "_g").where("n <> all").select("subset").distinct()
    lacking = names.crossJoin(labels.select(F.col("family_label").alias("_f"))).join(rows, ["subset", "_f"], "left_anti").select("subset").distinct()
    again = duplicate_keys(subsets, ["subset", segment]).select("subset").distinct()
    checks = {"contained_in_train": outside, "whole_groups": torn, "all_classes": lacking, "no_repeats": again}
    return union([names.join(bad.withColumn("_bad", F.lit(True)), "subset", "left").select("subset", F.lit(check).alias("check"), F.col("_bad").isNull().alias("passed")) for check, bad in checks.items()])
