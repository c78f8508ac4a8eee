"""Ordered quality rules: the first reason decides, the trail keeps every rule that fired."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import appended


@dataclass(frozen=True)
class QcRule:
    """``rule`` fires where ``condition`` holds and gives ``reason``."""

    rule: str
    condition: Column
    reason: str


def audio_rules(min_duration: float = 3.0) -> list[QcRule]:
    """Decode, duration, silence and clipping; thresholds of the last two come as columns."""
    ok = F.col("is_decodable")
    return [
        QcRule("D03", ~ok, "decode_failure"),
        QcRule("D04", ok & (F.col("duration_sec") < min_duration), "too_short"),
        QcRule("D05a", ok & (F.col("silence_ratio") > F.col("silence_threshold")), "excessive_silence"),
        QcRule("D06a", ok & (F.col("clipping_ratio") > F.col("clipping_threshold")), "severe_distortion"),
    ]


def apply_rules(df: DataFrame, rules: Sequence[QcRule], trail: str = "applied_rule_ids", reason: str = "drop_reason", status: str = "sample_status") -> DataFrame:
    """Adds trail (array), reason (first that fired, or empty) and status (drop or keep)."""
    fired = F.array_compact(F.array(*(F.when(r.condition, r.rule) for r in rules)))
    first = F.coalesce(*(F.when(r.condition, r.reason) for r in rules), F.lit(""))
    return df.withColumn(trail, fired).withColumn(reason, first).withColumn(status, F.when(F.col(reason) == "", "keep").otherwise("drop"))


def pending_after_qc(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept rows with unknown bit depth (rule I10) or content type need review.

    Returns the rows with flags and trail, and the queue (record_id, review_type, trigger_rule_id).
    """
    kept = F.col("sample_status") == "keep"
    depth, kind = kept & (F.col("bit_depth") == -1), kept & (F.coalesce("content_type", F.lit("")) == "")
    flagged = df.withColumn("review_required", depth | kind).withColumn("applied_rule_ids", appended(F.col("applied_rule_ids"), F.when(depth, "I10")))
    items = F.array_compact(F.array(F.when(depth, F.struct(F.lit("bit_depth_review").alias("review_type"), F.lit("I10").alias("trigger_rule_id"))), F.when(kind, F.struct(F.lit("content_type_review").alias("review_type"), F.lit("I01").alias("trigger_rule_id")))))
    return flagged, df.select("record_id", F.explode(items).alias("x")).select("record_id", "x.*")


def resolved_threshold(df: DataFrame, overrides: DataFrame, key: str, default: float, out: str, family: str = "family_label", source: str = "source_dataset", only_sources: dict[str, str] | None = None) -> DataFrame:
    """``out``: the first override of a row's family and ``key`` whose scope holds, else ``default``.

    ``overrides(pos, family, threshold_key, scope, value)`` is a configuration
    table. A scope holds for every source, unless ``only_sources`` ties it to one.
    """
    own = overrides.where(F.col("threshold_key") == key)
    allowed = F.lit(True)
    for scope, only in (only_sources or {}).items():
        allowed &= (F.col("scope") != scope) | (F.col("_source") == only)
    keys = df.select(F.col(family).alias("_family"), F.col(source).alias("_source")).distinct()
    best = keys.join(own, F.col("_family") == F.col("family")).where(allowed).groupBy("_family", "_source").agg(F.min_by("value", "pos").alias("_value"))
    out_df = df.join(best, (df[family] == best["_family"]) & (df[source] == best["_source"]), "left")
    return out_df.withColumn(out, F.coalesce(F.col("_value").cast("double"), F.lit(float(default)))).drop("_family", "_source", "_value")


def status_counts(df: DataFrame, by: str = "family_label") -> DataFrame:
    """Rows kept and dropped per family."""
    return df.groupBy(by).agg(F.count_if(F.col("sample_status") == "keep").alias("kept"), F.count_if(F.col("sample_status") == "drop").alias("dropped"), F.count(F.lit(1)).alias("total"))
