"""The review file: its columns and codes, its checks, and the queue of what is still open."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review
from ..operators.gates import GateError, require
from . import files

#: Columns, codes of review types, the fields each type may use, and the reasons it may drop for.
COLUMNS = ["record_id", "review_type", "decision", "drop_reason", "content_type_override", "peer_record_id", "canonical_record_id", "bit_depth_override", "justification", "reviewer"]
QUEUE = ["record_id", "review_type", "source_dataset", "family_label", "file_name", "source_path", "trigger_rule_id", "trigger_detail", "peer_record_id"]
TYPES = {"content_type": "content_type_review", "i10_encoding": "bit_depth_review", "d09_cross": "cross_duplicate_review", "g02_fingerprint": "fingerprint_review", "manual_merge": "group_merge_review"}
FIELDS = {"content_type_review": ("content_type_override",), "bit_depth_review": ("bit_depth_override",), "cross_duplicate_review": ("peer_record_id", "canonical_record_id"), "fingerprint_review": ("peer_record_id",), "group_merge_review": ("peer_record_id",)}
REASONS = (("content_type_review", "label_requires_guess"), ("bit_depth_review", "unrecognized_encoding"), ("cross_duplicate_review", "exact_duplicate"))


def _named(column, names: dict[str, str]):
    """``column`` by ``names``; what they lack stays as it is."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), column)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """The review file as decisions, all checks passed; no file means no decisions.

    Columns: record_id, review_type, decision, value, peer_record_id, drop_reason,
    position (the order of the file), justification, reviewer.
    """
    if not files.exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} {'long' if c == 'position' else 'string'}" for c in ("record_id", "review_type", "decision", "value", "peer_record_id", "drop_reason", "position", "justification", "reviewer")))
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    if set(rows.columns) != set(COLUMNS):
        raise GateError(f"{path}: columns missing {sorted(set(COLUMNS) - set(rows.columns))}, unknown {sorted(set(rows.columns) - set(COLUMNS))}")
    rows = rows.select(*(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in COLUMNS)).withColumn("review_type", _named(F.col("review_type"), TYPES))
    first = lambda *names: F.coalesce(*(F.when(F.col(n) != "", F.col(n)) for n in names), F.lit(""))
    # People write this file: it is one small file, read in its order.
    found = rows.coalesce(1).withColumn("position", F.monotonically_increasing_id()).withColumn("value", first("content_type_override", "bit_depth_override", "canonical_record_id"))
    require(review_problems(found), f"review file {path}")
    return found.select("record_id", "review_type", "decision", "value", "peer_record_id", "drop_reason", "position", "justification", "reviewer")


def review_problems(found: DataFrame) -> DataFrame:
    """Violations (check, record_id, detail) of a review table with all its columns."""
    spark = found.sparkSession
    reasons = spark.createDataFrame(list(REASONS), "review_type string, drop_reason string")
    unused = [
        found.where((F.col("review_type") == kind) & (F.col(c) != "")).select(F.lit("field_not_applicable").alias("check"), "record_id", F.lit(c).alias("detail"))
        for kind, own in FIELDS.items()
        for c in ("peer_record_id", "canonical_record_id", "bit_depth_override", "content_type_override")
        if c not in own
    ]
    return reduce(DataFrame.unionByName, unused, review.violations(found, required=("record_id", "review_type", "decision", "justification", "reviewer"), reasons=reasons))


def write_queue(items: DataFrame, audit: DataFrame, folder: str) -> str:
    """Write what waits for decisions (record_id, review_type, trigger_rule_id, ...) with the records' names; where it lies."""
    have = set(items.columns)
    rows = items.select("record_id", "review_type", *(F.col(c) if c in have else F.lit("").alias(c) for c in ("trigger_rule_id", "trigger_detail", "peer_record_id")))
    named = rows.join(audit.select("record_id", "source_dataset", "family_label", "file_name", "source_path"), "record_id", "left")
    path = f"{folder.rstrip('/')}/pending_review_queue.csv"
    files.write_csv(named.withColumn("review_type", _named(F.col("review_type"), {v: k for k, v in TYPES.items()})).select(*QUEUE).orderBy("record_id", "review_type", "peer_record_id"), path)
    return path
