"""Manual review: decisions by join, pending queues by anti-join, checks as violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the review file.
SINGLE_TYPES = ("bit_depth_review", "content_type_review")
PAIR_TYPES = ("cross_duplicate_review", "fingerprint_review")
MERGE_TYPES = ("fingerprint_review", "group_merge_review")
DECISIONS = ("approved", "rejected")
BIT_DEPTHS = ("16", "24", "32")
CONTENT_TYPES = ("phrase", "technique", "controlled")


def pair_key(a: Column, kind: Column, b: Column) -> Column:
    """A key that is the same for (a, b) and (b, a)."""
    return F.concat_ws("|", F.least(a, b), kind, F.greatest(a, b))


def pending(items: DataFrame, decisions: DataFrame, on: list[str]) -> DataFrame:
    """Items without a decision."""
    return items.join(decisions.select(*on).distinct(), on, "left_anti")


def pending_pairs(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pairs (record_id, review_type, peer_record_id) without a decision in either direction."""
    key = pair_key(F.col("record_id"), F.col("review_type"), F.col("peer_record_id"))
    return items.withColumn("_key", key).join(decisions.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def applied(df: DataFrame, decisions: DataFrame, record: str = "record_id") -> DataFrame:
    """Overrides and rejections of single-row reviews.

    ``decisions(record_id, review_type, decision, value)``. An approval sets the
    field; a rejection drops the row with the type's own reason, the later type
    winning if both reject.
    """
    kind = lambda t, d: (F.col("review_type") == t) & (F.col("decision") == d)
    held = decisions.groupBy("record_id").agg(
        F.max(F.when(kind("bit_depth_review", "approved"), F.col("value"))).alias("_depth"),
        F.max(F.when(kind("content_type_review", "approved"), F.col("value"))).alias("_kind"),
        F.coalesce(F.bool_or(kind("bit_depth_review", "rejected")), F.lit(False)).alias("_no_depth"),
        F.coalesce(F.bool_or(kind("content_type_review", "rejected")), F.lit(False)).alias("_no_kind"),
    ).withColumnRenamed("record_id", "_record")
    out = df.join(held, df[record] == held["_record"], "left")
    rejected = F.coalesce(F.col("_no_depth") | F.col("_no_kind"), F.lit(False))
    reason = F.when(F.col("_no_kind"), "label_requires_guess").when(F.col("_no_depth"), "unrecognized_encoding").otherwise(F.col("drop_reason"))
    return (
        out.withColumn("bit_depth", F.coalesce(F.col("_depth").try_cast("int"), F.col("bit_depth")))
        .withColumn("content_type", F.coalesce("_kind", "content_type"))
        .withColumn("drop_reason", reason)
        .withColumn("sample_status", F.when(rejected, "drop").otherwise(F.col("sample_status")))
        .withColumn("review_status", F.when(rejected, "rejected").when(F.col("_record").isNotNull(), "approved").otherwise(F.lit("")))
        .drop("_record", "_depth", "_kind", "_no_depth", "_no_kind")
    )


def pair_status(decisions: DataFrame) -> DataFrame:
    """(record_id, review_status) of both ends of pair decisions; a rejection dominates."""
    ends = decisions.select(F.explode(F.array("record_id", "peer_record_id")).alias("record_id"), (F.col("decision") == "rejected").alias("no"))
    return ends.groupBy("record_id").agg(F.when(F.bool_or("no"), "rejected").otherwise("approved").alias("review_status"))


def violations(review: DataFrame, required: tuple[str, ...] = ("record_id", "review_type", "decision"), types: tuple[str, ...] = SINGLE_TYPES + PAIR_TYPES + MERGE_TYPES[1:], reasons: DataFrame | None = None) -> DataFrame:
    """Everything wrong with a review table: (check, record_id, detail); none if it may be used."""
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    say = lambda rows, check, detail: rows.select(F.lit(check).alias("check"), F.coalesce("record_id", F.lit("")).alias("record_id"), detail.cast("string").alias("detail"))
    kind, approved, rejected = F.col("review_type"), F.col("decision") == "approved", F.col("decision") == "rejected"
    pair, value = kind.isin(*PAIR_TYPES, *MERGE_TYPES), F.coalesce("value", F.lit(""))
    found = [say(review.where(empty(c)), "required_empty", F.lit(c)) for c in required]
    found += [
        say(review.where(~empty("review_type") & ~kind.isin(*types)), "unknown_type", kind),
        say(review.where(~empty("decision") & ~F.col("decision").isin(*DECISIONS)), "unknown_decision", F.col("decision")),
        say(review.where(pair & empty("peer_record_id")), "peer_missing", kind),
        say(review.where(pair & (F.col("record_id") == F.col("peer_record_id"))), "self_pair", F.col("peer_record_id")),
        say(review.where(approved & (kind == "bit_depth_review") & ~value.isin(*BIT_DEPTHS)), "bad_bit_depth", value),
        say(review.where(approved & (kind == "content_type_review") & ~value.isin(*CONTENT_TYPES)), "bad_content_type", value),
        say(review.where(approved & (kind == "cross_duplicate_review") & (value != F.col("record_id")) & (value != F.col("peer_record_id"))), "bad_canonical", value),
        say(review.where(rejected & kind.isin(*MERGE_TYPES) & ~empty("drop_reason")), "merge_with_reason", F.col("drop_reason")),
    ]
    if reasons is not None:
        found.append(say(review.where(rejected & ~kind.isin(*MERGE_TYPES)).join(reasons, ["review_type", "drop_reason"], "left_anti"), "reason_not_allowed", F.col("drop_reason")))
    key = F.when(pair, pair_key(F.col("record_id"), kind, F.col("peer_record_id"))).otherwise(F.concat_ws("|", "record_id", kind))
    again = review.withColumn("_key", key).groupBy("_key").agg(F.min("record_id").alias("record_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found.append(say(again, "repeated_key", F.col("_key")))
    return reduce(DataFrame.unionByName, found)


def merge_violations(merges: DataFrame, audit: DataFrame) -> DataFrame:
    """Merge decisions whose ends do not exist, are dropped, or differ in source or family."""
    side = lambda p: audit.select(F.col("record_id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in ("sample_status", "source_dataset", "family_label")))
    both = merges.join(side("r"), F.col("record_id") == F.col("r_id"), "left").join(side("p"), F.col("peer_record_id") == F.col("p_id"), "left")
    problem = (
        F.when(F.col("r_id").isNull() | F.col("p_id").isNull(), "unknown_record")
        .when((F.col("r_sample_status") != "keep") | (F.col("p_sample_status") != "keep"), "dropped_record")
        .when(F.col("r_source_dataset") != F.col("p_source_dataset"), "other_source")
        .when(F.col("r_family_label") != F.col("p_family_label"), "other_family")
    )
    return both.select("record_id", "peer_record_id", problem.alias("problem")).where("problem is not null")
