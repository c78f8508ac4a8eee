"""Manifest tables: readers that check columns, and sinks with fixed formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cell
from ..operators.gates import GateError
from ..operators.joins import duplicate_keys, many_to_one, unmatched

JOIN_KEYS = ["sample_id", "split_seed", "split"]
CASTS = {"split_seed": "int", "segment_index": "int", "start_sec": "double", "end_sec": "double"}


def read_manifest(spark: SparkSession, path: str, required: list[str] = (), null_empty: bool = False) -> DataFrame:
    """A CSV manifest as strings. Empty cells stay empty strings, or become null if asked for."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    if missing := [c for c in required if c not in df.columns]:
        raise GateError(f"{path} lacks columns {missing}")
    return df if null_empty else df.na.fill("")


def write_manifest(df: DataFrame, path: str, columns: list[str], order: list[str] = (), files: int | None = 1) -> None:
    """Fixed columns (missing ones empty), fixed cell formats, rows by ``order`` in code points.

    ``files`` 1 gives one file with one header; None lets the sorted ranges be
    files of their own, in the order of their names, each with the header.
    """
    kinds = dict(df.dtypes)
    cells = [(F.array_join(F.col(c), ",") if kinds.get(c, "").startswith("array") else cell(F.col(c), kinds[c])).alias(c) if c in kinds else F.lit("").alias(c) for c in columns]
    rows = df.select(*cells)
    if order:
        rows = rows.orderBy(*order)
    (rows if files is None else rows.coalesce(files)).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("lineSep", "\n").csv(path)


def joined_manifests(split: DataFrame, segments: DataFrame, same: list[str] = ("family_label", "source_dataset", "recording_group_id")) -> DataFrame:
    """Segments with their split row's columns; every segment must have one, and they must agree."""
    if bad := unmatched(segments, split, JOIN_KEYS).limit(5).collect():
        raise GateError(f"segments without a split row: {[r['segment_id'] for r in bad]}")
    both = many_to_one(segments, split.withColumnsRenamed({c: f"{c}_split" for c in same if c in segments.columns}), JOIN_KEYS)
    twins = [c for c in same if c in segments.columns]
    for c in twins:
        if bad := both.where(~F.col(c).eqNullSafe(F.col(f"{c}_split"))).limit(5).collect():
            raise GateError(f"{c} differs between the manifests: {[r['segment_id'] for r in bad]}")
    return both.drop(*(f"{c}_split" for c in twins))


def label_map(spark: SparkSession, classes: dict[str, int]) -> DataFrame:
    """(family_label, label_id); ids must be 0 to n - 1."""
    if sorted(classes.values()) != list(range(len(classes))):
        raise GateError(f"label ids are not contiguous: {sorted(classes.values())}")
    return spark.createDataFrame(sorted(classes.items(), key=lambda x: x[1]), "family_label string, label_id int")


def unified(joined: DataFrame, labels: DataFrame, audio_root: str) -> DataFrame:
    """Label ids, absolute paths and casts; a label that is not in the map is an error."""
    if bad := unmatched(joined, labels, ["family_label"]).limit(5).collect():
        raise GateError(f"unknown labels: {sorted({r['family_label'] for r in bad})}")
    out = joined.join(labels, "family_label").withColumn("audio_path", F.concat_ws("/", F.lit(audio_root.rstrip("/")), F.format_string("seed%s", F.col("split_seed").cast("string")), "segment_path"))
    for c, kind in CASTS.items():
        if c in out.columns:
            out = out.withColumn(c, F.col(c).cast(kind))
    return out


def train_subset(table: DataFrame, listed: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """Listed train rows in the list's order, and all rows of other splits (position null).

    ``listed(position, segment_id)``. Raises if the list repeats, names rows that
    are no train rows, or has another size than expected.
    """
    if duplicate_keys(listed, ["segment_id"]).limit(1).collect():
        raise GateError("the subset lists a segment twice")
    if expected_rows is not None and (n := listed.count()) != expected_rows:
        raise GateError(f"the subset lists {n} segments, its metadata {expected_rows}")
    if bad := unmatched(listed, table.where("split = 'train'"), ["segment_id"]).limit(5).collect():
        raise GateError(f"listed segments are no train rows: {[r['segment_id'] for r in bad]}")
    train = table.where("split = 'train'").join(listed.select("segment_id", "position"), "segment_id")
    return train.unionByName(table.where("split <> 'train'").withColumn("position", F.lit(None).cast(dict(listed.dtypes)["position"])))
