"""Validated joins, and joins that report what does not fit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def many_to_one(left: DataFrame, right: DataFrame, on: list[str], check: bool = True) -> DataFrame:
    """left ⟕ right with the right side's new columns; raises if its keys repeat."""
    if check and (bad := duplicate_keys(right, on).limit(5).collect()):
        raise ValueError(f"keys repeat on the right side: {[tuple(r) for r in bad]}")
    return left.join(right.select(*on, *(c for c in right.columns if c not in left.columns)), on, "left")


def duplicate_keys(df: DataFrame, on: list[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_anti")


def disagreements(left: DataFrame, right: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, left, right) wherever matched rows differ, nulls included."""
    both = left.select(*on, *fields).join(right.select(*on, *(F.col(c).alias(f"_{c}") for c in fields)), on)
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("left"), F.col(f"_{c}").cast("string").alias("right")) for c in fields))
    return both.select(*on, F.explode(pairs).alias("x")).select(*on, "x.*").where(~F.col("left").eqNullSafe(F.col("right")))


def in_listed_order(df: DataFrame, listed: DataFrame, on: str, position: str) -> DataFrame:
    """The rows of ``df`` that are listed, with their place in the list."""
    return df.join(listed.select(on, position), on)


def missing_cells(dimensions: list[DataFrame], actual: DataFrame, on: list[str]) -> DataFrame:
    """Cells of the grid of small dimensions that ``actual`` lacks."""
    return reduce(DataFrame.crossJoin, dimensions).join(actual.select(*on).distinct(), on, "left_anti")


def keep_first(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Union by name; of rows that share ``on`` those of the earlier frame stay, and of these the least."""
    every = reduce(DataFrame.unionByName, (f.withColumn("source_rank", F.lit(i)) for i, f in enumerate(frames)))
    order = ["source_rank", *(c for c in every.columns if c not in (*on, "source_rank"))]
    return every.withColumn("_n", F.row_number().over(Window.partitionBy(*on).orderBy(*order))).where("_n = 1").drop("_n")


def listing_differences(manifest: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """(path, problem): named but not there, or there but not named."""
    a = manifest.select(path).distinct().join(listing.select(path).distinct(), path, "left_anti").withColumn("problem", F.lit("missing_file"))
    return a.unionByName(listing.select(path).distinct().join(manifest.select(path).distinct(), path, "left_anti").withColumn("problem", F.lit("unlisted_file")))


def ordered_keys_differ(a: DataFrame, b: DataFrame, key: str, position: str) -> DataFrame:
    """Positions at which two ordered lists of keys differ."""
    return a.select(position, F.col(key).alias("a")).join(b.select(position, F.col(key).alias("b")), position, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
