"""Registries kept by upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, on: str, position: str | None = None) -> DataFrame:
    """``old`` with the columns that ``new`` names replaced where keys match, and its other rows added.

    With ``position``, only the first of old rows that share a key is replaced.
    """
    given = [c for c in new.columns if c != on]
    if position:
        old = old.withColumn("_first", F.row_number().over(Window.partitionBy(on).orderBy(position)) == 1)
    else:
        old = old.withColumn("_first", F.lit(True))
    marked = new.select(F.col(on).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in given), F.lit(True).alias("_hit"))
    both = old.join(marked, (old[on] == marked["_key"]) & F.col("_first"), "full_outer")
    hit = F.coalesce("_hit", F.lit(False))
    names = [c for c in old.columns if c != "_first"]
    add = [c for c in given if c not in names]
    return both.select(*(F.coalesce(on, "_key").alias(on) if c == on else F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in names), *(F.col(f"_new_{c}").alias(c) for c in add))


def latest(df: DataFrame, on: str, order: list) -> DataFrame:
    """The last row of every key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(on).orderBy(*order))).where("_n = 1").drop("_n")


def not_completed(registry: DataFrame, expected: DataFrame, run: str = "run_id", status: str = "status") -> DataFrame:
    """(run_id, problem): expected runs that are missing or have another status."""
    missing = expected.select(run).join(registry.select(run), run, "left_anti").withColumn("problem", F.lit("missing"))
    other = registry.join(expected.select(run), run, "left_semi").where(~F.col(status).eqNullSafe(F.lit("completed"))).select(run, F.coalesce(status, F.lit("")).alias("problem"))
    return missing.unionByName(other)
