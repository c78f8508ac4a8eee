"""Quotas, subsets and weights. Native draws are ordered by hash; compatible ones by Python's generator."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import first_rows, numbers


def hash_order(seed: Column, key: Column) -> Column:
    return F.sha2(F.concat_ws(":", seed.cast("string"), key.cast("string")), 256)


def surplus(total: Column, part: Column, cap: float) -> Column:
    """How many of ``part`` must go so that it makes up at most ``cap`` of what is left."""
    k = F.ceil((part - F.lit(cap) * total) / F.lit(1.0 - cap)).cast("long")
    return F.when(part > F.lit(cap) * total, F.least(part, F.greatest(F.lit(0), k))).otherwise(0)


def quota_drops(df: DataFrame, family: str, over: Column, record: str, cap: float, seed: int) -> DataFrame:
    """(family, record) of the rows that go so that ``over`` rows make up at most ``cap`` of each family.

    Of those rows the first by hash go; ranks are taken over them alone.
    """
    counts = df.groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.count_if(over).alias("p"))
    goes = counts.select(family, surplus(F.col("n").cast("double"), F.col("p").cast("double"), cap).alias("k")).where("k > 0")
    ranks = numbers(df.where(over).select(family, record), [family], [hash_order(F.lit(seed), F.col(record)), record], "_r")
    return ranks.join(goes, family).where("_r <= k").select(family, record)


def python_sample(df: DataFrame, family: str, record: str, order: list[str], seed: int, counts: DataFrame) -> DataFrame:
    """As ``quota_drops``, with ``random.Random(seed).sample`` over the sorted rows of a family.

    ``counts(family, k)``. For compatibility: a family's candidates meet in one task.
    """

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*order, record], kind="stable").reset_index(drop=True)
        chosen = random.Random(seed).sample(range(len(pdf)), int(pdf["k"].iloc[0]))
        return pdf.loc[chosen, [family, record]]

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(family, record, *[c for c in order if c not in (family, record)]).join(counts, family).groupBy(family).applyInPandas(draw, f"{family} {kinds[family]}, {record} {kinds[record]}")


def group_subset(df: DataFrame, label: str, group: str, ratio: float, seed: int) -> DataFrame:
    """(label, group, selection_rank): of every label's groups the first max(1, ceil(n * ratio)) by hash."""
    groups = df.select(label, group).distinct()
    ranked = numbers(groups, [label], [hash_order(F.lit(seed), F.col(group)), group], "selection_rank").withColumn("selection_rank", F.col("selection_rank") - 1)
    ranked = ranked.join(ranked.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), label)
    return ranked.where(F.col("selection_rank") < F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(float(ratio))))).drop("_n")


def python_group_subset(groups: dict[str, list[str]], ratio: float, seed: int) -> dict[str, list[str]]:
    """As ``group_subset`` with Python's generator: class i shuffles with ``seed + i``, in class order."""
    out = {}
    for i, (label, names) in enumerate(groups.items()):
        names = sorted(names)
        random.Random(seed + i).shuffle(names)
        out[label] = names[: max(1, math.ceil(len(names) * ratio))]
    return out


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): the inverse of the label's frequency."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("weight", 1 / F.col("n"))


def weighted_draw(df: DataFrame, label: str, record: str, k: int, seed: int) -> DataFrame:
    """``k`` draws with replacement, labels alike likely: rows of ``df`` with the number of their ``draw``.

    Each draw, by hash, takes a label, all alike, then one of the label's rows,
    numbered by hash; only counts by label and drawn places are shuffled with it.
    """
    rows = numbers(df, [label], [hash_order(F.lit(seed), F.col(record)), record], "_place").withColumn("_place", F.col("_place") - 1)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    n_labels = counts.count()
    labels = counts.withColumn("_label", F.row_number().over(Window.orderBy(label)) - 1)  # one row a label
    whole = float(16**13)
    unit = lambda what: F.conv(F.substring(hash_order(F.lit(f"{seed}:{what}"), F.col("draw")), 1, 13), 16, 10).cast("double") / whole
    draws = df.sparkSession.range(k).withColumnRenamed("id", "draw")
    drawn = draws.withColumn("_label", F.floor(unit("label") * n_labels)).join(labels, "_label").withColumn("_place", F.floor(unit("row") * F.col("_n")))
    return rows.join(drawn.select("draw", label, "_place"), [label, "_place"]).select("draw", *df.columns)


def first_per(df: DataFrame, by: str, order: list[str], limits: DataFrame, limit: str = "limit") -> DataFrame:
    """The first rows of every group, as many as its limit says."""
    return first_rows(df, by, order, limits, limit)


def subset_statistics(df: DataFrame, by: list[str], group: str, record: str, segment: str, chosen: str) -> DataFrame:
    """Groups, records and segments in all and in the subset, and their ratios to four digits."""
    names = {"groups": group, "records": record, "segments": segment}
    counts = df.groupBy(*by).agg(*(F.count_distinct(c).alias(f"full_{n}") for n, c in names.items()), *(F.count_distinct(F.when(F.col(chosen), F.col(c))).alias(f"subset_{n}") for n, c in names.items()))
    return counts.select("*", *(F.round(F.try_divide(F.col(f"subset_{n}").cast("double"), F.col(f"full_{n}")), 4).alias(f"{n}_ratio") for n in names))
