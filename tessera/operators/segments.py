"""Fixed-length segments, caps, and cuts at silences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_bounds(length: Column, size: int, least: int) -> Column:
    """(index, start, stop, padded) of a record's segments.

    Shorter than ``least``: none. Shorter than ``size``: one, to be padded. Else
    whole segments, the tail is left.
    """
    whole = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(length / size) - 1).cast("int")), lambda i: F.struct(i.alias("index"), (i * size).cast("long").alias("start"), ((i + 1) * size).cast("long").alias("stop"), F.lit(False).alias("padded")))
    one = F.array(F.struct(F.lit(0).alias("index"), F.lit(0).cast("long").alias("start"), length.cast("long").alias("stop"), F.lit(True).alias("padded")))
    return F.when(length >= size, whole).when(length >= least, one)


def segmented(df: DataFrame, samples: str, size: int, least: int) -> DataFrame:
    """A row per segment with its samples, zeros at the end of a padded one."""
    rows = df.withColumn("_s", F.explode(segment_bounds(F.size(samples), size, least)))
    cut = F.slice(F.col(samples), F.col("_s.start").cast("int") + 1, size)
    zeros = F.array_repeat(F.element_at(F.col(samples), 1) * 0, size - F.size(cut))
    return rows.select(*(c for c in df.columns if c != samples), F.concat(cut, zeros).alias(samples), F.col("_s.index").alias("segment_position"), F.col("_s.start").alias("start"), F.col("_s.stop").alias("stop"), F.col("_s.padded").alias("is_padded"))


def capped(df: DataFrame, sample: str, family: str, start: str, class_rows: DataFrame, floor: int = 6, share: float = 0.10, primary: Column | None = None, index: str = "segment_index", tie: list[str] = ()) -> DataFrame:
    """The first max(floor, ceil(share * rows of the class)) segments of every sample, numbered from 0 by ``start``, then by ``tie``.

    ``class_rows(family, rows)``; rows that are not ``primary`` are not capped.
    """
    w = Window.partitionBy(sample).orderBy(start, *tie)
    cap = F.greatest(F.lit(floor), F.ceil(F.col("rows") * F.lit(float(share))))
    ranked = df.join(class_rows, family, "left").withColumn(index, F.row_number().over(w) - 1)
    inside = F.col(index) < cap
    return ranked.where(inside if primary is None else inside | ~primary).drop("rows")


def islands(df: DataFrame, by: list[str], order: str, gap: float, tie: str) -> DataFrame:
    """Runs of rows no further than ``gap`` apart: (by..., island, start, stop, n)."""
    w = Window.partitionBy(*by).orderBy(order, tie)
    new = F.coalesce(F.col(order) - F.lag(order).over(w) > gap, F.lit(True)).cast("int")
    marked = df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "island").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count(F.lit(1)).alias("n"))


def pieces_between(total: Column, silences: Column, least: float) -> Column:
    """Pieces (start, stop) cut at the middles of ordered silences (start, stop).

    A piece shorter than ``least`` joins the one before it; a first piece that
    is still short takes the second in.
    """
    middles = F.transform(silences, lambda s: (s["start"] + s["stop"]) / 2.0)
    starts = F.concat(F.array(F.lit(0.0)), middles)
    stops = F.concat(middles, F.array(total.cast("double")))
    pieces = F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop")))
    none = F.filter(pieces, lambda p: F.lit(False))

    def join(done, p):
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), p["stop"].alias("stop"))))
        return F.when((F.size(done) > 0) & (p["stop"] - p["start"] < least), longer).otherwise(F.concat(done, F.array(p)))

    merged = F.aggregate(pieces, none, join)
    # A short first piece takes the second in.
    first, second = F.element_at(merged, 1), F.element_at(merged, 2)
    forward = F.concat(F.array(F.struct(first["start"].alias("start"), second["stop"].alias("stop"))), F.slice(merged, 3, F.greatest(F.size(merged) - 2, F.lit(0))))
    return F.when((F.size(merged) > 1) & (first["stop"] - first["start"] < least), forward).otherwise(merged)
