"""Extensions of the batch operators to unbounded tables of events.

Analogues, none of which a finite curation run needs: gap islands as session
windows, fixed segments as tumbling windows, exact duplicates within a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events no further apart than ``gap``."""
    held = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w"))
    return held.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def tumbling(events: DataFrame, value: str, time: str = "ts", size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count and sum of fixed windows."""
    held = events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"))
    return held.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def distinct_within(events: DataFrame, keys: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first event of every key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
