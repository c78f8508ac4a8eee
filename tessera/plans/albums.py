"""Cutting albums into tracks at their silences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal, text
from ..operators.segments import pieces_between


def tracks(albums: DataFrame, noise_db: float = -40.0, silence: float = 2.0, least: float = 10.0) -> DataFrame:
    """A row per track of albums(path, rate, samples): path, track, name, start, stop, rate, samples.

    Cuts lie at the middles of silences; pieces shorter than ``least`` seconds join
    the one before, a first one the second. Names are the album's without its
    label or artist, and the track's number.
    """
    stem = text.without_prefix(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
    found = albums.withColumn("_total", F.size("samples") / F.col("rate")).withColumn("_silences", signal.silences(F.col("samples"), F.col("rate"), noise_db, silence))
    cut = found.select("path", "rate", "samples", stem.alias("_stem"), F.posexplode(pieces_between(F.col("_total"), F.col("_silences"), least)).alias("_n", "_p"))
    return cut.select("path", (F.col("_n") + 1).alias("track"), F.format_string("%s_track_%02d.wav", F.col("_stem"), F.col("_n") + 1).alias("name"), F.col("_p.start").alias("start"), F.col("_p.stop").alias("stop"), "rate", signal.extracted(F.col("samples"), F.col("rate"), F.col("_p.start"), F.col("_p.stop")).alias("samples"))
