"""The session that the operators are written for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators count on, at any size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}
#: Bounds of the batches that Python functions get: rows, and bytes, as texts may be long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; ``settings`` (dots as ``__``) win."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches to ``BATCHES``; lower ones stay."""
    for key, most in BATCHES.items():
        now = spark.conf.get(key)  # the default may be spelled with a unit
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def settled(df: DataFrame) -> DataFrame:
    """``df``, computed once: a checkpoint in the session's shared folder cuts its plan.

    The folder is the context's, or else the one that ``spark.checkpoint.dir`` names.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where)
    return df.checkpoint()
