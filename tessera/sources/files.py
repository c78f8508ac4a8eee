"""Small files in any store that the session reads: text, listings, copies."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, by name; nothing if it is missing."""
    where, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename within a store; what was at ``to`` is replaced."""
    remove(spark, to)
    where, fs = _at(spark, path)
    goal, _ = _at(spark, to)
    fs.mkdirs(goal.getParent())
    if not fs.rename(where, goal):
        raise OSError(f"cannot move {path} to {to}")


def copy(spark: SparkSession, path: str, to: str) -> None:
    where, fs = _at(spark, path)
    goal, other = _at(spark, to)
    other.mkdirs(goal.getParent())
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, where, other, goal, False, True, spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A whole file, replaced at once: written beside its place, then moved."""
    where, fs = _at(spark, path + ".part")
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    move(spark, path + ".part", path)


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2, default=str))


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header at just this path, for tables that other programs open by name."""
    spark = df.sparkSession
    parts = path + ".parts"
    df.select(*(F.col(f"`{c}`").cast("string") for c in df.columns)).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("lineSep", "\n").csv(parts)
    own = [n for n in names(spark, parts) if n.startswith("part-")]
    if own:
        move(spark, f"{parts}/{own[0]}", path)
    else:  # a frame without partitions
        write_text(spark, path, ",".join(df.columns) + "\n")
    remove(spark, parts)


def bounded(df: DataFrame, most: int = 10_000) -> list:
    """The rows of a small frame; more than ``most`` are an error, not a load."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows where a small table is expected")
    return rows
