"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: While a table is written: Arrow batches of bounded size, and shuffle files go with the query that made them.
WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it: ``spark.checkpoint.dir``, or an already set checkpoint folder.

    Without either there is no place that every executor sees, so this fails.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def settings(spark: SparkSession, values: dict):
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage at a table that survives the loss of any executor.
    """
    path = scratch(df.sparkSession, name)
    with settings(df.sparkSession, WRITING):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: The scratch tables of the scopes that are open, the innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession):
    """Remove at its end the scratch tables written in it, but for those that ``kept`` was told of."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)
        if not _SCOPES:
            release()


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that the innermost scope leaves to the one around it."""
    out = materialize(df, name)
    if _SCOPES:
        path = _SCOPES[-1].pop()
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(path)
    return out


def lean(run):
    """``run`` for a Python worker that gives its memory back at the end of a task: workers are used again."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, k: int):
    """crc32 of the column as text, modulo ``k``."""
    return F.crc32(F.col(column).cast("string")) % k


def literals(spark: SparkSession, rows, names) -> DataFrame:
    """A small table of constants, as a local relation of the plan."""
    one = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in rows]
    return spark.range(1).select(F.explode(F.array(*one)).alias("r")).select("r.*")


def fresh(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer form of it that no column of ``df`` bears."""
    names = {c.lower() for c in df.columns}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def extended(df: DataFrame, *more: T.StructField) -> T.StructType:
    """The schema of ``df`` without columns called like ``more``, then ``more``."""
    taken = {f.name.lower() for f in more}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in taken] + list(more))


class Remembered(dict):
    """A mapping that computes missing values and remembers some 2 x ``most`` of them.

    Two generations: when the young one is full it becomes the old one, and what
    is still asked for moves back. So memory is bounded and frequent keys stay.
    Keys of over ``LONG`` characters or bytes are computed each time.
    """

    LONG = 64

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most, self.old = most, {}

    def compute(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        if key.__class__ in (str, bytes) and len(key) > self.LONG:
            return self.compute(key)
        value = self.old.get(key)
        return self.put(key, self.compute(key) if value is None else value)

    def put(self, key, value):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Bloom:
    """A filter of long ids with a fixed size (8 MB), so it may be broadcast.

    It never misses an id. Beyond some ten million ids it lets more and more
    others through, which costs time but changes nothing.
    """

    BITS = 1 << 26

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(ids: np.ndarray) -> np.ndarray:
        x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        mask = np.uint64(Bloom.BITS - 1)
        return np.stack([x & mask, (x >> np.uint64(19)) & mask, (x >> np.uint64(37)) & mask])

    def met(self, ids: np.ndarray) -> np.ndarray:
        p = self.places(ids)
        return ((self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).all(axis=0)

    @classmethod
    def of(cls, ids: DataFrame) -> Bloom:
        """The filter of a one-column frame; tasks send the words they set, which are merged by word."""

        def words(batches):
            own = np.zeros(cls.BITS // 64, np.uint64)
            for batch in batches:
                p = cls.places(batch.column(0).to_numpy(zero_copy_only=False)).ravel()
                np.bitwise_or.at(own, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
            at = np.flatnonzero(own)
            for low in range(0, len(at), 1 << 16):
                part = at[low : low + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(own[part].view(np.int64))], ["at", "word"])

        got = ids.mapInArrow(lean(words), "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        out = np.zeros(cls.BITS // 64, np.uint64)
        out[got.column("at").to_numpy()] = got.column("word").to_numpy().view(np.uint64)
        return cls(out)


#: Bits of a table of marks, 64 to a row.
MARKED = 1 << 24


def marks(wanted: DataFrame) -> DataFrame:
    """A filter of the values of a one-column frame as a table (at, word) of at most ``MARKED`` / 64 rows, so it may be broadcast.

    It never misses a value. Beyond some ten million values it lets more and
    more others through, which costs time but changes nothing.
    """
    bit = F.pmod(F.xxhash64(*wanted.columns), F.lit(MARKED))
    words = wanted.select(F.floor(bit / 64).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("word"))
    return words.groupBy("at").agg(F.bit_or("word").alias("word"))


def apart(df: DataFrame, wanted: DataFrame, key) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose key may be among the values of the one-column frame ``wanted``, and those whose key is not.

    Both are read from ``df`` anew, and neither is shuffled. Types must be equal.
    """
    words = materialize(marks(wanted), "marks")
    at, word, bit = (fresh(df, n) for n in ("_at", "_word", "_bit"))
    there = F.broadcast(words.select(F.col("at").alias(at), F.col("word").alias(word)))
    split = df.withColumn(bit, F.pmod(F.xxhash64(key), F.lit(MARKED)))
    split = split.join(there, F.floor(split[bit] / 64).cast("int") == there[at], "left")
    hit = F.coalesce(F.getbit(F.col(word), F.pmod(F.col(bit), F.lit(64)).cast("int")) == 1, F.lit(False))
    return split.where(hit).select(*df.columns), split.where(~hit).select(*df.columns)


def without(df: DataFrame, ids: DataFrame, key) -> DataFrame:
    """``df`` without the rows whose key is among ``ids`` (one column); only rows that may be are shuffled."""
    ids = materialize(ids.distinct(), "ids")
    name = fresh(df, "_gone")
    maybe, others = apart(df, ids, key)
    gone = ids.toDF(name)
    return maybe.join(gone, key.eqNullSafe(F.col(name)), "left_anti").select(*df.columns).unionByName(others)
