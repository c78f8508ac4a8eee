"""Array functions: sets of rules, vectors and fingerprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def appended(rules: Column, rule: Column) -> Column:
    """The rule trail with ``rule``, unless it is there; a null rule changes nothing."""
    return F.array_distinct(F.array_compact(F.concat(rules, F.array(rule))))


def l2_normalized(vector: Column, floor: float = 1e-12) -> Column:
    norm = F.greatest(F.sqrt(total(F.transform(vector, lambda x: x.cast("double") * x.cast("double")))), F.lit(floor))
    # The norm is bound by the zip, so it is computed once a vector.
    return F.transform(F.arrays_zip(vector.alias("x"), F.array_repeat(norm, F.size(vector)).alias("n")), lambda p: p["x"].cast("double") / p["n"])


def softmax(logits: Column) -> Column:
    top = F.array_max(logits).cast("double")
    raised = F.transform(F.arrays_zip(logits.alias("x"), F.array_repeat(top, F.size(logits)).alias("m")), lambda p: F.exp(p["x"].cast("double") - p["m"]))
    return F.transform(F.arrays_zip(raised.alias("x"), F.array_repeat(total(raised), F.size(logits)).alias("s")), lambda p: p["x"] / p["s"])


def argmax(values: Column) -> Column:
    """The place of the largest value, the first on ties, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def fingerprint_sha256(words: Column) -> Column:
    return F.sha2(F.array_join(words.cast("array<string>"), ","), 256)


def hamming_similarity(a: Column, b: Column, bits: int = 32) -> Column:
    """The share of equal bits over the common prefix; 0.0 if either is empty."""
    n = F.least(F.size(a), F.size(b))
    differ = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(n > 0, 1 - differ / (n * bits)).otherwise(F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def containment(a: pd.Series, b: pd.Series) -> pd.Series:
    """The best hamming similarity of the shorter fingerprint anywhere in the longer one."""

    def best(x, y) -> float:
        x, y = (np.asarray(v, np.uint64) if v is not None else np.zeros(0, np.uint64) for v in (x, y))
        short, long = (x, y) if len(x) <= len(y) else (y, x)
        if not len(short):
            return 0.0
        least = min(int(np.bitwise_count(long[i : i + len(short)] ^ short).sum()) for i in range(len(long) - len(short) + 1))
        return 1 - least / (32 * len(short))

    return pd.Series([best(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def sign_bits(vector: Column, words: int = 1, bits: int = 32) -> Column:
    """The signs of a vector's first numbers, packed into words of ``bits`` bits."""
    one = lambda w: F.aggregate(F.slice(vector, w * bits + 1, bits), F.lit(0).cast("bigint"), lambda s, x: s * 2 + F.when(x > 0, 1).otherwise(0))
    return F.array(*(one(w) for w in range(words)))
