"""PCM WAVE files by the standard library: headers, digests, quality and samples."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.signal import frame_db, HOP_SEC, FRAME_SEC, SILENT_DB

PROFILE = "path string, audio_sha256 string, duration_sec double, sample_rate_hz int, channels int, bit_depth int, silence_ratio double, clipping_ratio double, is_decodable boolean"


def decoded(content: bytes) -> tuple[np.ndarray, int, int, int]:
    """Mono samples in -1..1, rate, channels and bit depth."""
    with wave.open(io.BytesIO(content)) as w:
        rate, channels, width, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 1 << 23) - (1 << 23)
    else:
        x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64) - (128 if width == 1 else 0)
    return (x / float(1 << 8 * width - 1)).reshape(-1, channels).mean(axis=1), rate, channels, 8 * width


def profile(files: DataFrame) -> DataFrame:
    """A row per file of a ``binaryFile`` read; one that cannot be decoded keeps sentinels of -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, digest, content in zip(batch["path"], batch["digest"], batch["content"], strict=True):
                try:
                    x, rate, channels, depth = decoded(bytes(content))
                    level = frame_db(x, int(FRAME_SEC * rate), int(HOP_SEC * rate))
                    rows.append((path, digest, len(x) / rate, rate, channels, depth, float((level < SILENT_DB).mean()) if len(level) else 1.0, float((np.abs(x) >= 0.998).mean()) if len(x) else 0.0, True))
                except Exception:  # whatever is wrong with a file, its row says so
                    rows.append((path, digest, -1.0, -1, -1, -1, -1.0, -1.0, False))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PROFILE.split(", ")])

    return files.select("path", F.sha2("content", 256).alias("digest"), "content").mapInPandas(run, PROFILE)


def waveforms(files: DataFrame) -> DataFrame:
    """(path, rate, samples) of files that can be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    x, rate, _, _ = decoded(bytes(content))
                except Exception:
                    continue
                yield pd.DataFrame({"path": [path], "rate": [rate], "samples": [x.astype(np.float32)]})

    return files.select("path", "content").mapInPandas(run, "path string, rate int, samples array<float>")


def wave_bytes(samples, rate: int) -> bytes:
    """A 16-bit PCM file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(samples, np.float64), -1, 1 - 2**-15) * 32768).round().astype("<i2").tobytes())
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def encoded(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """Segments as PCM files, to be kept in a binary column."""
    return pd.Series([wave_bytes(s, int(r)) for s, r in zip(samples, rate, strict=True)])
