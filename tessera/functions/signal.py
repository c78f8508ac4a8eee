"""Functions of a waveform held as an array of samples in -1..1."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME_SEC, HOP_SEC, SILENT_DB, FLOOR = 0.025, 0.010, -40.0, 1e-10


def frame_db(samples: np.ndarray, frame: int, hop: int) -> np.ndarray:
    """The level of every whole frame, in dB."""
    if frame < 1 or len(samples) < frame:
        return np.zeros(0)
    squares = np.concatenate([[0.0], np.cumsum(np.asarray(samples, np.float64) ** 2)])
    starts = np.arange(0, len(samples) - frame + 1, max(1, hop))
    mean = np.maximum(squares[starts + frame] - squares[starts], 0) / frame
    return 20 * np.log10(np.sqrt(mean) + FLOOR)


def _share(samples, rate: int, silent: bool) -> float:
    level = frame_db(np.asarray(samples if samples is not None else [], np.float64), int(FRAME_SEC * rate), int(HOP_SEC * rate))
    if not len(level):
        return 1.0 if silent else 0.0
    return float((level < SILENT_DB).mean() if silent else (level >= SILENT_DB).mean())


@F.pandas_udf(T.DoubleType())
def silence_ratio(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """The share of frames below -40 dB; 1.0 for less than a frame."""
    return pd.Series([_share(s, int(r), True) for s, r in zip(samples, rate, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def active_frame_ratio(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """The share of frames at -40 dB or above; 0.0 for less than a frame."""
    return pd.Series([_share(s, int(r), False) for s, r in zip(samples, rate, strict=True)], dtype=float)


def frame_silence_ratio(samples: Column, frame: int, hop: int, db: float = SILENT_DB) -> Column:
    """``silence_ratio`` as an expression, for short arrays and any frame length."""
    starts = F.sequence(F.lit(1), F.size(samples) - frame + 1, F.lit(hop))
    level = lambda s: 20 * F.log10(F.sqrt(F.aggregate(F.slice(samples, s, frame), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / frame) + FLOOR)
    silent = F.filter(F.transform(starts, level), lambda v: v < db)
    return F.when(F.size(samples) < frame, F.lit(1.0)).otherwise(F.size(silent) / F.size(starts))


def clipping_ratio(samples: Column, threshold: float = 0.998) -> Column:
    """The share of samples at the threshold or beyond; 0.0 for none."""
    return F.when(F.size(samples) > 0, F.size(F.filter(samples, lambda x: F.abs(x) >= threshold)) / F.size(samples)).otherwise(F.lit(0.0))


def mel_filters(rate: int, n_fft: int, n_mels: int = 128) -> np.ndarray:
    """Triangular filters on the HTK-free (Slaney) mel scale, area-normalised."""
    to_mel = lambda f: np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) / (np.log(6.4) / 27))
    to_hz = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))
    edges = to_hz(np.linspace(0, to_mel(np.array(rate / 2)), n_mels + 2))
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (bins - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - bins) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mfcc_statistics(samples: np.ndarray, rate: int, n_mfcc: int = 40, n_fft: int = 2048, hop: int = 512) -> np.ndarray:
    """Mean and deviation over time of the cepstral coefficients: 2 x ``n_mfcc`` numbers."""
    padded = np.pad(np.asarray(samples, np.float64), n_fft // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
    power = np.abs(np.fft.rfft(frames * np.hanning(n_fft + 1)[:-1], axis=1)) ** 2
    db = 10 * np.log10(np.maximum(power @ mel_filters(rate, n_fft).T, 1e-10))
    db = np.maximum(db, db.max() - 80)
    n = db.shape[1]
    basis = np.cos(np.pi * np.arange(n_mfcc)[:, None] * (2 * np.arange(n) + 1) / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    coefficients = db @ basis.T
    return np.concatenate([coefficients.mean(0), coefficients.std(0)]).astype(np.float32)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def mfcc(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """80 numbers per waveform; an empty one has none."""
    return pd.Series([mfcc_statistics(s, int(r)) if s is not None and len(s) else np.zeros(0, np.float32) for s, r in zip(samples, rate, strict=True)])


def quiet_runs(samples: np.ndarray, rate: int, noise_db: float, least: float) -> list[tuple[float, float]]:
    """(start, stop) in seconds of runs below the noise level that last ``least`` seconds."""
    quiet = np.abs(np.asarray(samples, np.float64)) < 10 ** (noise_db / 20)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], quiet.astype(np.int8), [0]])))
    return [(a / rate, b / rate) for a, b in edges.reshape(-1, 2).tolist() if b - a >= least * rate]


INTERVALS = T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("stop", T.DoubleType())]))


def silences(samples: Column, rate: Column, noise_db: float = -40.0, least: float = 2.0) -> Column:
    """Ordered silences (start, stop) of a waveform."""

    @F.pandas_udf(INTERVALS)
    def found(s: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "stop": b} for a, b in quiet_runs(x, int(n), noise_db, least)] for x, n in zip(s, r, strict=True)])

    return found(samples, rate)


def extracted(samples: Column, rate: Column, start: Column, stop: Column) -> Column:
    """The samples from ``start`` to ``stop`` seconds."""
    first = F.round(start * rate).cast("int")
    return F.slice(samples, first + 1, F.greatest(F.lit(0), F.least(F.round(stop * rate).cast("int"), F.size(samples)) - first))


#: Zero crossings of the resampling filter on each side, its window's shape, and the most numbers that a bank of filters holds.
ZEROS, BETA, BANK = 64, 14.0, 1 << 22


def filter_at(t: np.ndarray, half: int, scale: float) -> np.ndarray:
    """The Kaiser-windowed sinc at distances ``t`` in samples, its band ``scale`` of the input's."""
    window = np.i0(BETA * np.sqrt(np.maximum(0, 1 - (t / half) ** 2))) / np.i0(BETA)
    return np.sinc(t * scale) * window * scale


def at_rate(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """A waveform at another rate, by a windowed sinc whose band ends at the lower rate's half.

    Output samples lie between input samples in as many ways as the target rate
    has over the rates' common divisor. Each way is a phase with one filter, made
    once, and its outputs are a fixed number of input samples apart. Rates with
    so many phases that their filters would not fit ``BANK`` are interpolated sample
    by sample. Without a resampling library this is the engine's own; results
    differ from such a library's by rounding and at the ends.
    """
    x = np.asarray(samples, np.float64)
    if rate == target or not len(x):
        return x.astype(np.float32)
    scale = min(1.0, target / rate)
    half = int(np.ceil(ZEROS / scale))
    common = math.gcd(rate, target)
    phases, step = target // common, rate // common
    if phases * 2 * half > BANK:
        return between(x, rate, target, half, scale)
    n = -(-len(x) * target // rate)
    out, taps = np.empty(n), np.arange(-half + 1, half + 1)
    padded = np.concatenate([np.zeros(half - 1), x, np.zeros(half + 1)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half)
    first, part = np.divmod(np.arange(phases) * step, phases)
    bank = filter_at((part / phases)[:, None] - taps, half, scale)
    for p in range(min(phases, n)):
        own = windows[first[p] :: step]
        for at in range(0, len(range(p, n, phases)), 4096):  # some MB at once
            piece = out[p + at * phases : p + (at + 4096) * phases : phases]
            piece[:] = own[at : at + len(piece)] @ bank[p]
    return out.astype(np.float32)


def between(x: np.ndarray, rate: int, target: int, half: int, scale: float) -> np.ndarray:
    """As ``at_rate``, with a filter made for every output sample."""
    n = -(-len(x) * target // rate)
    out, taps = np.empty(n), np.arange(-half + 1, half + 1)
    padded = np.concatenate([np.zeros(half), x, np.zeros(half + 1)])
    for at in range(0, n, 4096):
        place = np.arange(at, min(n, at + 4096)) * (rate / target)
        base = np.floor(place).astype(np.int64)
        out[at : at + 4096] = (padded[base[:, None] + half + taps] * filter_at((place - base)[:, None] - taps, half, scale)).sum(1)
    return out.astype(np.float32)


#: A fingerprint's rate, window and hop, its lowest band in Hz, and the bands, twelve to an octave; a word has a bit for each two neighbours.
PRINT_RATE, PRINT_WINDOW, PRINT_HOP, PRINT_LOW, PRINT_BANDS = 11025, 4096, 512, 220.0, 33


def spectral_words(samples: np.ndarray, rate: int, seconds: float = 120.0) -> np.ndarray:
    """The fingerprint of the first seconds of a waveform: a word of 32 bits for each hop.

    Energies in bands of a semitone are compared with their upper neighbour and
    with the frame before; the sign of the difference of differences is a bit.
    Neither level nor rate moves the signs of bands with sound in them. A
    waveform shorter than two windows' hops has no words.
    """
    x = at_rate(np.asarray(samples, np.float64)[: int(seconds * rate)], rate, PRINT_RATE).astype(np.float64)
    if len(x) < PRINT_WINDOW + PRINT_HOP:
        return np.zeros(0, np.int64)
    edges = np.round(PRINT_LOW * 2 ** (np.arange(PRINT_BANDS + 1) / 12) * PRINT_WINDOW / PRINT_RATE).astype(int)
    shape, words, last = np.hanning(PRINT_WINDOW + 1)[:-1], [], None
    frames = np.lib.stride_tricks.sliding_window_view(x, PRINT_WINDOW)[::PRINT_HOP]
    for at in range(0, len(frames), 256):  # some MB at once
        power = np.abs(np.fft.rfft(frames[at : at + 256] * shape, axis=1)) ** 2
        bands = np.add.reduceat(power[:, : edges[-1]], edges[:-1], axis=1)
        steps = np.diff(np.log(bands + 1e-12 * max(power.max(), 1e-30)), axis=1)
        if last is not None:
            steps = np.concatenate([last, steps])
        words.append((np.diff(steps, axis=0) > 0) @ (1 << np.arange(PRINT_BANDS - 1, dtype=np.int64)))
        last = steps[-1:]
    return np.concatenate(words)


@F.pandas_udf(T.ArrayType(T.LongType()))
def fingerprint(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """Words of 32 bits for ``dedup.fingerprint_candidates``.

    The engine's own fingerprint, not that of an external program: its words can
    only be compared with each other. Any column of such words can stand in its place.
    """
    return pd.Series([spectral_words(s, int(r)) if s is not None and r is not None and len(s) else np.zeros(0, np.int64) for s, r in zip(samples, rate, strict=True)])


def resampled(samples: Column, rate: Column, target: int) -> Column:
    """Waveforms at the rate ``target``; resample a record once, then join it to its seeds."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([at_rate(x, int(n), target) for x, n in zip(s, r, strict=True)])

    return run(samples, rate)


def pooled(frames: Column, mask: Column | None = None) -> Column:
    """The mean over time of an array of vectors; with a mask of 0 and 1, over the frames that it keeps (none: zeros)."""
    kept = frames if mask is None else F.transform(F.filter(F.arrays_zip(frames.alias("v"), mask.alias("m")), lambda x: x["m"] > 0), lambda x: x["v"])
    width = F.size(F.element_at(frames, 1))
    sums = F.aggregate(kept, F.array_repeat(F.lit(0.0), width), lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return F.transform(sums, lambda x: x / F.greatest(F.lit(1), F.size(kept)))
