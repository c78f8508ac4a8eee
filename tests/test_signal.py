"""Resampling, fingerprints and cepstra of waveforms made here."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import signal
from tessera.operators import dedup


def tone(rate, seconds, hz):
    return np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)


def sweep(rate, seconds, low, high):
    t = np.arange(int(rate * seconds)) / rate
    return np.sin(2 * np.pi * (low * t + (high - low) * t * t / (2 * seconds)))


@pytest.mark.parametrize(("rate", "target"), [(44100, 24000), (48000, 24000), (16000, 24000), (22050, 24000), (24000, 11025), (8001, 24000)])
def test_tones_and_a_sweep_keep_their_shape(rate, target):
    inside = slice(400, -400)
    for hz in (55, 440, 0.3 * min(rate, target)):
        got = signal.at_rate(tone(rate, 1, hz), rate, target)
        assert len(got) == target and np.abs(got - tone(target, 1, hz))[inside].max() < 1e-4
    top = 0.35 * min(rate, target)
    assert np.abs(signal.at_rate(sweep(rate, 2, 50, top), rate, target) - sweep(target, 2, 50, top))[inside].max() < 1e-4


def test_phases_equal_a_filter_for_every_sample():
    x = np.random.default_rng(0).normal(size=5000)
    scale = 24000 / 44100
    slow = signal.between(x, 44100, 24000, math.ceil(signal.ZEROS / scale), scale)
    assert np.abs(signal.at_rate(x, 44100, 24000) - slow).max() < 1e-5
    assert len(signal.at_rate(x[:1], 44100, 24000)) == 1 and len(signal.at_rate([], 44100, 24000)) == 0


def test_a_minute_takes_little_time():
    x = np.random.default_rng(1).normal(size=60 * 44100)
    began = time.process_time()
    signal.at_rate(x, 44100, 24000)
    fast = time.process_time() - began
    scale, part = 24000 / 44100, 44100 * 2
    began = time.process_time()
    signal.between(x[:part], 44100, 24000, math.ceil(signal.ZEROS / scale), scale)
    assert 30 * (time.process_time() - began) > 20 * fast


def music(seed, rate, seconds=20):
    """Notes of a few partials with attacks, over soft noise, the same at any rate."""
    rng, t = np.random.default_rng(seed), np.arange(int(rate * seconds)) / rate
    out = np.zeros_like(t)
    for start in np.arange(0, seconds, 0.25):
        for _ in range(3):
            hz, length = 110 * 2 ** (rng.integers(0, 48) / 12), rng.uniform(0.3, 1.2)
            on = (t >= start) & (t < start + length)
            for k in range(1, 7):
                if hz * k < 4500:
                    out[on] += rng.uniform(0.1, 1) / k * np.sin(2 * np.pi * hz * k * (t[on] - start)) * np.exp(-3 * (t[on] - start))
    return out / np.abs(out).max()


def agree(a, b):
    n = min(len(a), len(b))
    return 1 - np.bitwise_count(a[:n] ^ b[:n]).sum() / (32 * n)


def test_a_recording_is_known_at_another_rate_and_level():
    prints = {(s, r): signal.spectral_words(music(s, r) * level, r) for s in (1, 2) for r, level in ((44100, 0.8), (22050, 0.05))}
    assert len(prints[1, 44100]) > 350
    for s in (1, 2):
        assert agree(prints[s, 44100], prints[s, 22050]) >= 0.85
    assert agree(prints[1, 44100], prints[2, 44100]) < 0.65
    rng = np.random.default_rng(3)
    noisy = music(1, 44100) + rng.normal(0, 0.002, 44100 * 20)
    assert agree(prints[1, 44100], signal.spectral_words(noisy, 44100)) >= 0.85


def test_fingerprints_give_candidates(spark):
    rows = [(f"r{s}{r}", "x", f"s{r}", [float(v) for v in music(s, r, 4) * level], r) for s in (5, 6) for r, level in ((16000, 0.9), (11025, 0.2))]
    rows += [("short", "x", "s0", [0.1] * 50, 8000), ("none", "x", "s1", None, 8000), ("flat", "x", "s2", [0.0] * 20_000, 11025)]
    df = spark.createDataFrame(rows, "record_id string, family string, subtype string, samples array<double>, rate int").withColumn("fp", signal.fingerprint("samples", "rate"))
    found = {(r.a, r.b) for r in dedup.fingerprint_candidates(df.drop("samples"), "family", "subtype", "fp").collect()}
    assert found == {("r511025", "r516000"), ("r611025", "r616000")}
    assert {r.record_id: r.n for r in df.select("record_id", F.size("fp").alias("n")).collect()}["short"] == 0


def test_cepstra_against_the_definition():
    rate, n_fft, hop = 16000, 2048, 512
    x = tone(rate, 0.4, 500) * 0.3 + sweep(rate, 0.4, 100, 3000) * 0.2
    padded, filters, rows = np.concatenate([np.zeros(n_fft // 2), x, np.zeros(n_fft // 2)]), signal.mel_filters(rate, n_fft), []
    window = np.array([0.5 - 0.5 * math.cos(2 * math.pi * i / n_fft) for i in range(n_fft)])
    for at in range(0, len(padded) - n_fft + 1, hop):
        spectrum = np.fft.fft(padded[at : at + n_fft] * window)[: n_fft // 2 + 1]
        rows.append([10 * math.log10(max(1e-10, float((np.abs(spectrum) ** 2 * f).sum()))) for f in filters])
    top = max(map(max, rows))
    n = len(rows[0])
    ceps = [[sum(max(v, top - 80) * math.cos(math.pi * k * (2 * i + 1) / (2 * n)) for i, v in enumerate(row)) * math.sqrt((1 if k == 0 else 2) / n) for k in range(40)] for row in rows]
    want = np.concatenate([np.mean(ceps, axis=0), np.std(ceps, axis=0)])
    got = signal.mfcc_statistics(x, rate)
    assert got.shape == (80,) and np.abs(got - want).max() < 1e-2
    # A fixed value, so the definition above cannot drift with the code.
    assert filters.shape == (128, 1025) and got[0] == pytest.approx(want[0], rel=1e-5)
