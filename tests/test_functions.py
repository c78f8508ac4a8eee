import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays, signal, text
from tessera.sources import audio


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_names(spark):
    assert column(spark, ["a  b第二遍.wav", "　x  y\t.mp3", "plain", None], text.normalized_name) == ["a b", "x y", "plain", None]
    assert column(spark, ["a b　c"], text.merge_key) == ["abc"]
    assert column(spark, ["x第一遍.wav", "x第三遍.wav", "x.wav"], text.take_id) == [1, 3, 0]
    assert column(spark, ["12.3.wav", "x.3.wav", "7.wav"], text.class_id) == [12, None, None]
    assert column(spark, ["乐曲片段一.wav", "scale.wav"], text.first_keyword) == ["phrase", None]
    assert column(spark, ["Label - Song", "A—Song"], text.without_prefix) == ["Song", "Song"]


def test_dotted_order(spark):
    df = spark.createDataFrame([("1.10.wav",), ("1.9.wav",), ("1.2.wav",)], "n string")
    assert [r[0] for r in df.orderBy(text.dotted_key(F.col("n"))).collect()] == ["1.2.wav", "1.9.wav", "1.10.wav"]


def test_cells(spark):
    assert column(spark, [0.5, -1.0, 1 / 3, None, 100.0], lambda c: text.cell(c, "double"), "double") == ["0.5", "-1.0", "0.333333", "", "100.0"]
    assert column(spark, [True, False, None], lambda c: text.cell(c, "boolean"), "boolean") == ["true", "false", ""]
    assert column(spark, ["1.10.0", "1.9", "2"], lambda c: text.version_key(c)) == [[1, 10, 0, 0], [1, 9, 0, 0], [2, 0, 0, 0]]


def test_vectors(spark):
    v = column(spark, [[3.0, 4.0], [0.0, 0.0]], arrays.l2_normalized, "array<double>")
    assert np.allclose(v, [[0.6, 0.8], [0, 0]])
    assert np.allclose(column(spark, [[1.0, 2.0, 2.0]], arrays.softmax, "array<double>")[0], np.exp([1, 2, 2]) / np.exp([1, 2, 2]).sum())
    assert column(spark, [[1.0, 2.0, 2.0]], arrays.argmax, "array<double>") == [1]
    assert column(spark, [["a", "b"]], lambda c: arrays.appended(c, F.lit("b")), "array<string>") == [["a", "b"]]


def test_fingerprints(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2]), ([0xFFFFFFFF], [0]), ([], [1]), ([9, 1, 2, 9], [1, 2])], "a array<bigint>, b array<bigint>")
    got = df.select(arrays.hamming_similarity(F.col("a"), F.col("b")), arrays.containment("a", "b")).collect()
    assert [r[0] for r in got][:3] == [1.0, 0.0, 0.0]
    assert [r[1] for r in got] == [1.0, 0.0, 0.0, 1.0]


def test_frames(spark):
    rate = 1000
    x = np.concatenate([np.zeros(500), np.full(500, 0.5)])
    df = spark.createDataFrame([(x.tolist(), rate), ([0.1] * 10, rate), ([1.0] * 100, rate)], "x array<double>, r int")
    silent, active, expr, clip = zip(*df.select(signal.silence_ratio("x", "r"), signal.active_frame_ratio("x", "r"), signal.frame_silence_ratio(F.col("x"), 25, 10), signal.clipping_ratio(F.col("x"))).collect(), strict=True)
    starts = range(0, 1000 - 25 + 1, 10)
    want = np.mean([20 * np.log10(np.sqrt(np.mean(x[s : s + 25] ** 2)) + 1e-10) < -40 for s in starts])
    assert silent[0] == pytest.approx(want) and expr[0] == pytest.approx(want) and active[0] == pytest.approx(1 - want)
    assert (silent[1], active[1], expr[1]) == (1.0, 0.0, 1.0)
    assert clip == (0.0, 0.0, 1.0)


def test_mfcc_shape(spark):
    x = np.sin(np.arange(24_000) / 20).tolist()
    df = spark.createDataFrame([(x, 24_000), ([], 24_000)], "x array<double>, r int")
    got = [r[0] for r in df.select(signal.mfcc("x", "r")).collect()]
    assert len(got[0]) == 80 and np.isfinite(got[0]).all() and got[1] == []


def test_wave_files(spark, tmp_path):
    x = np.sin(np.arange(8000) / 10) * 0.5
    (tmp_path / "a.wav").write_bytes(audio.wave_bytes(x, 8000))
    (tmp_path / "b.wav").write_bytes(b"no wave file")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    rows = {r["path"].rpartition("/")[2]: r for r in audio.profile(files).collect()}
    assert (rows["a.wav"]["sample_rate_hz"], rows["a.wav"]["channels"], rows["a.wav"]["bit_depth"], rows["a.wav"]["duration_sec"]) == (8000, 1, 16, 1.0)
    assert rows["a.wav"]["is_decodable"] and not rows["b.wav"]["is_decodable"] and rows["b.wav"]["bit_depth"] == -1
    (got,) = audio.waveforms(files).collect()
    assert np.allclose(got["samples"], x, atol=1e-4)
