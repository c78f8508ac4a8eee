"""Audits that write what gates later read, and runs that did not go through in the registry."""

import csv
import json
import wave

import pytest
from pyspark.sql import functions as F

from tessera.plans import audits, phases
from tessera.sources import audio


def rows_of(path):
    with open(path, newline="") as f:
        return list(csv.DictReader(f))


def table(spark, rows):
    return spark.createDataFrame(rows, "segment_id string, recording_group_id string, source_dataset string, split string, family_label string, label_id int, base_seed int")


GOOD = [("a", "g1", "CCMusic", "train", "x", 0, 7), ("b", "g2", "CCMusic", "val", "y", 1, 7), ("c", "g3", "ChMusic", "external_test", "x", 0, 7)]


@pytest.fixture
def fixed(spark):
    labels = spark.createDataFrame([("x", 0), ("y", 1)], "family_label string, label_id int")
    allowed = spark.createDataFrame([("CCMusic", "train"), ("CCMusic", "val"), ("CCMusic", "test"), ("ChMusic", "external_test")], "source_dataset string, split string")
    return labels, allowed, ["recording_group_id"]


def test_contracts_that_hold(spark, tmp_path, fixed):
    config = {"seed_name": "seed0", "seed_index": 0, "base_seed": 7}
    code = audits.audit_contracts(spark, f"{tmp_path}/out", f"{tmp_path}/registry.csv", {0: lambda: table(spark, GOOD)}, *fixed, configs={0: config}, listed=[{"base_seed": 7}])
    report = json.loads((tmp_path / "out/data_contract_report.json").read_text())
    assert code == 0 and report["passed"] is True and report["errors"] == [] and report["seed_summaries"]["seed0"]["classes"] == {"x": 2, "y": 1}
    assert phases.report_passed(spark, f"{tmp_path}/out/data_contract_report.json")[0]
    assert (tmp_path / "out/data_contract_errors.csv").read_text() == "seed,check,severity,detail\n"
    (row,) = rows_of(tmp_path / "registry.csv")
    assert tuple(row) == audits.REGISTRY and (row["run_id"], row["status"], row["seed_name"], row["notes"]) == ("run_audit_contract", "completed", "all", "1 seeds all passed")
    assert json.loads((tmp_path / "out/run_meta.json").read_text())["model"] == "data_contract"


def test_contracts_that_do_not_hold(spark, tmp_path, fixed):
    bad = [*GOOD, ("d", "g1", "CCMusic", "test", "x", 0, 7), ("e", "g9", "ChMusic", "train", "x", 0, 8)]
    seeds = {0: lambda: table(spark, bad), 1: lambda: spark.read.parquet(f"{tmp_path}/nothing"), 2: lambda: table(spark, GOOD)}
    configs = {0: {"seed_name": "seed0", "seed_index": 0, "base_seed": 7}, 1: {"seed_name": "seed1", "seed_index": 1, "base_seed": 2}, 2: {"seed_name": "seed1", "seed_index": 2, "base_seed": 9}}
    args = (spark, f"{tmp_path}/out", f"{tmp_path}/registry.csv", seeds, *fixed)
    assert audits.audit_contracts(*args, configs=configs, listed=[{"base_seed": 7}, {"base_seed": 2}, {"base_seed": 9}]) == 1
    report = json.loads((tmp_path / "out/data_contract_report.json").read_text())
    assert report["checks"] == {"leak": 1, "manifest_load": 1, "seed_mapping_consistency": 1, "source_in_wrong_split": 1, "wrong_base_seed": 4}
    errors = rows_of(tmp_path / "out/data_contract_errors.csv")
    assert len(errors) == report["num_blocking_errors"] == 8 and not report["passed"]
    assert any(e["check"] == "leak" and "g1" in e["detail"] and "test,train" in e["detail"] for e in errors)
    assert not phases.report_passed(spark, f"{tmp_path}/out/data_contract_report.json")[0]
    lenient = audits.audit_contracts(spark, f"{tmp_path}/out", f"{tmp_path}/registry.csv", {0: lambda: table(spark, [*GOOD, ("d", "g1", "CCMusic", "test", "x", 0, 7)])}, *fixed, warnings=("leak",))
    assert lenient == 0 and len(rows_of(tmp_path / "registry.csv")) == 1  # the same run, replaced


def wav(path, rate=24_000, channels=1, samples=120_000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"\0\0" * samples * channels)


def test_audio(spark, tmp_path):
    wav(tmp_path / "a.wav")
    wav(tmp_path / "b.wav", samples=120_001)
    wav(tmp_path / "c.wav", rate=16_000, samples=80_000)
    wav(tmp_path / "d.wav", channels=2)
    wav(tmp_path / "e.wav", samples=119_000)
    (tmp_path / "f.wav").write_bytes(b"nothing")
    headers = audio.profile(spark.read.format("binaryFile").load(f"{tmp_path}/*.wav")).withColumn("path", F.regexp_extract("path", "[^/]+$", 0))
    segments = spark.createDataFrame([(0, "train", n, f"{n}.wav") for n in "abcdefg"] + [(1, "test", "a", "a.wav")], "seed int, split string, segment_id string, segment_abs_path string")
    out, registry = f"{tmp_path}/out", f"{tmp_path}/registry.csv"
    assert audits.audit_audio(spark, out, registry, segments, headers) == 1
    found = {r["segment_id"]: r["detail"] for r in rows_of(tmp_path / "out/audio_io_failures.csv")}
    assert found == {"c": "sample_rate=16000, expected 24000", "d": "channels=2, expected 1", "e": "duration=4.958333s, expected 5.0s", "f": "decode_error", "g": "decode_error"}
    assert audits.audit_audio(spark, out, registry, segments, headers, {"train": 2, "test": 6}) == 0
    report = json.loads((tmp_path / "out/audio_io_audit.json").read_text())
    assert (report["total_files_checked"], report["num_seeds_audited"], report["passed"]) == (3, 2, True)
    assert [r["notes"] for r in rows_of(tmp_path / "registry.csv")] == ["3 files checked"]


def test_runs_that_did_not_go_through_are_recorded(spark, tmp_path):
    path = f"{tmp_path}/registry.csv"
    audits.recorded(spark, path, [{"run_id": "run_other", "status": "completed", "notes": 'says "yes", twice'}, {"run_id": "run_m_seed0", "status": "completed"}])
    describe = lambda cell: {"run_id": f"run_m_{cell['seed']}", "experiment_id": "exp", "phase": 1, "task_type": "probe", "model": "m", "seed_name": cell["seed"], "output_dir": f"runs/m/{cell['seed']}"}

    def run(cell):
        if cell["seed"] == "seed1":
            raise RuntimeError("no memory, again")

    cells = [{"seed": f"seed{i}"} for i in range(3)]
    assert phases.orchestrated(run, cells, first="seed1", status=audits.recorder(spark, path, describe)) == {("seed1",): "failed", ("seed0",): "blocked", ("seed2",): "blocked"}
    got = {r["run_id"]: r for r in rows_of(path)}
    assert list(got) == ["run_m_seed0", "run_other", "run_m_seed1", "run_m_seed2"]
    assert {k: (r["status"], r["notes"]) for k, r in got.items()} == {"run_other": ("completed", 'says "yes", twice'), "run_m_seed1": ("failed", "no memory, again"), "run_m_seed0": ("blocked", "an earlier run failed"), "run_m_seed2": ("blocked", "an earlier run failed")}
    assert got["run_m_seed1"]["output_dir"] == "runs/m/seed1" and got["run_m_seed1"]["started_at"] == got["run_m_seed1"]["finished_at"] != ""
    registry = audits.read_registry(spark, path)
    assert not phases.runs_completed(registry, ["run_m_seed0"])[0] and phases.runs_completed(registry, ["run_other"])[0]
