"""Run contracts, phase gates, analysis tables, album cutting and signal functions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import signal
from tessera.operators import gates, metrics
from tessera.operators.gates import GateError
from tessera.plans import albums, analysis, phases
from tessera.sources import runs


def checks(df):
    return sorted((r["check"], r["key"]) for r in df.collect())


def test_run_contract(spark, tmp_path):
    for seed in ("seed0", "seed1"):
        where = tmp_path / "m" / "train10" / seed
        (where / "artifacts").mkdir(parents=True)
        for own in phases.SPLIT_FILES.values():
            for name in own:
                (where / name).write_text('{"num_samples": 2}' if name.endswith("json") else "segment_id\na\nb\n")
        for name in phases.RUN_FILES:
            (where / name).write_text("x\n")
    dims = {"method": ["m"], "ratio": ["train10"], "seed": ["seed0", "seed1"]}
    assert phases.run_contract(spark, str(tmp_path), **dims).count() == 0
    assert phases.pilot_problems(spark, f"{tmp_path}/m/train10/seed0").count() == 0
    (tmp_path / "m/train10/seed1/test_metrics.json").unlink()
    (tmp_path / "m/train10/seed1/val_per_class_metrics_best.csv").unlink()
    (tmp_path / "m/train10/seed1/external_test_predictions.csv").write_text("segment_id\na\n")
    assert {(r["seed"], r["file"]) for r in phases.run_contract(spark, str(tmp_path), **dims).collect()} == {("seed1", "test_metrics.json"), ("seed1", "val_per_class_metrics_best.csv")}
    assert [r["file"] for r in phases.class_contract(spark, str(tmp_path), **dims).collect()] == ["val_per_class_metrics_best.csv"]
    assert checks(phases.pilot_problems(spark, f"{tmp_path}/m/train10/seed1")) == [("file_missing", "test_metrics.json"), ("file_missing", "val_per_class_metrics_best.csv"), ("rows_differ", "external_test_predictions.csv")]
    with pytest.raises(GateError):
        runs.require_files(phases.run_contract(spark, str(tmp_path), **dims))


def test_grid_and_cost_problems(spark):
    whole = [("m", r, s, x) for r in ("train10", "train25") for s in ("seed0", "seed1") for x in ("val", "test")]
    schema, dims = "method string, ratio_name string, seed string, split string", {"method": ["m"], "ratio_name": ["train10", "train25"]}
    ask = lambda rows: checks(phases.grid_problems(spark.createDataFrame(rows, schema), dims, ["seed0", "seed1"], ["val", "test"]))
    assert ask(whole) == []
    assert ask([x for x in whole if x[1:3] != ("train25", "seed1")]) == [("run_missing", "m/train25/seed1"), ("seeds_differ", "m/train25/test"), ("seeds_differ", "m/train25/val")]
    assert ask([x for x in whole if x[1] != "train10" or x[3] != "val"]) == [("split_missing", "m/train10")]
    costs = spark.createDataFrame([("m",)] * 3 + [("n",)], "method string")
    assert checks(phases.cost_problems(costs, ["m", "n", "o"])) == [("cost_rows", "n"), ("cost_rows", "o")]


def test_layer_problems(spark, tmp_path):
    (tmp_path / "layer_00/seed0").mkdir(parents=True)
    (tmp_path / "layer_00/seed0/cost_metrics.json").write_text("{}")
    found = spark.createDataFrame([("layer_00", "seed0", "test")], "layer string, seed string, split string")
    assert checks(phases.layer_problems(spark, found, str(tmp_path), 2, ["seed0"], ["test"])) == [("cost_missing", "layer_01/seed0"), ("run_missing", "layer_01/seed0")]


def test_phase_gates(spark, tmp_path):
    (tmp_path / "reports").mkdir()
    for name, value in (("good", True), ("truthy", "yes"), ("bad", False)):
        (tmp_path / f"reports/{name}.json").write_text(json.dumps({"passed": value}))
    (tmp_path / "c.yaml").write_text("a: 1\n")
    (tmp_path / "broken.yaml").write_text("a: [1\n")
    root = str(tmp_path)
    assert phases.phase_one(spark, root, ["reports/good.json"], ["c.yaml"], [f"{root}/reports"])[0]
    for report, config in (("reports/bad.json", "c.yaml"), ("reports/truthy.json", "c.yaml"), ("reports/none.json", "c.yaml"), ("reports/good.json", "broken.yaml")):
        ok, said = phases.phase_one(spark, root, [report], [config])
        assert not ok and any(x.startswith("FAILED") for x in said)
    registry = spark.createDataFrame([("run_exp01_m_seed0", "completed"), ("run_exp01_m_seed1", "failed")], "run_id string, status string")
    later = lambda seeds, **more: phases.later_phase(spark, root, registry, {"one": phases.run_names("run_exp01", ["m"], seeds)}, **more)[0]
    assert later(["seed0"], tables=["c.yaml"], folders=["reports"], configs=["c.yaml"], writable=["reports"], packages=["json"])
    assert not later(["seed0", "seed1"]) and not later(["seed0", "seed2"]) and not later(["seed0"], tables=["none.csv"]) and not later(["seed0"], folders=["none"]) and not later(["seed0"], packages=["no_such_package"])
    assert not later(["seed0"], confusions=spark.createDataFrame([("x",)], "path string"))
    assert not phases.phase_gate({"raises": lambda: 1 / 0})[0]
    assert phases.run_names("r", ["a", "b"], ["0"]) == ["r_a_0", "r_b_0"]


def test_orchestration():
    said = []

    def run(cell):
        if cell["method"] == "bad" and cell["seed"] == "seed1":
            raise ValueError("no")

    cells = [{"method": m, "seed": s} for m in ("good", "bad") for s in ("seed0", "seed1")]
    out = phases.orchestrated(run, cells, first="seed1", status=lambda c, what, note: said.append((c["method"], c["seed"], what)))
    assert out == {("good", "seed1"): "completed", ("bad", "seed1"): "failed", ("good", "seed0"): "blocked", ("bad", "seed0"): "blocked"}
    assert said[0] == ("good", "seed1", "completed") and len(said) == 4
    assert phases.orchestrated(run, cells)[("bad", "seed1")] == "failed" and phases.orchestrated(run, cells[::-1], fail_fast=True)[("good", "seed0")] == "blocked"
    done = []
    with pytest.raises(GateError):
        phases.rolled_up_or_stop(lambda: 1 / 0, lambda: done.append(1))
    phases.rolled_up_or_stop(lambda: None, lambda: done.append(1))
    assert done == [1]


def test_class_tables(spark):
    schema = "method string, split string, label_id int, label string, f1_mean double"
    first = spark.createDataFrame([("A", "test", 0, "a", 0.5), ("A", "val", 0, "a", 0.9)], schema)
    second = spark.createDataFrame([("B", "test", 0, "a", 0.7), ("C", "test", 0, "a", 0.7), ("Z", "test", 0, "a", 0.1)], schema)
    rows = analysis.class_tables(first, second, {"A": "sa", "B": "sb", "C": "sc"}, ["sa", "sc", "sb"], "B", "C").collect()
    assert [(r["method"], r["source_phase"], r["rank_in_split_class_by_f1_mean"], r["is_best_in_class"], r["is_best_phase2"], r["is_best_lora"]) for r in rows] == [("A", 1, 3, False, False, False), ("C", 2, 1, True, False, True), ("B", 2, 2, False, True, False), ("Z", 2, 4, False, False, False)]


def test_error_tables(spark):
    schema = "segment_id string, true_label string, pred_label string, top1_score double"
    rows = [("s1", "a", "b", 0.9), ("s2", "a", "b", 0.8), ("s3", "b", "a", 0.3), ("s4", "a", "a", 1.0)]
    segments = spark.createDataFrame([("s1", "test", "test/s1.wav", "CCMusic"), ("s3", "train", "x", "y")], "segment_id string, split string, segment_path string, source_dataset string")
    tags = {"method_short": "m", "method_display": "M", "seed_name": "seed0", "source_phase": 2}
    cases, summary = analysis.error_tables(spark.createDataFrame(rows, schema), segments, 2, "test", "/root/", tags)
    assert [(r["case_rank"], r["segment_id"], r["segment_abs_path"], r["dataset_name"]) for r in cases.collect()] == [(1, "s1", "/root/test/s1.wav", "CCMusic"), (2, "s3", "", "")]
    assert [(r["error_pair"], r["count"], r["split"]) for r in summary.collect()] == [("a → b", 2, "test"), ("b → a", 1, "test")]
    none, empty = analysis.error_tables(spark.createDataFrame(rows[3:], schema), None, 2, "test", "", tags)
    assert none.count() == empty.count() == 0


def test_confusion_tables_and_layers(spark):
    cells = spark.createDataFrame([("m", s, "a", p, n) for s, ns in (("seed0", (3, 1)), ("seed1", (2, 2))) for p, n in zip("ab", ns, strict=True)] + [("m", s, "b", p, 0) for s in ("seed0", "seed1") for p in "ab"], "method string, seed string, true_label string, pred_label string, n long")
    got = {(r["true_label"], r["pred_label"]): r for r in analysis.confusion_tables(cells, ["method"], 2).collect()}
    assert got["a", "a"]["count_mean"] == 2.5 and got["a", "a"]["rate_mean"] == 0.625 and got["b", "a"]["rate_mean"] == 0.0
    with pytest.raises(GateError):
        analysis.confusion_tables(cells, ["method"], 3)
    layers = spark.createDataFrame([("test", 0, 0.5), ("test", 1, 0.9), ("test", 2, 0.9), ("val", 0, 1.0)], "split string, layer_index int, macro_f1_mean double")
    assert [tuple(r) for r in analysis.best_layers(layers).collect()] == [("test", 1, 0.9)]


def test_subsets(spark):
    train = spark.createDataFrame([(s, f"f{f}", f"g{f}{g}", f"r{f}{g}", f"{s}-{f}{g}{k}", "train") for s in ("seed0", "seed1") for f in range(2) for g in range(8) for k in range(3)], "seed_name string, family_label string, recording_group_id string, record_id string, segment_id string, split string")
    chosen = analysis.subsets(train, {"train25": 0.25, "train100": 1.0}, {"seed0": 1, "seed1": 2}).cache()
    assert chosen.where("ratio_name = 'train100'").count() == train.count() and chosen.where("ratio_name = 'train25' and seed_name = 'seed0'").count() == 12
    by_class, overall = analysis.subset_tables(train, chosen)
    assert by_class.count() == 8 and overall.count() == 4
    assert {r["groups_ratio"] for r in overall.where("ratio_name = 'train25'").collect()} == {0.25}
    groups = chosen.select("ratio_name", "seed_name", "recording_group_id").distinct()
    meta = chosen.groupBy("ratio_name", "seed_name").agg(F.count_distinct("recording_group_id").alias("subset_train_group_count"), F.count(F.lit(1)).alias("subset_train_segment_count"))
    labels, expected = train.select("family_label").distinct(), groups.select("ratio_name", "seed_name").distinct().unionByName(spark.createDataFrame([("train10", "seed0")], "ratio_name string, seed_name string"))
    audit = lambda listed: sorted((r["ratio_name"], r["seed_name"], r["check"]) for r in analysis.subset_checks(train, listed, groups, meta, labels, expected).where("not passed").collect())
    lost = ("train10", "seed0", "files_exist")
    assert audit(chosen) == [lost] and analysis.subset_checks(train, chosen, groups, meta, labels, expected).count() == 19
    assert audit(chosen.where("not (ratio_name = 'train25' and seed_name = 'seed0' and family_label = 'f1')")) == sorted([lost, ("train25", "seed0", "all_classes"), ("train25", "seed0", "counts_match_meta")])
    odd = chosen.withColumn("split", F.when((F.col("ratio_name") == "train100") & (F.col("seed_name") == "seed1"), "val").otherwise("train")).withColumn("segment_id", F.when((F.col("ratio_name") == "train25") & (F.col("seed_name") == "seed1"), "zz").otherwise(F.col("segment_id")))
    assert audit(odd) == sorted([lost, ("train100", "seed1", "only_train"), ("train25", "seed1", "all_from_train")])


def test_small_views(spark):
    df = spark.createDataFrame([(f"s{i:02d}", "test" if i % 3 else "val") for i in range(30)], "segment_id string, split string")
    assert {r["split"]: r["count"] for r in analysis.limited(df, "split", "segment_id", 4).groupBy("split").count().collect()} == {"test": 4, "val": 4}
    assert analysis.split_view(df, "val").count() == 10
    with pytest.raises(GateError):
        analysis.split_view(df, "train")
    named = analysis.with_names(spark.createDataFrame([("s1", "a"), ("s2", "b")], "segment_id string, pred_label string"), spark.createDataFrame([("s1", "a", "x", "r")], "segment_id string, true_label string, sample_id string, record_id string"))
    assert {r["segment_id"]: (r["true_label"], r["record_id"]) for r in named.collect()} == {"s1": ("a", "r"), "s2": ("unknown", "unknown")}


def test_albums_are_cut_at_silences(spark):
    rate = 100
    tone = lambda s: [0.5, -0.5] * (int(s * rate) // 2)
    quiet = lambda s: [0.0] * int(s * rate)
    album = tone(12) + quiet(3) + tone(4) + quiet(3) + tone(15)
    df = spark.createDataFrame([("x/label-album.wav", rate, album)], "path string, rate int, samples array<double>")
    got = albums.tracks(df, least=10.0).orderBy("track").collect()
    assert [(r["name"], round(r["start"], 2), round(r["stop"], 2), len(r["samples"])) for r in got] == [("album_track_01.wav", 0.0, 20.5, 2050), ("album_track_02.wav", 20.5, 37.0, 1650)]
    assert signal.quiet_runs(np.zeros(0), rate, -40, 1) == [] and signal.quiet_runs(np.zeros(50), rate, -40, 0.5) == [(0.0, 0.5)]


def test_resampling_keeps_a_tone():
    t = np.arange(4800) / 48_000
    x = np.sin(2 * np.pi * 1000 * t)
    y = signal.at_rate(x, 48_000, 24_000)
    assert len(y) == 2400 and np.abs(y[300:-300] - np.sin(2 * np.pi * 1000 * np.arange(2400) / 24_000)[300:-300]).max() < 1e-3
    high = signal.at_rate(np.sin(2 * np.pi * 18_000 * t), 48_000, 24_000)
    assert np.abs(high[300:-300]).max() < 1e-3
    assert len(signal.at_rate(x[:0], 48_000, 24_000)) == 0 and len(signal.at_rate(x, 44_100, 24_000)) == -(-4800 * 24_000 // 44_100)


def test_masked_pooling(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [1, 0]), ([[1.0, 2.0]], [0])], "f array<array<double>>, m array<int>")
    assert [(r["a"], r["b"]) for r in df.select(signal.pooled(F.col("f")).alias("a"), signal.pooled(F.col("f"), F.col("m")).alias("b")).collect()] == [([2.0, 3.0], [1.0, 2.0]), ([1.0, 2.0], [0.0, 0.0])]


# ---- planted faults for gates that flows only pass through ------------------------------------


def test_freeze_gates_find_faults(spark):
    families = spark.createDataFrame([("fa",), ("fb",)], "family_label string")
    accepted = spark.createDataFrame([], "family_label string")
    rows = [(f"r{i}", "fa", "ChMusic", "keep", "") for i in range(4)] + [("r8", "fb", "ChMusic", "keep", "pending"), ("r9", "zz", "CCMusic", "keep", ""), ("r10", "zz", "CCMusic", "drop", "pending")]
    df = spark.createDataFrame(rows, "record_id string, family_label string, source_dataset string, sample_status string, review_status string")
    assert checks(gates.freeze_gates(df, families, "family_label", "source_dataset", accepted)) == [("inactive_label", "r9"), ("pending_review", "r8"), ("too_few_external", "fb")]
    assert checks(gates.freeze_gates(df.where("record_id < 'r4'"), families, "family_label", "source_dataset", families)) == []


def test_final_checks_find_faults(spark):
    families = spark.createDataFrame([("fa",)], "family_label string")
    splits = ("train", "val", "test", "external_test")
    frozen = [("r1", "fa", True, "d1", ""), ("r2", "fa", True, "d2", "")]
    frame = lambda rows: spark.createDataFrame(rows, "record_id string, family_label string, is_decodable boolean, audio_sha256 string, review_status string")
    split = spark.createDataFrame([(0, "g1", "train"), (0, "g2", "test")], "split_seed int, recording_group_id string, split string")
    segments = spark.createDataFrame([(0, "fa", s, f"{s}/x.wav") for s in splits], "split_seed int, family_label string, split string, segment_path string")
    listing = segments.select(F.col("segment_path").alias("path"))
    assert checks(gates.final_checks(frame(frozen), split, segments, families, listing)) == []
    bad = frame([*frozen, ("r3", "zz", False, "d1", "pending")])
    torn = split.unionByName(spark.createDataFrame([(0, "g1", "val")], split.schema))
    found = checks(gates.final_checks(bad, torn, segments.where("split <> 'val'"), families, spark.createDataFrame([("train/x.wav",), ("other.wav",)], "path string")))
    assert found == sorted([("empty_cell", "fa"), ("group_in_several_splits", "g1"), ("inactive_label", "r3"), ("missing_file", "external_test/x.wav"), ("missing_file", "test/x.wav"), ("not_decodable", "r3"), ("pending_review", "r3"), ("repeated_digest", "d1"), ("unlisted_file", "other.wav")])


def test_batches_and_audio_must_conform(spark):
    batch = spark.createDataFrame([("s1", [0.0] * 4, 0, "train", "CCMusic"), ("s2", [0.0] * 3, 9, "external_test", "CCMusic")], "segment_id string, waveform array<double>, label_id int, split string, source_dataset string")
    assert checks(gates.batch_violations(batch, 6, 4)) == [("external_source", "s2"), ("label_out_of_range", "s2"), ("wrong_length", "s2")]
    audio = spark.createDataFrame([("a", 24_000, 1, 5.0), ("b", 44_100, 2, 4.9), ("c", 24_000, 1, 5.0 + 1 / 24_000)], "path string, sample_rate_hz int, channels int, duration_sec double")
    assert checks(gates.audio_conformance(audio)) == [("wrong_channels", "b"), ("wrong_duration", "b"), ("wrong_rate", "b")]


def test_subset_audit_finds_faults(spark):
    full = spark.createDataFrame([(f"s{i}", f"g{i // 2}", "fa" if i < 4 else "fb", "train" if i < 7 else "val") for i in range(8)], "segment_id string, recording_group_id string, family_label string, split string")
    rows = [("good", f"s{i}") for i in (0, 1, 4, 5)] + [("bad", s) for s in ("s0", "s0", "s7")]
    labels = spark.createDataFrame([("fa",), ("fb",)], "family_label string")
    failed = {(r["subset"], r["check"]) for r in gates.subset_audit(full, spark.createDataFrame(rows, "subset string, segment_id string"), labels).where("not passed").collect()}
    assert failed >= {("bad", "contained_in_train"), ("bad", "no_repeats")} and not [f for f in failed if f[0] == "good"]


def test_support_errors(spark):
    cells = spark.createDataFrame([("a", "a", 3), ("a", "b", 1)], "true string, pred string, n long").withColumnsRenamed({"true": "true_label", "pred": "pred_label"})
    assert metrics.support_errors(spark.createDataFrame([("a", 4)], "label string, support long"), cells).count() == 0
    assert metrics.support_errors(spark.createDataFrame([("a", 5)], "label string, support long"), cells).count() == 1
