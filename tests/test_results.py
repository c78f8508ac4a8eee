"""Sinks of a run and their readers, configuration, review file and summary."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import rollup
from tessera.operators.gates import GateError
from tessera.plans import curation
from tessera.sources import audio, files, results, reviews, runs, settings


def test_result_files_are_read_back(spark, tmp_path):
    root = tmp_path / "runs"
    cells = spark.createDataFrame([("b", "a", 2), ("a", "a", 5), ("b", "b", 1)], "true_label string, pred_label string, n long")
    for seed in ("seed0", "seed1"):
        where = f"{root}/m/{seed}"
        results.write_confusion(cells, ["a", "b"], f"{where}/test_confusion_matrix.csv")
        results.write_metrics(spark.createDataFrame([(0.5, 0.25, 8)], "accuracy double, macro_f1 double, num_samples long"), f"{where}/test_metrics.json")
        results.write_class_metrics(spark.createDataFrame([(1, "b", 0.5, 0.5, 0.5, 3), (0, "a", 1.0, 1.0, 1.0, 5)], "label_id int, label string, precision double, recall double, f1 double, support long"), f"{where}/test_per_class_metrics.csv")
        rows = [(f"s{i}", "x", "r", "test", "CCMusic", "a", 0, "b", 1, 0.5) for i in (2, 1)]
        results.write_predictions(spark.createDataFrame(rows, results.PREDICTIONS), f"{where}/test_predictions.csv")
    assert (root / "m/seed0/test_confusion_matrix.csv").read_text() == "true_label,a,b\na,5,0\nb,2,1\n"
    assert (root / "m/seed0/test_predictions.csv").read_text().split("\n")[1].startswith("s1,x,r,test,CCMusic,a,0,b,1,0.5")
    back = runs.confusion_cells(spark, str(root), ["a", "b"])
    assert back.count() == 8 and back.where("true_label = 'b' and pred_label = 'a' and seed = 'seed1' and split = 'test'").first()["n"] == 2
    assert runs.run_metrics(spark, str(root)).select("method", "seed", "split", "num_samples").orderBy("seed").collect()[0].asDict() == {"method": "m", "seed": "seed0", "split": "test", "num_samples": 8}
    assert [r["label"] for r in runs.class_metrics(spark, str(root)).where("seed = 'seed0'").orderBy("label_id").collect()] == ["a", "b"]
    assert not [p for p in root.rglob("*") if p.name.endswith((".part", ".parts"))]


def test_run_costs(spark, tmp_path):
    runs_ = spark.createDataFrame([("m", 10, 4, 1.23456, 2.0, None, 3, 5), ("n", 0, 0, 0.0, 0.0, 7.126, 1, 1)], "method string, total_params long, trainable_params long, feature_prep_time_sec double, train_wall_time_sec double, peak_memory_mb double, best_epoch int, stopped_epoch int")
    epochs = spark.createDataFrame([("m", 1.0), ("m", 2.0)], "method string, seconds double")
    steps = spark.createDataFrame([], "method string, ms double")
    m, n = rollup.run_costs(runs_, epochs, steps, ["method"]).orderBy("method").collect()
    assert (m["trainable_ratio"], m["total_method_time_sec"], m["mean_epoch_time_sec"], m["mean_train_step_time_ms"], m["memory_metric_available"]) == (0.4, 3.235, 1.5, 0.0, False)
    assert (n["trainable_ratio"], n["peak_device_memory_mb"], n["mean_epoch_time_sec"]) == (0.0, 7.13, 0.0)


def test_run_meta_config_and_exports(spark, tmp_path):
    where = str(tmp_path)
    results.write_run_meta(spark, f"{where}/r/run_meta.json", "run_1", "seed0", 0, 3407, "v1", "2024-01-01", extra={"x": 1})
    meta = json.loads((tmp_path / "r/run_meta.json").read_text())
    assert meta["run_id"] == "run_1" and meta["x"] == 1 and meta["finished_at"]
    results.write_config(spark, {"a": {"名": [1, 2]}}, f"{where}/config.yaml")
    assert settings.read_yaml(spark, f"{where}/config.yaml") == {"a": {"名": [1, 2]}}
    assert results.merged_config({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "c": 4}) == {"a": {"x": 1, "y": 3}, "b": 1, "c": 4}
    assert results.merged_config({"a": {"x": 1}}, {"a": {"y": 3}}, deep=False) == {"a": {"y": 3}}
    assert results.exported(spark, {"config.yaml": "paper/c.yaml", "none.csv": "paper/n.csv"}, where, f"{where}/out") == ["none.csv"]
    assert (tmp_path / "out/paper/c.yaml").exists()
    results.write_selection(spark, {"best": "m"}, f"{where}/s/selection.json")
    assert json.loads((tmp_path / "s/selection.json").read_text()) == {"best": "m"}


def test_embedding_cache(spark, tmp_path):
    root = f"{tmp_path}/cache"
    df = spark.createDataFrame([("seed0", s, layer, f"g{i}", [float(layer), float(i)]) for s in ("train", "test") for layer in range(3) for i in range(4)], "seed_name string, split string, layer_index int, segment_id string, embedding array<double>")
    assert results.write_embeddings(df, root) and not results.write_embeddings(df, root)
    one = results.layer_embeddings(spark, root, "seed0", "test", 2)
    assert one.count() == 4 and {r["embedding"][0] for r in one.collect()} == {2.0}
    assert results.layer_count(spark, root) == 3 and results.layer_count(spark, root, f"{tmp_path}/none") == 3
    (tmp_path / "probe/layer_07").mkdir(parents=True)
    assert results.layer_count(spark, root, f"{tmp_path}/probe") == 8


def test_segments_are_written_as_files(spark, tmp_path):
    root = tmp_path / "seg"
    (root / "old").mkdir(parents=True)
    df = spark.createDataFrame([(f"train/s{i}.wav", [0.1 * i] * 400, 400) for i in range(5)], "segment_path string, samples array<double>, rate int").withColumn("wave", audio.encoded("samples", "rate"))
    assert results.write_segments(df, str(root)) == 5
    assert sorted(p.name for p in root.rglob("*.wav")) == [f"s{i}.wav" for i in range(5)] and not (root / "old").exists()
    x, rate, channels, depth = audio.decoded((root / "train/s3.wav").read_bytes())
    assert (len(x), rate, channels, depth) == (400, 400, 1, 16) and np.allclose(x, 0.3, atol=1e-4)


def test_subset_files(spark, tmp_path):
    where = tmp_path / "train10/seed0"
    where.mkdir(parents=True)
    with pytest.raises(GateError):
        results.subset_files(spark, str(tmp_path), "train10", "seed0")
    (where / "train_subset_segments.csv").write_text("segment_id,split\nz,train\na,train\n")
    (where / "train_subset_groups.csv").write_text("recording_group_id\ng\n")
    (where / "subset_meta.json").write_text('{"subset_train_segment_count": 2}')
    listed, groups, meta = results.subset_files(spark, str(tmp_path), "train10", "seed0")
    assert [r["segment_id"] for r in listed.orderBy("position").collect()] == ["z", "a"] and groups.count() == 1 and meta["subset_train_segment_count"] == 2


def test_summary(spark, tmp_path):
    rows = spark.createDataFrame([("fa", "CCMusic", "g1", "phrase"), ("fa", "External", "g1", None), ("fa", "ChMusic", "g9", "controlled")], "family_label string, source_dataset string, recording_group_id string, content_type string")
    one = results.class_statistics(rows).first()
    assert (one["ccmusic_kept_recordings"], one["external_kept_recordings"], one["chmusic_kept_recordings"], one["primary_unique_groups"]) == (1, 1, 1, 1)
    assert one["content_type_distribution"] == {"": 1, "phrase": 1}
    segments = spark.createDataFrame([(0, "fa", "train"), (0, "fa", "train"), (0, "fb", "test")], "split_seed int, family_label string, split string")
    assert results.segment_counts(segments).first().asDict() == {"split_seed": 0, "total_segments": 3, "per_class_per_split": {"fa": {"train": 2}, "fb": {"test": 1}}}
    (tmp_path / "audit.csv").write_text("sample_status,drop_reason\ndrop,too_short\nkeep,\ndrop,too_short\n")
    assert [tuple(r) for r in results.drop_reasons(spark, f"{tmp_path}/audit.csv").collect()] == [("too_short", 2)]
    results.write_summary(spark, f"{tmp_path}/out/summary.json", {"k": 1}, ["fa"], per_class_stats=results.class_statistics(rows))
    got = json.loads((tmp_path / "out/summary.json").read_text())
    assert got["classes"] == ["fa"] and got["per_class_stats"][0]["family_label"] == "fa" and "pyspark" in got["versions"]
    with pytest.raises(ValueError):
        files.bounded(spark.range(20), 10)


FREEZE = """
active_classes: [a, b, c, d, e, f]
family_abbr: {a: aa, b: bb, c: cc, d: dd, e: ee, f: ff}
ccmusic_whitelist: {a: [a1]}
chmusic_enabled_ids: [1]
chmusic_excluded_ids: [2]
chmusic_id_map: {1: a}
thresholds: {d05a_default: 0.7, d06a_default: 0.02, active_frame_ratio: 0.2, phrase_ratio_cap: 0.15, concentration_cap_floor: 15}
threshold_overrides:
  - {family_label: b, d05a: 0.9, scope: ccmusic_only}
split_seeds: [10, 20, 30]
seed_namespaces: {split: 0, phrase_downsampling: 101}
chmusic_r05_decisions: [{family_label: c, decision: accept_limited}]
external_test_exemptions: [{family_label: d, seed: 1}]
"""


def test_configuration(spark, tmp_path):
    (tmp_path / "freeze_config.yaml").write_text(FREEZE)
    given = settings.read_yaml(spark, f"{tmp_path}/freeze_config.yaml")
    assert settings.problems(given) == []
    config = settings.config_of(given)
    assert (config.silence_threshold, config.clipping_threshold, config.active_share, config.seeds, config.phrase_seed, config.accepted_external) == (0.7, 0.02, 0.2, (10, 20, 30), 111, ("c",))
    assert [tuple(r) for r in settings.overrides_of(spark, given).collect()] == [(0, "b", "silence_threshold", "ccmusic_only", 0.9)]
    assert [tuple(r) for r in settings.exemptions_of(spark, given).collect()] == [(1, "d", "external_test")]
    faults = [{"active_classes": ["a"] * 6}, {"family_abbr": {}}, {"thresholds": given["thresholds"] | {"d05a_default": 1.5}}, {"thresholds": {}}, {"split_seeds": [1]}, {"seed_namespaces": {}}, {"chmusic_excluded_ids": [1]}, {"chmusic_id_map": {5: "a"}}, {"chmusic_id_map": {1: "zz"}}]
    assert all(settings.problems(given | f) for f in faults)
    assert settings.problems({}) == [f"missing {k}" for k in settings.REQUIRED]
    with pytest.raises(GateError):
        settings.config_of({})
    (tmp_path / "one").mkdir()
    (tmp_path / "config.yaml").write_text("data_root_paths: {CCMusic: ./one, ChMusic: ./one}\noutput_dir: ./out\n")
    assert settings.preflight(spark, f"{tmp_path}/config.yaml")["output_dir"] == f"{tmp_path}/out"
    (tmp_path / "config.yaml").write_text("data_root_paths: {CCMusic: ./none, Other: ./one}\n")
    with pytest.raises(GateError, match="ChMusic.*Other.*no folder"):
        settings.preflight(spark, f"{tmp_path}/config.yaml")
    assert settings.newer("0.10.1", "0.9") and not settings.newer("1.4rc1", "1.5") and settings.newer("1.5", "1.5.0")
    assert settings.lacking_packages({"pyspark": "3.0", "no-such-package": "1"}) == ["no-such-package is not installed"]
    assert settings.lacking_tool(["no-such-program", "-v"], "1.5")


HEADER = ",".join(reviews.COLUMNS)


def test_review_file(spark, tmp_path):
    path = f"{tmp_path}/manual_review.csv"
    assert reviews.read_reviews(spark, path).count() == 0
    (tmp_path / "manual_review.csv").write_text(f"{HEADER}\nr1,i10_encoding,approved,,,,,24,ok,me\nr2,content_type,rejected,label_requires_guess,,,,,no,me\nr3,d09_cross,approved,,,r4,r4,,same,me\nr5,manual_merge,approved,,,r6,,,same,me\n")
    got = {r["record_id"]: (r["review_type"], r["value"], r["position"]) for r in reviews.read_reviews(spark, path).collect()}
    assert got == {"r1": ("bit_depth_review", "24", 0), "r2": ("content_type_review", "", 1), "r3": ("cross_duplicate_review", "r4", 2), "r5": ("group_merge_review", "", 3)}
    bad = ["r1,i10_encoding,approved,,phrase,,,24,x,me", "r1,d09_cross,approved,,,r1,r1,,x,me", "r1,d09_cross,approved,,,r2,r3,,x,me", "r1,content_type,rejected,exact_duplicate,,,,,x,me", "r1,manual_merge,rejected,exact_duplicate,,r2,,,x,me", "r1,other,approved,,,,,,x,me", "r1,i10_encoding,approved,,,,,24,,me", "r1,g02_fingerprint,approved,,,r2,,,x,me\nr2,g02_fingerprint,approved,,,r1,,,x,me"]
    for lines in bad:
        (tmp_path / "manual_review.csv").write_text(f"{HEADER}\n{lines}\n")
        with pytest.raises(GateError):
            reviews.read_reviews(spark, path)
    (tmp_path / "manual_review.csv").write_text("record_id,decision\nr1,approved\n")
    with pytest.raises(GateError, match="missing"):
        reviews.read_reviews(spark, path)


# ---- the second stage of grouping -------------------------------------------------------------

NONE = "record_id string, review_type string, decision string, value string, peer_record_id string, drop_reason string"


def stage_rows(spark):
    rows = [("r1", "CCMusic", "fa", "d1", "x", "g1"), ("r2", "CCMusic", "fb", "d1", "x", "g2"), ("r3", "CCMusic", "fa", "d2", "y", "g3"), ("r4", "CCMusic", "fa", "d2", "z", "g3"), ("r5", "CCMusic", "fa", "d3", "w", "g5")]
    return spark.createDataFrame([(*r, r[5], [], "keep", "", True, None, "", "filename_rule") for r in rows], "record_id string, source_dataset string, family_label string, source_subtype_dir string, audio_sha256 string, recording_group_id string, performer_or_recording_id string, applied_rule_ids array<string>, sample_status string, drop_reason string, is_decodable boolean, duplicate_of string, review_status string, grouping_method string")


def test_cross_duplicates_need_decisions(spark):
    rows = stage_rows(spark)
    with pytest.raises(curation.PendingReview) as e:
        curation.cross_resolved(rows, spark.createDataFrame([], NONE))
    assert [(r["record_id"], r["peer_record_id"]) for r in e.value.items.collect()] == [("r1", "r2")]
    decide = lambda *d: spark.createDataFrame([d], NONE)
    out = {r["record_id"]: r for r in curation.cross_resolved(rows, decide("r2", "cross_duplicate_review", "approved", "r2", "r1", "")).collect()}
    assert (out["r1"]["sample_status"], out["r1"]["drop_reason"], out["r1"]["duplicate_of"]) == ("drop", "exact_duplicate", "r2")
    assert out["r2"]["sample_status"] == "keep" and out["r2"]["applied_rule_ids"] == ["D09"] and out["r3"]["applied_rule_ids"] == []
    out = {r["record_id"]: r["sample_status"] for r in curation.cross_resolved(rows, decide("r1", "cross_duplicate_review", "rejected", "", "r2", "exact_duplicate")).collect()}
    assert out["r1"] == "drop" and out["r2"] == "keep"


def test_fingerprints_merge_groups(spark):
    rows = stage_rows(spark)
    prints = spark.createDataFrame([("r3", [1, 2, 3, 4]), ("r4", [1, 2, 3, 4]), ("r5", [1, 2, 3, 5]), ("r1", [-1, -1])], "record_id string, fingerprint array<bigint>")
    with pytest.raises(curation.PendingReview) as e:
        curation.fingerprint_merged(rows, prints, spark.createDataFrame([], NONE))
    pairs = sorted((r["record_id"], r["peer_record_id"]) for r in e.value.items.collect())
    assert pairs == [("r3", "r5"), ("r4", "r5")]
    said = spark.createDataFrame([("r5", "fingerprint_review", "approved", "", "r3", ""), ("r4", "fingerprint_review", "rejected", "", "r5", "")], NONE)
    out = {r["record_id"]: r for r in curation.fingerprint_merged(rows, prints, said).collect()}
    assert [out[r]["recording_group_id"] for r in ("r3", "r4", "r5")] == ["g3"] * 3 and out["r5"]["grouping_method"] == "fingerprint_merge" and out["r5"]["performer_or_recording_id"] == "g3"
    assert out["r5"]["applied_rule_ids"] == ["G02"] and out["r1"]["applied_rule_ids"] == [] and out["r1"]["audio_fingerprint_id"] and out["r2"]["audio_fingerprint_id"] == ""


def test_manual_merges(spark):
    rows = stage_rows(spark)
    said = lambda *d: spark.createDataFrame([("", *x) for x in d], "value string, record_id string, review_type string, decision string, peer_record_id string, position int")
    out = {r["record_id"]: r["recording_group_id"] for r in curation.manually_merged(rows, said(("r5", "group_merge_review", "approved", "r3", 0), ("r1", "group_merge_review", "approved", "r5", 1))).collect()}
    assert out == {"r1": "g1", "r2": "g2", "r3": "g1", "r4": "g1", "r5": "g1"}
    for pair in (("r1", "r9"), ("r1", "r2")):  # unknown, another family
        with pytest.raises(GateError):
            curation.manually_merged(rows, said((pair[0], "group_merge_review", "approved", pair[1], 0)))
    status = {r["record_id"]: r["review_status"] for r in curation.pair_reviewed(rows, said(("r1", "group_merge_review", "approved", "r5", 1), ("r5", "fingerprint_review", "rejected", "r3", 1))).collect()}
    assert status == {"r1": "approved", "r2": "", "r3": "rejected", "r4": "", "r5": "rejected"}


def test_open_reviews_are_queued(spark, tmp_path):
    audit = stage_rows(spark).withColumn("file_name", F.concat("record_id", F.lit(".wav"))).withColumn("source_path", F.col("file_name"))
    items = spark.createDataFrame([("r2", "cross_duplicate_review", "r1", "D09"), ("r1", "bit_depth_review", "", "I10")], "record_id string, review_type string, peer_record_id string, trigger_rule_id string")
    path = reviews.write_queue(items, audit, str(tmp_path))
    assert (tmp_path / "pending_review_queue.csv").read_text().split("\n")[:3] == [",".join(reviews.QUEUE), "r1,i10_encoding,CCMusic,fa,r1.wav,r1.wav,I10,,", "r2,d09_cross,CCMusic,fb,r2.wav,r2.wav,D09,,r1"]
    assert path.endswith("pending_review_queue.csv")
