import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.gates import GateError
from tessera.plans import curation, evaluation
from tessera.sources import audio, manifests, scan


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("audio")
    for family, abbr in (("bells", "bl"), ("drums", "dr")):
        for i in range(12):
            p = root / "ccm" / family / f"选段{i} take.wav" if i < 2 else root / "ccm" / family / f"技法{i}.wav"
            p.parent.mkdir(parents=True, exist_ok=True)
            x = np.sin(np.arange(int(400 * (3.5 + i))) * (0.1 + 0.01 * i + (0.2 if abbr == "dr" else 0)))
            p.write_bytes(audio.wave_bytes(x * 0.5, 400))
    (root / "ccm" / "bells" / "技法2 copy.wav").write_bytes((root / "ccm" / "bells" / "技法2.wav").read_bytes())
    (root / "ccm" / "other").mkdir()
    (root / "ccm" / "other" / "x.wav").write_bytes(b"x")
    (root / "chm").mkdir()
    for k, n in enumerate(("1.1.wav", "1.10.wav", "1.9.wav", "2.1.wav", "9.1.wav")):
        (root / "chm" / n).write_bytes(audio.wave_bytes(np.sin(np.arange(1600) * (0.3 + k / 10)) * 0.5, 400))
    return root


def scanned(spark, tree):
    ccm = scan.parts(scan.listing(spark, str(tree / "ccm"), "*.wav"), str(tree / "ccm"))
    chm = scan.parts(scan.listing(spark, str(tree / "chm"), "*.wav"), str(tree / "chm"))
    whitelist = scan.whitelist_lookup(spark, {"bells": ["bells"], "drums": ["drums"]})
    ids = scan.id_lookup(spark, [1, 2], [9], {1: "bells", 2: "drums"})
    return scan.scanned({"ccm": scan.scan_folders(ccm, whitelist, "CCMusic"), "chm": scan.scan_numbered(chm, ids, "ChMusic")})


def test_curation(spark, tree):
    rows = scanned(spark, tree)
    assert rows.count() == 31
    chm = [(r["record_id"], r["file_name"], r["scan_status"]) for r in rows.where("source_dataset = 'ChMusic'").orderBy("record_id").collect()]
    assert [c[1] for c in chm] == ["1.1.wav", "1.9.wav", "1.10.wav", "2.1.wav", "9.1.wav"] and chm[-1][2] == "out_of_scope"
    assert rows.where("drop_reason = 'subtype_out_of_scope'").count() == 1
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tree))
    profile = audio.profile(files).withColumn("path", F.regexp_replace("path", r"^.*/(ccm|chm)/", ""))
    config = curation.Config({"bells": "bl", "drums": "dr"}, min_kept=5, min_groups=2, wanted_groups=3, min_external=1, seeds=(1, 2), phrase_cap=0.10)
    none = spark.createDataFrame([], "record_id string, review_type string, decision string, value string")
    with pytest.raises(GateError):
        curation.run(rows, profile, none, curation.Config({}))
    out = curation.run(rows, profile, none, config)
    audit = out["audit"].cache()
    assert {r["drop_reason"] for r in audit.select("drop_reason").distinct().collect()} >= {"", "exact_duplicate", "phrase_quota_downsampled"}
    assert audit.where("duplicate_of is not null").count() == 1
    frozen = out["frozen"].cache()
    assert frozen.select("sample_id").distinct().count() == frozen.count()
    split = out["split"].cache()
    assert split.count() == 2 * frozen.count()
    assert {r["split"] for r in split.where("source_dataset = 'ChMusic'").select("split").distinct().collect()} == {"external_test"}
    waves = audio.waveforms(files).withColumn("source_path", F.regexp_replace("path", r"^.*/(ccm|chm)/", "")).join(frozen.select("source_path", "record_id"), "source_path").select("record_id", "samples")
    segments = curation.segment_rows(split, waves, config, rate=400).cache()
    assert segments.count() > 0
    assert {len(r["samples"]) for r in segments.select("samples").collect()} == {2000}
    assert segments.groupBy("segment_id", "split_seed").count().where("count > 1").count() == 0


def test_pending_review_stops(spark):
    audit = spark.createDataFrame([("r1", -1, "phrase", "keep", "")], "record_id string, bit_depth int, content_type string, sample_status string, drop_reason string")
    items = spark.createDataFrame([("r1", "bit_depth_review", "I10")], "record_id string, review_type string, trigger_rule_id string")
    none = spark.createDataFrame([], "record_id string, review_type string, decision string, value string")
    with pytest.raises(curation.PendingReview) as e:
        curation.reviewed(audit, items, none)
    assert e.value.items.count() == 1
    done = curation.reviewed(audit, items, spark.createDataFrame([("r1", "bit_depth_review", "approved", "24")], none.schema)).first()
    assert done["bit_depth"] == 24 and done["review_status"] == "approved"


def test_manifests(spark, tmp_path):
    df = spark.createDataFrame([("s,1", 0.5, True, None, ["a", "b"])], "sample_id string, x double, flag boolean, empty string, rules array<string>")
    path = str(tmp_path / "m")
    manifests.write_manifest(df, path, ["sample_id", "x", "flag", "empty", "rules", "missing"])
    assert tuple(manifests.read_manifest(spark, path).first()) == ("s,1", "0.5", "true", "", "a,b", "")
    with pytest.raises(GateError):
        manifests.read_manifest(spark, path, ["nothing"])
    split = spark.createDataFrame([("s1", "0", "train", "fa")], "sample_id string, split_seed string, split string, family_label string")
    seg = spark.createDataFrame([("s1", "0", "train", "fa", "g1", "train/g1.wav", "0"), ("s1", "0", "train", "fa", "g2", "train/g2.wav", "1")], "sample_id string, split_seed string, split string, family_label string, segment_id string, segment_path string, segment_index string")
    joined = manifests.joined_manifests(split, seg, ["family_label"])
    table = manifests.unified(joined, manifests.label_map(spark, {"fa": 0}), "/data")
    assert {r["audio_path"] for r in table.collect()} == {"/data/seed0/train/g1.wav", "/data/seed0/train/g2.wav"}
    listed = spark.createDataFrame([(0, "g2")], "position int, segment_id string")
    assert [r["segment_id"] for r in manifests.train_subset(table, listed, 1).collect()] == ["g2"]
    with pytest.raises(GateError):
        manifests.train_subset(table, spark.createDataFrame([(0, "g9")], listed.schema))
    with pytest.raises(GateError):
        manifests.joined_manifests(split, seg.withColumn("sample_id", F.lit("s2")), ["family_label"])


def test_evaluation(spark, tmp_path):
    for m, base in (("one", 0.5), ("two", 0.7)):
        for s in range(3):
            run = tmp_path / "runs" / m / f"seed{s}"
            run.mkdir(parents=True)
            for split, name in (("val", "val_metrics_best.json"), ("test", "test_metrics.json"), ("external_test", "external_test_metrics.json")):
                (run / name).write_text(json.dumps({"accuracy": base + s / 100, "macro_f1": base, "num_samples": 10 + s, "model": "k"}, indent=1))
                file = "val_per_class_metrics_best.csv" if split == "val" else f"{split}_per_class_metrics.csv"
                (run / file).write_text("label_id,label,precision,recall,f1,support\n0,a,0.5,0.5,0.5,10\n")
            (run / "cost_metrics.json").write_text(json.dumps({"total_params": 9, "trainable_params": 5 if m == "one" else 3, "total_method_time_sec": 2.0 + s, "memory_metric_available": False}))
    out = evaluation.rolled_up(spark, str(tmp_path / "runs"), ["one", "two"], costs=True)
    rows = {(r["method"], r["split"]): r for r in out["summary"].collect()}
    assert len(rows) == 6 and rows[("one", "val")]["accuracy_mean"] == pytest.approx(0.51) and rows[("one", "val")]["num_samples_per_seed"] == 11
    assert out["classes"].count() == 6
    assert {r["total_method_time_sec_mean"] for r in out["costs"].collect()} == {3.0} and {r["peak_device_memory_mb_mean"] for r in out["costs"].collect()} == {None}
    with pytest.raises(GateError):
        evaluation.rolled_up(spark, str(tmp_path / "runs"), ["one", "two", "three"])
    best = evaluation.selected(out["summary"].where("split = 'val'"), out["costs"].select("method", F.col("trainable_params_mean").alias("trainable_params")), ["one", "two"])
    assert best.first()["method"] == "two"
    assert evaluation.seeds_in_order(lambda s: 1 / (s != "seed1"), "seed1", ["seed0"])["seed0"] == "blocked"


def test_streaming(spark, tmp_path):
    from tessera import streaming

    spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:10:00", 2.0), (1, "2024-01-01 05:00:00", 3.0), (2, "2024-01-01 09:00:00", 4.0)], "user_id int, ts string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id int, ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = streaming.sessions(stream, "user_id").writeStream.format("memory").queryName("tessera_sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["user_id"], r["n"]) for r in spark.table("tessera_sessions").collect()} <= {(1, 2), (1, 1), (2, 1)}


def streamed(spark, tmp_path, frame, name):
    """A stream's whole result, run to its end."""
    where = str(tmp_path / name)
    q = frame.writeStream.format("parquet").option("path", where).option("checkpointLocation", f"{where}-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(frame.schema).parquet(where)


def test_windows_and_duplicates_of_a_stream(spark, tmp_path):
    from tessera import streaming

    rows = [(1, "2024-01-01 00:00:10", 1.0), (1, "2024-01-01 00:04:59", 2.0), (2, "2024-01-01 00:05:00", 4.0), (1, "2024-01-01 00:00:10", 8.0), (2, "2024-01-01 00:12:00", 16.0), (3, "2024-01-01 03:00:00", 32.0)]
    spark.createDataFrame(rows, "user_id int, ts string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema("user_id int, ts timestamp, value double").parquet(str(tmp_path / "events"))
    closed = {(str(r["start"]), r["n"], r["total"]) for r in streamed(spark, tmp_path, streaming.tumbling(stream, "value"), "tumbling").collect()}
    assert closed == {("2024-01-01 00:00:00", 3, 11.0), ("2024-01-01 00:05:00", 1, 4.0), ("2024-01-01 00:10:00", 1, 16.0)}  # the last window is still open
    first = streamed(spark, tmp_path, streaming.distinct_within(stream, ["user_id"]), "distinct").collect()
    assert sorted(r["user_id"] for r in first) == [1, 2, 3]
