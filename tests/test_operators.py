import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import dedup, gates, joins, metrics, qc, registry, review, rollup, sampling, segments, split
from tessera.operators.gates import GateError


def test_rules_keep_the_trail(spark):
    df = spark.createDataFrame([("a", True, 2.0, 0.9, 0.5), ("b", False, -1.0, -1.0, -1.0), ("c", True, 3.0, 0.6, 0.0)], "record_id string, is_decodable boolean, duration_sec double, silence_ratio double, clipping_ratio double").withColumn("silence_threshold", F.lit(0.6)).withColumn("clipping_threshold", F.lit(0.01))
    got = {r["record_id"]: (r["applied_rule_ids"], r["drop_reason"], r["sample_status"]) for r in qc.apply_rules(df, qc.audio_rules()).collect()}
    assert got == {"a": (["D04", "D05a", "D06a"], "too_short", "drop"), "b": (["D03"], "decode_failure", "drop"), "c": ([], "", "keep")}


def test_first_override_wins(spark):
    rows = spark.createDataFrame([("x", "S"), ("x", "C"), ("y", "S")], "family_label string, source_dataset string")
    over = spark.createDataFrame([(0, "x", "t", "c_only", 0.1), (1, "x", "t", "all", 0.2), (2, "x", "t", "all", 0.3)], "pos int, family string, threshold_key string, scope string, value double")
    out = qc.resolved_threshold(rows, over, "t", 0.5, "v", only_sources={"c_only": "C"})
    assert sorted((r["family_label"], r["source_dataset"], r["v"]) for r in out.collect()) == [("x", "C", 0.1), ("x", "S", 0.2), ("y", "S", 0.5)]


def test_components_and_merges(spark):
    edges = spark.createDataFrame([("g3", "g2"), ("g2", "g1"), ("g9", "g8")], "a string, b string")
    assert dict((r[0], r[1]) for r in dedup.components(edges).collect()) == {"g1": "g1", "g2": "g1", "g3": "g1", "g8": "g8", "g9": "g8"}
    assert dedup.merged_in_order({"a": "g1", "b": "g2", "c": "g2"}, [("a", "b")]) == {"a": "g1", "b": "g1", "c": "g1"}
    rows = spark.createDataFrame([("a", "g1"), ("b", "g2"), ("c", "g2"), ("d", "g4")], "record_id string, recording_group_id string")
    pairs = spark.createDataFrame([("b", "a")], "record_id string, peer_record_id string")
    assert sorted((r[0], r[1]) for r in dedup.merged_groups(rows, pairs).select("record_id", "recording_group_id").collect()) == [("a", "g1"), ("b", "g1"), ("c", "g1"), ("d", "g4")]


def test_clusters(spark):
    members = spark.createDataFrame([("k", "a"), ("k", "b"), ("l", "c"), ("l", "d"), ("m", "e"), ("m", "f"), ("n", "g"), ("n", "h")], "cluster string, record_id string")
    votes = spark.createDataFrame([("a", "canonical"), ("b", "rejected"), ("c", "rejected"), ("e", "canonical"), ("f", "canonical")], "record_id string, vote string")
    got = {r["cluster"]: (r["winner"], r["problem"]) for r in dedup.resolved_clusters(members, votes).collect()}
    assert got == {"k": ("a", None), "l": ("d", None), "m": (None, "several_canonical"), "n": (None, "several_survivors")}


def test_fingerprint_candidates(spark):
    rows = [("a", "f", "s1", [1, 2, 3, 4]), ("b", "f", "s2", [1, 2, 3, 4, 5]), ("c", "f", "s3", [0xFFFF, 1, 2, 3, 4]), ("d", "f", "s2", [1]), ("e", "g", "s9", [1, 2, 3, 4])]
    df = spark.createDataFrame(rows, "record_id string, family string, subtype string, fp array<bigint>")
    got = {(r["a"], r["b"]): r["containment_sim"] for r in dedup.fingerprint_candidates(df, "family", "subtype", "fp").collect()}
    assert ("a", "b") in got and got[("a", "b")] is None
    assert ("a", "e") not in got and ("a", "d") not in got


def test_review(spark):
    ok = dict(record_id="r1", review_type="bit_depth_review", decision="approved", value="16", peer_record_id="", drop_reason="")
    bad = [ok, ok | {"record_id": ""}, ok | {"record_id": "r2", "decision": "maybe"}, ok | {"record_id": "r3", "value": "8"}, ok | {"record_id": "r4", "review_type": "fingerprint_review", "peer_record_id": "r4"}, ok]
    df = spark.createDataFrame(bad)
    found = {(r["check"], r["record_id"]) for r in review.violations(df).collect()}
    assert {("required_empty", ""), ("unknown_decision", "r2"), ("bad_bit_depth", "r3"), ("self_pair", "r4"), ("repeated_key", "r1")} <= found
    assert review.violations(df.limit(1)).count() == 0


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, x string")
    right = spark.createDataFrame([(1, "a", 9), (2, "c", 8)], "k int, x string, y int")
    assert {r["k"]: r["y"] for r in joins.many_to_one(left, right, ["k"]).collect()} == {1: 9, 2: 8, 3: None}
    with pytest.raises(ValueError):
        joins.many_to_one(left, right.union(right), ["k"])
    assert [r["k"] for r in joins.unmatched(left, right, ["k"]).collect()] == [3]
    assert [(r["k"], r["left"], r["right"]) for r in joins.disagreements(left, right, ["k"], ["x"]).collect()] == [(2, "b", "c")]


def test_metrics(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")]
    cells = metrics.confusion(spark.createDataFrame(pairs, "t string, p string"), "t", "p")
    m = metrics.macro(cells).first()
    assert m["accuracy"] == 0.5 and m["num_samples"] == 4
    assert m["macro_f1"] == pytest.approx((0.5 + 2 / 3 + 0) / 3)
    labels = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "label string")
    assert {r["label"]: r["support"] for r in metrics.per_class(cells, labels).collect()} == {"a": 2, "b": 1, "c": 1, "d": 0}
    assert metrics.dense(cells, labels).count() == 16
    assert metrics.support_errors(metrics.per_class(cells, labels), cells).count() == 0


def test_rollups(spark):
    df = spark.createDataFrame([("m", "test", s, a, n) for s, a, n in ((0, 0.5, 204), (1, 0.7, 242), (2, 0.6, 233))], "method string, split string, seed int, accuracy double, n long")
    r = rollup.mean_std(df, ["method", "split"], ("accuracy",), samples="n").first()
    assert r["accuracy_mean"] == pytest.approx(0.6) and r["accuracy_std"] == pytest.approx(0.1) and r["num_samples_per_seed"] == 233
    top = rollup.diverse_top_k(spark.createDataFrame([("x", i, 1.0 - i / 100) for i in range(10)] + [("y", 50, 0.1)], "kind string, id int, s double"), "kind", "s", "id", 3)
    assert [(r["id"], r["case_rank"]) for r in top.orderBy("case_rank").collect()] == [(0, 1), (50, 2), (1, 3)]
    status = spark.createDataFrame([("m", "completed")] * 12 + [("k", "failed")] + [("l", "completed")], "m string, status string")
    assert {r["m"]: r["status"] for r in rollup.status_rollup(status, "m").collect()} == {"m": "completed", "k": "failed", "l": "partial"}


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "run_id string, n int, note string")
    new = spark.createDataFrame([("b", 5), ("c", 6)], "run_id string, n int")
    assert sorted(tuple(r) for r in registry.upserted(old, new, "run_id").collect()) == [("a", 1, "x"), ("b", 5, "y"), ("c", 6, None)]


def test_split_is_whole_and_balanced(spark):
    r = random.Random(2)
    rows = [(f, f"{f}{g}") for f in "ab" for g in range(40) for _ in range(r.randrange(1, 6))]
    df = spark.createDataFrame(rows, "family string, g string")
    for compatible in (False, True):
        out = split.group_split(df, "family", "g", 11, compatible=compatible)
        shares = split.split_shares(df.join(out.select("g", "split"), "g"), ["family"], dict(zip(split.SPLITS, split.TARGETS, strict=True))).collect()
        assert len(shares) == 6 and all(abs(s["deviation"]) < 0.05 for s in shares)
    assert split.leaks(df.join(out.select("g", "split"), "g"), ["g"]).count() == 0


def test_greedy_never_leaves_a_split_empty():
    where = split.placed_groups(["a", "b", "c"], [10, 1, 1])
    assert sorted(where) == [0, 1, 2]
    assert split.repaired([7, 2, 1, 1], [0, 0, 1, 2]) == [0, 1, 1, 2] or split.deviation([7, 2, 2]) <= split.deviation([9, 1, 1])


def test_sampling(spark):
    df = spark.createDataFrame([("f", f"r{i}", "phrase" if i < 30 else "technique") for i in range(100)], "family string, record_id string, kind string")
    gone = sampling.quota_drops(df, "family", F.col("kind") == "phrase", "record_id", 0.15, 101).count()
    assert (30 - gone) / (100 - gone) <= 0.15 < (30 - gone + 1) / (100 - gone + 1)
    picked = sampling.python_sample(df.where("kind = 'phrase'"), "family", "record_id", ["kind"], 5, spark.createDataFrame([("f", 4)], "family string, k long"))
    names = sorted(f"r{i}" for i in range(30))
    assert sorted(r["record_id"] for r in picked.collect()) == sorted(names[i] for i in random.Random(5).sample(range(30), 4))
    groups = {"a": ["g2", "g1", "g3"], "b": ["h1"]}
    out = sampling.python_group_subset(groups, 0.5, 7)
    want = ["g1", "g2", "g3"]
    random.Random(7).shuffle(want)
    assert out == {"a": want[:2], "b": ["h1"]}


def test_segments(spark):
    df = spark.createDataFrame([("a", [float(i) for i in range(25)]), ("b", [1.0] * 7), ("c", [1.0] * 3)], "id string, x array<double>")
    out = segments.segmented(df, "x", 10, 5).orderBy("id", "segment_position").collect()
    assert [(r["id"], r["segment_position"], len(r["x"]), r["is_padded"]) for r in out] == [("a", 0, 10, False), ("a", 1, 10, False), ("b", 0, 10, True)]
    assert out[2]["x"] == [1.0] * 7 + [0.0] * 3


def test_short_pieces_join(spark):
    df = spark.createDataFrame([(100.0, [(1.0, 3.0), (50.0, 52.0), (55.0, 57.0)]), (10.0, [])], "total double, s array<struct<start:double,stop:double>>")
    got = [[tuple(p) for p in r[0]] for r in df.select(segments.pieces_between(F.col("total"), F.col("s"), 10.0)).collect()]
    assert got == [[(0.0, 56.0), (56.0, 100.0)], [(0.0, 10.0)]]


def test_gates(spark):
    rows = spark.createDataFrame([("a", f"g{i % 8}", "keep") for i in range(30)] + [("b", "h", "keep")], "family string, g string, sample_status string")
    families = spark.createDataFrame([("a",), ("b",), ("c",)], "family string")
    found = {(r["check"], r["key"]) for r in gates.replacement_gates(rows, families, "family", "g").collect()}
    assert {("R01", "b"), ("R01", "c"), ("R03_hard", "b"), ("R03_hard", "c")} <= found and not any(k == "a" for _, k in found)
    with pytest.raises(GateError):
        gates.require(gates.replacement_gates(rows, families, "family", "g"), "gates")
