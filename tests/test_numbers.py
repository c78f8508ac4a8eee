"""Identifiers past their digits, numeric orders, draws with replacement."""

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import dedup, sampling, segments
from tessera.plans import curation
from tessera.sources import manifests


def test_numbers_longer_than_their_digits_stay_whole(spark):
    got = [r["x"] for r in spark.createDataFrame([(7,), (999_999,), (1_000_000,), (100_000,)], "n long").select(text.numbered(F.lit("x_"), F.col("n")).alias("x")).collect()]
    assert got == ["x_000007", "x_999999", "x_1000000", "x_100000"]


def test_more_groups_than_digits(spark):
    df = spark.range(12_345).select(F.lit("f").alias("family"), F.format_string("k%06d", "id").alias("key"), "id")
    got = dedup.group_numbers(df, ["family"], ["key"], F.lit("p"))
    assert got.select("recording_group_id").distinct().count() == 12_345
    assert got.where("id = 12344").first()["recording_group_id"] == "p_G12345" and got.where("id = 41").first()["recording_group_id"] == "p_G0042"


def test_group_keys_may_be_null(spark):
    df = spark.createDataFrame([("f", None), ("f", "a"), ("f", None)], "family string, key string")
    assert sorted(r[0] for r in dedup.group_numbers(df, ["family"], ["key"], F.lit("p")).select("recording_group_id").collect()) == ["p_G0001", "p_G0001", "p_G0002"]


def test_external_groups_are_numbered_apart_in_numeric_order(spark):
    rows = [(f"r{i}", s, f, "d", "fam", n, [], "keep", "", True, "", 0) for i, (s, f, n) in enumerate([("ChMusic", "1.10.wav", "1.10"), ("ChMusic", "1.9.wav", "1.9"), ("CCMusic", "b.wav", "b"), ("CCMusic", "a.wav", "a"), ("ChMusic", "1.2.wav", "1.2")])]
    audit = spark.createDataFrame(rows, "record_id string, source_dataset string, file_name string, source_subtype_dir string, family_label string, normalized_base_name string, applied_rule_ids array<string>, sample_status string, drop_reason string, is_decodable boolean, audio_sha256 string, take_id int")
    got = {r["file_name"]: (r["recording_group_id"], r["grouping_method"]) for r in curation.grouped(audit, curation.Config({"fam": "fm"})).collect()}
    assert got == {"1.2.wav": ("chm_fm_G0001", "unique_singleton"), "1.9.wav": ("chm_fm_G0002", "unique_singleton"), "1.10.wav": ("chm_fm_G0003", "unique_singleton"), "a.wav": ("ccm_fm_G0001", "filename_rule"), "b.wav": ("ccm_fm_G0002", "filename_rule")}


def test_weighted_draws_repeat_rows_and_balance_labels(spark):
    df = spark.createDataFrame([(i, "rare" if i < 3 else "common") for i in range(300)], "id long, label string")
    got = sampling.weighted_draw(df, "label", "id", 2000, 5).collect()
    assert len(got) == 2000 and {r["draw"] for r in got} == set(range(2000))
    rare = [r["id"] for r in got if r["label"] == "rare"]
    assert 850 < len(rare) < 1150 and set(rare) == {0, 1, 2}
    assert got == sampling.weighted_draw(df, "label", "id", 2000, 5).collect() or sorted(got) == sorted(sampling.weighted_draw(df, "label", "id", 2000, 5).collect())


def test_ties_of_a_cap_are_broken(spark):
    df = spark.createDataFrame([("s", 1, "b"), ("s", 1, "a"), ("s", 2, "a")], "sample string, start int, family string")
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "family string, rows long")
    got = segments.capped(df, "sample", "family", "start", rows, floor=1, share=0.0, tie=["family"]).collect()
    assert [(r["start"], r["family"], r["segment_index"]) for r in got] == [(1, "a", 0)]


def test_manifests_are_sorted_by_code_points(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("É",), ("Z",), ("a",)], "name string").repartition(3)
    manifests.write_manifest(df, str(tmp_path / "m"), ["name"], order=["name"])
    files = list((tmp_path / "m").glob("part-*.csv"))
    assert len(files) == 1 and files[0].read_text().split("\n")[:5] == ["name", "Z", "a", "b", "É"]
