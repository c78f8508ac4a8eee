"""Numbers and first rows by key against windows, and how they are dealt."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import numbering


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    keys = ["hot"] * 4000 + [f"k{i % 40}" for i in range(800)] + [None] * 60
    return spark.createDataFrame([(k, rng.choice([None, *"abcdefgh"]), i, rng.random()) for i, k in enumerate(keys)], "k string, s string, id long, x double").repartition(5)


def window(rows, by, order, n=lambda w: F.row_number().over(w)):
    return {r["id"]: r["n"] for r in rows.withColumn("n", n(Window.partitionBy(*by).orderBy(*order))).collect()}


@pytest.mark.parametrize("sent", [numbering.MOST_SENT, 3])
@pytest.mark.parametrize("by", [["k"], ["k", "s"], []])
def test_numbers_are_those_of_a_window(spark, rows, by, sent, monkeypatch):
    monkeypatch.setattr(numbering, "MOST_SENT", sent)
    order = ["s", -F.col("x"), "id"]
    out = numbering.numbers(rows, by, order)
    got = [(r["id"], r["n"]) for r in out.collect()]
    assert len(got) == rows.count() and dict(got) == window(rows, by, order)
    assert out.columns == ["k", "s", "id", "x", "n"] and sorted(got) == sorted((r["id"], r["n"]) for r in out.collect())


def test_a_hot_key_lies_in_several_tasks(spark, rows):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = numbering.numbers(rows, ["k"], ["id"])
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan
        tasks = out.where("k = 'hot'").withColumn("t", F.spark_partition_id()).groupBy("t").count().collect()
        assert len(tasks) >= 3 and max(t["count"] for t in tasks) < 3000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_edges(spark):
    empty = spark.createDataFrame([], "k string, id long")
    assert numbering.numbers(empty, ["k"], ["id"]).collect() == []
    same = spark.createDataFrame([("a", 1)] * 7, "k string, id long")
    assert sorted(r["n"] for r in numbering.numbers(same, ["k"], ["id"], "n").collect()) == list(range(1, 8))
    arrays = spark.createDataFrame([([1, 10], 1), ([1, 9], 2), (None, 3)], "a array<int>, id long")
    assert {r["id"]: r["n"] for r in numbering.numbers(arrays, [], ["a"]).collect()} == {3: 1, 2: 2, 1: 3}


@pytest.mark.parametrize("held", [40, numbering.HELD])
def test_first_rows(spark, rows, held, monkeypatch):
    monkeypatch.setattr(numbering, "HELD", held)
    limits = spark.createDataFrame([("hot", 12), ("k3", 6), ("k4", 0), ("k5", 10_000), ("none", 3)], "k string, limit int")
    got = sorted(r["id"] for r in numbering.first_rows(rows, "k", ["s", "id"], limits).collect())
    most = {r["k"]: r["limit"] for r in limits.collect()}
    keys = {r["id"]: r["k"] for r in rows.collect()}
    assert got == sorted(i for i, n in window(rows, ["k"], ["s", "id"]).items() if n <= most.get(keys[i], 0))


def test_first_rows_are_cut_before_they_are_shuffled(spark, rows):
    limits = spark.createDataFrame([("hot", 12)], "k string, limit int")
    out = numbering.first_rows(rows, "k", ["id"], limits)
    plan = out._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Window") :]
    assert below.index("Exchange hashpartitioning(k") < below.index("MapInArrow")
