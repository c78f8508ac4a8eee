"""Run files as they are written, and the summaries that were published for them (fixed values)."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import rollup
from tessera.operators.gates import GateError
from tessera.plans import analysis, evaluation
from tessera.sources import results, runs

#: (method, seed, total, trainable, ratio, preparation, training, total, epoch, step) of published runs.
COSTS = [
    ("linear", "seed0", 94376326, 4614, 4.888937931319768e-05, 159.258, 6.761, 166.019, 0.157, 0.625),
    ("linear", "seed1", 94376326, 4614, 4.888937931319768e-05, 143.575, 2.439, 146.014, 0.097, 0.514),
    ("linear", "seed2", 94376326, 4614, 4.888937931319768e-05, 160.864, 4.459, 165.323, 0.164, 0.717),
    ("lora_r8", "seed0", 94671238, 299526, 0.0031638542637416446, 0.0, 1338.608, 1338.608, 121.668, 161.911),
    ("lora_r8", "seed1", 94671238, 299526, 0.0031638542637416446, 0.0, 2426.747, 2426.747, 121.317, 163.288),
    ("lora_r8", "seed2", 94671238, 299526, 0.0031638542637416446, 0.0, 1072.367, 1072.367, 119.133, 159.842),
]
#: Mean and deviation of preparation, training, total, epoch and step.
COST_SUMMARY = {
    "linear": (154.56566666666666, 9.552008916104167, 4.553, 2.162532774318114, 159.11866666666666, 11.354308448044437, 0.13933333333333334, 0.0368284310463171, 0.6186666666666666, 0.10164808573373789),
    "lora_r8": (0.0, 0.0, 1612.5739999999998, 717.5509201213528, 1612.5739999999998, 717.5509201213528, 120.706, 1.373516290402123, 161.68033333333335, 1.7345415340467716),
}
#: (split, seed, samples, accuracy, macro F1, macro precision, macro recall) of one published method.
METRICS = [
    ("val", "seed0", 221, 0.9819004524886877, 0.9767867303301075, 0.9887910798122065, 0.9678559948569592), ("test", "seed0", 204, 0.9754901960784313, 0.9804920833999579, 0.9797211497211498, 0.9816899451045793), ("external_test", "seed0", 610, 0.44098360655737706, 0.3875519935745902, 0.44167274098493164, 0.4945169428685619),
    ("val", "seed1", 185, 0.9513513513513514, 0.9280853156309546, 0.9572954822954823, 0.9204166666666667), ("test", "seed1", 242, 0.987603305785124, 0.9885805408763808, 0.9884615384615385, 0.9889237746380605), ("external_test", "seed1", 610, 0.4524590163934426, 0.41190262406390604, 0.4763077906798101, 0.49363789225727933),
    ("val", "seed2", 230, 0.9521739130434783, 0.9604515090753623, 0.9635802469135802, 0.9626634689352459), ("test", "seed2", 233, 0.9098712446351931, 0.9333137427651711, 0.9317448680351906, 0.9420401000428361), ("external_test", "seed2", 610, 0.4672131147540984, 0.38837165639130866, 0.47095225021266957, 0.5227549754774112),
]
#: Samples a seed, then mean and deviation of the four metrics.
METRIC_SUMMARY = {
    "external_test": (610, 0.453551912568306, 0.013148862749197781, 0.3959420913432683, 0.01382830124520683, 0.4629775939591371, 0.018643846802985118, 0.5036366035344174, 0.016562828617337284),
    "test": (233, 0.9576549154995829, 0.04182273613297961, 0.96746212234717, 0.02984861231521796, 0.966642518739293, 0.03053658653701211, 0.9708846065951587, 0.02524056736912026),
    "val": (221, 0.9618085722945059, 0.017404938645032862, 0.9551078516788082, 0.02478654784764363, 0.9698889363404231, 0.016668618342476335, 0.9503120434862905, 0.026020006682404912),
}
#: (seed, training, total, epoch, step, groups, segments) of the smallest subset, and the summary of training time.
SUBSET = [("seed0", 0.338, 116.025, 0.023, 0.908, 23, 97), ("seed1", 0.67, 121.102, 0.022, 0.662, 23, 114), ("seed2", 0.941, 117.968, 0.024, 0.562, 23, 151)]
SUBSET_TRAINING = (0.6496666666666666, 0.30201379659434985)


def cost_file(total, trainable, ratio, prep, train, whole, epoch, step, memory=None):
    return json.dumps({
        "method": "shown", "model": "base", "seed_name": "seed", "device_type": "mps", "total_params": total, "trainable_params": trainable, "trainable_ratio": ratio, "feature_prep_time_sec": prep, "train_wall_time_sec": train,
        "total_method_time_sec": whole, "mean_epoch_time_sec": epoch, "mean_train_step_time_ms": step, "peak_device_memory_mb": memory, "memory_metric_available": memory is not None, "best_epoch": 3, "stopped_epoch": 8,
    }, indent=2)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("published")
    for method, seed, *fields in COSTS:
        (root / method / seed).mkdir(parents=True)
        (root / method / seed / "cost_metrics.json").write_text(cost_file(*fields))
        for split, s, n, *values in METRICS:
            if s == seed:
                name = "val_metrics_best.json" if split == "val" else f"{split}_metrics.json"
                (root / method / seed / name).write_text(json.dumps({"split": split, "num_samples": n, **dict(zip(("accuracy", "macro_f1", "macro_precision", "macro_recall"), values, strict=True))}))
                file = "val_per_class_metrics_best.csv" if split == "val" else f"{split}_per_class_metrics.csv"
                (root / method / seed / file).write_text("label_id,label,precision,recall,f1,support\n0,a,0.5,0.5,0.5,10\n")
    return str(root)


def test_cost_files_are_read_whole(spark, root):
    rows = runs.cost_metrics(spark, root).collect()
    assert len(rows) == len(COSTS)
    assert not [(c, r) for r in rows for c in runs.COST_FIELDS if r[c] is None and c != "peak_device_memory_mb"]


def test_published_summaries(spark, root):
    out = evaluation.rolled_up(spark, root, ["linear", "lora_r8"], costs=True)
    for r in out["costs"].collect():
        got = [r[f"{c}_{s}"] for c in runs.COST_MEANS[2:] for s in ("mean", "std")]
        assert got == pytest.approx(list(COST_SUMMARY[r["method"]]), abs=1e-12)
        assert (r["seed_count"], r["peak_device_memory_mb_mean"], r["peak_device_memory_mb_std"]) == (3, None, None)
        assert r["total_params"] == next(c[2] for c in COSTS if c[0] == r["method"])
    for r in out["summary"].where("method = 'linear'").collect():
        n, *values = METRIC_SUMMARY[r["split"]]
        assert (r["num_samples_per_seed"], r["seed_count"]) == (n, 3)
        assert [r[f"{m}_{s}"] for m in rollup.METRICS for s in ("mean", "std")] == pytest.approx(values, abs=1e-12)


def test_subset_counts_come_from_the_metadata(spark, tmp_path):
    for seed, train, whole, epoch, step, groups, segments in SUBSET:
        run = tmp_path / "linear" / "train10" / seed
        run.mkdir(parents=True)
        (run / "cost_metrics.json").write_text(cost_file(94376326, 4614, 4.888937931319768e-05, whole - train, train, whole, epoch, step))
        if seed != "seed2":
            (run / "run_meta.json").write_text(json.dumps({"run_id": "r", "subset_train_group_count": groups, "subset_train_segment_count": segments}))
    costs = runs.with_ratio(runs.cost_metrics(spark, str(tmp_path), ["method", "ratio_name", "seed"], with_meta=True), {"train10": 0.1})
    assert {(r["seed"], r["subset_train_group_count"], r["subset_train_segment_count"]) for r in costs.collect()} == {("seed0", 23, 97), ("seed1", 23, 114), ("seed2", None, None)}
    r = rollup.cost_summary(costs, ["method", "ratio_name", "ratio_value"], runs.COST_MEANS, "peak_device_memory_mb", "memory_metric_available", "total_params", "seed").first()
    assert (r["train_wall_time_sec_mean"], r["train_wall_time_sec_std"]) == pytest.approx(SUBSET_TRAINING, abs=1e-12)


def test_what_is_written_is_read(spark, tmp_path):
    made = spark.createDataFrame([("m", 10, 4, 1.0, 2.0, 7.126, 3, 5)], "method string, total_params long, trainable_params long, feature_prep_time_sec double, train_wall_time_sec double, peak_memory_mb double, best_epoch int, stopped_epoch int")
    epochs, steps = spark.createDataFrame([("m", 1.5)], "method string, seconds double"), spark.createDataFrame([("m", 2.25)], "method string, ms double")
    cost = rollup.run_costs(made, epochs, steps, ["method"])
    results.write_cost(cost.drop("method").withColumns({"model": F.lit("base"), "device_type": F.lit("cpu")}), f"{tmp_path}/m/seed0/cost_metrics.json")
    back = runs.cost_metrics(spark, str(tmp_path)).first().asDict()
    assert back == cost.first().asDict() | {"model": "base", "device_type": "cpu", "seed": "seed0"}


def test_a_missing_confusion_file_is_an_error(spark, tmp_path):
    (tmp_path / "m" / "seed0").mkdir(parents=True)
    (tmp_path / "m" / "seed0" / "test_confusion_matrix.csv").write_text("true_label,a,b\na,1,0\nb,2,3\n")
    need = lambda *seeds: spark.createDataFrame([("m", s, "test") for s in seeds], "method string, seed string, split string")
    assert runs.confusion_cells(spark, str(tmp_path), ["a", "b"], expected=need("seed0")).count() == 4
    with pytest.raises(GateError, match="m/seed1/test"):
        runs.confusion_cells(spark, str(tmp_path), ["a", "b"], expected=need("seed0", "seed1"))


#: (layer, split, macro F1 mean and deviation, accuracy mean and deviation) of three published layers, and their rows of the published table.
LAYERS = [
    (0, "external_test", 0.29701103507770776, 0.01883507629400216, 0.3628415300546448, 0.020757835970735054), (0, "test", 0.9661312093489595, 0.010657730629403218, 0.9616996315545809, 0.015880155475367756),
    (6, "external_test", 0.32378161581548387, 0.030794467799771325, 0.3879781420765027, 0.01658359661802569), (6, "test", 0.9802246731294165, 0.01514834100768753, 0.9747158880814294, 0.021549470350095783),
    (11, "external_test", 0.45154568967667147, 0.061180376650465, 0.5207650273224044, 0.04520351225712252), (11, "test", 0.9538712433461037, 0.03450610602157123, 0.9409544945681366, 0.048316095210504374),
]
LAYER_TABLE = [
    (0, "embedding_output", "0.9661±0.0107", "0.9617±0.0159", "0.2970±0.0188", "0.3628±0.0208"),
    (6, "transformer_layer_6", "**0.9802±0.0151**", "**0.9747±0.0215**", "0.3238±0.0308", "0.3880±0.0166"),
    (11, "transformer_layer_11", "0.9539±0.0345", "0.9410±0.0483", "**0.4515±0.0612**", "**0.5208±0.0452**"),
]


def test_the_published_layer_table(spark):
    summary = spark.createDataFrame(LAYERS, "layer_index int, split string, macro_f1_mean double, macro_f1_std double, accuracy_mean double, accuracy_std double")
    out = analysis.layer_report(summary)
    assert out.columns == ["layer_index", "layer_name", "test_macro_f1", "test_accuracy", "ext_macro_f1", "ext_accuracy"]
    assert [tuple(r) for r in out.collect()] == LAYER_TABLE
    lacking = analysis.layer_report(summary.where("layer_index <> 11 or split = 'test'")).collect()
    assert tuple(lacking[2])[4:] == ("-", "-") and lacking[1]["ext_macro_f1"] == "**0.3238±0.0308**"
    assert analysis.layer_report(summary.limit(0)).collect() == []
