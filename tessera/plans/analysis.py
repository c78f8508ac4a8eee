"""Analysis tables over rolled-up results: classes, error cases, confusions, layers, subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import mean_std
from ..operators import gates, joins, rollup, sampling
from ..operators.gates import GateError

SPLITS = ("test", "external_test")
#: The columns of the error table, in their order.
CASES = ["case_rank", "source_phase", "method_short", "method_display", "seed_name", "split", "segment_id", "segment_abs_path", "dataset_name", "true_label", "pred_label", "top1_score", "error_pair"]


def place_of(column, order: list[str], other: int = 99):
    """The place of a value in a list; ``other`` for what it lacks."""
    return F.coalesce(*(F.when(column == v, i) for i, v in enumerate(order)), F.lit(other))


def class_tables(first: DataFrame, second: DataFrame, shorts: dict[str, str], order: list[str], best: str, best_lora: str) -> DataFrame:
    """Class summaries of two phases in one table: tagged, ranked by class, in the order of the methods.

    ``shorts``: display name -> short name; a method it lacks has none and comes last.
    """
    both = first.withColumn("source_phase", F.lit(1)).unionByName(second.withColumn("source_phase", F.lit(2))).where(F.col("split").isin(*SPLITS))
    pairs = [F.lit(x) for pair in shorts.items() for x in pair]
    named = both.withColumn("method_short", F.element_at(F.create_map(*pairs), F.col("method"))).withColumn("is_best_phase2", F.col("method") == best).withColumn("is_best_lora", F.col("method") == best_lora)
    placed = named.withColumn("_place", place_of(F.col("method_short"), order))
    ranked = rollup.ranked(placed, ["split", "label_id"], "f1_mean", ["source_phase", "_place", "method"], "rank_in_split_class_by_f1_mean", "is_best_in_class")
    return ranked.orderBy("source_phase", "_place", "split", "label_id", "method").drop("_place")


def error_tables(predictions: DataFrame, segments: DataFrame | None, top_k: int, split: str, root: str, tags: dict) -> tuple[DataFrame, DataFrame]:
    """The diverse top cases with their segments' paths, and the summary of every error pair.

    A case whose segment is not listed keeps an empty path. Without errors both
    are empty. ``tags``: constant columns (method_short, seed_name, ...).
    """
    cases = rollup.diverse_top_k(rollup.error_cases(predictions), "error_pair", "top1_score", "segment_id", top_k)
    if segments is not None:
        own = segments.where(F.col("split") == split).select("segment_id", F.col("segment_path").alias("_path"), F.col("source_dataset").alias("_source"))
        cases = cases.join(own, "segment_id", "left").withColumn("segment_abs_path", F.coalesce(F.concat_ws("/", F.lit(root.rstrip("/")), F.when(F.col("_path").isNotNull(), F.col("_path"))), F.lit("")))
        cases = cases.withColumn("segment_abs_path", F.when(F.col("_path").isNull(), "").otherwise(F.col("segment_abs_path"))).withColumn("dataset_name", F.coalesce("source_dataset" if "source_dataset" in cases.columns else "_source", "_source", F.lit("")))
    else:
        cases = cases.withColumn("segment_abs_path", F.lit("")).withColumn("dataset_name", F.lit(""))
    constant = lambda df: df.withColumns({k: F.lit(v) for k, v in tags.items()})
    cases = constant(cases)
    errors = rollup.error_cases(predictions)
    summary = errors.groupBy("true_label", "pred_label", "error_pair").agg(F.count("segment_id").alias("count"), *(f("top1_score").alias(f"{n}_score") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))))
    return cases.select(*(c for c in CASES if c in cases.columns)).orderBy("case_rank"), constant(summary).withColumn("split", F.lit(split)).orderBy(F.desc("count"), "error_pair")


def confusion_tables(cells: DataFrame, keys: list[str], seeds: int = 3) -> DataFrame:
    """Mean and deviation over seeds of confusion counts and row rates; raises if a cell lacks seeds.

    ``cells(keys..., seed, true_label, pred_label, n)``.
    """
    totals = cells.groupBy(*keys, "seed", "true_label").agg(F.sum("n").alias("_total"))
    rates = cells.join(totals, [*keys, "seed", "true_label"]).withColumn("rate", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("_total").cast("double")), F.lit(0.0)))
    out = rates.groupBy(*keys, "true_label", "pred_label").agg(*(f(c).alias(f"{n}_{s}") for c, n in (("n", "count"), ("rate", "rate")) for f, s in ((F.avg, "mean"), (F.stddev_samp, "std"))), F.count_distinct("seed").alias("n_seeds"))
    gates.require(out.where(F.col("n_seeds") != seeds).select(F.lit("seeds").alias("check"), F.concat_ws("/", *keys, "true_label", "pred_label").alias("key"), F.col("n_seeds").cast("string").alias("detail")), "confusion cells")
    return out


def best_layers(summary: DataFrame, splits=SPLITS) -> DataFrame:
    """(split, layer_index, macro_f1_mean) of the best layer of each split, the first on ties."""
    best = F.min_by(F.struct("layer_index", "macro_f1_mean"), F.struct((-F.col("macro_f1_mean")).alias("s"), F.col("layer_index").alias("l")))
    return summary.where(F.col("split").isin(*splits)).groupBy("split").agg(best.alias("b")).select("split", "b.*")


def layer_report(summary: DataFrame, short: dict[str, str] | None = None, metrics=("macro_f1", "accuracy"), by: str = "macro_f1") -> DataFrame:
    """A row per layer: its name, and each split's metrics as mean±std; "-" where a split lacks the layer.

    ``short``: split -> prefix of its columns. Each split's best layer by the mean
    of ``by`` (the first on ties) is bold in all its columns.
    """
    short = short or {"test": "test", "external_test": "ext"}
    best = best_layers(summary.withColumn("macro_f1_mean", F.col(f"{by}_mean")), tuple(short)).select("split", F.col("layer_index").alias("_best"))
    rows = summary.join(F.broadcast(best), "split", "left")  # a row a split
    cell = lambda split, m: F.coalesce(F.max(F.when(F.col("split") == split, mean_std(F.col(f"{m}_mean"), F.col(f"{m}_std"), F.col("layer_index") == F.col("_best")))), F.lit("-"))
    out = rows.groupBy("layer_index").agg(*(cell(split, m).alias(f"{prefix}_{m}") for split, prefix in short.items() for m in metrics))
    named = F.when(F.col("layer_index") == 0, "embedding_output").otherwise(F.format_string("transformer_layer_%d", "layer_index"))
    return out.select("layer_index", named.alias("layer_name"), *(c for c in out.columns if c != "layer_index")).orderBy("layer_index")


def subsets(train: DataFrame, ratios: dict[str, float], seeds: dict[str, int], label: str = "family_label", group: str = "recording_group_id") -> DataFrame:
    """Every ratio's and seed's train rows: (ratio_name, seed_name, rows of ``train``, selection_rank); whole groups only.

    ``train(seed_name, ...)``: a seed's own train rows; a ratio of 1 takes all of them.
    """
    out = None
    for seed_name, seed in seeds.items():
        own = train.where(F.col("seed_name") == seed_name)
        for i, (ratio_name, ratio) in enumerate(ratios.items()):
            chosen = sampling.group_subset(own, label, group, ratio, seed + 1000 * i)
            rows = own.join(chosen, [label, group]).withColumn("ratio_name", F.lit(ratio_name))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise GateError("no ratios or no seeds")
    return out


def subset_tables(train: DataFrame, chosen: DataFrame, group: str = "recording_group_id", record: str = "record_id", segment: str = "segment_id") -> tuple[DataFrame, DataFrame]:
    """Statistics of every subset by class, and over all classes."""
    names = chosen.select("ratio_name", "seed_name").distinct()
    full = train.join(F.broadcast(names), "seed_name")  # a row a subset
    marks = chosen.select("ratio_name", "seed_name", segment).withColumn("_in", F.lit(True))
    both = full.join(marks, ["ratio_name", "seed_name", segment], "left").withColumn("chosen", F.coalesce("_in", F.lit(False)))
    by = ["ratio_name", "seed_name"]
    return tuple(sampling.subset_statistics(both, keys, group, record, segment, "chosen") for keys in ([*by, "family_label"], by))


def subset_checks(train: DataFrame, listed: DataFrame, groups: DataFrame, meta: DataFrame, labels: DataFrame, expected: DataFrame, whole: str = "train100") -> DataFrame:
    """(ratio_name, seed_name, check, passed, detail) of every subset that should be there.

    ``expected(ratio_name, seed_name)``; ``listed(ratio_name, seed_name, segment_id,
    split, family_label)``; ``groups(ratio_name, seed_name, recording_group_id)``;
    ``meta(ratio_name, seed_name, subset_train_group_count,
    subset_train_segment_count)``; ``train(seed_name, segment_id,
    recording_group_id)``. A subset without a list has the one check that fails.
    """
    by = ["ratio_name", "seed_name"]
    there = listed.select(*by).distinct().join(groups.select(*by).distinct(), by).join(meta.select(*by).distinct(), by)
    outside = listed.join(train.select("seed_name", "segment_id"), ["seed_name", "segment_id"], "left_anti").groupBy(*by).agg(F.count_distinct("segment_id").alias("outside"))
    rows = listed.groupBy(*by).agg(F.count(F.lit(1)).alias("segments"), F.array_sort(F.collect_set("split")).alias("splits"), F.array_sort(F.collect_set("family_label")).alias("classes"))
    own = groups.groupBy(*by).agg(F.count_distinct("recording_group_id").alias("groups"))
    classes = F.lit(sorted(r["family_label"] for r in labels.select("family_label").distinct().collect()))
    full = train.groupBy("seed_name").agg(F.count_distinct("recording_group_id").alias("all_groups"))
    common = groups.join(train.select("seed_name", "recording_group_id").distinct(), ["seed_name", "recording_group_id"]).groupBy(*by).agg(F.count_distinct("recording_group_id").alias("common"))
    held = there.join(rows, by).join(own, by).join(meta, by).join(full, "seed_name", "left").join(outside, by, "left").join(common, by, "left").na.fill(0, ["outside", "common", "all_groups"])
    check = lambda name, passed, detail: F.struct(F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.cast("string").alias("detail"))
    checks = F.array_compact(F.array(
        check("only_train", F.col("splits") == F.array(F.lit("train")), F.array_join("splits", ",")),
        check("all_from_train", F.col("outside") == 0, F.concat(F.lit("missing="), "outside")),
        check("all_classes", F.col("classes") == classes, F.array_join("classes", ",")),
        F.when(F.col("ratio_name") == whole, check("groups_match", (F.col("groups") == F.col("all_groups")) & (F.col("groups") == F.col("common")), F.concat_ws("/", "groups", "all_groups"))),
        check("counts_match_meta", (F.col("groups") == F.col("subset_train_group_count")) & (F.col("segments") == F.col("subset_train_segment_count")), F.concat_ws("/", "groups", "segments")),
    ))
    missing = expected.select(*by).join(there, by, "left_anti").select(*by, F.lit("files_exist").alias("check"), F.lit(False).alias("passed"), F.lit("missing").alias("detail"))
    return held.select(*by, F.explode(checks).alias("x")).select(*by, "x.*").unionByName(missing)


def with_names(predicted: DataFrame, table: DataFrame, on: str = "segment_id", columns: tuple = ("true_label", "sample_id", "record_id")) -> DataFrame:
    """Predictions with the label and identifiers of their segments; "unknown" where a segment is not listed."""
    joined = joins.many_to_one(predicted, table.select(on, *columns), [on])
    return joined.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in columns})


def limited(df: DataFrame, by: str, order: str, most: int = 16) -> DataFrame:
    """The first rows of each split, as many as a smoke run needs."""
    limits = df.select(by).distinct().withColumn("limit", F.lit(most))
    return sampling.first_per(df, by, [order], limits)


def split_view(df: DataFrame, split: str) -> DataFrame:
    """One split's rows; an empty one is an error."""
    rows = df.where(F.col("split") == split)
    if rows.isEmpty():
        raise GateError(f"no rows in split {split}")
    return rows
