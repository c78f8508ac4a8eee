"""The curation flow: profile to frozen, split and segmented rows, with its hard stops.

Each step is a transform of DataFrames; configuration is a plain mapping.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import dedup, gates, qc, review, sampling, segments, split
from ..operators.gates import GateError
from ..operators.numbering import numbers
from ..session import settled

PREFIX = {"CCMusic": "ccm", "ChMusic": "chm", "External": "ext"}


@dataclass(frozen=True)
class Config:
    """What a run is told; ``problems`` says what is wrong with it."""

    families: dict[str, str]  # active family -> abbreviation
    silence_threshold: float = 0.6
    clipping_threshold: float = 0.01
    min_duration: float = 3.0
    phrase_cap: float = 0.15
    seeds: tuple[int, ...] = (101, 202, 303)
    min_kept: int = 25
    min_median_share: float = 0.40
    min_groups: int = 3
    wanted_groups: int = 7
    min_external: int = 4
    accepted_external: tuple[str, ...] = ()
    thin_from_groups: int = 35
    segment_floor: int = 15
    segment_share: float = 0.10
    active_share: float = 0.3
    phrase_seed: int | None = None  # else the first seed and 101
    scope_sources: dict[str, str] = field(default_factory=lambda: {"chmusic_only": "ChMusic"})
    scope_sources_strict: bool = False  # True also ties "ccmusic_only" to its source

    def scopes(self) -> dict[str, str]:
        return self.scope_sources | ({"ccmusic_only": "CCMusic"} if self.scope_sources_strict else {})

    def problems(self) -> list[str]:
        out = []
        if not self.families:
            out.append("no active family")
        if len(set(self.families.values())) < len(self.families):
            out.append("two families share an abbreviation")
        for name, low, high in (("silence_threshold", 0, 1), ("clipping_threshold", 0, 1), ("phrase_cap", 0, 0.999), ("min_median_share", 0, 1), ("segment_share", 0, 1)):
            if not low <= getattr(self, name) <= high:
                out.append(f"{name} must lie in {low}..{high}")
        if len(set(self.seeds)) < len(self.seeds) or not self.seeds:
            out.append("seeds must be distinct, and at least one")
        if not set(self.accepted_external) <= set(self.families):
            out.append("accepted_external names an inactive family")
        return out


class PendingReview(GateError):
    """A step needs decisions; ``items`` holds the queue, ``path`` where it was written."""

    def __init__(self, items: DataFrame, what: str):
        super().__init__(f"{what}: decisions are missing")
        self.items, self.path = items, None


def audit_rows(scan: DataFrame, profile: DataFrame) -> DataFrame:
    """In-scope scan rows with their profile and the columns derived from names."""
    rows = scan.where("scan_status = 'in_scope'").join(profile, scan["source_path"] == profile["path"], "left").drop("path")
    name = F.col("file_name")
    return rows.select(
        "record_id", F.lit("").alias("sample_id"), "source_dataset", "source_path", "file_name", "file_ext",
        F.col("raw_dir_label").alias("source_subtype_dir"), F.col("mapped_family_label").alias("family_label"),
        F.when(F.col("source_dataset") == "ChMusic", text.class_id(name)).otherwise(F.lit(-1)).alias("chmusic_class_id"),
        F.when(F.col("source_dataset") == "ChMusic", "controlled").otherwise(text.first_keyword(name)).alias("content_type"),
        text.normalized_name(name).alias("normalized_base_name"), text.take_id(name).alias("take_id"),
        F.coalesce("audio_sha256", F.lit("")).alias("audio_sha256"),
        *(F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("duration_sec", "silence_ratio", "clipping_ratio")),
        *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("sample_rate_hz", "channels", "bit_depth")),
        F.coalesce("is_decodable", F.lit(False)).alias("is_decodable"), F.lit("").alias("review_status"),
    )


def quality(audit: DataFrame, config: Config, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rules with resolved thresholds; rows and the queue of single-row reviews."""
    for key, value in (("silence_threshold", config.silence_threshold), ("clipping_threshold", config.clipping_threshold)):
        audit = qc.resolved_threshold(audit, overrides, key, value, key, only_sources=config.scopes()) if overrides is not None else audit.withColumn(key, F.lit(value))
    return qc.pending_after_qc(qc.apply_rules(audit, qc.audio_rules(config.min_duration)))


def reviewed(audit: DataFrame, items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions applied; raises PendingReview if an item has none."""
    open_ = review.pending(items, decisions, ["record_id", "review_type"])
    if not open_.isEmpty():
        raise PendingReview(open_, "review")
    return review.applied(audit, decisions.join(items.select("record_id", "review_type").distinct(), ["record_id", "review_type"], "left_semi"))


def grouped(audit: DataFrame, config: Config) -> DataFrame:
    """Groups of takes and variants, exact duplicates dropped, near duplicates flagged."""
    bare = audit.withColumn("_bare", text.merge_key(F.col("normalized_base_name")))
    rows = dedup.variant_groups(bare, ["source_subtype_dir", "family_label"], "normalized_base_name", "_bare").drop("_bare")
    short = F.coalesce(*(F.when(F.col("family_label") == k, v) for k, v in config.families.items()), F.col("family_label"))
    external = F.col("source_dataset") == "ChMusic"
    # Every primary group is named with the first source's prefix, as the manifests have it. External
    # rows are groups of their own, numbered apart from 1 in the numeric order of their files.
    rows = rows.withColumn("_kind", F.when(external, "chm").otherwise("ccm")).withColumn("_place", F.when(external, text.dotted_key(F.col("file_name"))))
    rows = rows.withColumn("_key", F.when(external, F.col("file_name")).otherwise(F.col("canonical_name"))).withColumn("_folder", F.when(external, "").otherwise(F.col("source_subtype_dir")))
    rows = dedup.group_numbers(rows, ["family_label", "_kind"], ["_place", "_folder", "_key"], F.concat(F.col("_kind"), F.lit("_"), short)).drop("_kind", "_place", "_folder", "_key")
    rows = rows.withColumn("grouping_method", F.when(external, "unique_singleton").otherwise(F.col("grouping_method"))).withColumn("take_id", F.when(external, 0).otherwise(F.col("take_id")))
    rows = dedup.near_duplicate_flag(rows, "recording_group_id").withColumn("performer_or_recording_id", F.col("recording_group_id"))
    twins = dedup.exact_duplicates(comparable(rows), "audio_sha256", ["source_dataset", "source_subtype_dir", "file_name"], ["family_label", "source_dataset"]).where("duplicate_of is not null").select("record_id", "duplicate_of")
    rows = rows.join(twins, "record_id", "left")
    return dropped(rows, F.col("duplicate_of").isNotNull(), "exact_duplicate", "D09")


def comparable(rows: DataFrame) -> DataFrame:
    return rows.where("sample_status = 'keep' and is_decodable")


def marked(rows: DataFrame, pairs: DataFrame, rule: str) -> DataFrame:
    """The rule in the trail of both ends of pairs (record_id, peer_record_id)."""
    ends = pairs.select(F.explode(F.array("record_id", "peer_record_id")).alias("record_id")).distinct().withColumn("_end", F.lit(True))
    trail = F.when(F.col("_end"), F.array_distinct(F.concat("applied_rule_ids", F.array(F.lit(rule))))).otherwise(F.col("applied_rule_ids"))
    return rows.join(ends, "record_id", "left").withColumn("applied_rule_ids", trail).drop("_end")


def decided(items: DataFrame, decisions: DataFrame, what: str) -> DataFrame:
    """Decisions of pair items in either direction; raises PendingReview if an item has none."""
    open_ = review.pending_pairs(items, decisions)
    if not open_.isEmpty():
        raise PendingReview(open_, what)
    key = review.pair_key(F.col("record_id"), F.col("review_type"), F.col("peer_record_id"))
    return decisions.withColumn("_key", key).join(items.select(key.alias("_key")).distinct(), "_key", "left_semi").drop("_key")


def cross_resolved(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Equal files of several families or sources: each cluster keeps the one that its reviews name."""
    kept = comparable(rows).where("audio_sha256 <> ''")
    pairs = settled(dedup.cross_pairs(kept, "audio_sha256", ["family_label", "source_dataset"]).withColumnsRenamed({"a": "record_id", "b": "peer_record_id"}))
    if pairs.isEmpty():
        return rows
    items = pairs.select("record_id", F.lit("cross_duplicate_review").alias("review_type"), "peer_record_id", F.lit("D09").alias("trigger_rule_id"), F.concat(F.lit("sha256="), F.substring("audio_sha256", 1, 16), F.lit("...")).alias("trigger_detail"))
    own = decided(items, decisions, "cross duplicates")
    votes = own.select(F.when(F.col("decision") == "approved", F.col("value")).otherwise(F.col("record_id")).alias("record_id"), F.when(F.col("decision") == "approved", "canonical").otherwise("rejected").alias("vote"))
    members = pairs.select(F.col("audio_sha256").alias("cluster"), F.explode(F.array("record_id", "peer_record_id")).alias("record_id")).distinct()
    clusters = settled(dedup.resolved_clusters(members, votes))
    gates.require(clusters.where("problem is not null").select(F.lit("cross_duplicates").alias("check"), F.col("cluster").alias("key"), F.col("problem").alias("detail")), "cross duplicates")
    losers = members.join(clusters, "cluster").where("record_id <> winner").select("record_id", F.col("winner").alias("_winner"))
    out = marked(rows, items, "D09").join(losers, "record_id", "left")
    out = out.withColumn("duplicate_of", F.coalesce("duplicate_of", "_winner")).withColumn("_lost", F.col("_winner").isNotNull())
    return dropped(out, F.col("_lost"), "exact_duplicate", "D09").drop("_winner", "_lost")


def fingerprint_merged(rows: DataFrame, fingerprints: DataFrame, decisions: DataFrame) -> DataFrame:
    """Likely equal recordings by fingerprint (record_id, fingerprint): approved pairs share a group from now on."""
    rows = rows.join(fingerprints.select("record_id", F.when(F.size("fingerprint") > 0, arrays.fingerprint_sha256(F.col("fingerprint"))).alias("audio_fingerprint_id")), "record_id", "left").withColumn("audio_fingerprint_id", F.coalesce("audio_fingerprint_id", F.lit("")))
    held = comparable(rows).where("source_dataset <> 'ChMusic'").join(fingerprints.select("record_id", "fingerprint"), "record_id")
    near = settled(dedup.fingerprint_candidates(held, "family_label", "source_subtype_dir", "fingerprint"))
    if near.isEmpty():
        return rows
    items = near.select(F.col("a").alias("record_id"), F.lit("fingerprint_review").alias("review_type"), F.col("b").alias("peer_record_id"), F.lit("G02").alias("trigger_rule_id"), F.format_string("hamming_sim=%.4f", "hamming_sim").alias("trigger_detail"))
    approved = decided(items, decisions, "fingerprints").where("decision = 'approved'")
    # As the items have it, not the review file: the lesser identifier's group stays.
    key = review.pair_key(F.col("record_id"), F.col("review_type"), F.col("peer_record_id"))
    ordered = items.withColumn("_key", key).join(approved.select(key.alias("_key")).distinct(), "_key", "left_semi").drop("_key")
    return dedup.merged_by_decisions(marked(rows, items, "G02"), ordered, ["record_id", "peer_record_id"], "fingerprint_merge")


def manually_merged(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Groups that reviewers merge by hand; raises if a pair cannot be merged."""
    own = decisions.where("review_type = 'group_merge_review'")
    gates.require(review.merge_violations(own, rows).select(F.lit("group_merge").alias("check"), F.concat_ws("|", "record_id", "peer_record_id").alias("key"), F.col("problem").alias("detail")), "group merges")
    order = ["position"] if "position" in decisions.columns else ["record_id", "peer_record_id"]
    return dedup.merged_by_decisions(rows, own.where("decision = 'approved'"), order, "manual_merge")


def pair_reviewed(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows that pair decisions name carry their outcome; a rejection dominates, a merge file's row too."""
    status = review.pair_status(decisions.where(F.col("review_type").isin(*review.PAIR_TYPES, *review.MERGE_TYPES))).withColumnRenamed("review_status", "_pair")
    return rows.join(status, "record_id", "left").withColumn("review_status", F.when((F.col("review_status") == "rejected") | F.col("_pair").isNull(), F.col("review_status")).otherwise(F.col("_pair"))).drop("_pair")


def dropped(rows: DataFrame, condition, reason: str, rule: str) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False)) & (F.col("sample_status") == "keep")
    return rows.withColumn("applied_rule_ids", F.when(hit, F.array_distinct(F.concat("applied_rule_ids", F.array(F.lit(rule))))).otherwise(F.col("applied_rule_ids"))).withColumn("drop_reason", F.when(hit, reason).otherwise(F.col("drop_reason"))).withColumn("sample_status", F.when(hit, "drop").otherwise(F.col("sample_status")))


def near_thinned(rows: DataFrame, config: Config) -> DataFrame:
    """In families of many groups one row of each group stays; primary sources only."""
    kept = rows.where("sample_status = 'keep' and source_dataset <> 'ChMusic'")
    gone = dedup.thinned(kept, "family_label", "recording_group_id", ["source_subtype_dir", "file_name", "record_id"], config.thin_from_groups).where("thinned").select("record_id", F.lit(True).alias("_gone"))
    return dropped(rows.join(gone, "record_id", "left"), F.col("_gone"), "redundant_near_duplicate", "D10").drop("_gone")


def quota(rows: DataFrame, config: Config) -> DataFrame:
    """Phrases cut to their cap, then the gates on what is left; raises on a violation."""
    kept = rows.where("sample_status = 'keep' and source_dataset <> 'ChMusic'")
    over = (F.col("content_type") == "phrase") & (F.col("source_dataset") != "External")
    gone = sampling.quota_drops(kept, "family_label", over, "record_id", config.phrase_cap, config.seeds[0] + 101 if config.phrase_seed is None else config.phrase_seed).select("record_id", F.lit(True).alias("_gone"))
    out = dropped(rows.join(gone, "record_id", "left"), F.col("_gone"), "phrase_quota_downsampled", "B01").drop("_gone")
    primary = out.where("source_dataset <> 'ChMusic'")
    found = gates.replacement_gates(primary, families(rows, config), "family_label", "recording_group_id", config.min_kept, config.min_median_share, config.min_groups, config.wanted_groups)
    gates.require(found, "replacement gates")
    return out


def families(df: DataFrame, config: Config) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*(F.lit(f) for f in config.families))).alias("family_label"))


def frozen(rows: DataFrame, config: Config) -> DataFrame:
    """Stable sample identifiers over all rows, gates, and the rows that stay."""
    order = ["source_subtype_dir", "recording_group_id", "file_name", "record_id"]
    placed = numbers(rows.select("record_id", "source_dataset", "family_label", *order[:3]), ["source_dataset", "family_label"], order, "_n").select("record_id", "_n")
    prefix = F.coalesce(*(F.when(F.col("source_dataset") == k, v) for k, v in PREFIX.items()), F.lit("oth"))
    short = F.coalesce(*(F.when(F.col("family_label") == k, v) for k, v in config.families.items()), F.col("family_label"))
    named = rows.join(placed, "record_id", "left").withColumn("sample_id", text.numbered(F.concat(prefix, F.lit("_"), short, F.lit("_")), F.col("_n"), 4)).drop("_n")
    all_ = families(rows, config)
    gates.require(gates.freeze_gates(named, all_, "family_label", "source_dataset", all_.where(F.col("family_label").isin(*config.accepted_external)), least=config.min_external), "freeze gates")
    return named.where("sample_status = 'keep'").orderBy("sample_id")


def splits(rows: DataFrame, config: Config, compatible: bool = False) -> DataFrame:
    """Every seed's split of the frozen rows, with the seed's place among the seeds; raises if a gate is violated."""
    out = None
    for place, seed in enumerate(config.seeds):
        primary = rows.where("source_dataset <> 'ChMusic'")
        placed = split.group_split(primary, "family_label", "recording_group_id", seed, compatible=compatible)
        own = settled(split.routed(rows, placed, "recording_group_id").withColumn("split_seed", F.lit(place)))
        gates.require(split.split_gates(own.where("source_dataset <> 'ChMusic'"), families(rows, config), "family_label", "recording_group_id"), f"split gates of seed {seed}")
        out = own if out is None else out.unionByName(own)
    return out


def segment_rows(split_rows: DataFrame, waveforms: DataFrame, config: Config, rate: int = 24_000, seconds: float = 5.0, least_seconds: float = 3.0, active: float | None = None) -> DataFrame:
    """Segments of every seed: cut, filtered by active frames, capped, numbered and named.

    ``waveforms(record_id, samples)`` at ``rate``: cut and filtered once, joined to all seeds.
    """
    from ..functions.signal import active_frame_ratio

    cut = segments.segmented(waveforms, "samples", int(rate * seconds), int(rate * least_seconds))
    cut = cut.withColumn("active_frame_ratio", active_frame_ratio("samples", F.lit(rate))).where(F.col("active_frame_ratio") >= (config.active_share if active is None else active))
    rows = cut.join(split_rows, "record_id")
    per_class = split_rows.where("source_dataset <> 'ChMusic'").groupBy("family_label", "split_seed").agg(F.count(F.lit(1)).alias("rows"))
    keyed = rows.withColumn("_class", F.concat_ws("|", "family_label", F.col("split_seed").cast("string"))).withColumn("_sample", F.concat_ws("|", "sample_id", F.col("split_seed").cast("string")))
    classes = per_class.select(F.concat_ws("|", "family_label", F.col("split_seed").cast("string")).alias("_class"), "rows")
    out = segments.capped(keyed, "_sample", "_class", "start", classes, config.segment_floor, config.segment_share, F.col("source_dataset") != "ChMusic").drop("_class", "_sample")
    name = F.format_string("%s_s%02d", F.col("sample_id"), F.col("segment_index"))
    seconds_of = lambda c: F.round(F.col(c) / rate, 6)
    return out.withColumn("segment_id", name).withColumn("segment_path", F.concat(F.col("split"), F.lit("/"), name, F.lit(".wav"))).withColumn("start_sec", F.when(F.col("is_padded"), 0.0).otherwise(seconds_of("start"))).withColumn("end_sec", F.when(F.col("is_padded"), seconds).otherwise(seconds_of("stop")))


#: What decisions of pairs and merges need besides record_id, review_type, decision and value.
PAIR_COLUMNS = ("peer_record_id", "drop_reason")


def run(scan: DataFrame, profile: DataFrame, decisions: DataFrame, config: Config, overrides: DataFrame | None = None, fingerprints: DataFrame | None = None, queue: str | None = None) -> dict[str, DataFrame]:
    """The steps from scan to splits, each settled before the next; frames by step.

    ``fingerprints(record_id, fingerprint)`` asks for the second stage of grouping.
    Where decisions are missing the run stops with PendingReview, after the queue
    was written to the folder ``queue``, if one is named.
    """
    if problems := config.problems():
        raise GateError("; ".join(problems))
    for c in PAIR_COLUMNS:
        if c not in decisions.columns:
            decisions = decisions.withColumn(c, F.lit(""))
    audit = settled(audit_rows(scan, profile))
    try:
        rows, items = quality(audit, config, overrides)
        rows, items = settled(rows), settled(items)
        rows = settled(reviewed(rows, items, decisions))
        rows = settled(grouped(rows, config))
        rows = settled(cross_resolved(rows, decisions))
        if fingerprints is not None:
            rows = settled(fingerprint_merged(rows, fingerprints, decisions))
        rows = settled(pair_reviewed(manually_merged(rows, decisions), decisions))
    except PendingReview as e:
        if queue:
            from ..sources.reviews import write_queue

            e.path = write_queue(e.items, audit, queue)
        raise
    rows = settled(near_thinned(rows, config))
    rows = settled(quota(rows, config))
    kept = settled(frozen(rows, config))
    return {"audit": rows, "frozen": kept, "split": settled(splits(kept, config))}
