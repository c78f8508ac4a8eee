"""Exact and near duplicates, groups of variants, and merged groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import hamming_similarity
from ..functions.text import numbered
from ..session import settled
from . import similar
from .numbering import numbers


def exact_duplicates(df: DataFrame, digest: str, order: list[str], same: list[str], record: str = "record_id") -> DataFrame:
    """Adds ``duplicate_of``: the first row of a digest whose rows agree on ``same``; null for it and others.

    The group is summed before it is shuffled, so a digest many rows share costs
    one row a task; only the join back meets its rows.
    """
    first = F.min_by(record, F.struct(*order, record))
    groups = df.where(F.coalesce(F.col(digest), F.lit("")) != "").groupBy(digest).agg(
        first.alias("_first"), F.count(F.lit(1)).alias("_n"), *(F.min(c).alias(f"_lo_{c}") for c in same), *(F.max(c).alias(f"_hi_{c}") for c in same)
    )
    agree = F.lit(True)
    for c in same:
        agree &= F.col(f"_lo_{c}").eqNullSafe(F.col(f"_hi_{c}"))
    firsts = groups.where(agree & (F.col("_n") > 1)).select(digest, "_first")
    out = df.join(firsts, digest, "left").withColumn("duplicate_of", F.when(F.col("_first") != F.col(record), F.col("_first"))).drop("_first")
    return out.select(*df.columns, "duplicate_of")


def mixed_digests(df: DataFrame, digest: str, differ: list[str]) -> DataFrame:
    """The digests whose rows differ on one of ``differ``, nulls included."""
    mixed = F.lit(False)
    for c in differ:
        mixed |= ~F.col(f"_lo_{c}").eqNullSafe(F.col(f"_hi_{c}")) | (F.col(f"_n_{c}") > 0) & (F.col(f"_n_{c}") < F.col("_n"))
    ends = [f(c).alias(f"_{n}_{c}") for c in differ for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]
    return df.groupBy(digest).agg(F.count(F.lit(1)).alias("_n"), *ends).where(mixed).select(digest)


def cross_members(df: DataFrame, digest: str, differ: list[str], record: str = "record_id") -> DataFrame:
    """(record, representative, digest) of all rows in groups that differ on one of ``differ``: the least record stands for its group.

    A row a record, however large a group is; every pair of members is a pair of equal contents.
    """
    rows = df.select(record, digest).join(mixed_digests(df, digest, differ), digest, "left_semi")
    return rows.join(rows.groupBy(digest).agg(F.min(record).alias("representative")), digest).select(record, "representative", digest)


def cross_pairs(df: DataFrame, digest: str, differ: list[str], record: str = "record_id") -> DataFrame:
    """All pairs (a < b) of equal digests in groups whose rows differ on one of ``differ``.

    Reviewers decide every pair by itself, so the pairs are the result; for
    anything else ``cross_members`` says the same in a row a record.
    """
    rows = df.select(digest, F.col(record).alias("a")).join(mixed_digests(df, digest, differ), digest, "left_semi")
    return rows.join(rows.withColumnRenamed("a", "b"), digest).where("a < b").select("a", "b", digest)


def resolved_clusters(members: DataFrame, votes: DataFrame) -> DataFrame:
    """The outcome of every cross-duplicate cluster.

    ``members(cluster, record_id)``; ``votes(record_id, vote)`` with votes
    "canonical" and "rejected". Columns: cluster, winner, problem. Two canonical
    votes, or one that is also rejected, are problems; without a vote the sole
    member that is not rejected wins, and none or several are a problem.
    """
    own = members.join(votes, "record_id", "left").groupBy("cluster", "record_id").agg(*(F.coalesce(F.bool_or(F.col("vote") == v), F.lit(False)).alias(v) for v in ("canonical", "rejected")))
    left = ~F.col("rejected")
    held = own.groupBy("cluster").agg(
        F.count_if("canonical").alias("n_voted"), F.count_if(left).alias("n_left"), F.count_if(F.col("canonical") & F.col("rejected")).alias("n_both"),
        F.min(F.when(F.col("canonical"), F.col("record_id"))).alias("voted"), F.min(F.when(left, F.col("record_id"))).alias("survivor"),
    )
    problem = (
        F.when(F.col("n_voted") > 1, "several_canonical")
        .when(F.col("n_both") > 0, "canonical_rejected")
        .when((F.col("n_voted") == 0) & (F.col("n_left") == 0), "no_survivor")
        .when((F.col("n_voted") == 0) & (F.col("n_left") > 1), "several_survivors")
    )
    return held.select("cluster", F.when(problem.isNull(), F.coalesce("voted", "survivor")).alias("winner"), problem.alias("problem"))


def variant_groups(df: DataFrame, within: list[str], name: str, bare: str) -> DataFrame:
    """Adds ``canonical_name`` and ``grouping_method``: names that agree without white space merge under the least."""
    w = Window.partitionBy(*within, bare)
    several = F.min(name).over(w) != F.max(name).over(w)
    return df.withColumn("canonical_name", F.min(name).over(w)).withColumn("grouping_method", F.when(several, "whitespace_variant_merge").otherwise("filename_rule"))


def group_numbers(df: DataFrame, family: list[str], keys: list[str], prefix: Column, out: str = "recording_group_id", digits: int = 4) -> DataFrame:
    """Numbers the groups of each family in the order of their keys, ``<prefix>_G0001``.

    Only distinct groups are numbered; rows get theirs by a join.
    """
    columns = [*family, *keys]
    groups = numbers(df.select(*columns).distinct(), family, keys, "_n").withColumnsRenamed({c: f"_own_{c}" for c in columns})
    same = [F.col(c).eqNullSafe(F.col(f"_own_{c}")) for c in columns]
    return df.join(groups, same, "left").select(*df.columns, "_n").withColumn(out, numbered(F.concat(prefix, F.lit("_G")), F.col("_n"), digits)).drop("_n")


def near_duplicate_flag(df: DataFrame, group: str, out: str = "is_near_duplicate") -> DataFrame:
    """Whether a row's group has more rows than it."""
    sizes = df.groupBy(group).agg((F.count(F.lit(1)) > 1).alias(out))
    return df.drop(out).join(sizes, group, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def thinned(df: DataFrame, family: str, group: str, order: list[str], least_groups: int = 35, out: str = "thinned") -> DataFrame:
    """Adds ``out``: true for all but the first row of a group, in families of at least ``least_groups`` groups."""
    many = df.groupBy(family).agg(F.count_distinct(group).alias("_groups")).where(F.col("_groups") >= least_groups).select(family)
    firsts = df.join(many, family, "left_semi").groupBy(family, group).agg(F.min(F.struct(*order)).alias("_first"))
    return df.join(firsts, [family, group], "left").withColumn(out, F.coalesce(F.struct(*order) != F.col("_first"), F.lit(False))).drop("_first").select(*df.columns, out)


def fingerprint_candidates(df: DataFrame, family: str, subtype: str, fingerprint: str, record: str = "record_id", ratio: float = 0.5, hamming: float = 0.85, contained: float = 0.90) -> DataFrame:
    """Pairs of one family and different subtypes whose fingerprints agree.

    Skipped if one is less than ``ratio`` of the other; a hit by hamming
    similarity over the common prefix, or else by sliding containment. Both are
    joined on parts that such pairs must share (``similar``), never all with all
    of a family; equal fingerprints are compared once. A threshold above 1 leaves containment out.
    """
    near = similar.prefix_pairs(df, family, subtype, fingerprint, record, hamming, ratio).withColumnRenamed("sim", "hamming_sim").withColumn("containment_sim", F.lit(None).cast("double"))
    if contained <= 1:
        one, members = similar.classes(df, [family, subtype], fingerprint, record)
        side = one.select(F.col(family).alias("group"), F.col(subtype).alias("tag"), "name", "words")
        held = similar.contained_pairs(side.withColumnRenamed("name", "short"), side.withColumnRenamed("name", "long"), contained, ratio)
        words = one.select("name", "words")
        both = held.join(words.toDF("short", "a_words"), "short").join(words.toDF("long", "b_words"), "long").withColumn("hamming_sim", hamming_similarity(F.col("a_words"), F.col("b_words"))).where(F.col("hamming_sim") < hamming)
        rest = both.join(members.toDF("short", "a"), "short").join(members.toDF("long", "b"), "long").select(F.col("group").alias("family"), "a", "b", "hamming_sim", F.col("sim").alias("containment_sim"))
        near = near.unionByName(rest)
    return near.select("family", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "hamming_sim", "containment_sim")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that edges connect a node with.

    Labels go to the least neighbour's label until none changes; every round is
    settled, so plans stay short.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct()
    labels = settled(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("label")), "other").groupBy("node").agg(F.min("label").alias("label"))
        step = labels.join(heard, "node").select("node", F.least("component", "label").alias("component"))
        # A label's own label is one jump further.
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = settled(step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component")))
        changed = moved.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty()
        labels = moved
        if changed:
            return labels


def merged_groups(df: DataFrame, pairs: DataFrame, group: str = "recording_group_id", record: str = "record_id") -> DataFrame:
    """Groups that approved pairs (record_id, peer_record_id) connect take the least of their names."""
    own = df.select(F.col(record).alias("r"), F.col(group).alias("g"))
    edges = pairs.join(own.withColumnsRenamed({"r": "record_id", "g": "a"}), "record_id").join(own.withColumnsRenamed({"r": "peer_record_id", "g": "b"}), "peer_record_id").select("a", "b").where("a <> b")
    names = components(edges).select(F.col("node").alias(group), "component")
    out = df.join(names, group, "left")
    moved = F.col("component").isNotNull() & (F.col("component") != F.col(group))
    return out.withColumn("grouping_method", F.when(moved, "fingerprint_merge").otherwise(F.col("grouping_method") if "grouping_method" in df.columns else F.lit("filename_rule"))).withColumn(group, F.coalesce("component", group)).drop("component")


def merged_in_order(groups: dict[str, str], pairs: list[tuple[str, str]]) -> dict[str, str]:
    """The same merge as an ordered fold: each pair moves the peer's whole group to the record's.

    For small decision lists, where the surviving name must follow their order.
    """
    now = dict(groups)
    for record, peer in pairs:
        goes, to = now[peer], now[record]
        now = {r: to if g == goes else g for r, g in now.items()}
    return now


def merged_by_decisions(df: DataFrame, pairs: DataFrame, order: list[str], method: str, group: str = "recording_group_id", record: str = "record_id", most: int = 100_000) -> DataFrame:
    """Groups after decisions (record_id, peer_record_id) in their order: each moves the peer's whole group to the record's.

    People decide, so the list is short: groups are renamed on the driver by
    ``merged_in_order`` over the groups that pairs name, at most ``most`` pairs.
    """
    own = df.select(F.col(record).alias("_r"), F.col(group).alias("_g"))
    ends = pairs.join(own.withColumnsRenamed({"_r": "record_id", "_g": "_a"}), "record_id").join(own.withColumnsRenamed({"_r": "peer_record_id", "_g": "_b"}), "peer_record_id")
    rows = ends.where("_a <> '' and _b <> ''").orderBy(*order).select("_a", "_b").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} merge decisions")
    named = [(r["_a"], r["_b"]) for r in rows]
    after = merged_in_order({g: g for pair in named for g in pair}, named)
    moves = [(g, to) for g, to in sorted(after.items()) if g != to]
    if not moves:
        return df
    moved = df.sparkSession.createDataFrame(moves, "_from string, _to string")
    out = df.join(F.broadcast(moved), df[group] == moved["_from"], "left")
    for c in (c for c in (group, "performer_or_recording_id") if c in df.columns):
        out = out.withColumn(c, F.coalesce("_to", c))
    if "grouping_method" in df.columns:
        out = out.withColumn("grouping_method", F.when(F.col("_to").isNotNull(), method).otherwise(F.col("grouping_method")))
    return out.select(*df.columns)
