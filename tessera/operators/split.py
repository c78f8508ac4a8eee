"""Group-aware splits: a group lies in one split, and shares come near their targets."""

from __future__ import annotations

import bisect
import heapq
import math
import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sampling import hash_order

SPLITS = ("train", "val", "test")
TARGETS = (0.70, 0.15, 0.15)


def deviation(counts: list[int], targets=TARGETS) -> float:
    total = sum(counts)
    return max(abs(c / total - t) for c, t in zip(counts, targets, strict=True)) if total else 0.0


def placed_groups(names: list[str], sizes: list[int], targets=TARGETS) -> list[int]:
    """The split of each group, in the order given.

    A group goes where the largest deviation from the targets is least, the
    earlier split on ties, as long as enough groups are left for empty splits.
    Only the split that takes a group changes its deviation, so a group costs a
    few operations, however many there are.
    """
    total, splits = sum(sizes), range(len(targets))
    counts, out = [0] * len(targets), []
    off = [abs(0 / total - t) if total else 0.0 for t in targets]
    for i, size in enumerate(sizes):
        left, empty = len(sizes) - i - 1, counts.count(0)
        best = None
        for s in splits:
            if empty - (counts[s] == 0 and size != 0) > left:
                continue
            now = abs((counts[s] + size) / total - targets[s]) if total else 0.0
            worst = max(now, *(off[k] for k in splits if k != s))
            if best is None or worst < best[0]:
                best = worst, s, now
        if best is None:
            s = counts.index(min(counts))
            best = None, s, abs((counts[s] + size) / total - targets[s]) if total else 0.0
        _, s, off[s] = best
        counts[s] += size
        out.append(s)
    return out


def repaired(sizes: list[int], where: list[int], targets=TARGETS, enough: float = 0.01) -> list[int]:
    """Single moves that lower the largest deviation most, until none does; no split is emptied.

    What a move gives depends on the two splits and the size only, so groups are
    a sorted multiset by (split, size). As the size grows, both splits come
    nearer to their targets and then leave them, so the best size between two
    splits is found by bisection, with all sizes that are as good because a third split
    is worse. Of the best moves that of the first group is made, to the earlier
    split on ties. A move costs a few bisections, however many groups there are.
    """
    where, splits = list(where), range(len(targets))
    counts, held = [0] * len(targets), [{} for _ in splits]  # by split and size: a heap of the groups' places
    for i, (size, s) in enumerate(zip(sizes, where, strict=True)):
        counts[s] += size
        held[s].setdefault(size, []).append(i)
    if deviation(counts, targets) <= enough:
        return where
    total, distinct = sum(counts), [sorted(h) for h in held]
    firsts = [[h[z][0] for z in d] for h, d in zip(held, distinct, strict=True)]  # beside the sizes

    def best_between(old: int, new: int):
        """(deviation, first group, size) of the best move of a group of ``old`` to ``new``; no move if it would be emptied."""
        own, end = distinct[old], bisect.bisect_left(distinct[old], counts[old])
        if not end:
            return None
        others = max((abs(counts[k] / total - targets[k]) for k in splits if k not in (old, new)), default=0.0)

        def worst(at: int) -> float:
            return max(abs((counts[old] - own[at]) / total - targets[old]), abs((counts[new] + own[at]) / total - targets[new]))

        low = bisect.bisect_left(range(end - 1), True, key=lambda at: worst(at) <= worst(at + 1))
        least = max(worst(low), others)
        first = bisect.bisect_left(range(low), True, key=lambda at: worst(at) <= least)
        last = low + bisect.bisect_left(range(low, end), True, key=lambda at: worst(at) > least)
        group = min(firsts[old][first:last])
        return least, group, own[firsts[old].index(group, first, last)]

    while True:
        now, best = deviation(counts, targets), None
        for old in splits:
            for new in splits:
                if old != new and (found := best_between(old, new)) and found[0] < now - 1e-12:
                    least, group, size = found
                    best = min(best or (math.inf,), (least, group, new, old, size))
        if best is None:
            return where
        _, group, new, old, size = best
        at = bisect.bisect_left(distinct[old], size)
        heapq.heappop(held[old][size])
        if held[old][size]:
            firsts[old][at] = held[old][size][0]
        else:
            del held[old][size], distinct[old][at], firsts[old][at]
        at = bisect.bisect_left(distinct[new], size)
        if size not in held[new]:
            held[new][size] = []
            distinct[new].insert(at, size)
            firsts[new].insert(at, group)
        heapq.heappush(held[new][size], group)
        firsts[new][at] = held[new][size][0]
        counts[old], counts[new], where[group] = counts[old] - size, counts[new] + size, new


def group_split(df: DataFrame, family: str, group: str, seed: int, targets=TARGETS, compatible: bool = False) -> DataFrame:
    """(family, group, n, split) of every group.

    Groups are shuffled by hash, or by Python's generator if ``compatible``. The
    sequential part works on a family's table of group sizes, never on its rows.
    """
    sizes = df.groupBy(family, group).agg(F.count(F.lit(1)).alias("n"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(group if compatible else ["_order", group], kind="stable").reset_index(drop=True)
        if compatible:
            rows = list(range(len(pdf)))
            random.Random(seed).shuffle(rows)
            pdf = pdf.loc[rows].reset_index(drop=True)
        own = pdf["n"].tolist()
        pdf["split"] = [SPLITS[s] for s in repaired(own, placed_groups(pdf[group].tolist(), own, targets), targets)]
        return pdf[[family, group, "n", "split"]]

    ordered = sizes.withColumn("_order", hash_order(F.lit(seed), F.col(group)))
    return ordered.groupBy(family).applyInPandas(place, f"{family} {kinds[family]}, {group} {kinds[group]}, n long, split string")


def hash_split(df: DataFrame, family: str, group: str, seed: int, targets=TARGETS) -> DataFrame:
    """As ``group_split`` with expressions only: groups by hash order, cut where prefix sums pass the targets."""
    sizes = df.groupBy(family, group).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(family).orderBy(hash_order(F.lit(seed), F.col(group)), group)
    share = (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") / 2) / F.sum("n").over(Window.partitionBy(family))
    split = F.when(share <= targets[0], SPLITS[0]).when(share <= targets[0] + targets[1], SPLITS[1]).otherwise(SPLITS[2])
    return sizes.withColumn("split", split)


def routed(df: DataFrame, assigned: DataFrame, group: str, source: str = "source_dataset", outside=("ChMusic",)) -> DataFrame:
    """Rows with their group's split; external sources are ``external_test``, unassigned groups train."""
    out = df.join(assigned.select(group, "split"), group, "left")
    return out.withColumn("split", F.when(F.col(source).isin(*outside), "external_test").otherwise(F.coalesce("split", F.lit("train"))))


def leaks(df: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """(key_name, key, splits): identifiers met in several splits."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key_name"), F.col(k).cast("string").alias("key")) for k in keys))
    return df.select(F.explode(pairs).alias("x"), split).select("x.*", split).groupBy("key_name", "key").agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def split_gates(df: DataFrame, families: DataFrame, family: str, group: str, splits=SPLITS) -> DataFrame:
    """(gate, family, detail): splits of a family without a group, and groups in several splits."""
    grid = families.select(family).crossJoin(df.sparkSession.range(1).select(F.explode(F.array(*(F.lit(s) for s in splits))).alias("split")))
    empty = grid.join(df.select(family, "split").distinct(), [family, "split"], "left_anti").select(F.lit("empty_split").alias("gate"), family, F.col("split").alias("detail"))
    torn = df.groupBy(family, group).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select(F.lit("group_in_several_splits").alias("gate"), family, F.col(group).cast("string").alias("detail"))
    return empty.unionByName(torn)


def split_shares(df: DataFrame, by: list[str], targets: dict[str, float]) -> DataFrame:
    """Rows and share of every split, and its deviation from the target to six digits."""
    counts = df.groupBy(*by, "split").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    target = F.coalesce(*(F.when(F.col("split") == s, F.lit(t)) for s, t in targets.items()))
    return counts.withColumn("share", F.round(share, 6)).withColumn("deviation", F.round(share - target, 6))
