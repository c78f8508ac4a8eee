"""A prefix trie of conversations, each node with what its subtree holds.

Turns become digests first (128 bits of SHA-256 over role and text), so texts are
never shuffled: a conversation is one row of a digest of 32 characters and a
number a turn, and a prefix of turns is a prefix of a string. Equal conversations
become one sequence with a count before anything else is dealt.

Sequences are hash-partitioned by their first turn, many first turns to a bucket
of some ``most`` turns, and each bucket's tries are built in ``applyInPandas``:
nodes that point to their children by dictionaries, summed up by an iterative
postorder. A first turn whose sequences have more than ``most`` turns left is
too large for that. It is repartitioned by its next turn, and again while a part
is too large: the part's least and greatest sequence give the prefix that all of
it shares, which becomes nodes of the top of the trie, and what follows is dealt
by the turn after that prefix. So copies of a long start cost one round, and the
top has at most one part for ``most`` turns of input. Its sums are joined from
the bottom up, a round at a time. One sequence is never split: its row, and so
the longest conversation, must fit a task (some 50 bytes a turn).

Rows without a conv_id belong to no conversation. Null roles and texts count as
empty. Turns are ordered by turn (null first), then by role and digest; repeated
rows are turns of their own. An empty table gives no nodes; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, lean, materialize, scope, table

#: Turns that a trie is built of at once; characters of a turn's digest; bytes of conv_ids that are hashed at once.
MOST, DIGEST, CHUNK_BYTES = 100_000, 32, 1 << 16
ROOT = "root"


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): the turns of a conversation in order, ``ids`` their digests end to end, ``sizes`` the bytes of their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGEST)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", role.alias("role"), digest.alias("id"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.array_join("t.id", "").alias("ids"), F.col("t.size").alias("sizes"))


def with_shared_starts(convs: DataFrame, family: int = 5, longest: int = 8) -> DataFrame:
    """``convs`` rebuilt: the first h turns of conversation c - c % family, then those of c after its first h.

    h is crc32 of c in decimals, modulo ``longest + 1``; a conversation that is
    absent gives no turns, a shorter one all it has.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % (longest + 1)).cast("int")
    base = convs.select(F.col("conv_id").alias("base"), F.substring("ids", 1, DIGEST * longest).alias("base_ids"), F.slice("sizes", 1, longest).alias("base_sizes"))
    both = convs.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % family}).join(base, "base", "left")
    ids = F.concat(F.coalesce(F.substring("base_ids", F.lit(1), F.col("h") * DIGEST), F.lit("")), F.substring("ids", F.col("h") * DIGEST + 1, F.length("ids")))
    start = F.when(F.col("h") > 0, F.slice("base_sizes", F.lit(1), F.col("h")))
    rest = F.slice("sizes", F.col("h") + 1, F.size("sizes"))
    return both.select("conv_id", ids.alias("ids"), F.concat(F.coalesce(start, F.array().cast("array<long>")), rest).alias("sizes"))


NODES = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_first long, ends_n long, up string"


class Node:
    __slots__ = ("children", "depth", "ends_first", "ends_n", "first", "leaves", "n", "parent", "saved", "size")

    def __init__(self, parent, depth, size):
        self.parent, self.depth, self.size, self.children = parent, depth, size, {}
        self.first, self.n, self.ends_first, self.ends_n, self.leaves, self.saved = None, 0, None, 0, 0, 0

    def meet(self, first: int, n: int):
        self.first = first if self.first is None else min(self.first, first)
        self.n += n


def postorder(root: Node):
    """The nodes below and with ``root``, children before parents."""
    stack = [(root, iter(root.children.values()))]
    while stack:
        child = next(stack[-1][1], None)
        if child is None:
            yield stack.pop()[0]
        else:
            stack.append((child, iter(child.children.values())))


def tries(bucket: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a bucket's subtries; the top of each bears the name of the part it hangs from."""
    roots: dict[str, tuple[Node, str]] = {}
    for ids, sizes, n, first, at, key, up in zip(*(bucket[c] for c in ("ids", "sizes", "n", "first", "at", "key", "up")), strict=True):
        if key not in roots:
            roots[key] = Node(None, at, int(sizes[at - 1])), up
        node = roots[key][0]
        node.meet(first, n)
        for depth in range(at + 1, len(sizes) + 1):
            turn = ids[(depth - 1) * DIGEST : depth * DIGEST]
            child = node.children.get(turn)
            if child is None:
                child = node.children[turn] = Node(node, depth, int(sizes[depth - 1]))
            node = child
            node.meet(first, n)
        node.ends_first, node.ends_n = first, n
    out = []
    for root, up in roots.values():
        for node in postorder(root):
            below = node.children.values()
            node.leaves = sum(c.leaves for c in below) or 1
            node.saved = (node.n - 1) * node.size + sum(c.saved for c in below)
            out.append((node.first, node.depth, node.parent and node.parent.first, node.n, len(below), node.leaves, node.saved, node.ends_first, node.ends_n, up if node is root else None))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])
    return frame.astype({"parent_conv_id": "Int64", "ends_first": "Int64"})


def shared_turns(low, high):
    """How many turns two sequences share at their start."""
    places = F.sequence(F.lit(0), F.floor(F.length(high) / DIGEST).cast("int"))
    differ = F.transform(places, lambda i: F.substring(low, i * DIGEST + 1, F.lit(DIGEST)) != F.substring(high, i * DIGEST + 1, F.lit(DIGEST)))
    return (F.array_position(differ, True) - 1).cast("int")


def parts(distinct: DataFrame, most: int):
    """The sequences as they are dealt to tries, and the parts of the top, a frame a round."""
    every = distinct.agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.min(F.when(F.col("ids") == "", F.col("first"))).alias("ends_first"), F.sum(F.when(F.col("ids") == "", F.col("n"))).alias("ends_n"))
    tops = [materialize(every.where("n > 0").select(F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("up"), F.lit(0).alias("at"), F.lit(0).alias("shared"), "n", "first", F.array().cast("array<long>").alias("sizes"), "ends_first", F.coalesce("ends_n", F.lit(0)).cast("long").alias("ends_n")), "trie-top")]
    left, dealt = distinct.where("ids <> ''").withColumns({"at": F.lit(1), "up": F.lit(ROOT)}), []
    while True:
        left = left.withColumn("key", F.sha2(F.substring("ids", F.lit(1), F.col("at") * DIGEST), 256))
        by_key = left.groupBy("key").agg(
            F.sum(F.size("sizes") - F.col("at") + 1).alias("weight"), F.count("*").alias("rows"), F.first("up").alias("up"), F.first("at").alias("at"), F.sum("n").alias("n"), F.min("first").alias("first"),
            F.min("ids").alias("low"), F.max("ids").alias("high"), F.min_by("sizes", "ids").alias("sizes"), F.min_by("first", "ids").alias("ends_first"), F.min_by("n", "ids").alias("ends_n"),
        )
        large = by_key.where((F.col("weight") > most) & (F.col("rows") > 1)).withColumn("shared", shared_turns(F.col("low"), F.col("high")))
        ends = F.size("sizes") == F.col("shared")
        large = materialize(large.select("key", "up", "at", "shared", "n", "first", F.slice("sizes", F.lit(1), F.col("shared")).alias("sizes"), F.when(ends, F.col("ends_first")).alias("ends_first"), F.when(ends, F.col("ends_n")).otherwise(0).cast("long").alias("ends_n")), "trie-top")
        if large.isEmpty():
            return [*dealt, left], tops
        tops.append(large)
        split = materialize(left.join(large.select("key", "shared"), "key", "left"), "trie-parts")
        dealt.append(split.where("shared is null").drop("shared"))
        left = split.where(F.size("sizes") > F.col("shared")).select("ids", "sizes", "n", "first", (F.col("shared") + 1).alias("at"), F.col("key").alias("up"))


def top_nodes(tops: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The nodes of the top, from the subtries that hang from it, the last round first."""
    out, below = [], roots.select("up", "n_leaves", "saved_tokens")
    for top in reversed(tops):
        sums = below.groupBy("up").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_below"))
        own = F.aggregate(F.slice("sizes", F.greatest("at", F.lit(1)), F.col("shared") - F.col("at") + 1), F.lit(0).cast("long"), lambda a, x: a + x)
        full = top.join(sums.withColumnRenamed("up", "key"), "key", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "n_leaves": F.coalesce("n_leaves", F.lit(1)), "saved_below": F.coalesce("saved_below", F.lit(0))})
        full = materialize(full.withColumn("saved_tokens", F.col("saved_below") + F.when(F.col("at") > 0, (F.col("n") - 1) * own).otherwise(0)), "trie-sums")
        out.append(full)
        below = roots.select("up", "n_leaves", "saved_tokens").unionByName(full.where("up is not null").select("up", "n_leaves", "saved_tokens"))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    every = every.withColumn("depth", F.explode(F.sequence("at", "shared")))
    last = F.col("depth") == F.col("shared")
    rest = F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.aggregate(F.slice("sizes", F.greatest("depth", F.lit(1)), F.col("shared") - F.col("depth") + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    return every.select(
        F.col("first").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("at"), F.col("first")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved_below") + (F.col("n") - 1) * rest).alias("saved_tokens"), F.when(last, F.col("ends_first")).alias("ends_first"), F.when(last, F.col("ends_n")).otherwise(0).cast("long").alias("ends_n"), F.when(F.col("depth") == F.col("at"), F.col("up")).alias("up"),
    )


def prefix_trie(convs: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie of ``convs(conv_id, ids, sizes)``, and the members of repeated sequences.

    A node is (conv_id of its smallest member, depth), with its parent's
    conv_id, the conversations that start with it, its children, the childless
    nodes and the saved bytes of its subtree, and of the ``ends_n``
    conversations that end at it the smallest, ``ends_first``. Members are
    (ends_first, conv_id) for all nodes at which two or more end.
    """
    with scope(convs.sparkSession):
        convs = materialize(convs, "trie-sequences")
        distinct = materialize(convs.groupBy("ids", "sizes").agg(F.count("*").alias("n"), F.min("conv_id").alias("first")), "trie-distinct")
        dealt, tops = parts(distinct, most)
        fit = dealt[0]
        for more in dealt[1:]:
            fit = fit.unionByName(more)
        total = fit.agg(F.sum(F.size("sizes") - F.col("at") + 1)).first()[0] or 0
        buckets = -(-total // most) or 1
        low = fit.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInPandas(tries, NODES)
        low = materialize(low, "trie-low")
        hung = low.where("up is not null")
        nodes = top_nodes(tops, hung)
        names = tops[0].select("key", "first")
        for more in tops[1:]:
            names = names.unionByName(more.select("key", "first"))
        tip = hung.unionByName(nodes.where("up is not null")).drop("parent_conv_id").join(names.select(F.col("key").alias("up"), F.col("first").alias("parent_conv_id")), "up")
        rest = low.where("up is null").unionByName(nodes.where("up is null"))
        out = kept(rest.drop("up").unionByName(tip.drop("up")), "trie-nodes")
        again = distinct.where("n > 1").select("ids", F.col("first").alias("ends_first"))
        members = kept(convs.select("conv_id", "ids").join(again, "ids").select("ends_first", "conv_id"), "trie-members")
    return out, members


def joined_digests(members: DataFrame) -> DataFrame:
    """(ends_first, ends_sha256): SHA-256 of each node's conv_ids in ascending order, joined by commas.

    Sorted by range, ids become strings of at most ``CHUNK_BYTES`` in the tasks
    that hold them; only these strings of a node meet, and are hashed as a stream.
    """

    def chunks(batches):
        of, low, held, size = None, None, [], 0
        for batch in batches:
            for first, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (first != of or size >= CHUNK_BYTES):
                    yield pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([low], pa.int64()), pa.array([",".join(held)])], ["ends_first", "low", "part"])
                    held, size = [], 0
                if not held:
                    of, low = first, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([low], pa.int64()), pa.array([",".join(held)])], ["ends_first", "low", "part"])

    def digests(batches):
        of, state = None, None
        for batch in batches:
            for first, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if first != of:
                    if state:
                        yield row(of, state)
                    of, state = first, hashlib.sha256(part.encode())
                else:
                    state.update(b"," + part.encode())
        if state:
            yield row(of, state)

    def row(of, state):
        return pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([state.hexdigest()])], ["ends_first", "ends_sha256"])

    strings = members.repartitionByRange("ends_first", "conv_id").sortWithinPartitions("ends_first", "conv_id").mapInArrow(lean(chunks), "ends_first long, low long, part string")
    return strings.repartition("ends_first").sortWithinPartitions("ends_first", "low").mapInArrow(lean(digests), "ends_first long, ends_sha256 string")


def op11_trie(spark, sf_dir: str) -> DataFrame:
    """A row for each node of the trie of all rebuilt conversations."""
    with scope(spark):
        nodes, members = prefix_trie(with_shared_starts(sequences(table(spark, sf_dir, "conversations"))))
        alone = nodes.where("ends_n < 2").withColumn("ends_sha256", F.sha2(F.when(F.col("ends_n") == 1, F.col("ends_first").cast("string")).otherwise(""), 256))
        several = nodes.where("ends_n > 1").join(joined_digests(members), "ends_first")
        columns = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        return kept(alone.select(*columns).unionByName(several.select(*columns)), "trie")


ORACLE_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc
), r AS (
  SELECT c.conv_id, 0 AS side, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h
), seq AS (
  SELECT conv_id, coalesce(ids, []) AS ids, coalesce(sizes, []) AS sizes FROM c LEFT JOIN (
    SELECT conv_id, list(md5(strlen(role) || ':' || role || text) ORDER BY side, pos) AS ids, list(strlen(text) ORDER BY side, pos) AS sizes FROM r GROUP BY conv_id) USING (conv_id)
), p AS (
  SELECT conv_id, d, array_to_string(ids[1:d], '') AS key, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size, len(ids) = d AS ends FROM seq, unnest(range(0, len(ids) + 1)) AS u(d)
), node AS (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n, max(size) AS size, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ends FROM p GROUP BY key, d
), kids AS (SELECT left(key, 32 * (d - 1)) AS key, count(*) AS n FROM node WHERE d > 0 GROUP BY 1
), sub AS (
  SELECT left(node.key, 32 * a) AS key, count(*) FILTER (kids.n IS NULL) AS leaves, sum((node.n - 1) * size) AS saved
  FROM node LEFT JOIN kids USING (key), unnest(range(0, d + 1)) AS u(a) GROUP BY 1
)
SELECT node.conv_id, CAST(d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(node.n AS BIGINT) AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM node JOIN sub USING (key) LEFT JOIN kids USING (key) LEFT JOIN (SELECT key, conv_id FROM node) AS up ON node.d > 0 AND up.key = left(node.key, 32 * (d - 1))
"""
