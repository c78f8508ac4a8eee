"""Connected groups over bucketed candidates, without a row for every pair of a bucket.

Used where candidates share bucket keys (LSH bands, SimHash blocks) and a
verifier decides on pairs. A bucket whose members already lie in one component
needs no further comparison, so a bucket is first compared with one hub (a
star, linear in its size), then members of *different* components with a hub of
the bucket's own. What still spans components is compared in blocks of bounded
size (see ``block_pairs``), many pairs at a time and without a row for each. No
comparison that could join two components is left out.

Keys are dealt to tasks in packed form (see ``Dealer``), 13 bytes a key, as most
of them turn out to have no partner.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, lean, materialize, scope

#: Members of a block, and the bytes of what they are compared by.
MEMBERS, BYTES = 256, 8 << 20
#: Rows and bytes of blocks that are held, and pairs that are compared at once.
ROWS, HELD, PAIRS = 20_000, 3 << 20, 30_000
#: Entries that a task packs at once.
PACKED = 1 << 18


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (id, comp), comp the least id.

    Alternating large-star and small-star rounds; every round pre-aggregates by
    node and is written to the shared folder, so lineage stays short and a hub
    of any degree is combined before it is shuffled. Empty edges give no rows.
    """
    with scope(edges.sparkSession):
        now = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "cc")
        before = None
        while True:
            # Every neighbour above a node moves to the least of its neighbourhood.
            both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).union(now.select(F.col("u").alias("x"), F.col("v").alias("y")))
            low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
            large = both.where("y > x").join(low, "x").where("y <> m").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
            # Every neighbour below a node, and the node, move to the least of them.
            least = large.groupBy("v").agg(F.min("u").alias("m"))
            small = large.join(least, "v")
            small = small.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u"))).distinct()
            now = materialize(small, "cc")
            stamp = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
            if stamp == before:
                return kept(now.select(F.col("v").alias("id"), F.col("u").alias("comp")).union(now.select(F.col("u").alias("id"), F.col("u").alias("comp")).distinct()), "components")
            before = stamp


class Dealer:
    """Packs (key, id) entries for the tasks that look for shared keys: a row a bucket, 4 bytes of key and 8 of id an entry.

    The first bits of a key name its bucket; there are ``buckets`` (a power of
    two) of them. With 32 bits left in a bucket, keys that only seem equal are
    rare, and pairs are verified anyway.
    """

    NAMES = ["bucket", "part", "ids"]
    SCHEMA = "bucket int, part binary, ids binary"

    def __init__(self, buckets: int):
        self.bits = buckets.bit_length() - 1
        self.keys, self.ids, self.held = [], [], 0

    def add(self, keys: np.ndarray, ids: np.ndarray):
        """``keys``: of all ids, as unsigned numbers; ``ids``: one for each key. Gives a batch when enough is held."""
        self.keys.append(keys)
        self.ids.append(ids)
        self.held += len(keys)
        if self.held >= PACKED:
            yield self.packed()

    def finish(self):
        if self.held:
            yield self.packed()

    def packed(self) -> pa.RecordBatch:
        keys, ids = np.concatenate(self.keys).astype(np.uint64), np.concatenate(self.ids)
        self.keys, self.ids, self.held = [], [], 0
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        bucket = (keys >> np.uint64(64 - self.bits)).astype(np.int32) if self.bits else np.zeros(len(keys), np.int32)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.concatenate([first[1:], [len(keys)]])
        rest = ((keys << np.uint64(self.bits)) >> np.uint64(32)).astype("<u4")
        return pa.RecordBatch.from_arrays([pa.array(bucket[first]), binaries(rest, first, ends), binaries(ids.astype("<i8"), first, ends)], self.NAMES)


def binaries(values: np.ndarray, first: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value for each run values[first:end] of consecutive runs."""
    offsets = np.concatenate([first, ends[-1:]]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def buckets_of(spark: SparkSession) -> int:
    """How many buckets keys are dealt to: several a shuffle partition, so tasks hold a little at a time."""
    return 1 << math.ceil(math.log2(8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def gathered(rows):
    """Rows (a tuple of values) of one bucket at a time: (bucket, list of rows)."""
    now, held = None, []
    for batch in rows:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != now and held:
                yield now, held
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield now, held


def entries_of(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """The (rest of the key, id) entries of a bucket whose key several ids share, sorted, each once."""
    part = np.frombuffer(b"".join(r[0] for r in rows), "<u4")
    ids = np.frombuffer(b"".join(r[1] for r in rows), "<i8")
    ordered = np.sort(part)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])  # most keys occur once
    at = np.minimum(np.searchsorted(twice, part), max(0, len(twice) - 1))
    held = twice[at] == part if len(twice) else np.zeros(len(part), bool)
    part, ids = part[held], ids[held]
    order = np.lexsort((ids, part))
    part, ids = part[order], ids[order]
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (ids[1:] != ids[:-1])
    part, ids = part[new], ids[new]
    same = part[1:] == part[:-1]
    many = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(part) else new
    return part[many], ids[many]


def spread(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit numbers from any."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_keys(part: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each entry a key of all the ids that share its key: buckets of the same ids become one."""
    if not len(part):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    sums = np.add.reduceat(spread(ids.view(np.uint64)), first)
    sizes = np.diff(np.concatenate([first, [len(part)]]))
    return np.repeat(spread(sums + sizes.astype(np.uint64)), sizes)


#: What is known of a shared key: an id, the key, the least id that has it, and how many have it.
SHARED = "id long, key long, hub long, n int"


def keyed(bucket: int, rows: list):
    """Batches (id, key, hub, n) of a bucket's shared entries."""
    part, ids = entries_of(rows)
    if not len(part):
        return
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(part)]]))
    hub, n = np.repeat(ids[first], sizes), np.repeat(sizes, sizes).astype(np.int32)
    key = part.astype(np.int64) | (bucket << 32)
    for at in range(0, len(part), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in (ids, key, hub, n)], ["id", "key", "hub", "n"])


def shared_keys(dealt: DataFrame) -> DataFrame:
    """The entries (id, key, hub, n) of keys that several ids share, from a Dealer's rows.

    Near ids share many keys. Keys that the same ids share are told by these ids
    from here on, in a second deal, so each set of ids is kept once.
    """
    n = buckets_of(dealt.sparkSession)

    def sets(batches):
        dealer = Dealer(n)
        for _, rows in gathered(batches):
            part, ids = entries_of(rows)
            yield from dealer.add(set_keys(part, ids), ids)
        yield from dealer.finish()

    def find(batches):
        for bucket, rows in gathered(batches):
            yield from keyed(bucket, rows)

    return by_bucket(by_bucket(dealt).mapInArrow(lean(sets), Dealer.SCHEMA)).mapInArrow(lean(find), SHARED)


def by_bucket(dealt: DataFrame) -> DataFrame:
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket")


def deal(rows: DataFrame) -> DataFrame:
    """A Dealer's rows of ``rows(id, keys)``, keys an array of numbers."""
    n = buckets_of(rows.sparkSession)

    def run(batches):
        dealer = Dealer(n)
        for batch in batches:
            keys = batch.column(1)
            sizes = keys.value_lengths().to_numpy(zero_copy_only=False)
            yield from dealer.add(keys.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes))
        yield from dealer.finish()

    return rows.select("id", "keys").mapInArrow(lean(run), Dealer.SCHEMA)


def joined(comp: DataFrame, won: DataFrame) -> DataFrame:
    """The components ``comp(id, comp)`` with the links ``won(a, b)``: only components that links join are searched."""
    a, b = (comp.select(F.col("id").alias(x), F.col("comp").alias(f"of_{x}")) for x in "ab")
    ends = won.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    lifted = components(ends).withColumnsRenamed({"id": "_from", "comp": "_to"})
    old = comp.join(lifted, comp["comp"] == lifted["_from"], "left").select("id", F.coalesce("_to", "comp").alias("comp"))
    new = lifted.join(comp, lifted["_from"] == comp["id"], "left_anti").select(F.col("_from").alias("id"), F.col("_to").alias("comp"))
    return kept(old.union(new), "comp")


def linked_groups(keys: DataFrame, verify: Callable[[DataFrame], DataFrame], within: Callable[[DataFrame], DataFrame], weights: DataFrame | None = None, rounds: int = 2, few: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Components of the graph whose edges are verified pairs sharing a key.

    ``keys(id, key, hub, n)``: a table of the keys that several ids share. ``verify`` takes
    pairs(a, b) and gives back those that are links. ``within`` takes members of
    blocks (see ``block_pairs``) and gives the links (a, b) across components.
    ``weights(id, weight)`` has the bytes a member is compared by. ``few``, if given,
    takes (key, id, hub, comp) of the buckets of at most ``MEMBERS`` ids that are left
    and gives the links across components in them, so only larger ones make blocks.
    Returns (id, comp) of all ids that have a link.

    Round 0 compares each bucket with its least id; later rounds compare members
    of buckets that still span several components with a hub of the bucket's
    own, so a group whose members are near some of each other meets many hubs;
    the last step compares what is left across components.
    """
    spark = keys.sparkSession
    with scope(spark):
        comp = spark.createDataFrame([], "id long, comp long")

        def labelled(least: int) -> DataFrame:
            """The entries of buckets of at least so many ids, with components."""
            return keys.where(F.col("n") >= least).select("key", "id", "hub").join(comp, "id", "left").select("key", "id", "hub", F.coalesce("comp", "id").alias("comp"))

        for turn in range(rounds):
            # A bucket of so many ids has met all its hubs by now.
            if turn == 0:
                found = keys.where("id <> hub")
            else:
                open_ = labelled(turn + 2).drop("hub")
                hubs = open_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct(F.xxhash64("id", "key", F.lit(turn)), "id", "comp")).alias("h")).where("lo <> hi")
                found = open_.join(hubs.select("key", F.col("h.id").alias("hub"), F.col("h.comp").alias("hub_comp")), "key").where("comp <> hub_comp")
            pairs = materialize(found.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "pairs")
            won = materialize(verify(pairs), "links")
            if not won.isEmpty():
                comp = joined(comp, won)
        last = labelled(rounds + 2)
        spans = last.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("key", "size")
        left = materialize(last.join(spans, "key"), "open")
        small, large = (left.where(f"size <= {MEMBERS}"), left.where(f"size > {MEMBERS}")) if few else (left.limit(0), left)
        for rest, search in ((small, few), (large, lambda x: within(block_pairs(x, weights)))):
            rest = rest.drop("size")
            if not rest.isEmpty():
                won = materialize(search(rest), "links")
                if not won.isEmpty():
                    comp = joined(comp, won)
        return kept(comp, "linked")


def block_pairs(left: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Members of buckets dealt to pairs of blocks: (pair, side, id, comp, hub, keys).

    ``left(key, id, hub, comp)``: the entries of buckets that span components. Near
    ids share many buckets, which mostly have the same least id, their hub: so the
    buckets of a hub are dealt together, each of their ids once. Their ids come in
    blocks of some ``MEMBERS`` ids and ``BYTES`` bytes; every two blocks meet in one
    ``pair``. ``side`` tells the blocks apart (0 and 1; a block that meets itself is
    side 2). n ids make n rows, or n * n / MEMBERS if they are many, and no task
    holds more than two blocks at once. ``keys`` are all buckets of the id, with
    their hubs.
    """
    keys = left.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("key", "hub"))).alias("keys"))  # as many as an id has keys
    members = left.select("hub", "id", "comp").distinct()
    if weights is not None:
        members = members.join(weights, "id", "left")
    sizes = members.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(0) if weights is None else F.coalesce("weight", F.lit(0))).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("bytes") / BYTES)).cast("int")
    each = members.join(sizes.select("hub", blocks.alias("blocks")), "hub").join(keys, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = each.select("hub", "keys", "id", "comp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(low == high, 2).when(F.col("block") == low, 0).otherwise(1)
    return each.select(F.xxhash64("hub", low, high).alias("pair"), side.alias("side"), "id", "comp", "hub", "keys")


def whole_groups(batches):
    """Tables of some ``ROWS`` rows that hold all rows of each value of their first column; rows come sorted by it."""
    held, n, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
        if n >= ROWS or size >= HELD:
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column(0).to_numpy()
            last = int(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[-1])
            if last:
                yield table.slice(0, last)
            table = table.slice(last)
            held, n, size = table.to_batches(), table.num_rows, table.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def pairs_of(groups: np.ndarray):
    """(left, right) row numbers of all pairs within groups (the first row of each, and the end), a bounded number at once."""
    first, size = groups[:-1], np.diff(groups)
    for m in np.unique(size[size > 1]).tolist():
        i, j = np.triu_indices(m, 1)
        own = first[size == m]
        step = max(1, PAIRS // len(i))
        for at in range(0, len(own), step):
            yield (own[at : at + step, None] + i).ravel(), (own[at : at + step, None] + j).ravel()


def compared(members: DataFrame, payload: DataFrame, links: Callable, out: str = "a long, b long") -> DataFrame:
    """The links (a, b) that ``links`` finds in pairs of blocks.

    ``members``: as ``block_pairs`` gives them, ``payload(id, payload)`` what ids are
    compared by. ``links`` takes the payloads of some rows, a generator of the pairs
    (left, right) of row numbers that may be compared, and a function that tells
    which of them are to be compared here: those that share a bucket, the least of
    which has this hub. It gives those that are links, as two arrays at a time.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.join(payload, "id").select("pair", "side", "id", "comp", "hub", "keys", "payload").repartition(n, "pair").sortWithinPartitions("pair")

    def run(batches):
        for table in whole_groups(batches):
            pair, side, ids, comp, hub = (table.column(c).to_numpy() for c in ("pair", "side", "id", "comp", "hub"))
            groups = np.concatenate([np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])), [len(pair)]])
            keys, held = table.column("keys"), {}

            def wanted(groups=groups, side=side, ids=ids, comp=comp):
                for a, b in pairs_of(groups):
                    own = (comp[a] != comp[b]) & (ids[a] != ids[b]) & ((side[a] != side[b]) | (side[a] == 2))
                    if own.any():
                        yield a[own], b[own]

            def here(a, b, hub=hub, keys=keys, held=held):
                for i in np.union1d(a, b).tolist():
                    if i not in held:
                        held[i] = {x["key"]: x["hub"] for x in keys[i].as_py()}
                out = np.zeros(len(a), bool)
                for n, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                    common = held[i].keys() & held[j].keys()
                    out[n] = bool(common) and held[i][min(common)] == hub[i]
                return out

            for a, b in links(table.column("payload"), wanted(), here):
                if len(a):
                    low, high = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
                    both = np.unique(np.stack([low, high], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return dealt.mapInArrow(lean(run), out).distinct()
