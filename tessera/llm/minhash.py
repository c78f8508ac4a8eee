"""Near-duplicate documents by circulant MinHash.

Words are runs of non-space, A-Z lower-cased; a document's set holds its distinct
shingles of five words (fewer words: the whole sequence as one shingle).

All signature coordinates come from two permutations of 32-bit numbers: a first
one spreads the shingles, and coordinate k is the least value of the second at
the spread shingle shifted circularly by k. ``BANDS`` bands of ``ROWS``
coordinates give the candidates: at a similarity of 0.75 a pair shares a band
with a probability of 0.998 (at 0.8, of 0.99998), and texts that merely hold a
common passage seldom do.

Documents with equal sets form a class with one representative. Only classes
that share a band with another one are compared, first with hubs of each band
bucket and then in blocks across components (see ``links``), on whole shingle
sets, exactly: 100 * intersection >= 75 * union. A hub's set is sent in ``salts``
copies that grow with the number of its candidates, so a large group of near
copies is verified by many tasks. The component of a document is the least
doc_id reachable over links.

Shingles are held as 64-bit hashes; two shingles of one pair of documents
collide with a probability below 1e-11.

Null, empty and blank texts have an empty set and are linked with nothing. Rows
with a null doc_id are linked with nothing either, and have no component; rows
that share a doc_id are one node, linked if any of its texts is. Other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, Remembered, kept, lean, materialize, scope
from .links import compared, components, deal, linked_groups, shared_keys

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SHINGLE, BANDS, ROWS = 5, 60, 8
LIMIT = 75  # per cent
#: Odd multipliers of the two permutations (fixed values, any odd ones do).
SPREAD, SECOND = 0x9E3779B1, 0xC2B2AE35
MANY = 256


class Words(Remembered):
    """Word to a 64-bit hash."""

    def compute(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


def shingles(text: str | None, lookup: Words) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = WORD.findall(text.encode("utf-8", "replace").lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(lookup.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def permute(x: np.ndarray, odd) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place: multiplications and xor-shifts."""
    x ^= x >> np.uint32(15)
    x *= np.uint32(odd)
    x ^= x >> np.uint32(13)
    return x


def signature(hashes: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant signature of a non-empty set."""
    spread = permute((hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32), SPREAD)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    for at in range(0, len(spread), 2048):  # some 640 KB at once
        np.minimum(out, permute(spread[None, at : at + 2048] + shifts, SECOND).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(sig[b * ROWS : (b + 1) * ROWS].tobytes(), seed=b) - (1 << 63) for b in range(BANDS)]


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty) and band keys of every row."""
    names = ["doc_id", "n_shingles", "digest", "bands"]

    def sign(batches):
        lookup = Words()
        for batch in batches:
            column, n, digests, bands = batch.column(1), [], [], []
            for i in range(len(column)):
                s = shingles(column[i].as_py(), lookup)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(signature(s)) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(bands, pa.list_(pa.int64()))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(lean(sign), "doc_id long, n_shingles long, digest string, bands array<long>")


def spread_hubs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(hub, id, text, hub_text) of pairs(a, b), however many pairs share an end.

    The end that more pairs share is the hub; its text comes in one copy for
    every ``MANY`` of its pairs, each joined with a share of them.
    """
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    degree = materialize(degree, "degree")
    na, nb = degree.select(F.col("id").alias("a"), F.col("n").alias("na")), degree.select(F.col("id").alias("b"), F.col("n").alias("nb"))
    ends = pairs.join(na, "a").join(nb, "b").withColumn("swap", F.col("nb") > F.col("na"))
    ends = ends.select(
        F.when(F.col("swap"), F.col("b")).otherwise(F.col("a")).alias("hub"),
        F.when(F.col("swap"), F.col("a")).otherwise(F.col("b")).alias("id"),
        F.ceil(F.greatest("na", "nb") / MANY).cast("int").alias("salts"),
    ).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    hubs = degree.withColumn("salts", F.ceil(F.col("n") / MANY).cast("int")).join(ends.select(F.col("hub").alias("id")), "id", "left_semi")
    copies = texts.join(hubs, "id").select(F.col("id").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("text").alias("hub_text"))
    return ends.select("hub", "salt", "id").join(texts, "id").join(copies, ["hub", "salt"]).select("hub", "id", "text", "hub_text")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles are similar enough."""
    if 100 * min(len(a), len(b)) < LIMIT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= LIMIT * (len(a) + len(b) - both)


def verified(sets: DataFrame):
    """A verifier over sets(id, payload): keeps pairs (a, b) whose shingle sets are similar enough."""

    def verify(pairs: DataFrame) -> DataFrame:
        held = spread_hubs(pairs, sets.select("id", F.col("payload").alias("text")))

        def compare(batches):
            last, hub_set = None, None
            for batch in batches:
                keep = []
                _, _, own, other = batch.columns
                for i in range(batch.num_rows):
                    if (h := other[i].as_py()) != last:
                        last, hub_set = h, np.frombuffer(h, np.uint64)
                    keep.append(linked(np.frombuffer(own[i].as_py(), np.uint64), hub_set))
                won = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
                if won.num_rows:
                    yield won

        return held.mapInArrow(lean(compare), "hub long, id long").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()

    return verify


def links_of(payloads, wanted, here):
    """The wanted pairs whose sets are similar enough. Many pairs of the same rows are counted at once: sets as rows of a matrix of shingles."""
    sets = {}

    def of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.frombuffer(payloads[i].as_buffer(), np.uint64)
        return sets[i]

    for a, b in wanted:
        size = {i: len(of(i)) for i in np.union1d(a, b).tolist()}
        na, nb = (np.fromiter(map(size.__getitem__, x.tolist()), np.int64, len(x)) for x in (a, b))
        near = 100 * np.minimum(na, nb) >= LIMIT * np.maximum(na, nb)
        near[near] = here(a[near], b[near])
        a, b, na, nb = a[near], b[near], na[near], nb[near]
        if not len(a):
            continue
        both = np.zeros(len(a), np.int64)
        # Pairs that lie together are of one group; a group is at most two blocks.
        cuts = np.flatnonzero(np.concatenate([[True], np.maximum.accumulate(b)[:-1] < a[1:]]))
        for low, high in zip(cuts, [*cuts[1:], len(a)], strict=True):
            own = slice(low, high)
            if high - low < 64:
                both[own] = [len(np.intersect1d(of(i), of(j), assume_unique=True)) for i, j in zip(a[own].tolist(), b[own].tolist(), strict=True)]
            else:
                both[own] = common_counts(of, a[own], b[own])
        won = 100 * both >= LIMIT * (na + nb - both)
        yield a[won], b[won]


def common_counts(of, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles the pairs (a, b) of sets share."""
    used = np.union1d(a, b)
    owner = np.repeat(np.arange(len(used)), [len(of(i)) for i in used.tolist()])
    value = np.concatenate([of(i) for i in used.tolist()])
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    same = value[1:] == value[:-1]
    held = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    owner, value = owner[held], value[held]
    left, right = np.searchsorted(used, a), np.searchsorted(used, b)
    if not len(value):
        return np.zeros(len(a), np.int64)
    number = np.cumsum(np.concatenate([[True], value[1:] != value[:-1]])) - 1
    rows, columns = np.unique(left), np.unique(right)
    place = [np.full(len(used), -1), np.full(len(used), -1)]
    place[0][rows], place[1][columns] = np.arange(len(rows)), np.arange(len(columns))
    both = np.zeros((len(rows), len(columns)), np.float32)
    step = 4096  # shingles at once
    for low in range(0, int(number[-1]) + 1, step):
        x, y = np.searchsorted(number, [low, low + step])
        held = []
        for n, where in ((len(rows), place[0]), (len(columns), place[1])):
            matrix = np.zeros((n, step), np.float32)
            at = where[owner[x:y]]
            matrix[at[at >= 0], (number[x:y] - low)[at >= 0]] = 1
            held.append(matrix)
        both += held[0] @ held[1].T
    return both[place[0][left], place[1][right]].astype(np.int64)


def candidate_sets(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """(id, payload) of the wanted doc_ids: their shingles, packed.

    A fixed-size filter of the wanted ids is applied where texts are read, so the
    others are neither cut nor shuffled. A doc_id with several texts has several rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Bloom.of(wanted))

    def cut(batches):
        lookup = Words()
        for batch in batches:
            met = np.flatnonzero(shared.value.met(batch.column(0).to_numpy(zero_copy_only=False))).tolist()
            for low in range(0, len(met), 256):
                own = met[low : low + 256]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array([shingles(batch.column(1)[i].as_py(), lookup).tobytes() for i in own], pa.binary())], ["id", "payload"])

    body = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
    return body.mapInArrow(lean(cut), "id long, payload binary").join(wanted, "id", "left_semi")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    spark = docs.sparkSession
    with scope(spark):
        signed = materialize(signatures(docs, text), "signatures")
        # Documents with equal sets: a class, represented by its least doc_id.
        nodes = signed.where("doc_id is not null and digest is not null")
        classes = materialize(nodes.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "n_shingles"), "doc_id").alias("s")).select("digest", "rep", "s.*"), "classes")
        keys = materialize(shared_keys(deal(classes.select(F.col("rep").alias("id"), F.col("bands").alias("keys")))), "keys")
        wanted = materialize(keys.select("id").distinct(), "candidates")
        sets = materialize(candidate_sets(docs, wanted, text), "candidate-sets")
        weights = classes.groupBy(F.col("rep").alias("id")).agg((8 * F.max("n_shingles")).alias("weight"))
        comps = linked_groups(keys, verified(sets), lambda members: compared(members, sets, links_of), weights)
        # A doc_id with several texts lies in several classes: they are one node.
        twice = nodes.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
        named = classes.select("digest", "rep").join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("digest", F.coalesce("comp", "rep").alias("component_id"))
        named = materialize(joined_components(nodes, named, twice), "components")
        out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        out = out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")) | F.col("doc_id").isNull())
        return kept(out, "near-duplicates")


def joined_components(nodes: DataFrame, named: DataFrame, twice: DataFrame) -> DataFrame:
    """Join the components of classes that hold one doc_id; without such ids, ``named`` as it is."""
    twice = materialize(twice, "several-texts")
    if twice.isEmpty():
        return named
    spans = nodes.join(twice, "doc_id", "left_semi").join(named, "digest").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    lifted = components(spans)
    return named.join(lifted.select(F.col("id").alias("component_id"), "comp"), "component_id", "left").select("digest", F.coalesce("comp", "component_id").alias("component_id"))


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
