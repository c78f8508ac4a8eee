"""Ranked lexical search over dual-sorted wavelet trees, a tree per shard of documents.

The index is partitioned by document: a task closes a shard every ``SHARD``
words. A shard is one row of a table in the shared folder: its documents in
ascending order of identifier, its sorted terms, and one sequence of postings,
list after list, each list ordered by falling impact. The sequence holds places
of documents and is kept as a wavelet matrix, a bit vector a level, so each list
is navigable by identifier too: a node is a range of documents, its part of a
list stays in order of impact, and the first entry of that part is the largest
impact that any document below can have. No posting is shuffled, and no term is
gathered, however common it is.

A query keeps its lists' ranges at each node. The sum of the weighted first
impacts bounds every score below, so nodes are opened best first (some at a
time, in array operations) until no bound reaches the k-th best score found; a
task carries that score from shard to shard. At a leaf the sum is the score
itself, so the top k are exact. Equal scores go by identifier, and a node whose
bound only equals the k-th score is opened only if its identifiers can win.

Impacts need the number of documents and of words, which are counted first. The
weight of a term needs the documents that hold it: the lengths of its lists, read
from the shards' terms alone. Items travel in blocks of bounded bytes.

Null text has no terms. Rows are documents each for itself, repeated ones too;
null identifiers come first. Items that share an identifier are one item with
the terms of all their texts; those without terms have no results. Empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, lean, materialize, scope, table

WORD, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
SHARD, TEXT_BLOCK, BLOCK, OPENED = 1_000_000, 1 << 20, 4 << 20, 64
#: Fixed values of the score.
IMPACT, TF, LENGTH, FLAT, WEIGHT = 1_000_000_000, 1000, 20, 50, 1000


class Index(NamedTuple):
    """Shards, and the counts that their impacts were made with."""

    shards: DataFrame
    n_docs: int
    n_words: int


class Numbers(dict):
    """Terms by number, in the order they are met."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


def word_blocks(text: str | None):
    """The words of a text, a bounded part at a time."""
    data = (text or "").encode("utf-8", "replace").lower()
    low = 0
    while low < len(data):
        gap = GAP.search(data, low + TEXT_BLOCK)
        end = gap.start() if gap else len(data)
        yield WORD.findall(data, low, end)
        low = end


def wavelet(docs: np.ndarray, levels: int) -> bytes:
    """The bit vectors of a wavelet matrix over places of documents, the highest bit first."""
    out = []
    for level in range(levels):
        bits = docs >> (levels - 1 - level) & 1
        out.append(np.packbits(bits.astype(np.uint8)).tobytes())
        docs = np.concatenate([docs[bits == 0], docs[bits == 1]])
    return b"".join(out)


SCHEMA = "doc_ids array<long>, terms array<binary>, ends binary, impacts binary, bits binary"
KINDS = [pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary()]


def shard_of(ids: list, texts: list[np.ndarray], numbers: Numbers, n_docs: int, n_words: int) -> pa.RecordBatch:
    """A shard's row from its documents' term numbers."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
    ids, texts = [ids[i] for i in order], [texts[i] for i in order]
    lengths = [len(t) for t in texts]
    names = sorted(numbers)
    rank = np.empty(len(names), np.int64)
    rank[[numbers[t] for t in names]] = np.arange(len(names))
    keys, tf = np.unique(rank[np.concatenate(texts)] * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    term, doc = keys // len(ids), keys % len(ids)
    m = np.array([100 - FLAT + FLAT * n * n_docs // n_words for n in lengths], np.int64)
    impact = IMPACT * tf // (TF * tf + LENGTH * m[doc])
    by = np.lexsort((doc, -impact, term))
    ends = np.cumsum(np.bincount(term, minlength=len(names)))
    values = [ids, names, ends.astype("<u4").tobytes(), impact[by].astype("<u4").tobytes(), wavelet(doc[by], max(1, (len(ids) - 1).bit_length()))]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, KINDS, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


def build_index(docs: DataFrame, text: str = "text", shard_words: int = SHARD) -> Index:
    """The stored index of ``docs(doc_id, text)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def count(batches):
        docs = words = 0
        for batch in batches:
            for text in batch.column(0):
                n = sum(map(len, word_blocks(text.as_py())))
                docs, words = docs + (n > 0), words + n
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([words], pa.int64())], ["docs", "words"])

    totals = rows.select("text").mapInArrow(lean(count), "docs long, words long").agg(F.sum("docs"), F.sum("words")).first()
    n_docs, n_words = (n or 0 for n in totals)

    def build(batches):
        numbers, ids, texts, size = Numbers(), [], [], 0
        for batch in batches:
            column = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                own = [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)) for words in word_blocks(column[i].as_py()) if words]
                if not own:
                    continue
                ids.append(doc_id)
                texts.append(np.concatenate(own))
                size += len(texts[-1])
                if size >= shard_words:
                    yield shard_of(ids, texts, numbers, n_docs, n_words)
                    numbers, ids, texts, size = Numbers(), [], [], 0
        if ids:
            yield shard_of(ids, texts, numbers, n_docs, n_words)

    return Index(materialize(rows.mapInArrow(lean(build), SCHEMA), "wavelet-index"), n_docs, n_words)


class Tree:
    """A shard's wavelet matrix, ready to search: ranks and impacts by level."""

    def __init__(self, row: dict):
        self.ids = row["doc_ids"]
        self.keys = np.array([-(1 << 63) if i is None else i for i in self.ids], np.int64)
        self.levels = max(1, (len(self.ids) - 1).bit_length())
        impact = np.frombuffer(row["impacts"], "<u4")
        n, width = len(impact), (len(impact) + 7) // 8
        #: By level and place: ones before it, and the impact there (0 behind the last); by level: zeros.
        self.ones, self.impact = np.zeros((self.levels, n + 1), np.int32), np.zeros((self.levels + 1, n + 1), np.int32)
        self.zeros = np.zeros(self.levels, np.int32)
        self.impact[0, :n] = impact
        packed = np.frombuffer(row["bits"], np.uint8)
        for level in range(self.levels):
            bits = np.unpackbits(packed[level * width : (level + 1) * width], count=n)
            np.cumsum(bits, out=self.ones[level, 1:])
            self.zeros[level] = n - self.ones[level, n]
            one, now = bits.astype(bool), self.impact[level, :n]
            self.impact[level + 1, : self.zeros[level]] = now[~one]
            self.impact[level + 1, self.zeros[level] : n] = now[one]

    def bounds(self, level, first, last, weights):
        """What no score below a node exceeds; at a leaf, its score."""
        return np.where(last > first, self.impact[level[:, None], first], 0) @ weights

    def opened(self, level, prefix, first, last):
        """Both children of each node."""
        at = level[:, None]
        f1, l1, zeros = self.ones[at, first], self.ones[at, last], self.zeros[at]
        return np.concatenate([level, level]) + 1, np.concatenate([prefix * 2, prefix * 2 + 1]), np.concatenate([first - f1, zeros + f1]), np.concatenate([last - l1, zeros + l1])

    def search(self, first: np.ndarray, last: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Add to ``best`` the documents that belong there."""
        level, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64)
        first, last = first[None].astype(np.int64), last[None].astype(np.int64)
        bound = self.bounds(level, first, last, weights)
        while len(bound):
            if len(bound) > OPENED:
                pick = np.zeros(len(bound), bool)
                pick[np.argpartition(bound, -OPENED)[-OPENED:]] = True
            else:
                pick = np.ones(len(bound), bool)
            level2, prefix2, first2, last2 = self.opened(level[pick], prefix[pick], first[pick], last[pick])
            bound2 = self.bounds(level2, first2, last2, weights)
            leaf = level2 == self.levels
            if leaf.any():
                met = leaf & (bound2 > 0)
                best.add(bound2[met], self.keys[prefix2[met]], [self.ids[p] for p in prefix2[met]])
            rest = ~pick
            parts = ((level, level2), (prefix, prefix2), (first, first2), (last, last2), (bound, bound2))
            level, prefix, first, last, bound = (np.concatenate([a[rest], b[~leaf]]) for a, b in parts)
            keep = best.can(bound, self.keys[np.minimum(prefix << (self.levels - level), len(self.keys) - 1)])
            level, prefix, first, last, bound = level[keep], prefix[keep], first[keep], last[keep], bound[keep]


class Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.keys, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def add(self, scores: np.ndarray, keys: np.ndarray, ids: list) -> None:
        scores, keys, ids = np.concatenate([self.scores, scores]), np.concatenate([self.keys, keys]), self.ids + ids
        order = np.lexsort((keys, -scores))[: self.k]
        self.scores, self.keys, self.ids = scores[order], keys[order], [ids[i] for i in order]

    def can(self, bounds: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which nodes can still hold one of the best; least: their smallest identifier."""
        if len(self.ids) < self.k:
            return bounds > 0
        return (bounds > self.scores[-1]) | (bounds == self.scores[-1]) & (least < self.keys[-1])


def blocks(items: DataFrame, block_bytes: int = BLOCK):
    """The items in blocks of bounded size, never all of them at once; the texts of one identifier stay together."""
    held, size = [], 0
    for name, body in items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string")).distinct().orderBy(F.asc_nulls_first("item_id")).toLocalIterator():
        if size >= block_bytes and name != held[-1][0]:
            yield held
            held, size = [], 0
        held.append((name, body))
        size += len(body or "") + 16
    if held:
        yield held


def terms_by_item(items: list[tuple]) -> tuple[list, list[list[int]], list[bytes]]:
    """Names, their distinct terms by number, and the terms."""
    own: dict = {}
    for name, text in items:
        own.setdefault(name, set()).update(w for words in word_blocks(text) for w in words)
    terms = sorted(set().union(*own.values()))
    number = {t: i for i, t in enumerate(terms)}
    return list(own), [sorted(number[t] for t in ts) for ts in own.values()], terms


def lists_of(wanted: pa.Array, terms: pa.Array, ends: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of the lists of ``wanted`` terms, empty for those that the shard lacks."""
    at = pc.index_in(wanted, value_set=terms)
    have, at = at.is_valid().to_numpy(zero_copy_only=False), at.fill_null(0).to_numpy(zero_copy_only=False)
    last = np.frombuffer(ends, "<u4").astype(np.int64)
    first = np.concatenate([[0], last[:-1]])
    return np.where(have, first[at], 0), np.where(have, last[at], 0)


def document_counts(index: Index, terms: list[bytes]) -> dict[int, int]:
    """Of each term by number, the documents that hold it; read from the shards' terms alone."""

    def count(batches):
        wanted, total = pa.array(terms, pa.binary()), np.zeros(len(terms), np.int64)
        for batch in batches:
            for n in range(batch.num_rows):
                first, last = lists_of(wanted, batch.column(0)[n].values, batch.column(1)[n].as_py())
                total += last - first
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there])], ["term", "n"])

    counts = index.shards.select("terms", "ends").mapInArrow(lean(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counts.collect()}  # a number for a term of one block of items


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search_block(index: Index, items: list[tuple], k: int) -> DataFrame:
    """(item_id, doc_id, score): each task's k best for each item of a block."""
    names, lists, terms = terms_by_item(items)
    df = document_counts(index, terms)
    kept_terms = np.array(sorted(df), np.int64)
    place = {t: i for i, t in enumerate(kept_terms.tolist())}
    weights = np.array([weight(index.n_docs, df[t]) for t in kept_terms.tolist()], np.int64)
    wanted = [np.array([p for t in own if (p := place.get(t)) is not None and weights[p] > 0], np.int64) for own in lists]
    shared = index.shards.sparkSession.sparkContext.broadcast((names, wanted, [terms[t] for t in kept_terms.tolist()], weights))

    def search(batches):
        names, wanted, terms, weights = shared.value
        best, terms = [Best(k) for _ in names], pa.array(terms, pa.binary())
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n] for c in ("doc_ids", "terms", "ends", "impacts", "bits")}
                first, last = lists_of(terms, row["terms"].values, row["ends"].as_py())
                tree = Tree({c: row[c].as_py() for c in ("doc_ids", "impacts", "bits")})
                for own, found in zip(wanted, best, strict=True):
                    own = own[last[own] > first[own]]
                    if len(own):
                        tree.search(first[own], last[own], weights[own], found)
        for name, found in zip(names, best, strict=True):
            if found.ids:
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found.ids), pa.string()), pa.array(found.ids, pa.int64()), pa.array(found.scores)], ["item_id", "doc_id", "score"])

    return index.shards.mapInArrow(lean(search), "item_id string, doc_id long, score long")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 50, text: str = "text", shard_words: int = SHARD) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each of ``items(item_id, text)``."""
    with scope(docs.sparkSession):
        index = build_index(docs, text, shard_words)
        found = [search_block(index, block, k) for block in blocks(items)] or [search_block(index, [], k)]
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        best = every.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).where(F.col("rank") <= k)
        return kept(best.select(F.col("item_id").cast(items.schema["item_id"].dataType).alias("item_id"), "rank", "doc_id", "score"), "ranked")


def op12_search(spark, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score of the 50 best documents of every benchmark item."""
    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM d
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark
), p AS (
  SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, n, t
), w AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s
), x AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words)))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN w USING (t), s GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
