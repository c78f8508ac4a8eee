"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document, as search engines do it: a task reads its
documents and closes a segment every ``SEGMENT`` words. A segment is one row of
a table in the shared folder: its documents (identifier, length, first place),
its sorted term dictionary, and one postings list per term with the places of
the term, documents laid end to end with a gap no window can span. All terms of
all documents are indexed; a segment never splits a document, so no postings are
shuffled and nothing is gathered by term, however common a word or passage is.

Each test window is answered in every segment from its rarest term: that list,
adjusted by the term's offset, is intersected with the others in ascending
order of length. Windows with a term that the segment lacks are left out by array
operations over all windows, so only those that may occur are visited.
Proximity matches let every term lie up to ``slop`` words off its place.

Test items travel in blocks of at most ``BLOCK`` bytes of text; each block is
broadcast by itself, which bounds the broadcast whatever the size of the table.

Null text has no words; empty texts and tables give zero counts and no rows.
Items without words match nothing, items that share an identifier count once (a
null one is called "null"). Rows are answered one by one, repeated ones too, and
columns other than doc_id and the text are ignored by the index.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Remembered, kept, lean, materialize, scope

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW, SEGMENT, GAP, BLOCK, ROWS = 13, 500_000, 256, 4 << 20, 1 << 16


class Terms(Remembered):
    """Word to 64-bit term number."""

    def compute(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


def terms_of(text: str | None, lookup: Terms) -> np.ndarray:
    words = WORD.findall(text.encode("utf-8", "replace").lower()) if text else []
    return np.fromiter(map(lookup.__getitem__, words), np.uint64, len(words))


def segment_of(ids: list, texts: list[np.ndarray]):
    """An index row without its name: (doc_ids, lengths, terms, counts, postings)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    bases = np.concatenate([[0], np.cumsum(lengths + GAP)[:-1]]).astype(np.int64)
    words = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    places = (np.arange(len(words)) + np.repeat(bases - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)).astype(np.uint32)
    order = np.argsort(words, kind="stable")
    words = words[order]
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([first, [len(words)]])).astype(np.uint32)
    # Differences within a list are small, so the table's compression bites.
    sorted_places = places[order]
    steps = np.diff(sorted_places, prepend=np.uint32(0)).astype(np.uint32)
    steps[first] = sorted_places[first]
    return ids, lengths.tolist(), words[first].tobytes(), counts.tobytes(), steps.tobytes()


SEGMENTS = T.StructType([T.StructField("segment", T.StringType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("postings", T.BinaryType())])
SEGMENT_KINDS = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]


def build_index(docs: DataFrame, text: str = "text", segment_words: int = SEGMENT) -> DataFrame:
    """The stored index of ``docs(doc_id, text)``."""

    def build(batches):
        from pyspark import TaskContext

        lookup, ids, texts, n, done = Terms(), [], [], 0, 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            column = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                ids.append(doc_id)
                texts.append(terms_of(column[i].as_py(), lookup))
                n += len(texts[-1]) + GAP
                if n >= segment_words:
                    yield row((f"{task}-{done}", *segment_of(ids, texts)))
                    ids, texts, n, done = [], [], 0, done + 1
        if ids:
            yield row((f"{task}-{done}", *segment_of(ids, texts)))

    def row(values):
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, SEGMENT_KINDS, strict=True)], SEGMENTS.names)

    return materialize(docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(lean(build), SEGMENTS), "positional-index")


class Segment:
    """A segment ready to search."""

    def __init__(self, values: dict):
        self.name, self.ids, self.lengths = values["segment"], values["doc_ids"], np.array(values["lengths"], np.int64)
        self.bases = np.concatenate([[0], np.cumsum(self.lengths + GAP)[:-1]]).astype(np.int64)
        self.terms, counts = np.frombuffer(values["terms"], np.uint64), np.frombuffer(values["counts"], np.uint32).astype(np.int64)
        self.ends = np.cumsum(counts)
        steps = np.frombuffer(values["postings"], np.uint32)
        run = np.cumsum(steps, dtype=np.int64)
        before = np.concatenate([[0], run[self.ends[:-1] - 1]]) if len(counts) else np.zeros(0, np.int64)
        self.places = run - np.repeat(before, counts)

    def lists(self, terms: np.ndarray):
        """First and last place in the postings of each term; empty for those it lacks."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        have = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        last = np.where(have, self.ends[at] if len(self.ends) else 0, 0)
        first = np.where(have & (at > 0), self.ends[np.maximum(at - 1, 0)] if len(self.ends) else 0, 0)
        return first, np.where(have, last, first)

    def starts(self, window: np.ndarray, first: np.ndarray, last: np.ndarray, order: np.ndarray, slop: int = 0) -> np.ndarray:
        """Where the window occurs; first, last: its terms' lists, order: by their length."""
        k = order[0]
        found = self.places[first[k] : last[k]] - k
        for k in order[1:]:
            own = self.places[first[k] : last[k]]
            if slop:
                found = found[np.searchsorted(own, found + k - slop) < np.searchsorted(own, found + k + slop, "right")]
            else:
                at = np.searchsorted(own, found + k)
                at[at == len(own)] = 0
                found = found[own[at] == found + k]
            if not len(found):
                break
        return found


class Windows:
    """A block of test items as windows over a shared list of terms."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        lookup = Terms()
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        seen: dict[tuple, set] = {}
        for name, text in items:
            words = tuple(terms_of(text, lookup).tolist())
            for i in range(max(1, len(words) - size + 1) if words else 0):
                seen.setdefault(words[i : i + size], set()).add(number[name])
        self.items = [sorted(x) for x in seen.values()]
        self.terms = np.unique(np.array([t for w in seen for t in w], np.uint64))
        self.windows = [np.searchsorted(self.terms, np.array(w, np.uint64)) for w in seen]
        #: The windows of each length as rows, and their numbers.
        lengths = np.array([len(w) for w in self.windows], np.int64)
        self.rows = [(own, np.stack([self.windows[n] for n in own])) for k in np.unique(lengths) for own in [np.flatnonzero(lengths == k)]]

    def possible(self, sizes: np.ndarray):
        """Numbers of the windows all of whose terms have postings, found by array operations over some rows at once."""
        for own, rows in self.rows:
            for low in range(0, len(own), ROWS):
                yield from own[low : low + ROWS][(sizes[rows[low : low + ROWS]] > 0).all(axis=1)].tolist()

    def search(self, segment: Segment, slop: int = 0):
        """(window number, starts) of those that occur."""
        if not len(segment.terms) or not len(self.terms):
            return
        first, last = segment.lists(self.terms)
        sizes = last - first
        for n in self.possible(sizes):
            w = self.windows[n]
            found = segment.starts(w, first[w], last[w], np.argsort(sizes[w], kind="stable"), slop)
            if len(found):
                yield n, found


def blocks(benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK):
    """The items in blocks of bounded size, never all of them at once."""
    held, size = [], 0
    for name, body in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col(text).cast("string")).distinct().toLocalIterator():
        held.append((name, body))
        size += len(body or "") + 16
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


HITS = T.StructType([T.StructField("segment", T.StringType()), T.StructField("place", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("runs", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])


def document_hits(index: DataFrame, items: list, size: int = WINDOW, then=None, schema=None) -> DataFrame:
    """A row per document: its words, the runs of hit words, the items that occur.

    ``then``, if given, makes batches of ``schema`` of these, in the same worker: two
    Python functions in a row would hold a second worker for each task.
    """
    shared = index.sparkSession.sparkContext.broadcast(Windows(items, size))

    def search(batches):
        windows = shared.value
        for batch in batches:
            for n in range(batch.num_rows):
                segment = Segment({c: batch.column(c)[n].as_py() for c in SEGMENTS.names})
                yield from rows(windows, segment)

    def rows(windows, segment):
        starts, lengths, met = [], [], {}
        for n, found in windows.search(segment):
            starts.append(found)
            lengths.append(np.full(len(found), len(windows.windows[n])))
            for doc in np.unique(np.searchsorted(segment.bases, found, "right") - 1).tolist():
                met.setdefault(doc, set()).update(windows.items[n])
        runs: dict[int, bytes] = {}
        if starts:
            at, end = np.concatenate(starts), np.concatenate(starts) + np.concatenate(lengths)
            order = np.argsort(at, kind="stable")
            at, end = at[order], np.maximum.accumulate(end[order])
            new = np.flatnonzero(np.concatenate([[True], at[1:] > end[:-1]]))
            at, end = at[new], end[np.concatenate([new[1:] - 1, [len(end) - 1]])]
            doc = np.searchsorted(segment.bases, at, "right") - 1
            pairs = np.stack([at - segment.bases[doc], end - segment.bases[doc]], 1).astype("<i8")
            cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            for d, part in zip(doc[cut].tolist(), np.split(pairs, cut[1:]), strict=True):
                runs[d] = part.tobytes()
        for low in range(0, len(segment.ids), 4096):
            own = range(low, min(low + 4096, len(segment.ids)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment.name] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array([segment.ids[i] for i in own], pa.int64()), pa.array(segment.lengths[own.start : own.stop], pa.int64()),
                 pa.array([runs.get(i, b"") for i in own], pa.binary()), pa.array([sorted(windows.names[k] for k in met.get(i, ())) for i in own], pa.list_(pa.string()))], HITS.names)

    return index.mapInArrow(lean(search), HITS) if then is None else index.mapInArrow(lean(lambda batches: then(search(batches))), schema)


def merged(runs: list[bytes]) -> np.ndarray:
    """Union of half-open runs, as (start, end) rows."""
    pairs = np.frombuffer(b"".join(runs), "<i8").reshape(-1, 2)
    if not len(pairs):
        return pairs
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    end = np.maximum.accumulate(pairs[:, 1])
    new = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > end[:-1]]))
    return np.stack([pairs[new, 0], end[np.concatenate([new[1:] - 1, [len(end) - 1]])]], 1)


CONTAMINATION = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, runs array<array<long>>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = 0.05, text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK) -> DataFrame:
    """A row per document of ``docs``: words, hit words, items, the runs of hit words, and the verdict.

    A document is contaminated if it has hit words and they make up at least
    ``share`` of its words.
    """
    with scope(docs.sparkSession):
        return kept(judged(build_index(docs, text), benchmark, share, size, block_bytes), "contamination")


def judged(index: DataFrame, benchmark: DataFrame, share: float, size: int, block_bytes: int) -> DataFrame:
    per_hundred_thousand = round(share * 100_000)

    def judge(batches, single=False):
        for batch in batches:
            out = []
            for doc_id, n, runs, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_words", "runs", "items")), strict=True):
                if single:
                    runs, items = [runs], [items]
                runs, names = merged(runs), sorted({x for own in items for x in own})
                hit = int((runs[:, 1] - runs[:, 0]).sum())
                out.append((doc_id, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and 100_000 * hit >= per_hundred_thousand * n, runs.tolist(), names))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), JUDGED, strict=True)], [c.split()[0] for c in CONTAMINATION.split(", ")])

    items = list(blocks(benchmark, block_bytes=block_bytes)) or [[]]
    if len(items) == 1:
        return document_hits(index, items[0], size, lambda batches: judge(batches, True), CONTAMINATION)
    # The blocks' answers for a document meet at its segment and its place there: a row a block.
    every = document_hits(index, items[0], size)
    for more in items[1:]:
        every = every.union(document_hits(index, more, size))
    hits = every.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("runs").alias("runs"), F.collect_list("items").alias("items")).drop("segment", "place")
    return hits.mapInArrow(lean(judge), CONTAMINATION)


JUDGED = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]


def matches(docs: DataFrame, benchmark: DataFrame, slop: int = 0, text: str = "text", size: int = WINDOW) -> DataFrame:
    """Every match: (doc_id, item_id, kind, start, length), places counted in words.

    ``slop`` 0 gives exact phrases. Else every term may lie up to ``slop`` words
    off its place relative to the first, and matches that are no exact phrase
    are of kind "proximity"; ``start`` is where the phrase would begin.
    """
    with scope(docs.sparkSession):
        index = build_index(docs, text)
        found = [search_block(index, items, slop, size) for items in blocks(benchmark)] or [search_block(index, [], slop, size)]
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        return kept(every, "matches")


def search_block(index: DataFrame, items: list, slop: int, size: int) -> DataFrame:
    if slop * 2 + size >= GAP:
        raise ValueError("slop and window must stay below the gap between documents")
    shared = index.sparkSession.sparkContext.broadcast(Windows(items, size))
    names = ["doc_id", "item_id", "kind", "start", "length"]

    def search(batches):
        windows = shared.value
        for batch in batches:
            for n in range(batch.num_rows):
                segment = Segment({c: batch.column(c)[n].as_py() for c in SEGMENTS.names})
                exact = dict(windows.search(segment))
                for w, starts in (windows.search(segment, slop) if slop else exact.items()):
                    doc = np.searchsorted(segment.bases, starts + len(windows.windows[w]) // 2, "right") - 1
                    phrase = np.isin(starts, exact.get(w, np.zeros(0)))
                    for i in windows.items[w]:
                        yield pa.RecordBatch.from_arrays([pa.array([segment.ids[d] for d in doc], pa.int64()), pa.array([windows.names[i]] * len(doc)), pa.array(["phrase" if p else "proximity" for p in phrase]), pa.array(starts - segment.bases[doc], pa.int64()), pa.array(np.full(len(doc), len(windows.windows[w])), pa.int64())], names)

    return index.mapInArrow(lean(search), "doc_id long, item_id string, kind string, start long, length long")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark).drop("runs", "items")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(2, len(w) - 11))) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM g
), x AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n
), m AS (SELECT x.doc_id, x.i, x.n, g.item_id FROM x JOIN g USING (n, s)
), h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM m), unnest(range(i, i + n)) AS u(p) GROUP BY doc_id
), t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
