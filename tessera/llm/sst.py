"""Token ids in sorted-string-table shards.

Documents, keyed by identifier, lie in ascending order over shard files; each
file can answer a point lookup by itself:

    block*  index  bloom  footer

* block: entries ``varint shared, varint own, key suffix, varint n, ids`` with
  keys prefix-compressed against the entry before; a block closes at
  ``block_bytes`` and starts with a whole key;
* index (sparse): for each block its last key, offset and length;
* bloom: 10 bits a key, 7 probes by double hashing;
* footer: shard number, id width, documents, ids, places of index and bloom,
  crc32 of both, magic.

A key is one byte for null (0) or not (1), then the identifier as 8 big-endian
bytes with the sign bit flipped, so bytes sort as the identifiers do. Ids are
little-endian, two bytes wide where the vocabulary allows it, else four.

Blocks are rows of one column and Spark's text writer puts them into files (the
separator after each row is the byte 0x0A that the offsets allow for). So any
store Spark can write holds the shards, a lost executor's task is run again, and
only committed files appear. Files are read back by the ``binaryFile`` source.

Null text counts as empty. Rows with a null identifier come first; rows that
share an identifier follow each other in the order of their texts, and a lookup
returns all of them. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import zlib
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WRITING, Remembered, kept, lean, scope, scratch, settings

MAGIC = b"TSRASST1"
FOOTER = struct.Struct("<IIQQQQQQI8s")
BLOCK_BYTES, SHARD_BYTES = 1 << 16, 24 << 20
#: White space for Python, but not for the tokenizer: such texts are encoded whole.
ODD = "\x1c\x1d\x1e\x1f"
#: Fixed value: how byte-level BPE cuts a text before it merges.
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts of ASCII and Latin letters, where the faster ``re`` has equal classes and cuts alike.
LATIN = re.compile("[\t-\r -~À-ÖØ-öø-ɏ]*")
#: Classes are spelled as ranges, which ``re`` looks up; differences of classes take twice the time.
LETTER, WHITE = "A-Za-zÀ-ÖØ-öø-ɏ", r" \t-\r"
LATIN_CUT = re.compile(rf" ?[{LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^{WHITE}0-9{LETTER}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def byte_letters() -> dict[int, int]:
    """Byte-level BPE writes each byte as a letter: printable ones as they are, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


class Units(Remembered):
    """Ids of a cut as packed bytes."""

    def __init__(self, tokenizer, code: str):
        super().__init__(300_000)
        self.tokenizer, self.code, self.model, self.letters = tokenizer, code, tokenizer.model, byte_letters()
        self.kind = {"<u2": "H", "<u4": "I"}[code]
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        shape = json.loads(tokenizer.to_str())
        before = shape.get("pre_tokenizer") or {}
        #: Whether texts can be cut and merged here; else they are encoded whole.
        self.by_cut = sys.byteorder == "little" and shape.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.code).tobytes()

    def compute(self, cut: str) -> bytes:
        return array(self.kind, [t.id for t in self.model.tokenize(cut.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_cut or any(s in text for s in self.special):
            return self.whole(text)
        if any(c in text for c in ODD):
            return self.whole(text)
        cut = LATIN_CUT if text.isascii() or LATIN.fullmatch(text) else CUT
        return b"".join(map(self.__getitem__, cut.findall(text)))


#: A worker keeps the encoder of its last task and what it remembers (at most some 110 MB), as most cuts come again.
_LAST: dict[str | int, Units] = {}


def units_of(model: bytes | str) -> Units:
    """An encoder from the tokenizer's file: its path, or its bytes for executors that need not see it."""
    name = model if isinstance(model, str) else zlib.crc32(model)
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = read_units(model)
    return _LAST[name]


def read_units(model: bytes | str) -> Units:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(model) if isinstance(model, bytes) else Tokenizer.from_file(model)
    return Units(tokenizer, "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def probes(key: bytes, bits: int):
    h1, h2 = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(h1 + i * h2) % bits for i in range(7)]


class ShardWriter:
    """Turns (key, packed ids) in key order into the chunks of one shard."""

    def __init__(self, shard: int, width: int, block_bytes: int = BLOCK_BYTES):
        self.shard, self.width, self.block_bytes = shard, width, block_bytes
        self.offset, self.docs, self.ids = 0, 0, 0
        self.block, self.last, self.index, self.keys = bytearray(), b"", [], []

    def add(self, key: bytes, ids: bytes):
        shared = 0
        if self.block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + key[shared:] + varint(len(ids) // self.width) + ids
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(ids) // self.width
        if len(self.block) >= self.block_bytes:
            yield self.close_block()

    def close_block(self) -> bytes:
        chunk = bytes(self.block)
        self.index.append(struct.pack("<B", len(self.last)) + self.last + struct.pack("<QI", self.offset, len(chunk)))
        self.block = bytearray()
        self.offset += len(chunk) + 1
        return chunk

    def finish(self):
        if self.block:
            yield self.close_block()
        bits = max(64, 10 * len(self.keys))
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for k in self.keys:
            for p in probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        tail = index + bloom.tobytes()
        yield tail + FOOTER.pack(self.shard, self.width, self.docs, self.ids, self.offset, len(index), bits, len(bloom), zlib.crc32(tail), MAGIC)


class Shard:
    """One shard file's content: iterate it, or look a document up."""

    def __init__(self, data: bytes):
        end = len(data) - 1 if data[-1:] == b"\n" and data[-9:-1] == MAGIC else len(data)
        self.data = data
        self.number, self.width, self.docs, self.ids, at, size, self.bits, bloom, crc, magic = FOOTER.unpack_from(data, end - FOOTER.size)
        tail = data[at : at + size + bloom]
        if magic != MAGIC or zlib.crc32(tail) != crc:
            raise ValueError("not a whole shard")
        self.bloom = tail[size:]
        self.blocks, i = [], 0
        while i < size:
            n = tail[i]
            self.blocks.append((tail[i + 1 : i + 1 + n], *struct.unpack_from("<QI", tail, i + 1 + n)))
            i += 1 + n + 12

    def entries(self, block: int):
        _, at, size = self.blocks[block]
        end, key = at + size, b""
        while at < end:
            shared, at = read_varint(self.data, at)
            own, at = read_varint(self.data, at)
            key = key[:shared] + self.data[at : at + own]
            n, at = read_varint(self.data, at + own)
            yield key, self.data[at : at + n * self.width]
            at += n * self.width

    def __iter__(self):
        for i in range(len(self.blocks)):
            yield from self.entries(i)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this identifier: Bloom filter, index, then its blocks."""
        key = key_of(doc_id)
        if not self.docs or any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, self.bits)):
            return []
        low, high = 0, len(self.blocks)
        while low < high:  # the first block whose last key reaches ours
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.blocks[mid][0] < key else (low, mid)
        found = []
        for i in range(low, len(self.blocks)):
            for k, ids in self.entries(i):
                if k == key:
                    found.append(np.frombuffer(ids, f"<u{self.width}").astype(np.uint32))
            if self.blocks[i][0] > key:
                break
        return found


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, shard_bytes: int = SHARD_BYTES, text: str = "text") -> None:
    """Encode ``docs`` into shards of about ``shard_bytes`` of text at ``path``."""
    from pyspark import TaskContext

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shared = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    rows = rows.repartitionByRange(max(1, -(-total // shard_bytes)), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def encode(batches):
        units, writer = units_of(shared.value), None
        for batch in batches:
            if writer is None:
                width = int(units.code[-1])
                writer = ShardWriter(TaskContext.get().partitionId(), width)
                end = b"" if end_id is None else np.array([end_id], units.code).tobytes()
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, doc_id in enumerate(ids):
                for chunk in writer.add(key_of(doc_id), units.encode(texts[i].as_py()) + end):
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.binary())], ["chunk"])
        if writer is not None and writer.docs:
            for chunk in writer.finish():
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.binary())], ["chunk"])

    # The cast relabels the bytes; the writer copies them as they are.
    with settings(docs.sparkSession, WRITING):
        rows.mapInArrow(lean(encode), "chunk binary").select(F.col("chunk").cast("string").alias("value")).write.text(path, lineSep="\n")


COLUMNS = {"shard": ("int", pa.int32()), "doc_id": ("long", pa.int64()), "start": ("long", pa.int64()), "n_tokens": ("long", pa.int64()), "ids_crc32": ("long", pa.int64()), "ids": ("binary", pa.binary())}


def read_shards(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(shard, doc_id, start in the shard, n_tokens, ids_crc32, ids) of every document in shards.

    Ids are 32-bit numbers; ``ids=False`` leaves them out.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    names = [c for c in COLUMNS if ids or c != "ids"]

    def parse(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                yield from rows(Shard(batch.column(0)[n].as_py()))

    def rows(shard):
        start, out, size = 0, [], 0
        for key, packed in shard:
            wide = np.frombuffer(packed, f"<u{shard.width}").astype("<u4").tobytes()
            out.append((shard.number, id_of(key), start, len(wide) // 4, zlib.crc32(wide), wide if ids else None))
            start, size = start + len(wide) // 4, size + len(wide) * ids
            if len(out) == 512 or size >= 4 << 20:
                yield table_of(out)
                out, size = [], 0
        if out:
            yield table_of(out)

    def table_of(out):
        each = dict(zip(COLUMNS, zip(*out, strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(each[c], COLUMNS[c][1]) for c in names], names)

    return files.mapInArrow(lean(parse), ", ".join(f"{c} {COLUMNS[c][0]}" for c in names))


def with_starts(read: DataFrame) -> DataFrame:
    """Turn starts within shards into starts in the whole order, by the shards' totals."""
    totals = read.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row a shard
    before = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return read.join(before, "shard").withColumn("start", F.col("start") + F.col("before")).drop("before", "shard")


def op5_sst(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shards."""
    import public_tokenizers

    with scope(spark):
        path = scratch(spark, "sst")
        write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
        read = kept(read_shards(spark, path, ids=False), "sst-read")
    return with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")
