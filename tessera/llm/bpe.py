"""BPE encoding by forced-boundary splitting, and decoding.

A pair of bytes that stands inside no token of the vocabulary can never be
merged across, so between two such bytes every encoding has a boundary: a
certain cut. A table of 256 x 256 pairs finds all cuts of a text at once; the
fragments between them are encoded by themselves, by the tokenizer, and their
ids are concatenated. Most fragments are single words that come again and again,
so a worker remembers the ids of short ones (a bounded number).

What a fragment's ids could still depend on is how the tokenizer divides a text
before it merges, which looks at the character after white space and takes an
apostrophe with what follows. So no cut is taken behind white space, beside an
apostrophe or inside a character; and since the strings of special tokens are
tokens too, none is taken inside them. At any other certain cut a division
either ends anyway, or runs through it in a stretch of one kind of characters,
whose two parts are then divided and merged like the whole.

Texts are read in blocks, so beside the text and its ids a task holds the cuts
of one block. Null text counts as empty and gives no ids; null ids decode to the
empty string. Bytes that are no UTF-8 count as U+FFFD. Rows are taken one by
one, repeated ones too; an empty table gives no rows; other columns are kept,
but for those named like a new one.
"""

from __future__ import annotations

import re
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Remembered, extended, lean
from .sst import byte_letters

BLOCK, BATCH_BYTES = 1 << 20, 4 << 20
#: White space of one byte, and of more.
SPACE = b"\t\n\x0b\x0c\r "
LONG_SPACE = ("\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
#: Fragments that are one word to any tokenizer of this kind: letters in every version of Unicode.
ONE_WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03b1-\u03c9\u0400-\u0481]+")
LONG_ENDS = np.isin(np.arange(256), [c.encode()[-1] for c in LONG_SPACE])


def token_bytes(tokenizer) -> dict[int, bytes]:
    """What each id stands for: letters of byte-level BPE are bytes, special tokens are text."""
    back = {chr(c): b for b, c in byte_letters().items()}
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    return {i: special[i].encode() if i in special else bytes(map(back.__getitem__, t)) for t, i in tokenizer.get_vocab().items()}


def certain_cuts(tokens) -> np.ndarray:
    """By ``first * 256 + second``: whether a text may be cut between two bytes."""
    cut = np.ones((256, 256), bool)
    for token in tokens:
        whole = np.frombuffer(token, np.uint8)
        cut[whole[:-1], whole[1:]] = False
    cut[:, 0x80:0xC0] = False  # inside a character
    cut[list(SPACE)] = False
    cut[ord("'")] = cut[:, ord("'")] = False
    return cut.ravel()


def after_long_space(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Which cuts stand behind a white space character of two or three bytes."""
    found = np.zeros(len(cuts), bool)
    for c in LONG_SPACE:
        own = c.encode()
        same = cuts >= len(own)
        for back, byte in enumerate(reversed(own), 1):
            same &= data[np.maximum(cuts - back, 0)] == byte
        found |= same
    return found


class Fragments(Remembered):
    """Packed ids of a fragment."""

    def __init__(self, tokenizer):
        super().__init__(300_000)
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.letters = byte_letters()
        self.tokens = token_bytes(tokenizer)
        self.cut = certain_cuts(self.tokens.values())
        #: The tokens' bytes end to end, and by id where they begin and how many they are.
        self.laid = np.frombuffer(b"".join(self.tokens.values()), np.uint8)
        self.places, at = np.zeros((max(self.tokens, default=0) + 1, 2), np.int64), 0
        for i, token in self.tokens.items():
            self.places[i], at = (at, len(token)), at + len(token)
        shape = tokenizer.pre_tokenizer
        if tokenizer.normalizer is not None or type(shape).__name__ != "ByteLevel" or shape.add_prefix_space:
            raise ValueError("certain cuts are known for byte-level tokenizers without a normaliser or a prefix")

    def compute(self, fragment: bytes) -> bytes:
        text = fragment.decode("utf-8", "replace")
        if ONE_WORD.fullmatch(text):  # only to be merged
            ids = [t.id for t in self.model.tokenize(fragment.decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("i", ids).tobytes()

    def cuts(self, data: bytes):
        """The places of the cuts, block by block."""
        whole = np.frombuffer(data, np.uint8)
        for low in range(0, len(whole) - 1, BLOCK):
            part = whole[low : low + BLOCK + 1].astype(np.uint16)
            found = np.flatnonzero(self.cut[part[:-1] << 8 | part[1:]]) + low + 1
            doubtful = np.flatnonzero(LONG_ENDS[whole[found - 1]])
            if len(doubtful):
                found = np.delete(found, doubtful[after_long_space(whole, found[doubtful])])
            yield found.tolist()

    def encode(self, data: bytes) -> bytes:
        out, start = [], 0
        for ends in self.cuts(data):
            if ends:
                out += map(self.__getitem__, [data[i:j] for i, j in zip([start, *ends[:-1]], ends, strict=True)])
                start = ends[-1]
        if start < len(data):
            out.append(self[data[start:]])
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The bytes of the tokens, laid end to end a stretch of ids at a time."""
        out = []
        for low in range(0, len(ids), BLOCK >> 2):
            first, size = self.places[ids[low : low + (BLOCK >> 2)]].T
            ends = np.cumsum(size)
            out.append(self.laid[np.arange(ends[-1]) + np.repeat(first - ends + size, size)].tobytes())
        return b"".join(out).decode("utf-8", "replace")


#: A worker keeps the tokenizer of its last task and what it remembers.
_LAST: dict[int, Fragments] = {}


def fragments_of(model: bytes) -> Fragments:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if (name := hash(model)) not in _LAST:
        tokenizer = Tokenizer.from_buffer(model)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LAST.clear()
        _LAST[name] = Fragments(tokenizer)
    return _LAST[name]


def changed(df: DataFrame, tokenizer: str, source: str, gives: T.StructField, kind: pa.DataType, keep: bool, convert) -> DataFrame:
    """``df`` with a column made of ``source`` by a worker's ``Fragments``, a batch of bounded bytes at a time."""
    shared = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    others = [c for c in df.columns if c.lower() != gives.name.lower() and (keep or c.lower() != source.lower())]
    schema = extended(df.select(*others), gives)
    work = df.select(*others, F.col(source).alias("_source"))

    def run(batches):
        own = fragments_of(shared.value)
        for batch in batches:
            column, low, out, size = batch.column(len(others)), 0, [], 0
            for i in range(batch.num_rows):
                value, weight = convert(own, column[i])
                out.append(value)
                size += weight
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(low, len(out)) for k in range(len(others))), pack(out)], schema.names)
                    low, out, size = i + 1, [], 0

    def pack(out):
        if pa.types.is_list(kind):
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(out), "<i4")))
        return pa.array(out, kind)

    return work.mapInArrow(lean(run), schema)


def encode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids array<int>`` in the place of the text, as the tokenizer gives them without special tokens."""

    def convert(own, value):
        data = value.as_py()
        ids = own.encode(data) if data else b""
        return ids, len(ids)

    source = docs.withColumn(text, F.col(text).cast("string").cast("binary"))
    return changed(source, tokenizer, text, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), pa.list_(pa.int32()), False, convert)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids, special tokens as they are written."""

    def convert(own, value):
        out = own.decode(value.values.to_numpy()) if value.is_valid else ""
        return out, len(out)

    return changed(encoded, tokenizer, ids, T.StructField(into, T.StringType()), pa.string(), True, convert)


def op13_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    import public_tokenizers

    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    read = decode(encode(docs, tokenizer), tokenizer)
    return read.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
