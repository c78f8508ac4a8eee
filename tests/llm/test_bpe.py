"""Forced-boundary BPE against the tokenizers library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Characters at the edges of the rules: white space of every kind, apostrophes, marks, scripts, control strings.
EDGES = [*map(chr, range(0x500)), *"  \n\t'''sdtmrevl" * 20, *bpe.LONG_SPACE * 5, *"漢字かなΩж😀é’“…" * 5, *["<|endoftext|>", "<|end"] * 4, *["́"] * 9, *"\x1c\x1d\x1e\x1f" * 4, *map(chr, range(0x1FF0, 0x2070))]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own(library):
    return bpe.Fragments(library)


def ids_of(own, text):
    return np.frombuffer(own.encode(text.encode()), "<i4").tolist()


def test_random_texts_of_edges(library, own):
    rng = random.Random(13)
    for _ in range(4000):
        text = "".join(rng.choices(EDGES, k=rng.randint(0, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert ids_of(own, text) == ids, ascii(text)
        assert own.decode(np.array(ids, int)) == library.decode(ids, skip_special_tokens=False)


def test_no_token_spans_a_certain_cut(own):
    for token in own.tokens.values():
        assert not any(own.cut[a << 8 | b] for a, b in zip(token, token[1:]))
    assert own.cut.sum() > 20_000


@pytest.mark.parametrize("text", ["a" * 50_000, "я" * 5000, "漢字" * 3000, " " * 5000 + "x", "x" + "\n" * 4000, "word " * 300_000])
def test_long_texts_and_block_edges(library, own, text):
    assert ids_of(own, text) == library.encode(text, add_special_tokens=False).ids


def test_decoding_replaces_what_is_no_character(library, own):
    broken = [i for i, t in own.tokens.items() if t in (b"\xe2", b"\xf0", b"\xc3", b"\xa9")]
    for ids in ([broken[0]], broken, broken[::-1], broken * 3):
        assert own.decode(np.array(ids, int)) == library.decode(ids, skip_special_tokens=False)


def test_frames(spark, library):
    rows = [(1, "It's a test.  Yes", "x", 9), (1, "It's a test.  Yes", "x", 9), (2, None, None, None), (None, "", "y", 1), (3, "é" * 3000, "z", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n int")
    out = bpe.encode(df, PATH)
    assert out.columns == ["doc_id", "n", "ids"]
    got = bpe.decode(out, PATH).collect()
    assert sorted((r.doc_id or 0, list(r.ids), r.decoded) for r in got) == sorted((i or 0, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, _, _ in rows)
    assert bpe.decode(bpe.encode(df.limit(0), PATH), PATH).collect() == []
    assert [r.decoded for r in bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), PATH).collect()] == [""]


def test_the_query_is_the_library(spark, library):
    where = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op13_bpe(spark, where).collect()}
    want = {}
    for r in spark.read.parquet(f"{where}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert got == want
