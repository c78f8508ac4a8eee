"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import pytest

from tessera.llm import ranked

WORDS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORDS.findall(text or "")]


def plain(docs, items, k):
    counts = [(i, Counter(words(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    own = {}
    for name, text in items:
        own.setdefault(name, set()).update(words(text))
    out = []
    for name, terms in own.items():
        scores = []
        for i, c in counts:
            m = 100 - 50 + 50 * c.total() * n_docs // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s:
                scores.append((-s, i is not None, i or 0, i))
        out += [(name, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def result(spark, docs, items, k, shard):
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, rank string").repartition(3)
    q = spark.createDataFrame(items, "item_id string, text string")
    return sorted((tuple(r) for r in ranked.top_documents(d, q, k, shard_words=shard).collect()), key=str)


@pytest.mark.parametrize("shard", [1, 150, 1_000_000])
def test_equal_to_all_scores(spark, shard):
    rng = random.Random(shard)
    vocabulary = [f"W{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["Éa", "漢字", "É"]
    docs = [(i * 3 - 40, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 40, 400])))) for i in range(120)]
    docs += [(None, "W1 W2"), (None, "W1 W2"), (7, None), (8, ""), (9, ".,;"), *[(1000 + i, "W3 same copy") for i in range(60)], (5000, "w3 SAME, copy!")]
    items = [(f"q{i}", " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 30])))) for i in range(12)] + [("copies", "w3 same copy"), ("twice", "w1"), ("twice", "W2 w2"), (None, "w5"), ("none", "absent"), ("empty", ""), ("null", None)]
    for k in (1, 7, 50):
        assert result(spark, docs, items, k, shard) == plain(docs, items, k)


def test_long_text_in_blocks(spark, monkeypatch):
    text = " ".join(f"t{i % 977}" for i in range(5000)) + " Ω" * 50
    monkeypatch.setattr(ranked, "TEXT_BLOCK", 100)
    assert [w.decode() for own in ranked.word_blocks(text) for w in own] == words(text)
    assert list(ranked.word_blocks(None)) == []


def test_empty_tables(spark):
    assert result(spark, [], [("a", "x")], 5, 100) == []
    assert result(spark, [(1, "x")], [], 5, 100) == []
    assert result(spark, [(1, "..."), (2, None)], [("a", "x")], 5, 100) == []


def test_pruning_leaves_most_nodes_closed():
    """Short of the k best, subtrees stay closed: a rare term among common ones."""
    import numpy as np

    rng = np.random.default_rng(5)
    numbers = ranked.Numbers()
    texts = [np.array([numbers[b"common"]] * 3 + [numbers[b"rare"]] * (i % 512 == 7) + [numbers[b"w%d" % x] for x in rng.integers(0, 50, 20)], np.int32) for i in range(4096)]
    batch = ranked.shard_of(list(range(4096)), texts, numbers, 4096, sum(map(len, texts)))
    tree, opened = ranked.Tree(batch.to_pylist()[0]), []
    plain_open = tree.opened
    tree.opened = lambda level, *rest: opened.append(len(level)) or plain_open(level, *rest)
    first, last = ranked.lists_of(ranked.pa.array([b"common", b"rare"]), batch.column(1)[0].values, batch.column(2)[0].as_py())
    best = ranked.Best(4)
    tree.search(first, last, np.array([1, 6000]), best)
    assert [i % 512 for i in best.ids] == [7] * 4 and sum(opened) < 1000
