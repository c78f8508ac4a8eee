import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, toxicity
from tessera.llm.common import Remembered, crc_mod

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        words = [r.choice(WORDS) for _ in range(r.randrange(20, 60))]
        bad, toxic = i % 5 == 0, i % 4 == 0
        if bad:
            words = [w + " |" for w in words]
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["scum", "moron"]))
        docs.append((i, " ".join(words[:10]) + ". " + " ".join(words[10:]) + ".", "en", 0.25))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(None, "alpha beta", "x", 0.0), (1000, None, "x", 0.0), (1001, "", None, 0.0), (1002, "theta " * 60_000, "x", 0.0), (3, docs[3][1], "en", 0.25)]
    labels += [(None, 1, 0), (1, None, None), (7, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(out, labels, column):
    rows = out.where("held_out").join(labels.dropDuplicates(["doc_id"]), "doc_id").where(f"{column} is not null").select("predicted", column).collect()
    return np.mean([a == b for a, b in rows])


def test_quality_held_out(spark, corpus):
    docs, labels = corpus
    out = quality.classify(docs, labels, usable=crc_mod("doc_id", 5) != 0, held_out=crc_mod("doc_id", 5) == 0).cache()
    assert out.count() == docs.count()
    assert out.columns == ["doc_id", "text", "lang", "held_out", "score", "predicted"]
    low, high = out.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1
    assert accuracy(out, labels, "quality") > 0.9
    again = quality.classify(docs.repartition(7), labels, usable=crc_mod("doc_id", 5) != 0, held_out=crc_mod("doc_id", 5) == 0)
    key = lambda df: sorted((str(a), round(b, 9)) for a, b in df.select("doc_id", "score").collect())
    assert key(out) == key(again)


def test_context_sums_by_hand():
    places, signs = quality.index_vectors(64, 8)
    total, counts = np.zeros((64, 8), np.int64), np.zeros(64, np.int64)
    texts = ["a b c a", "", None, "b ! b"]
    quality.context_sums(texts, total, counts, places, signs)
    want, bucket = np.zeros((64, 8), np.int64), quality.Buckets(64)
    for t in texts:
        ids = [bucket[x.encode()] for x in (t or "").split()]
        for i, a in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if i != j:
                    np.add.at(want[a], places[ids[j]], signs[ids[j]])
    assert (total == want).all()
    assert counts.sum() == 7


def test_pooled_long_text_in_pieces():
    table = quality.damped(np.random.default_rng(0).normal(size=(32, 4)), np.ones(32))
    texts = ["x y z " * 30_000, "", "x", None, "z z"]
    whole = quality.pooled(texts, table)
    bucket = quality.Buckets(32)
    for t, row in zip(texts, whole, strict=True):
        v = np.array([table[bucket[w.encode()]] for w in (t or "").split()]).reshape(-1, 4)
        mean = v.mean(0) if len(v) else np.zeros(4)
        assert np.allclose(row[:4], mean, atol=1e-3)
        assert np.allclose(row[4:], v.std(0) if len(v) else 0, atol=2e-2)


def test_no_labels_and_one_class(spark, corpus):
    docs, labels = corpus
    for some in (labels.limit(0), labels.where("quality = 1")):
        scores = {r[0] for r in quality.classify(docs.limit(5), some).select("score").collect()}
        assert len(scores) == 1
    assert quality.classify(docs.limit(0), labels).count() == 0
    model = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert {r[0] for r in toxicity.score(docs.where("doc_id > 999 and doc_id < 1002"), model).select("score").collect()} == {0.0}


def test_toxicity_held_out_and_places(spark, corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels, crc_mod("doc_id", 3) != 1)
    out = toxicity.score(docs, model, crc_mod("doc_id", 3) == 1).cache()
    assert out.count() == docs.count()
    assert accuracy(out, labels, "toxic") > 0.97
    for text, places in out.where("size(offending) > 0").select("text", "offending").collect():
        assert any(w in text[p["start"] : p["end"]] for p in places for w in ("scum", "moron"))
    assert [r[0] for r in out.where("doc_id in (1000, 1001)").select("score").collect()] == [0.0, 0.0]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_noisy_or_is_one_minus_the_product():
    m = toxicity.NoisyOr(buckets=1 << 10)
    m.fitted, m.bias = True, -2.0
    m.weights[:] = np.random.default_rng(1).normal(size=1 << 10)
    texts = ["a b. c d! e", "", None, "...", "a\nb\nc", "one"]
    lookup = toxicity.Parts(1 << 10)
    for t, got in zip(texts, m.score(texts), strict=True):
        keep = 1.0
        for s in toxicity.re.split(r"[.!?\n]", t or ""):
            ids = toxicity.parts(s, lookup)
            if len(ids):
                keep *= 1 - 1 / (1 + np.exp(-(m.bias + m.weights[ids].sum())))
        assert got == pytest.approx(1 - keep, abs=1e-6)


def test_remembered_is_bounded():
    class Square(Remembered):
        def compute(self, key):
            return key * key

    s = Square(10)
    assert [s[i % 37] for i in range(500)] == [(i % 37) ** 2 for i in range(500)]
    assert len(s) <= 10 and len(s.old) <= 10
