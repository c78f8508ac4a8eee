"""containment_pairs over small tables made here."""

import random
import re
import zlib

import numpy as np
import pytest

from tessera.plans import queries as q


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root, r = str(tmp_path_factory.mktemp("containment")), random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, some(r.choice([1, 5, 12, 20, 33, 40]))) for i in range(14)]
    docs = []
    for i in range(60):
        body, held = some(r.randrange(5, 90)), list(r.choice(items)[1])
        for k in r.sample(range(len(held)), min(len(held) - 1, i % 7)):
            held[k] = "changed"
        if i % 5 == 4 and len(held) > 2:
            held[len(held) // 2 - 1] = "middle"
        docs.append((i, " ".join(body[:i] + held + body[i:]) if i % 3 else " ".join(held[: max(1, len(held) * 2 // 3)])))
    docs += [(100, None), (101, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 4)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, docs, items


def test_documents_of_any_label_are_searched(spark, tables):
    root, docs, items = tables
    got = {x["doc_id"] for x in q.containment_pairs(spark, root).collect()}
    whole = {d for d, t in docs for _, w in items if len(w) >= 5 and f" {' '.join(w)} " in f" {t} "}
    assert len(whole) > 2 and whole <= got


def test_all_pairs_at_the_threshold(spark, tables):
    root, docs, items = tables
    fp = lambda t: np.array([zlib.crc32(w.encode()) for w in re.split(r"\s+", (t or "").lower())], np.uint32)
    want = {}
    for d, t in docs:
        for i, w in items:
            short, long = sorted((fp(t), fp(" ".join(w))), key=len)
            best = 1 - np.bitwise_count(np.lib.stride_tricks.sliding_window_view(long, len(short)) ^ short).sum(axis=1).min() / (32 * len(short))
            if best >= 0.90:
                want[d, i] = round(float(best), 5)
    got = {(x["doc_id"], x["item_id"]): round(float(x["containment_sim"]), 5) for x in q.containment_pairs(spark, root).collect()}
    assert got == want
    assert any(v < 1 for v in want.values()) and any(len(fp(dict(docs)[d])) < len(dict(items)[i]) for d, i in want)
