"""The prefix trie against a plain trie of whole turns."""

import hashlib
import math
import random
import zlib

import pytest

from tessera.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def plain(convs: dict[int, list[tuple[str, str]]]):
    """Every node by its whole path of turns."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) for p in below)
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(path))))
        out.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    return out


def rows_of(convs):
    return [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]


def result(spark, convs, most):
    nodes, members = trie.prefix_trie(trie.sequences(spark.createDataFrame(rows_of(convs), "conv_id long, turn int, role string, text string")), most)
    sums = {r.ends_first: r.ends_sha256 for r in trie.joined_digests(members).collect()}
    return sorted((tuple(r[c] for c in COLUMNS) + (sums.get(r.ends_first) if r.ends_n > 1 else hashlib.sha256(str(r.ends_first if r.ends_n else "").encode()).hexdigest(),) for r in nodes.collect()), key=str)


@pytest.mark.parametrize("most", [3, 12, 100_000])
def test_equal_to_a_plain_trie(spark, most):
    rng = random.Random(most)
    convs = {}
    for c in range(1, 90):  # long shared starts, copies, prefixes of others, single ones
        start = [("user", "hello"), ("assistant", "é" * 3), ("user", ""), ("assistant", "go on")][: rng.choice([1, 2, 4, 4])]
        convs[c * 7] = start + [(rng.choice(["user", "assistant"]), rng.choice("abc")) for _ in range(rng.randrange(0, 6))]
    convs[1000] = [("user", str(i)) for i in range(60)]
    convs[1001] = convs[1000][:50] + [("user", "other")]
    convs[1002] = convs[1000]
    assert result(spark, convs, most) == plain({c: t for c, t in convs.items() if t})


def test_shared_starts(spark):
    rng = random.Random(4)
    convs = {c: [("user", f"{c // 3 if rng.random() < 0.5 else 'x'} {i}") for i in range(rng.randrange(1, 10))] for c in [*range(-9, 40), 101, 10**12 + 3] if c % 11}
    seqs = trie.with_shared_starts(trie.sequences(spark.createDataFrame(rows_of(convs), "conv_id long, turn int, role string, text string")))
    want = {c: sum(len(t.encode()) for _, t in turns) for c, turns in rebuilt(convs).items()}
    assert {r.conv_id: sum(r.sizes) for r in seqs.collect()} == want


def test_the_query_equals_a_plain_trie(spark):
    where = "/root/testdata/sf0.001"
    convs = {}
    for r in sorted(spark.read.parquet(f"{where}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn is not None, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    got = sorted((tuple(r[c] for c in COLUMNS) + (r.ends_sha256,) for r in trie.op11_trie(spark, where).collect()), key=str)
    assert got == plain(rebuilt(convs))


def test_edges(spark):
    schema = "conv_id long, turn int, role string, text string, ids int"
    assert trie.prefix_trie(trie.sequences(spark.createDataFrame([], schema)))[0].collect() == []
    rows = [(1, None, None, None, 5), (1, 0, "user", "b", 5), (1, 0, "user", "b", 5), (2, None, "", "", 5), (None, 0, "user", "lost", 5), (3, 1, "user", "x" * 100_000, None)]
    nodes = {(r.conv_id, r.depth): r for r in trie.prefix_trie(trie.sequences(spark.createDataFrame(rows, schema)), 2)[0].collect()}
    assert sorted(nodes) == [(1, 0), (1, 1), (1, 2), (1, 3), (3, 1)]
    assert (nodes[1, 1].n_convs, nodes[1, 1].ends_first, nodes[1, 0].n_leaves, nodes[1, 0].n_children) == (2, 2, 2, 2)
    turnless = trie.prefix_trie(spark.createDataFrame([(4, "", []), (9, "", [])], "conv_id long, ids string, sizes array<long>"))
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves, r.ends_n) for r in turnless[0].collect()] == [(4, 0, 2, 1, 2)]


def test_a_hot_first_turn_is_repartitioned(spark):
    convs = {c: [("system", "same"), ("user", str(c % 40)), ("assistant", str(c))] for c in range(400)}
    seqs = trie.sequences(spark.createDataFrame(rows_of(convs), "conv_id long, turn int, role string, text string"))
    distinct = seqs.groupBy("ids", "sizes").agg({"conv_id": "min", "*": "count"}).toDF("ids", "sizes", "first", "n")
    with trie.scope(spark):
        dealt, tops = trie.parts(distinct, 50)
        sizes = [r["sum(left)"] for part in dealt for r in part.selectExpr("key", "size(sizes) - at + 1 AS left").groupBy("key").sum("left").collect()]
    assert len(tops) == 2 and sum(sizes) == 800 and max(sizes) <= 50
