import itertools
import random
import re

import numpy as np
import pytest

from tessera.llm import exact, lines, links, minhash


def union_find(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    got = {x: y for x, y in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union_find({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def numbers_within(near):
    """Blocks of ids compared as numbers."""

    def within(members):
        payload = members.select("id").distinct().selectExpr("id", "cast(cast(id as string) as binary) as payload")

        def found(payloads, wanted, here):
            ids = np.array([int(x) for x in payloads.to_pylist()])
            for a, b in wanted:
                own = near(ids[a], ids[b])
                own[own] = here(a[own], b[own])
                yield a[own], b[own]

        return links.compared(members, payload, found)

    return within


@pytest.mark.parametrize("members", [256, 7])
def test_linked_groups_lose_no_link(spark, monkeypatch, members):
    """Chains in one bucket: the hubs are near few, and every link must still be found."""
    monkeypatch.setattr(links, "MEMBERS", members)
    monkeypatch.setattr(links, "ROWS", 50)
    keys = [(i, 1) for i in range(40)] + [(i, 2) for i in range(30, 60)] + [(200 + i, 3) for i in range(6)] + [(99, 4), (100, 4), (98, 5)]
    near = lambda a, b: np.isin(np.abs(a - b), (1, 13))
    rows = {k: sorted(i for i, key in keys if key == k) for _, k in keys}
    keys = [(i, k) for i, k in keys if len(rows[k]) > 1]
    frame = spark.createDataFrame([(i, k, rows[k][0], len(rows[k])) for i, k in keys], links.SHARED)
    got = {x: y for x, y in links.linked_groups(frame, lambda p: p.where("abs(a - b) in (1, 13)"), numbers_within(near)).collect()}
    edges = [(a, b) for k in (1, 2, 3, 4) for a, b in itertools.combinations([i for i, key in keys if key == k], 2) if near(a, b)]
    assert got == union_find({x for e in edges for x in e}, edges)


def test_dealt_keys_come_back(spark):
    r = np.random.default_rng(1)
    keys = {i: np.unique(r.integers(-(1 << 63), 1 << 63, 20)) for i in range(-50, 50)}
    for i in range(0, 40, 4):
        keys[i] = np.append(keys[i], [keys[i + 1][0], keys[i + 1][3], keys[i + 2][1]])
    frame = spark.createDataFrame([(i, k.tolist()) for i, k in keys.items()], "id long, keys array<long>").repartition(3)
    got = links.shared_keys(links.deal(frame.union(frame))).collect()
    groups = {}
    for x in got:
        groups.setdefault(x["key"], set()).add(x["id"])
    assert len(got) == len({(x["id"], x["key"]) for x in got})
    # Two keys that the same ids share are one.
    assert sorted(map(sorted, groups.values())) == sorted([i, j] for i in range(0, 40, 4) for j in (i + 1, i + 2))
    assert links.shared_keys(links.deal(frame.limit(0))).count() == 0


def test_many_sets_at_once():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: r.integers(1, 400)], r.integers(0, 1 << 63, r.integers(0, 60)).astype(np.uint64)])) for _ in range(80)]
    groups = np.array([0, 50, 53, 54, 80])
    pairs = [(i, j) for low, high in itertools.pairwise(groups.tolist()) for i, j in itertools.combinations(range(low, high), 2)]
    assert sorted(p for a, b in links.pairs_of(groups) for p in zip(a.tolist(), b.tolist(), strict=True)) == pairs
    chosen = lambda: ((a[x], b[x]) for a, b in links.pairs_of(groups) for x in [(a + b) % 3 > 0])
    got = {p for a, b in minhash.links_of(minhash.pa.array([s.tobytes() for s in sets], minhash.pa.binary()), chosen(), lambda a, b: np.ones(len(a), bool)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i, j in pairs if (i + j) % 3 and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert got == want and len(want) > 50


def near_texts():
    r = random.Random(8)
    base = [" ".join(r.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(r.randrange(30)) for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(60):
        words = r.choice(base).split(" ")
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = f"new{r.randrange(5)}"
        rows.append((i, "  ".join(words).upper() if i % 7 == 0 else " ".join(words)))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "one two"), (104, "ONE  two"), (105, "one two three"), (None, rows[0][1]), (106, "w " * 30_000), (107, "w " * 20_000), (3, rows[3][1]), (108, "é à 中文 🙂 x y"), (109, "É à 中文 🙂 x y")]
    return rows


def test_minhash_against_brute_force(spark):
    rows = near_texts()
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, kept int, digest string").repartition(4)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows if i is not None}
    edges = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = union_find(sets, edges)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_signature_agreement_estimates_similarity():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 63, 4000).astype(np.uint64)
    b = np.concatenate([a[:3000], r.integers(0, 1 << 63, 1000).astype(np.uint64)])
    same = (minhash.signature(a, 512) == minhash.signature(b, 512)).mean()
    assert abs(same - 3000 / 5000) < 0.08


def test_doc_id_with_two_texts_is_one_node(spark):
    a, b = "p q r s t u v w", "a b c d e f g h"
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b)], "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {1}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_stream(spark, tmp_path, weak):
    rows = [(i, f"text {i % 17}", i) for i in range(200)] + [(None, "text 1", 0), (500, None, 0), (501, "", 0), (7, "text 7", 7), (7, "text 7", 7), (600, "x" * 200_000, 1), (601, "x" * 199_999 + "y", 1), (602, "text 1 ", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group_size int")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    digest = (lambda t: minhash.F.substring(minhash.F.sha2(t, 256), 1, 1)) if weak else exact.sha256
    out = exact.deduplicate(spark, str(tmp_path / "documents.parquet"), digest=digest).collect()
    assert len(out) == len(rows)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    import hashlib

    want = sorted((str(i), str(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in out) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in out)


def test_exact_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "d.parquet"))
    assert exact.deduplicate(spark, str(tmp_path / "d.parquet")).count() == 0


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_similar_lines(monkeypatch):
    r = random.Random(1)
    pairs = [("", ""), ("", "a"), ("a" * 30, "a" * 27), ("a" * 30, "a" * 26), ("x" * 700, "x" * 350 + "y" + "x" * 349), ("q" * 5000, "q" * 4500)]
    for _ in range(1500):
        a = "".join(r.choice("abc é") for _ in range(r.randrange(150)))
        b = list(a)
        for _ in range(r.randrange(20)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(2)] = r.choice(["", "a", "d"])
        pairs.append((a, "".join(b)[r.randrange(3) :]))
    want = [10 * distance(a, b) <= max(len(a), len(b)) for a, b in pairs]
    for cells in (lines.CELLS, 500):
        monkeypatch.setattr(lines, "CELLS", cells)
        x, y = (lines.Texts(list(t), mark) for t, mark in zip(zip(*pairs, strict=True), (0xFFFFFFFF, 0xFFFFFFFE), strict=True))
        assert lines.alike(x, y, np.arange(len(pairs)), np.arange(len(pairs))).tolist() == want
    assert 300 < sum(want) < 1200
    both = lines.Texts([t for p in pairs for t in p])
    rows = np.arange(len(pairs))
    assert lines.alike(both, both.other(), 2 * rows, 2 * rows + 1).tolist() == want
    assert (both.profiles() == lines.unpacked([lines.profile(t) for p in pairs for t in p])).all()


def test_edits_are_counted_up_to_a_bound():
    r = random.Random(2)
    a, b = (["".join(r.choice("ab") for _ in range(r.randrange(30))) for _ in range(600)] for _ in range(2))
    x, y = lines.Texts(a, 0xFFFFFFFF), lines.Texts(b, 0xFFFFFFFE)
    most = np.array([r.choice([0, 1, 3, 8, 40]) for _ in a])
    assert lines.within_edits(x, y, np.arange(600), np.arange(600), most).tolist() == [distance(*ab) <= k for *ab, k in zip(a, b, most, strict=True)]


def normal(line):
    return " ".join(x.translate(str.maketrans("123456789", "000000000")) for x in re.findall(r"[0-9a-z\x80-\U0010ffff]+", line.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))))


def test_lines_against_brute_force(spark):
    r = random.Random(5)
    pool = [" ".join(r.choice("red green blue white black pink gold grey cyan lime".split()) + r.choice("abcdef") for _ in range(80)) for _ in range(8)]
    rows = []
    for i in range(30):
        own = [r.choice(pool) for _ in range(3)]
        own = [x.replace("red", "rod", 1) if r.random() < 0.4 else x for x in own]
        own = [x.upper() + "!" if r.random() < 0.2 else x for x in own]
        rows.append((i, "\n".join([*own, "ok", f"only here in document number {i} of them {'x' * i}"])))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, pool[0]), (None, pool[1]), (103, pool[0])]
    docs = spark.createDataFrame([(i, t, 9, "q") for i, t in rows], "doc_id long, text string, n_removed int, line string").repartition(3)
    out = lines.deduplicated(docs)
    assert out.columns == ["doc_id", "text", "line", "n_removed"]
    got = sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in out.collect())
    places = {}
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            n = normal(x)
            if len(n.split(" ")) >= lines.MIN_WORDS:
                places.setdefault(n, set()).add(((0, 0) if i is None else (1, i), k))
    names = sorted(places)
    forms = lines.analysed([n.encode() for n in names])
    assert [forms.normal(i).decode() for i in range(len(names))] == names
    edges = [(a, b) for a, b in itertools.combinations(names, 2) if 10 * distance(a, b) <= max(len(a), len(b))]
    group = union_find(names, edges)
    assert len(edges) > 3
    first = {}
    for n in names:
        first[group[n]] = min(first.get(group[n], min(places[n])), min(places[n]))
    want = []
    for i, t in rows:
        if t is None:
            want.append((str(i), None, 0))
            continue
        own, left = t.split("\n"), []
        for k, x in enumerate(own):
            n = normal(x)
            if n not in places or first[group[n]] == ((0, 0) if i is None else (1, i), k):
                left.append(x)
        want.append((str(i), "\n".join(left), len(own) - len(left)))
    assert got == sorted(want, key=lambda w: (w[0], str(w[1]))) or sorted(map(str, got)) == sorted(map(str, want))
    assert lines.deduplicated(docs.limit(0)).count() == 0


def test_long_lines_vote_in_pieces():
    texts = [" ".join(f"w{'x' * (i % 7)}{'ab'[i % 2]}{chr(97 + i % 26)}" for i in range(700)), "x " * 300 + "y " * 10, "a b c d e"]
    x = lines.analysed([t.encode() for t in texts])
    assert x.words.tolist() == [700, 310, 5]
    at = 0
    for n, row in zip(x.words, lines.simhashes(x.hashes, x.words), strict=True):
        bits = np.unpackbits(np.ascontiguousarray(lines.votes(x.hashes[at : at + n]).T), axis=1).sum(axis=0)
        assert (np.packbits(2 * bits > n) == row).all()
        at += n


def test_lines_are_cut_where_they_end():
    texts = ["", "A b, C-d 17 e\n\nshort\nf g h i j", "\n", "é à ü ö ä\n", "one two three four"]
    x = lines.analysed([t.encode() for t in texts])
    got = [(int(o), int(n), x.normal(i).decode()) for i, (o, n) in enumerate(zip(x.owner, x.number, strict=True))]
    assert got == [(1, 0, "a b c d 00 e"), (1, 3, "f g h i j"), (3, 0, "é à ü ö ä")]
    again = lines.analysed([b"zzz a b\n" * 500, b"F g! h  i j"])
    assert again.id[-1] == x.id[1]
