import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import chat, decontam, pieces, secrets, sst

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "  a  b ", "tab\tnew\n\nline ", "don't we'll  x", "é🙂 中文 ", "a\x1cb \x1f c", "<|endoftext|> in text", "x" * 5000, "the " * 20_000, "\r\n  z", "1234 5,6"]


def test_units_equal_the_tokenizer():
    tokenizer, units = Tokenizer.from_file(BPE), sst.units_of(BPE)
    r = random.Random(0)
    texts = [t for t in ODD if t] + ["".join(r.choice("ab 'st\n\t.é9 ") for _ in range(r.randrange(1, 60))) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(units.encode(t), units.code).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_shards(spark, tmp_path):
    rows = [(i * 3 - 20, t) for i, t in enumerate(ODD)] + [(None, "first"), (5000, "same"), (5000, "id"), (-(1 << 63), "least"), ((1 << 63) - 1, "most")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    path = f"file://{tmp_path}/shards"
    sst.write_shards(docs, path, BPE, shard_bytes=40_000)
    out = sst.with_starts(sst.read_shards(spark, path)).collect()
    tokenizer, start, want = Tokenizer.from_file(BPE), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in out), key=lambda r: r[1]) == want
    shards = [sst.Shard(f.read_bytes()) for f in (tmp_path / "shards").glob("part-*") if f.stat().st_size]
    assert len(shards) > 1
    found = [ids for s in shards for ids in s.lookup(5000)]
    assert sorted(tokenizer.decode(x[:-1].tolist()) for x in found) == ["id", "same"]
    assert [len(s.lookup(4999)) for s in shards] == [0] * len(shards)
    assert sum(len(s.lookup(None)) for s in shards) == 1
    with pytest.raises(ValueError):
        sst.Shard((tmp_path / "shards" / sorted(f.name for f in (tmp_path / "shards").glob("part-*") if f.stat().st_size)[0]).read_bytes()[:-5] + b"12345")


def test_shards_empty(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    sst.write_shards(spark.createDataFrame([], "doc_id long, text string"), path, BPE)
    assert sst.with_starts(sst.read_shards(spark, path)).count() == 0


def test_blocks_compress_keys_and_are_found():
    w = sst.ShardWriter(3, 2, block_bytes=200)
    data = b"".join(c + b"\n" for i in range(0, 1000, 2) for c in w.add(sst.key_of(i), np.arange(i % 5, dtype="<u2").tobytes())) + b"".join(c + b"\n" for c in w.finish())
    s = sst.Shard(data)
    assert s.docs == 500 and len(s.blocks) > 10
    assert [sst.id_of(k) for k, _ in s] == list(range(0, 1000, 2))
    assert all([x.tolist() for x in s.lookup(i)] == [list(range(i % 5))] for i in range(0, 1000, 2))
    assert not any(s.lookup(i) for i in range(1, 1000, 2))


def brute_pieces(m, t):
    s, own = pieces.SPACE + t.replace(" ", pieces.SPACE), {i + 1 for i, c in enumerate(t) if c == pieces.SPACE}
    best, back, raw = [0.0] + [-1e18] * len(s), [0] * (len(s) + 1), [False] * (len(s) + 1)
    for i in range(1, len(s) + 1):
        for j in range(max(0, i - m.longest), i):
            hit = m.ids.get(s[j:i])
            if hit and not own.intersection(range(j, i)) and best[j] + hit[0] > best[i]:
                best[i], back[i] = best[j] + hit[0], j
        if best[i] == -1e18:
            best[i], back[i], raw[i] = best[i - 1] + m.penalty, i - 1, True
    out, i = [], len(s)
    while i:
        j = back[i]
        out = ([m.bytes[b] for b in s[j:i].encode()] if raw[i] else [m.ids[s[j:i]][1]]) + out
        i = j
    return out


def test_viterbi(spark):
    e = pieces.encoder_of(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(2)
    texts = ["a", " ", "  a  b ", "▁x ▁", "日本語 🙂\n\tq", "a" * 300, "the" * 100 + " " + "in" * 90, "achlichkeit" * 40]
    texts += ["".join(r.choice("abeinrst  ▁é🙂\n中") for _ in range(r.randrange(1, 150))) for _ in range(100)]
    for t in texts:
        ids = np.frombuffer(e.encode(t), np.uint32).tolist()
        assert ids == brute_pieces(e.model, t) and e.decode(ids) == t
    given = list(e.stream(pieces.SPACE + "in" * 2000))  # a character at a time
    assert len(given) > 100 and [x for ids in given for x in ids] == brute_pieces(e.model, "in" * 2000)
    docs = spark.createDataFrame([(1, "Hello world", "x"), (1, "Hello world", "x"), (None, None, None), (2, "", "")], "doc_id long, text string, ids string")
    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "ids_crc32", "exact"]
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["exact"]) for r in out.collect()) == [("1", 2, True), ("1", 2, True), ("2", 0, True), ("None", 0, True)]
    assert pieces.encode(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def brute_chat(rows, budget=1024, history=2, history_tokens=256):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        h, loss = hashlib.sha256(), ""
        for _, _, role, text in own:
            h.update(f"{role}\n{text}\n".encode())
            loss += text if role == "assistant" else ""
        out[conv] = (len(own), h.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat(spark):
    r = random.Random(6)
    words = ["</s>", "[INST]", "\\", "<|end|>", "<|", "ok", "\n", "é🙂", "<<SYS>>", "word " * 30]
    rows = []
    for c in range(6):
        if c % 2:
            rows.append((c, 0, "system", "be kind <s>"))
        rows += [(c, t, r.choice(["user", "assistant", "assistant", None, "to|ol<"]), r.choice([None, " ".join(r.choice(words) for _ in range(r.randrange(40)))])) for t in range(1, r.randrange(3, 40))]
    rows += [(None, 1, "user", "null conversation"), (None, None, "assistant", "a"), (9, 5, "assistant", "tie"), (9, 5, "assistant", "tie"), (10, 0, "system", "alone"), (11, 3, "assistant", "x" * 50_000), (11, 4, "assistant", "y" * 10)]
    rows += [(12, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(1500)]
    turns = spark.createDataFrame([(*x, "c") for x in rows], "conv_id long, turn long, role string, text string, key string").repartition(4)
    shown = chat.windows(turns)
    got = {x["conv_id"]: (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) for x in chat.digests(chat.read_back(shown)).collect()}
    assert got == brute_chat(rows)
    for x in shown.where("conv_id = 12").collect():
        bodies = re.findall(r"<\|start\|>.*?<\|text\|>(.*?)<\|end\|>", x["formatted"], re.S)
        assert sum(-(-len(b.encode()) // 4) + 4 for b in bodies) <= 1024
        assert x["n_repeated"] == (0 if x["w"] == 0 else 2)
    for x in shown.where("conv_id in (1, 3, 5)").collect():
        assert x["formatted"].startswith("<|start|>system<|text|>be kind <\\s><|end|>")
    assert chat.digests(chat.read_back(chat.windows(turns.limit(0)))).count() == 0


def brute_spans(text):
    kinds = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    out = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m)]
    return ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(out))


def test_secrets(spark):
    r = random.Random(9)
    bits = ["password", "Api_Key", "APIKEY", "secret", "toKen", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123456789", "deadbeef" * 3, "abcdefg", "é🙂", "\n", "x", "tok", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 25))) for _ in range(300)]
    texts += [None, "", "secret: token:abcdef", "token=token=abcdefgh", "password=ſecret", "toKen=abcdefgh", "AKIAAKIA" + "A" * 30, "0" * 100_000, "token = 'abc123456' " * 500]
    docs = spark.createDataFrame([(i % 250 or None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, found int").repartition(3)
    out = secrets.scan(docs)
    base = out.select("text", secrets.named(F.filter("found", lambda s: s["rank"] < 3)).alias("s")).collect()
    assert len(base) == len(texts)
    assert all(s == brute_spans(t) for t, s in base)
    extra = out.where(F.contains("text", F.lit("PRIVATE KEY"))).select(secrets.named(F.col("found")).alias("s")).collect()
    assert extra and all("pem:" in x["s"] for x in extra)
    assert secrets.scan(docs.limit(0)).count() == 0
    assert secrets.scan(docs, secrets.BASE[2:]).count() == len(texts)


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]{24,}") == []
    assert secrets.trigram_query(r"abcd|xyz") == [[frozenset({"abc", "bcd"}), frozenset({"xyz"})]]
    assert secrets.trigram_query(r"ab?cd") == [[frozenset({"abc", "bcd"}), frozenset({"acd"})]]
    assert secrets.trigram_query(r"a.*") == []


def brute_contamination(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for name, text in items:
            q = words(text)
            for k in range(max(1, len(q) - 12) if q else 0):
                win = q[k : k + 13]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        names.add("null" if name is None else str(name))
        out.append((str(i), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination(spark, block_bytes):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 8, 13, 20, 30])))) for i in range(12)] + [(50, None), (51, "!!"), (3, "w1 w2 w1"), (None, "w5 w6 w7 w8")]
    docs = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randrange(0, 120))]
        if r.random() < 0.6:
            words[10:10] = (r.choice(items)[1] or "").split() if r.random() < 0.9 and items[i % 12][1] else []
        docs.append((i, "-".join(words).upper() if i % 9 == 0 else " ".join(words)))
    docs += [(None, "w5 w6 w7 w8"), (61, None), (62, ""), (1, docs[1][1]), (63, items[0][1] + " x" * 30_000), (64, "W5, w6; w7 (w8)")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_hit int").repartition(3)
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    out = decontam.contamination(frame, bench, block_bytes=block_bytes).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out)
    assert got == brute_contamination(docs, items)
    assert decontam.contamination(frame.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in decontam.contamination(frame, bench.limit(0)).collect()} == {0}


def test_matches_by_place_and_proximity(spark):
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, "a b z c d"), (3, "d c b a"), (4, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d")], "item_id long, text string")
    assert [tuple(r) for r in decontam.matches(docs, bench).collect()] == [(1, "7", "phrase", 1, 4)]
    near = {(r["doc_id"], r["kind"]) for r in decontam.matches(docs, bench, slop=1).collect()}
    assert near == {(1, "phrase"), (2, "proximity")}


def test_chat_after_a_long_system_turn(spark):
    """A system turn over the budget does not make a window of every turn."""
    rows = [(1, 0, "system", "s" * 8000)] + [(1, t, "assistant" if t % 2 == 0 else "user", f"turn {t}") for t in range(1, 101)]
    rows += [(2, 0, "system", "s" * 3000)] + [(2, t, "user", "u" * 60) for t in range(1, 60)]
    shown = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {x["conv_id"]: (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) for x in chat.digests(chat.read_back(shown)).collect()}
    assert got == brute_chat(rows)
    size = lambda text: -(-len(text.encode()) // 4) + 4
    total = {c: sum(size(t) for i, n, r, t in rows if i == c and n) for c in (1, 2)}
    for x in shown.collect():
        bodies = re.findall(r"<\|start\|>.*?<\|text\|>(.*?)<\|end\|>", x["formatted"], re.S)
        assert bodies[0] == "s" * len(bodies[0]) and sum(map(size, bodies[1:])) <= 1024
    for c in (1, 2):
        assert shown.where(f"conv_id = {c}").count() <= total[c] / (1024 / chat.FLOOR) + 1


def test_only_candidates_are_shuffled(spark):
    """Without automatic broadcasts too, texts that no indexed rule asks for pass no exchange."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(i, "plain text " + "0a" * (i % 30)) for i in range(50)] + [(99, "token=abcdefgh")], "doc_id long, text string")
        out = secrets.scan(docs)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        union = plan[plan.index("Union") :]
        branches = union.split("\n:- " if "\n:- " in union else "\n+- ")
        assert any("Join LeftOuter, " in b and "strategy=broadcast" in b for b in branches)
        assert out.count() == 51 and out.where("size(found) > 0").count() == 50 - sum(i % 30 < 12 for i in range(50)) + 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_latin_texts_are_cut_by_ranges():
    """The cuts of the tokenizer's own expression, in less time than by differences of classes."""
    import random
    import re
    import time

    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice("ab'sZéßÿɏ×÷ \t\r\n\x0b09_-.\x01\x7f") for _ in range(r.randrange(0, 20)))
        assert sst.LATIN_CUT.findall(text) == sst.CUT.findall(text) or not (text.isascii() or sst.LATIN.fullmatch(text))
    differences = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    text = " ".join("".join(r.choice("abcdefghijklé") for _ in range(r.randrange(2, 12))) for _ in range(60_000))

    def least(cut):
        out = []
        for _ in range(5):
            began = time.process_time()
            cut.findall(text)
            out.append(time.process_time() - began)
        return min(out)

    assert least(sst.LATIN_CUT) < 0.8 * least(differences)


def test_one_worker_searches_and_judges(spark):
    """Benchmark items of one block are searched and judged in one Python worker a task; of several blocks with the same verdicts."""
    docs = spark.createDataFrame([(i, f"w{i} " + " ".join(f"x{j}" for j in range(20 * (i % 3)))) for i in range(9)] + [(9, None), (None, "x1")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", " ".join(f"x{j}" for j in range(13))), ("b", " ".join(f"x{j}" for j in range(20, 34))), ("c", "w4")], "item_id string, text string")
    with decontam.scope(spark):
        index = decontam.build_index(docs)
        one = decontam.judged(index, bench, 0.05, decontam.WINDOW, decontam.BLOCK)
        assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        several = decontam.judged(index, bench, 0.05, decontam.WINDOW, 40)
        assert several._jdf.queryExecution().executedPlan().toString().count("MapInArrow") > 1
        key = lambda df: sorted(map(str, df.collect()))
        assert key(one) == key(several) and one.where("contaminated").count() == 6


def test_remembered_stretches_are_small():
    """Stretches of plain text are remembered with a byte a character, and give what a search of the whole text gives."""
    encoder = pieces.encoder_of(public_tokenizers.path("piece_bpe_32k.model"))
    for t in ("a few  plain words, and spaces   ", " ", "  x", "tab\tand\nline", "naïve Ωmega 日本 🙂", "same same same", "under ▁ score"):
        whole = pieces.SPACE + t.replace(" ", pieces.SPACE)
        assert pieces.SPACE in t or encoder.encode(t) == encoder.searched(whole)
        assert encoder.decode(np.frombuffer(encoder.encode(t), np.int32).tolist()) == t
    assert len(encoder) > 10 and "  plain" in encoder and all(k.isascii() for k in encoder if k.strip().isascii())
    assert pieces.SPACE not in "".join(encoder)
