"""Joins of bit words by Hamming distance against all pairs."""

import random

import pytest

from tessera.operators import dedup, similar


def sim(a, b):
    n = min(len(a), len(b))
    return 1 - sum((x ^ y).bit_count() for x, y in zip(a[:n], b[:n], strict=True)) / (32 * n) if n else 0.0


def contained(a, b):
    short, long = sorted((a, b), key=len)
    return max(sim(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1)) if short else 0.0


def turned(rng, words, bits):
    out = list(words)
    for place in rng.sample(range(32 * len(words)), bits):
        out[place // 32] ^= 1 << place % 32
    return out


@pytest.fixture(scope="module")
def prints():
    """Records of two families and three subtypes, of several lengths, with near ones planted about the thresholds."""
    rng, rows = random.Random(8), []
    for base in range(24):
        words = [rng.getrandbits(32) for _ in range(rng.choice([1, 2, 3, 7, 16, 33]))]
        family = "x" if base % 3 else "y"
        rows.append((f"r{base}", family, "s0", words))
        allowed = int(0.15 * 32 * len(words))
        for n, bits in enumerate((0, allowed // 2, allowed, allowed + 1)):
            rows.append((f"r{base}n{n}", family, f"s{1 + n % 2}", turned(rng, words, bits)))
        rows.append((f"r{base}t", family, "s1", turned(rng, words, allowed // 3) + [rng.getrandbits(32) for _ in range(len(words))]))  # a common prefix
        rows.append((f"r{base}m", family, "s2", [rng.getrandbits(32) for _ in range(len(words) // 2)] + turned(rng, words, int(0.1 * 32 * len(words)) - base % 2)))  # inside, elsewhere
    words = [0] * 5  # equal ones, and one word that many share
    rows += [(f"same{i}", "x", f"s{i % 3}", words) for i in range(12)] + [(f"part{i}", "x", f"s{i % 3}", [0, *(rng.getrandbits(32) for _ in range(4))]) for i in range(20)]
    return [*rows, ("none", "x", "s0", []), ("null", "x", "s1", None), ("lost", None, "s0", [1])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "record_id string, family string, subtype string, fp array<bigint>")


def test_candidates_are_those_of_all_pairs(spark, prints):
    want = {}
    for i, (a, f, s, x) in enumerate(prints):
        for b, g, t, y in prints[i + 1 :]:
            if f and f == g and s != t and x and y and min(len(x), len(y)) / max(len(x), len(y)) >= 0.5:
                h = sim(x, y)
                if h >= 0.85:
                    want[min(a, b), max(a, b)] = (round(h, 9), None)
                elif (c := contained(x, y)) >= 0.90:
                    want[min(a, b), max(a, b)] = (round(h, 9), round(c, 9))
    got = dedup.fingerprint_candidates(frame(spark, prints), "family", "subtype", "fp").collect()
    assert len(got) == len(want)
    assert {(r.a, r.b): (round(r.hamming_sim, 9), r.containment_sim and round(r.containment_sim, 9)) for r in got} == want
    assert sum(c is None for _, c in want.values()) > 60 and sum(c is not None for _, c in want.values()) > 10


@pytest.mark.parametrize("bits", [0, 1, 3, 4, 5, 8])
def test_near_words(spark, bits):
    rng = random.Random(bits)
    words = [rng.getrandbits(32) for _ in range(30)]
    others = [turned(rng, [w], k)[0] for w in words for k in (0, bits // 2, bits, bits + 1)]
    got = {tuple(r) for r in similar.near_words(spark.createDataFrame([(w,) for w in set(words)], "w long"), spark.createDataFrame([(w,) for w in set(others)], "w long"), bits).collect()}
    assert got == {(a, b) for a in words for b in others if (a ^ b).bit_count() <= bits}


@pytest.mark.parametrize(("similarity", "ratio"), [(0.70, 0.25), (0.95, 1.0)])
def test_other_thresholds(spark, prints, similarity, ratio):
    rows = prints[:80]
    want = {tuple(sorted((a, b))) for i, (a, f, s, x) in enumerate(rows) for b, g, t, y in rows[i + 1 :] if f == g and s != t and min(len(x), len(y)) / max(len(x), len(y)) >= ratio and sim(x, y) >= similarity}
    got = [tuple(sorted((r.a, r.b))) for r in similar.prefix_pairs(frame(spark, rows), "family", "subtype", "fp", "record_id", similarity, ratio).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_join_on_the_family_alone(spark, prints):
    plan = similar.prefix_pairs(frame(spark, prints), "family", "subtype", "fp", "record_id", 0.85, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join " in line]
    assert joins and not any("Cross" in j or "place" not in j and "family" in j.split("Inner")[-1] for j in joins)


def test_empty(spark):
    assert dedup.fingerprint_candidates(frame(spark, []), "family", "subtype", "fp").collect() == []
    with pytest.raises(ValueError):
        similar.contained_pairs(frame(spark, []), frame(spark, []), 0.5)


def test_small_sides_are_changed_in_more_places():
    assert similar.cheapest_radii(5, 1000, 1000) == (1, 1) == similar.radii(5)
    assert similar.cheapest_radii(5, 1_000_000, 1000) == (0, 2) and similar.cheapest_radii(5, 1000, 1_000_000) == (2, 0)


def test_only_sequences_that_fit_are_cut_into_words(spark, monkeypatch):
    """A sequence longer than all that could hold it is neither ranked nor searched."""
    rng, rows, settled = random.Random(3), [], similar.settled

    def counted(df):
        out = settled(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(similar, "settled", counted)
    held = [rng.getrandbits(32) for _ in range(4)]
    short = [(0, "a", f"s{i}", [rng.getrandbits(32) for _ in range(200)]) for i in range(40)] + [(0, "a", "in", held)]
    long = [(0, "b", "l0", [7, *held, 9]), (0, "b", "l1", [1, 2, 3])]
    frames = [spark.createDataFrame(x, f"group int, tag string, {name} string, words array<bigint>") for x, name in ((short, "short"), (long, "long"))]
    got = similar.contained_pairs(*frames, 0.9).collect()
    assert [tuple(r) for r in got] == [(0, "in", "l0", 1.0)]
    assert max(rows) <= 10
