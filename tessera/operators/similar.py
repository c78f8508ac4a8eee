"""Exact joins of bit words by Hamming distance, and of sequences of them.

A sequence is an array of words of 32 bits. Two words of at most r different
bits share a half with at most r / 2 of them, and two halves of at most q
different bits meet if the one is changed in at most p and the other in at most
q - p places. So words are joined on equality of (half, changed half), never all
with all, and the bits are counted where they meet.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import hamming_similarity
from ..session import settled

WORD, HALF = 32, 16
#: Rows of lookup tables that are broadcast; larger ones are shuffled.
LOOKUP = 200_000


def changes(most: int) -> list[int]:
    """The masks of at most ``most`` of a half's bits."""
    return [sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(HALF), n)]


def halves(word: Column, most: int) -> Column:
    """The keys of a word: which half, and the half changed in at most ``most`` places."""
    masks = F.array(*(F.lit(m) for m in changes(most)))

    def keys(which: int) -> Column:
        half = F.shiftright(word.cast("long"), HALF * which).bitwiseAND((1 << HALF) - 1).cast("int")
        return F.transform(masks, lambda m: half.bitwiseXOR(m) + F.lit(which << HALF))

    return F.concat(keys(0), keys(1))


def radii(bits: int) -> tuple[int, int]:
    """Places in which the halves of either side are changed, so that words of at most ``bits`` different bits meet."""
    within = bits // 2
    return within - within // 2, within // 2


def different(a: Column, b: Column) -> Column:
    return F.bit_count(a.cast("long").bitwiseXOR(b.cast("long")))


def cheapest_radii(bits: int, a: int, b: int) -> tuple[int, int]:
    """Like ``radii``, for sides of ``a`` and ``b`` words: the split with the fewest keys, so the small side is changed more."""
    within = bits // 2
    return min(((within - r, r) for r in range(within + 1)), key=lambda s: a * len(changes(s[0])) + b * len(changes(s[1])))


def small(df: DataFrame) -> DataFrame:
    """A settled table, to be broadcast if it has at most ``LOOKUP`` rows."""
    return F.broadcast(df) if df.count() <= LOOKUP else df


def near_words(a: DataFrame, b: DataFrame, bits: int) -> DataFrame:
    """(a, b): the words of two settled one-column frames of distinct words with at most ``bits`` different bits."""
    left, right = cheapest_radii(bits, a.count(), b.count())
    x = a.toDF("a").select("a", F.explode(halves(F.col("a"), left)).alias("key"))
    y = b.toDF("b").select("b", F.explode(halves(F.col("b"), right)).alias("key"))
    return x.join(y, "key").where(different(F.col("a"), F.col("b")) <= bits).select("a", "b").distinct()


def classes(df: DataFrame, keep: list[str], words: str, record: str) -> tuple[DataFrame, DataFrame]:
    """Equal sequences as one class (``keep``, words, name), and its members (name, record)."""
    rows = df.where(F.size(words) > 0).select(*keep, F.col(words).alias("words"), F.col(record).alias("record"))
    name = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in keep), F.array_join(F.col("words").cast("array<string>"), ",")), 256)
    rows = settled(rows.withColumn("name", name))
    return settled(rows.groupBy("name").agg(*(F.first(c).alias(c) for c in (*keep, "words")))), rows.select("name", "record")


def prefix_pairs(df: DataFrame, family: str, subtype: str, words: str, record: str, similarity: float, ratio: float) -> DataFrame:
    """(family, a, b, sim) of records of one family and subtypes a < b that agree over their common prefix.

    ``sim`` is the share of equal bits, at least ``similarity``; the shorter
    sequence has at least ``ratio`` of the longer one's words. Some word of the
    prefix then has no more different bits than the average allows, so pairs
    meet at (family, place, length class, half): lengths of one class are within
    a factor of two, and a row is dealt to its own class and those that ``ratio`` reaches.
    Equal sequences are one class, expanded at the end. The work of a place is
    quadratic in the sequences whose words agree there, but not otherwise.
    """
    if not 0 < ratio <= 1:
        raise ValueError("the ratio of lengths lies in (0, 1]")
    bits = int((1 - similarity) * WORD + 1e-9)
    left, right = radii(bits)
    one, members = classes(df, [family, subtype], words, record)
    reach = 0
    while 2**-reach > ratio:
        reach += 1
    size = F.size("words")
    class_ = F.floor(F.log2(size.cast("double"))).cast("int")
    rows = one.select("name", F.col(family).alias("family"), F.col(subtype).alias("subtype"), size.alias("n"), class_.alias("class"), F.posexplode("words").alias("place", "word"))
    near = F.explode(F.sequence(F.col("class") - reach, F.col("class") + reach))
    a = rows.select("*", F.explode(halves(F.col("word"), left)).alias("key")).withColumn("class", near)
    b = rows.select("*", F.explode(halves(F.col("word"), right)).alias("key"))
    b = b.withColumnsRenamed({c: f"{c}_b" for c in ("name", "subtype", "n", "word")})
    least = F.least("n", "n_b") / F.greatest("n", "n_b")
    met = a.join(b, ["family", "place", "class", "key"]).where((F.col("subtype") < F.col("subtype_b")) & (least >= ratio) & (different(F.col("word"), F.col("word_b")) <= bits))
    pairs = met.select("name", "name_b").distinct()
    held = one.select("name", "words")
    found = pairs.join(held, "name").join(held.withColumnsRenamed({"name": "name_b", "words": "words_b"}), "name_b").withColumn("sim", hamming_similarity(F.col("words"), F.col("words_b"))).where(F.col("sim") >= similarity)
    found = found.join(one.select("name", F.col(family).alias("family")), "name").select("family", "name", "name_b", "sim")
    return found.join(members.withColumnRenamed("record", "a"), "name").join(members.withColumnsRenamed({"name": "name_b", "record": "b"}), "name_b").select("family", "a", "b", "sim")


def contained_pairs(short: DataFrame, long: DataFrame, similarity: float, ratio: float = 0.0, near: int = 5, hits: int = 3) -> DataFrame:
    """(group, short, long, sim): how well a sequence is contained anywhere in one that is not shorter, where at least ``similarity``.

    ``short(group, tag, short, words)`` and ``long(group, tag, long, words)``: a
    pair lies in one group, has different tags, and the shorter side at least
    ``ratio`` of the longer one's words. Of n words at most D = (1 - similarity) * 32 * n bits may differ,
    so at most D / (``near`` + 1) words are further than ``near`` bits: of that
    many words and ``hits`` more, the short side's rarest, ``hits`` are near in
    place. Such words vote for their diagonal (pair, offset), and diagonals with
    enough votes are counted in full. Sequences without words are in no pair.
    """
    far_bits = (1 - similarity) * WORD
    if far_bits >= near + 1:
        raise ValueError("near must allow for the bits that may differ in an average word")
    n = F.col("n")
    docs = long.where(F.size("words") > 0).select("group", F.col("tag").alias("long_tag"), "long", "words", F.size("words").alias("m"))
    # Only sequences that some other one can hold, or be held by, are cut into words.
    longest = settled(docs.groupBy("group").agg(F.max("m").alias("longest")))
    items = short.where(F.size("words") > 0).select("group", "tag", "short", "words", F.size("words").alias("n"))
    items = settled(items.join(small(longest), "group").where("n <= longest").drop("longest"))
    shortest = settled(items.groupBy("group").agg(F.min("n").alias("shortest")))
    docs = docs.join(small(shortest), "group").where("m >= shortest").drop("shortest")
    placed = docs.select("group", "long_tag", "long", "m", F.posexplode("words").alias("pos", "w"))
    known = settled(placed.groupBy("w").agg(F.count(F.lit(1)).alias("df")))
    far = F.floor(F.floor(F.lit(far_bits) * n + 1e-9) / (near + 1))
    words = items.select("group", "tag", "short", "n", F.posexplode("words").alias("at", "iw")).join(known.select(F.col("w").alias("iw"), "df"), "iw", "left")
    ranked = words.withColumn("k", F.row_number().over(Window.partitionBy("group", "short").orderBy(F.coalesce("df", F.lit(0)), "at")))
    anchors = settled(ranked.withColumn("hits", F.least(F.lit(hits), n - far)).where(F.col("k") <= far + F.col("hits")).select("group", "tag", "short", "n", "at", "iw", "hits"))
    alike = settled(near_words(known.select("w"), settled(anchors.select("iw").distinct()), near).toDF("w", "iw").join(anchors, "iw").drop("iw"))
    met = placed.join(small(alike.hint("shuffle_hash")), ["group", "w"]).withColumn("offset", F.col("pos") - F.col("at")).where("tag <> long_tag and offset >= 0 and offset + n <= m").where(n >= F.lit(float(ratio)) * F.col("m"))
    votes = settled(met.groupBy("group", "long", "short", "offset").agg(F.count(F.lit(1)).alias("found"), F.first("hits").alias("hits")).where("found >= hits"))
    full = docs.select("group", "long", F.col("words").alias("body")).join(small(votes), ["group", "long"]).join(items.drop("tag"), ["group", "short"])
    sims = full.select("group", "short", "long", hamming_similarity(F.slice("body", F.col("offset") + 1, n), F.col("words")).alias("sim"))
    return sims.where(F.col("sim") >= similarity).groupBy("group", "short", "long").agg(F.max("sim").alias("sim"))
