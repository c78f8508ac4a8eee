"""Secret scans over a trigram inverted index, on DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams that
every match must contain: literals are followed through sequences, alternatives
and optional parts; what cannot be followed asks nothing. The index holds the
postings (trigram, doc_id) of the trigrams that any rule asks for, over
lower-cased whole texts. A rule's candidates are the intersection of its
conjuncts, each a union over alternatives of intersected postings; only they are
verified by the expression itself, on the text as it is. A rule whose
expression has no mandatory trigram scans every text.

Spans count code points, end exclusive, and are leftmost and non-overlapping per
rule. Null text counts as empty and has no spans; rows are answered one by one.
Identifiers only have to narrow candidates down, so null and repeated ones are
fine. An empty table gives no rows; columns but doc_id and the text are ignored.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, kept, literals, materialize, scope

MOST = 16  # strings followed at once


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression, and how long a group of it must be."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The kinds that every scan reports, in the order of their spans.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Conjuncts; each a list of alternatives; each a set of trigrams, lower-cased.

    A match contains, for every conjunct, all trigrams of one alternative.
    """
    conjuncts: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        if strings and min(map(len, strings)) >= 3:
            conjuncts.append(sorted({trigrams(s.lower()) for s in strings}, key=sorted))

    def exact(items) -> set[str] | None:
        """The few strings that ``items`` can match, or None."""
        out = {""}
        for op, arg in items:
            own: set[str] | None = None
            if op is sre.LITERAL:
                own = {chr(arg)}
            elif op is sre.SUBPATTERN:
                own = exact(arg[3])
            elif op is sre.BRANCH:
                each = [exact(x) for x in arg[1]]
                own = None if None in each else set().union(*each)
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
                own = {chr(a) for _, a in arg}
            elif op is sre.IN and all(o in (sre.LITERAL, sre.RANGE) for o, _ in arg):
                wide = {chr(c) for o, a in arg for c in (range(a[0], a[1] + 1) if o is sre.RANGE else [a])}
                own = wide if len(wide) <= MOST else None
            elif op is sre.MAX_REPEAT and arg[1] == 1 and arg[0] == 0:
                inner = exact(arg[2])
                own = None if inner is None else inner | {""}
            elif op is sre.MAX_REPEAT and arg[0] == arg[1] <= 8:
                inner = exact(arg[2])
                own = None if inner is None else reduce(lambda a, _: {x + y for x in a for y in inner}, range(arg[0]), {""})
            if own is None:
                return None
            out = {a + b for a in out for b in own}
            if len(out) > MOST:
                return None
        return out

    def walk(items) -> None:
        held = {""}
        for item in items:
            own = exact([item])
            if own is None or len(held) * len(own) > MOST:
                close(held)
                held = {""} if own is None else own
                if own is None and item[0] is sre.SUBPATTERN:
                    walk(item[1][3])
            else:
                held = {a + b for a in held for b in own}
        close(held)

    walk(sre_parse.parse(pattern))
    return conjuncts


def build_index(docs: DataFrame, rules, text: str = "text") -> DataFrame:
    """Postings (trigram, doc_id) of every trigram that a rule asks for."""
    asked = sorted({t for r in rules for c in trigram_query(r.pattern) for a in c for t in a})
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("low"))
    met = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in asked)))
    return materialize(low.select("doc_id", met.alias("met")).select(F.explode("met").alias("trigram"), "doc_id").distinct(), "trigrams")


def candidates(index: DataFrame, rules) -> DataFrame:
    """(doc_id, kinds): the rules that a document must be verified for."""
    spark = index.sparkSession
    asked = [(r.kind, i, j, len(alternative), t) for r in rules for i, c in enumerate(trigram_query(r.pattern)) for j, alternative in enumerate(c) for t in sorted(alternative)]
    n = [(r.kind, len(trigram_query(r.pattern))) for r in rules if trigram_query(r.pattern)]
    # Both tables are as large as the rules are, whatever the input.
    wanted = F.broadcast(literals(spark, asked, ("kind", "conjunct", "alternative", "need", "trigram")))
    conjuncts = F.broadcast(literals(spark, n, ("kind", "conjuncts")))
    met = index.join(wanted, "trigram").groupBy("doc_id", "kind", "conjunct", "alternative", "need").agg(F.count(F.lit(1)).alias("n")).where("n = need")
    whole = met.groupBy("doc_id", "kind").agg(F.count_distinct("conjunct").alias("met")).join(conjuncts, "kind").where("met = conjuncts")
    return whole.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def found(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans. Pieces between matches and the matches give the places."""
    pattern = F.lit(rule.pattern)
    parts = [F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))]
    if rule.group:
        parts.append(F.regexp_extract_all(text, pattern, F.lit(rule.group)))
    # Zipped outside of the lambdas, so each expression runs once a text.
    steps = F.transform(F.arrays_zip(*(p.alias(f"p{i}") for i, p in enumerate(parts))), lambda x: F.struct(F.length(x["p0"]).alias("gap"), F.coalesce(F.length(x["p1"]), F.lit(0)).alias("size"), F.coalesce(F.length(x[f"p{len(parts) - 1}"]), F.lit(-1)).alias("judged")))

    def step(held, x):
        at = held["at"] + x["gap"]
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (at + x["size"]).alias("end"))
        return F.struct((at + x["size"]).alias("at"), F.when(x["judged"] >= max(1, rule.least), F.concat(held["spans"], F.array(span))).otherwise(held["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), SPAN).alias("spans"))
    return F.aggregate(steps, zero, step, lambda held: held["spans"])


def named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, rules=BASE + MORE, text: str = "text") -> DataFrame:
    """``docs``' doc_id and text, with ``found``: all spans by start, then by the order of the rules.

    Only candidates' texts are shuffled: a fixed-size filter of the candidates is
    broadcast, and what passes it is joined with them and verified. Other texts are
    scanned where they are read, for the rules without mandatory trigrams alone.
    """
    rules = tuple(rules)
    indexed = [r for r in rules if trigram_query(r.pattern)]
    rows = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    none = F.from_json(F.lit("[]"), SPAN)

    def verified(df: DataFrame, own) -> DataFrame:
        each = [none]
        for rank, rule in enumerate(rules):
            if rule in own:
                ask = F.array_contains("kinds", rule.kind) if rule in indexed else F.lit(True)
                each.append(F.when(ask & F.col("text").rlike(rule.pattern), found(F.col("text"), rule, rank)).otherwise(none))
        return df.select("doc_id", "text", F.array_sort(F.concat(*each)).alias("found"))

    everywhere = [r for r in rules if r not in indexed]
    if not indexed:
        return verified(rows, everywhere)
    with scope(docs.sparkSession):
        chosen = kept(candidates(build_index(docs, indexed, text), indexed).withColumnRenamed("doc_id", "_id"), "secret-candidates")
    key = F.col("doc_id").cast("long")
    maybe, others = apart(rows, chosen.select("_id"), key)
    return verified(maybe.join(chosen, key.eqNullSafe(F.col("_id")), "left"), rules).unionByName(verified(others, everywhere))


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    spans = scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "found")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return spans.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("found")).alias("spans"))


def _sql() -> str:
    fold = "".join
    word = lambda w: fold(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    keys = "|".join([*(word(w) for w in ("password", "passwd", "secret", "token")), word("api") + "_?" + word("key")])
    patterns = {"assign": rf"""({keys})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""} | {r.kind: r.pattern for r in (*BASE[1:], *MORE)}
    parts = []
    for rank, (kind, p) in enumerate(patterns.items()):
        group, least = (2, 6) if kind == "assign" else (0, 1)
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS whole, regexp_extract_all(t, '{p}', {group}) AS judged, {least} AS least FROM d""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({" UNION ALL ".join(parts)}),
n AS (SELECT doc_id, rank, kind, least, gaps, whole, judged, unnest(range(1, len(whole) + 1)) AS i FROM r),
s AS (SELECT doc_id, rank, kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS a, length(whole[i]) AS size FROM n WHERE length(judged[i]) >= least),
g AS (SELECT doc_id, CAST(count(*) FILTER (WHERE kind = 'assign') AS BIGINT) AS n_assign, CAST(count(*) FILTER (WHERE kind = 'access') AS BIGINT) AS n_access, CAST(count(*) FILTER (WHERE kind = 'hex') AS BIGINT) AS n_hex,
  string_agg(kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + size AS BIGINT) AS VARCHAR), ',' ORDER BY a, rank) FILTER (WHERE rank < 3) AS base,
  string_agg(kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + size AS BIGINT) AS VARCHAR), ',' ORDER BY a, rank) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


ORACLE_SQL = _sql()
