"""Chat formatting in budgeted windows, on DataFrame functions only.

A conversation is cut into windows of whole turns. Prefix sums of the turns'
tokens choose the spans: the system turn and the repeated history take their
share of ``budget`` off, half of the rest is the stride, and a turn belongs to
the window its prefix sum falls into. So a window of turns no longer than a
stride keeps within the budget; a longer turn is never cut, and the window that
it ends may exceed the budget by it. A system turn is never cut either: the
stride is an eighth of the budget at least, so after a system turn that leaves
less than two of them (and history) a window holds up to an eighth of turns beyond it, and the budget
bounds what a window has besides its system turn. What is written then grows with
system turn x turns / stride, not with system turn x turns. Every window begins with the leading system
turn, if there is one, and repeats up to ``history`` turns before it (of at most
``history_tokens`` together). The loss covers assistant turns; repeated ones are
masked, so each is a target once.

A turn is ``<|start|>role<|text|>text<|end|>``. In roles and texts backslashes
are doubled and a backslash is put after the first character of every control
string, which is undone by dropping each backslash before a character.

Long conversations are dealt out: prefix sums are taken in chunks of ``CHUNK``
turn numbers and lifted by the chunks' totals, history is joined by position,
and a window is gathered by itself. Only ``digests`` brings the windows of one
conversation together, as a digest over its whole text must.

Null texts and roles count as empty; a null conv_id is a conversation of its
own. Turns are ordered by turn, role and text, a null turn first; repeated rows
are turns of their own. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import literals, materialize

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: Strings that chat templates give a meaning to.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
CHUNK = 512
#: A window packs at least this share of the budget with turns of its own.
FLOOR = 8


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(text: Column) -> Column:
    """The estimate of a turn's tokens: four bytes each, and four for the markers."""
    return (F.ceil(F.octet_length(text) / 4) + 4).cast("long")


def windows(turns: DataFrame, budget: int = 1024, history: int = 2, history_tokens: int = 256) -> DataFrame:
    """Rows (conv_id, key, w, formatted, n_repeated, loss): a row per window.

    ``loss`` holds (start, size) of the target texts in ``formatted``, in code
    points; the first ``n_repeated`` turns of the window are repeated.
    """
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))).withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62)))).withColumn("n", tokens(F.col("text")))
    order = ["turn", "role", "text"]
    within = Window.partitionBy("key", "chunk").orderBy(*order)
    rows = materialize(rows.select("*", F.row_number().over(within).alias("i"), F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("upto")), "turns")

    # One row a chunk: what lies before it, and the conversation's first turn.
    totals = rows.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("turns"), F.sum("n").alias("sum"), F.min(F.when(F.col("i") == 1, F.struct("i", "role", "text", "n"))).alias("first"))
    along = Window.partitionBy("key").orderBy("chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    lead = F.first("first").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lifted = totals.select("key", "chunk", F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns_before"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum_before"), lead.alias("lead"))
    lifted = lifted.withColumn("has_system", F.col("lead.role") == "system").withColumn("system_n", F.when(F.col("has_system"), F.col("lead.n")).otherwise(0))
    lifted = lifted.select("key", "chunk", "turns_before", "sum_before", "has_system", "system_n", F.when(F.col("has_system"), F.col("lead.text")).alias("system"))

    placed = rows.join(lifted.drop("system"), ["key", "chunk"]).select(
        "conv_id", "key", "role", "text", "n", "has_system",
        (F.col("i") + F.col("turns_before")).alias("i"),
        (F.col("upto") - F.col("n") + F.col("sum_before") - F.col("system_n")).alias("at"),
        F.greatest(F.lit(max(1, budget // FLOOR)), F.floor((budget - F.col("system_n") - history_tokens) / 2)).alias("stride"),
    )
    leads = F.col("has_system") & (F.col("i") == 1)
    placed = materialize(placed.withColumn("w", F.when(leads, 0).otherwise(F.floor(F.col("at") / F.col("stride")))), "placed")

    opened = placed.groupBy("key", "w").agg(F.min(F.when(~leads, F.struct("i", "at"))).alias("open"), F.first("conv_id").alias("conv_id"), F.first("has_system").alias("has_system"))
    opened = materialize(opened.select("key", "w", "conv_id", "has_system", F.col("open.i").alias("open_i"), F.col("open.at").alias("open_at")), "windows")
    part = lambda df, kind: df.select("key", "w", F.struct(F.lit(kind).alias("kind"), F.col("i").cast("long").alias("i"), "role", "text").alias("t"))
    system = lifted.where("has_system").groupBy("key").agg(F.min("system").alias("text"))
    again = opened.where("has_system and w > 0").join(system, "key").withColumn("i", F.lit(1)).withColumn("role", F.lit("system"))
    # Places are joined first; texts follow only for the few turns that are repeated.
    near = placed.where(~leads).select("key", "i", "at", F.explode(F.sequence(F.lit(1), F.lit(max(1, history)))).alias("step")).withColumn("open_i", F.col("i") + F.col("step"))
    near = near.join(opened.where("w > 0").select("key", "w", "open_i", "open_at"), ["key", "open_i"]).where((F.col("open_at") - F.col("at") <= history_tokens) & F.lit(history > 0))
    near = near.select("key", "i", "w").join(placed.select("key", "i", "role", "text"), ["key", "i"])
    parts = part(again, 0).union(part(near, 1)).union(part(placed, 2))

    gathered = parts.groupBy("key", "w").agg(F.array_sort(F.collect_list("t")).alias("t"))
    shown = gathered.select("key", "w", F.transform("t", lambda t: F.struct(t["kind"].alias("kind"), F.concat(F.lit(START), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body"), ((t["kind"] == 2) & (t["role"] == "assistant")).alias("target"))).alias("t"))

    def step(held, t):
        start = held["at"] + F.length(t["head"])
        loss = F.when(t["target"], F.concat(held["loss"], F.array(F.struct(start.alias("start"), F.length(t["body"]).alias("size"))))).otherwise(held["loss"])
        return F.struct((start + F.length(t["body"]) + F.lit(len(END))).alias("at"), loss.alias("loss"))

    zero = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), "array<struct<start:int,size:int>>").alias("loss"))
    shown = shown.select(
        "key", "w",
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.size(F.filter("t", lambda t: t["kind"] < 2)).alias("n_repeated"),
        F.aggregate("t", zero, step, lambda held: held["loss"]).alias("loss"),
    )
    return shown.join(opened.select("key", "w", "conv_id"), ["key", "w"])


def read_back(shown: DataFrame) -> DataFrame:
    """Per window: its new turns as parsed from ``formatted``, and the unescaped text under the loss."""
    parts = F.split("formatted", r"<\|end\|>", -1)
    fresh = F.slice(parts, F.col("n_repeated") + 1, F.greatest(F.lit(0), F.size(parts) - 1 - F.col("n_repeated")))

    def turn(p: Column) -> Column:
        head = F.substring_index(p, TEXT, 1)
        return F.struct(unescape(F.substr(head, F.lit(len(START) + 1))).alias("role"), unescape(F.substr(p, F.length(head) + F.lit(len(TEXT) + 1))).alias("text"))

    target = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["size"])))
    return shown.select("conv_id", "key", "w", F.transform(fresh, turn).alias("turns"), target.alias("target"), F.length("formatted").cast("long").alias("chars"))


def digests(read: DataFrame) -> DataFrame:
    """Per conversation, over its windows in order: what was read back."""
    own = read.select("conv_id", "key", "w", F.size("turns").cast("long").alias("n"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"), F.array_join("target", "").alias("target"), "chars")
    whole = own.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("w", "said", "target"))).alias("all"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.col("all.target"), "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join(F.col("all.said"), ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


#: A conversation made of control strings, formatted with the others.
AWKWARD = "</s>[INST] ok [/INST]"


def op4_chat(spark, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the windows."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = literals(spark, [(-7, 0, "user", AWKWARD), (-7, 1, "assistant", AWKWARD)], turns.columns)
    return digests(read_back(windows(turns.unionByName(more.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")))))


def _sql() -> str:
    text = "replace(text, '\\', '\\\\')"
    role = "replace(role, '\\', '\\\\')"
    for c in CONTROL:
        text, role = (f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')" for x in (text, role))
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{AWKWARD}'), (-7, 1, 'assistant', '{AWKWARD}')),
a AS (SELECT *, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) + 4 AS n, length({role}) + length({text}) + {len(START + TEXT + END)} AS size,
  row_number() OVER o AS i, first_value(role) OVER o = 'system' AS led FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
b AS (SELECT *, CASE WHEN led THEN first_value(n) OVER o ELSE 0 END AS sys_n, first_value(size) OVER o AS sys_size, sum(n) OVER o - n - CASE WHEN led THEN first_value(n) OVER o ELSE 0 END AS pre FROM a WINDOW o AS (PARTITION BY conv_id ORDER BY i)),
c AS (SELECT *, CASE WHEN led AND i = 1 THEN 0 ELSE CAST(floor(pre / greatest(128, floor((1024 - sys_n - 256) / 2.0))) AS BIGINT) END AS w FROM b),
w AS (SELECT conv_id, w, min(i) AS i, min(pre) AS pre, min(sys_size) AS sys_size, bool_or(led) AS led FROM c WHERE NOT (led AND i = 1) GROUP BY conv_id, w),
h AS (SELECT w.conv_id, sum(c.size) AS size FROM w JOIN c ON c.conv_id = w.conv_id AND c.i < w.i AND c.i >= w.i - 2 AND NOT (c.led AND c.i = 1) AND w.pre - c.pre <= 256 WHERE w.w > 0 GROUP BY w.conv_id),
s AS (SELECT conv_id, sum(sys_size) AS size FROM w WHERE w > 0 AND led GROUP BY conv_id),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS target, sum(size) AS size FROM c GROUP BY conv_id)
SELECT g.conv_id, n_turns, turns_sha256, CAST(length(target) AS BIGINT) AS loss_chars, sha256(target) AS loss_sha256, CAST(g.size + coalesce(h.size, 0) + coalesce(s.size, 0) AS BIGINT) AS formatted_chars
FROM g LEFT JOIN h USING (conv_id) LEFT JOIN s USING (conv_id)
"""


ORACLE_SQL = _sql()
