"""Queries that run the operators on the standard tables, each with the SQL it must equal.

A document stands for a recording, ``lang`` for its family, ``source`` for its
folder or data set; numbers are rounded to six digits and ties end in an id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, signal, text
from ..operators import dedup, gates, joins, learning, metrics, numbering, qc, registry, review, rollup, sampling, segments, similar, split
from ..session import settled
from ..sources import runs
from . import analysis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: A line's supplier, five ways, stands for the method of a run.
ITEMS = "(SELECT *, 'm' || CAST(l_suppkey % 5 AS VARCHAR) AS l_method FROM lineitem)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("FROM lineitem", f"FROM {ITEMS}") if "l_method" in sql and ITEMS not in sql else sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn("l_method", F.concat(F.lit("m"), (F.col("l_suppkey") % 5).cast("string"))) if name == "lineitem" else df


def small(spark: SparkSession, values: list, name: str) -> DataFrame:
    """A fixed list as a one-column table."""
    return spark.range(1).select(F.explode(F.array(*(F.lit(v) for v in values))).alias(name))


def six(column):
    return F.round(column, 6)


NAME = "split_part(coalesce(text, ''), chr(10), 1)"


def documents(spark, d) -> DataFrame:
    """Documents as recordings: first line as name, digest, and profile columns."""
    docs = read(spark, d, "documents")
    body = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "lang", "source", "n_chars", body.alias("text"), F.substring_index(body, "\n", 1).alias("name"))


# ---- scan, text and rules -------------------------------------------------------------------


@query("SELECT source, lang, count(*) AS n, min(n_chars) AS min_chars, max(n_chars) AS max_chars, round(avg(n_chars), 6) AS avg_chars FROM documents GROUP BY source, lang")
def scan_profile(spark, d):
    return read(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"), six(F.avg("n_chars")).alias("avg_chars"))


@query("SELECT doc_id, 'rec_' || source || '_' || printf('%06d', row_number() OVER (PARTITION BY source ORDER BY lang, doc_id)) AS record_id FROM documents")
def assign_record_id(spark, d):
    rows = numbering.numbers(read(spark, d, "documents").select("doc_id", "source", "lang"), ["source"], ["lang", "doc_id"])
    return rows.select("doc_id", text.numbered(F.concat(F.lit("rec_"), "source", F.lit("_")), F.col("n")).alias("record_id"))


_TRIM = r"regexp_replace({}, '^[\s\x{{3000}}\x{{00A0}}]+|[\s\x{{3000}}\x{{00A0}}]+$', '', 'g')"


@query(
    "SELECT doc_id, " + _TRIM.format(rf"regexp_replace(regexp_replace(regexp_replace({NAME}, '\.[^.]*$', ''), '[\s\x{{3000}}\x{{00A0}}]*第[一二三]遍[\s\x{{3000}}\x{{00A0}}]*$', ''), '[\s\x{{3000}}\x{{00A0}}]+', ' ', 'g')") + rf" AS normalized, regexp_replace({NAME}, '[\s\x{{3000}}\x{{00A0}}]+', '', 'g') AS bare FROM documents"
)
def normalize_text(spark, d):
    return documents(spark, d).select("doc_id", text.normalized_name(F.col("name")).alias("normalized"), text.merge_key(F.col("name")).alias("bare"))


KINDS = (("license", ("License", "Copyright")), ("contact", ("@", "http")), ("shout", ("!!",)))


@query("SELECT doc_id, CASE WHEN contains(text, 'License') OR contains(text, 'Copyright') THEN 'license' WHEN contains(text, '@') OR contains(text, 'http') THEN 'contact' WHEN contains(text, '!!') THEN 'shout' END AS content_type FROM documents")
def classify_content(spark, d):
    return read(spark, d, "documents").select("doc_id", text.first_keyword(F.col("text"), KINDS).alias("content_type"))


@query("SELECT page_id, CASE WHEN contains(html, '<table') THEN 'table' WHEN contains(html, '<a ') OR contains(html, 'href') THEN 'links' END AS content_type FROM pages")
def classify_pages(spark, d):
    return read(spark, d, "pages").select("page_id", text.first_keyword(F.col("html"), (("table", ("<table",)), ("links", ("<a ", "href")))).alias("content_type"))


def _profiled(spark, d) -> DataFrame:
    docs = documents(spark, d)
    lines = F.split("text", "\n", -1)
    blank = F.length(F.col("text")) - F.length(F.replace(F.replace(F.col("text"), F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    return docs.select("doc_id", "lang", "source", F.length("text").alias("chars"), F.when(F.length("text") > 0, blank / F.length("text")).otherwise(0.0).alias("space_share"), (1 - F.size(F.array_distinct(lines)) / F.size(lines)).alias("repeat_share"))


_PROFILE = """p AS (SELECT doc_id, lang, source, length(coalesce(text, '')) AS chars,
  CASE WHEN length(coalesce(text, '')) > 0 THEN (length(text) - length(replace(replace(text, ' ', ''), chr(10), ''))) / length(text) ELSE 0.0 END AS space_share,
  1 - len(list_distinct(string_split(coalesce(text, ''), chr(10)))) / len(string_split(coalesce(text, ''), chr(10))) AS repeat_share FROM documents)"""


def _rules(limit=None):
    return [
        qc.QcRule("D03", F.col("chars") == 0, "decode_failure"),
        qc.QcRule("D04", (F.col("chars") > 0) & (F.col("chars") < 200), "too_short"),
        qc.QcRule("D05a", F.col("space_share") > (F.lit(0.16) if limit is None else F.col(limit)), "excessive_silence"),
        qc.QcRule("D06a", F.col("repeat_share") > 0.05, "severe_distortion"),
    ]


_TRAIL = """concat_ws(',', CASE WHEN chars = 0 THEN 'D03' END, CASE WHEN chars > 0 AND chars < 200 THEN 'D04' END, CASE WHEN space_share > {limit} THEN 'D05a' END, CASE WHEN repeat_share > 0.05 THEN 'D06a' END) AS trail,
  CASE WHEN chars = 0 THEN 'decode_failure' WHEN chars > 0 AND chars < 200 THEN 'too_short' WHEN space_share > {limit} THEN 'excessive_silence' WHEN repeat_share > 0.05 THEN 'severe_distortion' ELSE '' END AS drop_reason"""


@query(f"WITH {_PROFILE}, q AS (SELECT *, {_TRAIL.format(limit='CAST(0.16 AS DOUBLE)')} FROM p) SELECT doc_id, trail, drop_reason, CASE WHEN drop_reason = '' THEN 'keep' ELSE 'drop' END AS sample_status FROM q")
def qc_rules(spark, d):
    out = qc.apply_rules(_profiled(spark, d), _rules())
    return out.select("doc_id", F.array_join("applied_rule_ids", ",").alias("trail"), "drop_reason", "sample_status")


@query(f"WITH {_PROFILE}, q AS (SELECT *, {_TRAIL.format(limit='CAST(0.16 AS DOUBLE)')} FROM p) SELECT lang, count(*) FILTER (WHERE drop_reason = '') AS kept, count(*) FILTER (WHERE drop_reason <> '') AS dropped, count(*) AS total FROM q GROUP BY lang")
def qc_status_counts(spark, d):
    return qc.status_counts(qc.apply_rules(_profiled(spark, d), _rules()), "lang")


def _overrides(spark):
    rows = [(0, "de", "space_share", "all", 0.13), (1, "de", "space_share", "all", 0.5), (2, "fr", "space_share", "src0_only", 0.15), (3, "fr", "space_share", "all", 0.17)]
    one = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("pos", "family", "threshold_key", "scope", "value"), r, strict=True))) for r in rows))
    return spark.range(1).select(F.explode(one).alias("r")).select("r.*")


@query(
    f"""WITH {_PROFILE}, o(pos, family, scope, value) AS (VALUES (0, 'de', 'all', 0.13), (1, 'de', 'all', 0.5), (2, 'fr', 'src0_only', 0.15), (3, 'fr', 'all', 0.17)),
    t AS (SELECT p.*, coalesce(CAST((SELECT arg_min(value, pos) FROM o WHERE family = p.lang AND (scope <> 'src0_only' OR p.source = 'src0')) AS DOUBLE), CAST(0.16 AS DOUBLE)) AS threshold FROM p)
    SELECT doc_id, threshold, space_share > threshold AS fires FROM t"""
)
def threshold_overrides(spark, d):
    out = qc.resolved_threshold(_profiled(spark, d), _overrides(spark), "space_share", 0.16, "threshold", "lang", "source", {"src0_only": "src0"})
    return out.select("doc_id", "threshold", (F.col("space_share") > F.col("threshold")).alias("fires"))


@query("SELECT doc_id, CASE WHEN b THEN 'true' ELSE 'false' END AS flag, CASE WHEN contains(x, '.') THEN CASE WHEN rtrim(x, '0') LIKE '%.' THEN rtrim(x, '0') || '0' ELSE rtrim(x, '0') END ELSE x END AS shown FROM (SELECT doc_id, n_chars > 500 AS b, printf('%.6f', CAST(n_chars AS DOUBLE) / 8) AS x FROM documents)")
def format_cells(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", text.cell(F.col("n_chars") > 500, "boolean").alias("flag"), text.cell(F.col("n_chars").cast("double") / 8, "double").alias("shown"))


@query("SELECT p_partkey, CAST(p_partkey % 13 AS VARCHAR) || '.' || CAST(p_partkey % 101 AS VARCHAR) || '.wav' AS file_name, row_number() OVER (ORDER BY p_partkey % 13, p_partkey % 101, p_partkey) AS place FROM part")
def dotted_order(spark, d):
    part = read(spark, d, "part").select("p_partkey", F.concat((F.col("p_partkey") % 13).cast("string"), F.lit("."), (F.col("p_partkey") % 101).cast("string"), F.lit(".wav")).alias("file_name"))
    return numbering.numbers(part, [], [text.dotted_key(F.col("file_name")), "p_partkey"], "place")


# ---- duplicates and groups ------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN n > 1 AND lo = hi AND f <> doc_id THEN f END AS duplicate_of FROM (SELECT doc_id, count(*) OVER w AS n, min(lang) OVER w AS lo, max(lang) OVER w AS hi, first_value(doc_id) OVER (PARTITION BY coalesce(text, '') ORDER BY source, doc_id) AS f FROM documents WINDOW w AS (PARTITION BY coalesce(text, '')))")
def exact_dedup(spark, d):
    docs = documents(spark, d).withColumn("sha", F.sha2("text", 256)).select("doc_id", "lang", "source", "sha")
    return dedup.exact_duplicates(docs, "sha", ["source"], ["lang"], "doc_id").select("doc_id", "duplicate_of")


@query("SELECT source, count(*) AS n, count(DISTINCT text) AS n_texts FROM (SELECT source, coalesce(text, '') AS text FROM documents) GROUP BY source")
def exact_dedup_rollup(spark, d):
    return documents(spark, d).select("source", F.sha2("text", 256).alias("sha")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sha").alias("n_texts"))


@query("WITH t AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS sha FROM documents), g AS (SELECT sha FROM t GROUP BY sha HAVING count(DISTINCT source) > 1) SELECT x.doc_id AS a, y.doc_id AS b, x.sha FROM t x JOIN t y ON x.sha = y.sha AND x.doc_id < y.doc_id WHERE x.sha IN (SELECT sha FROM g)")
def cross_group_dup_pairs(spark, d):
    docs = documents(spark, d).select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    return dedup.cross_pairs(docs, "sha", ["source"], "doc_id")


@query("WITH t AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS sha FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY sha) AS representative, sha FROM t WHERE sha IN (SELECT sha FROM t GROUP BY sha HAVING count(DISTINCT source) > 1)")
def cross_group_members(spark, d):
    docs = documents(spark, d).select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    return dedup.cross_members(docs, "sha", ["source"], "doc_id")


@query(
    """WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS cluster FROM documents), m AS (SELECT * FROM t WHERE cluster IN (SELECT cluster FROM t GROUP BY cluster HAVING count(*) > 1)),
    v AS (SELECT doc_id, CASE WHEN quality = 1 AND doc_id % 3 = 0 THEN 'canonical' WHEN quality = 0 OR doc_id % 3 = 1 THEN 'rejected' END AS vote FROM labels),
    g AS (SELECT cluster, count(*) FILTER (WHERE vote = 'canonical') AS voted, count(*) FILTER (WHERE vote IS DISTINCT FROM 'rejected') AS alive, min(m.doc_id) FILTER (WHERE vote = 'canonical') AS c, min(m.doc_id) FILTER (WHERE vote IS DISTINCT FROM 'rejected') AS s FROM m LEFT JOIN v USING (doc_id) GROUP BY cluster)
    SELECT cluster, CASE WHEN voted = 1 THEN c WHEN voted = 0 AND alive = 1 THEN s END AS winner, CASE WHEN voted > 1 THEN 'several_canonical' WHEN voted = 0 AND alive = 0 THEN 'no_survivor' WHEN voted = 0 AND alive > 1 THEN 'several_survivors' END AS problem FROM g"""
)
def dup_cluster_resolution(spark, d):
    docs = documents(spark, d).select(F.col("doc_id").alias("record_id"), F.sha2("text", 256).alias("cluster"))
    many = docs.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster")
    vote = F.when((F.col("quality") == 1) & (F.col("doc_id") % 3 == 0), "canonical").when((F.col("quality") == 0) | (F.col("doc_id") % 3 == 1), "rejected")
    votes = read(spark, d, "labels").select(F.col("doc_id").alias("record_id"), vote.alias("vote"))
    return dedup.resolved_clusters(docs.join(many, "cluster", "left_semi"), votes)


@query(rf"SELECT doc_id, min(name) OVER w AS canonical_name, CASE WHEN min(name) OVER w <> max(name) OVER w THEN 'whitespace_variant_merge' ELSE 'filename_rule' END AS grouping_method FROM (SELECT doc_id, lang, source, {NAME} AS name FROM documents) WINDOW w AS (PARTITION BY lang, regexp_replace(name, '[\s\x{{3000}}\x{{00A0}}]+', '', 'g'))")
def whitespace_variant_merge(spark, d):
    docs = documents(spark, d).withColumn("bare", text.merge_key(F.col("name")))
    return dedup.variant_groups(docs, ["lang"], "name", "bare").select("doc_id", "canonical_name", "grouping_method")


@query(f"SELECT doc_id, 'ccm_' || lang || '_G' || printf('%04d', dense_rank() OVER (PARTITION BY lang ORDER BY source, name)) AS recording_group_id FROM (SELECT doc_id, lang, source, {NAME} AS name FROM documents)")
def group_ids(spark, d):
    docs = documents(spark, d).select("doc_id", "lang", "source", "name")
    return dedup.group_numbers(docs, ["lang"], ["source", "name"], F.concat(F.lit("ccm_"), "lang")).select("doc_id", "recording_group_id")


@query(f"SELECT doc_id, count(*) OVER (PARTITION BY name) > 1 AS is_near_duplicate FROM (SELECT doc_id, {NAME} AS name FROM documents)")
def near_dup_flag(spark, d):
    return dedup.near_duplicate_flag(documents(spark, d).select("doc_id", "name"), "name").select("doc_id", "is_near_duplicate")


@query(f"WITH t AS (SELECT doc_id, lang, source, {NAME} AS name FROM documents), g AS (SELECT lang FROM t GROUP BY lang HAVING count(DISTINCT name) >= 35) SELECT doc_id, lang IN (SELECT lang FROM g) AND row_number() OVER (PARTITION BY lang, name ORDER BY source, doc_id) > 1 AS thinned FROM t")
def near_dup_thin(spark, d):
    return dedup.thinned(documents(spark, d).select("doc_id", "lang", "source", "name"), "lang", "name", ["source", "doc_id"]).select("doc_id", "thinned")


def _fingerprints(spark, d) -> DataFrame:
    """The signs of every vector as two words, and again with the last 0 to 12 signs of the first word turned, as by another take."""
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("label").alias("family"), (F.col("vec_id") % 2).alias("subtype"), arrays.sign_bits(F.col("embedding"), 2, 32).alias("fp"))
    turned = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("record_id") % 13).cast("int")) - 1
    return rows.unionByName(rows.select((-F.col("record_id") - 1).alias("record_id"), "family", (F.col("subtype") + 2).alias("subtype"), F.array(F.col("fp")[0].bitwiseXOR(turned), F.col("fp")[1]).alias("fp")))


_BITS = "list_reduce(list_transform(embedding[{a}:{b}], lambda x: CAST(x > 0 AS BIGINT)), lambda s, x: s * 2 + x, CAST(0 AS BIGINT))"


@query(
    f"""WITH e AS (SELECT vec_id, label, vec_id % 2 AS subtype, CAST({_BITS.format(a=1, b=32)} AS BIGINT) AS p, CAST({_BITS.format(a=33, b=64)} AS BIGINT) AS q FROM embeddings),
    f AS (SELECT * FROM e UNION ALL SELECT -vec_id - 1, label, subtype + 2, xor(p, (CAST(1 AS BIGINT) << CAST(vec_id % 13 AS INTEGER)) - 1), q FROM e)
    SELECT x.label AS family, least(x.vec_id, y.vec_id) AS a, greatest(x.vec_id, y.vec_id) AS b, round(1 - (bit_count(xor(x.p, y.p)) + bit_count(xor(x.q, y.q))) / 64, 6) AS hamming_sim FROM f x JOIN f y ON x.label = y.label AND x.subtype < y.subtype
    WHERE 1 - (bit_count(xor(x.p, y.p)) + bit_count(xor(x.q, y.q))) / 64 >= 0.85"""
)
def hamming_pairs(spark, d):
    found = dedup.fingerprint_candidates(_fingerprints(spark, d), "family", "subtype", "fp", hamming=0.85, contained=2.0)
    return found.select("family", "a", "b", six(F.col("hamming_sim")).alias("hamming_sim"))


@query(
    r"""WITH crc AS (
      SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
    ), d AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+') AS w FROM documents
    ), i AS (SELECT item_id, regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+') AS w FROM benchmark
    ), v AS (SELECT DISTINCT unnest(w) AS t FROM (SELECT w FROM d UNION ALL SELECT w FROM i)
    ), h AS (
      SELECT t, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * strlen(t), 2), lambda k: CAST('0x' || substr(hex(encode(t)), CAST(k AS BIGINT), 2) AS BIGINT))), lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS x FROM v, crc
    ), dw AS (SELECT doc_id, u.n AS pos, x FROM (SELECT doc_id, w, unnest(range(len(w))) AS n FROM d) u JOIN h ON h.t = u.w[u.n + 1]
    ), iw AS (SELECT item_id, u.n AS pos, x FROM (SELECT item_id, w, unnest(range(len(w))) AS n FROM i) u JOIN h ON h.t = u.w[u.n + 1]
    ), ds AS (SELECT doc_id, list(x ORDER BY pos) AS f FROM dw GROUP BY doc_id), es AS (SELECT item_id, list(x ORDER BY pos) AS f FROM iw GROUP BY item_id
    ), near AS (SELECT a.x AS p, b.x AS q FROM (SELECT DISTINCT x FROM dw) a JOIN (SELECT DISTINCT x FROM iw) b ON bit_count(xor(a.x, b.x)) <= 3
    ), c AS (SELECT DISTINCT doc_id, item_id, dw.pos - iw.pos AS o FROM dw JOIN near ON dw.x = p JOIN iw ON iw.x = q
    ), s AS (
      SELECT doc_id, item_id, CASE WHEN len(ds.f) >= len(es.f) THEN o ELSE -o END AS o, CASE WHEN len(ds.f) >= len(es.f) THEN ds.f ELSE es.f END AS l, CASE WHEN len(ds.f) >= len(es.f) THEN es.f ELSE ds.f END AS s FROM c JOIN ds USING (doc_id) JOIN es USING (item_id)
    ), r AS (
      SELECT doc_id, item_id, 1 - list_sum(list_transform(range(len(s)), lambda k: bit_count(xor(s[k + 1], l[k + 1 + o])))) / (32 * len(s)) AS sim FROM s WHERE o >= 0 AND o + len(s) <= len(l))
    SELECT doc_id, item_id, round(max(sim), 6) AS containment_sim FROM r WHERE sim >= CAST(0.90 AS DOUBLE) GROUP BY doc_id, item_id"""
)
def containment_pairs(spark, d):
    """Documents and benchmark items, as sequences of word hashes, one of which holds the other with at most a tenth of the bits different."""
    words = lambda table, id_: read(spark, d, table).select(F.lit(0).alias("group"), F.lit(table).alias("tag"), id_, F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\x0B\f\r]+"), lambda w: F.crc32(w)).alias("words"))
    items, docs = (settled(words(*x)) for x in (("benchmark", "item_id"), ("documents", "doc_id")))  # texts are cut once
    inside = similar.contained_pairs(items.withColumnRenamed("item_id", "short"), docs.withColumnRenamed("doc_id", "long"), 0.90).select(F.col("long").alias("doc_id"), F.col("short").alias("item_id"), "sim")
    around = similar.contained_pairs(docs.withColumnRenamed("doc_id", "short"), items.withColumnRenamed("item_id", "long"), 0.90).select(F.col("short").alias("doc_id"), F.col("long").alias("item_id"), "sim")
    return inside.union(around).groupBy("doc_id", "item_id").agg(six(F.max("sim")).alias("containment_sim"))


@query(
    """WITH RECURSIVE t AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents), n AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS name, lang FROM documents),
    k AS (SELECT doc_id, 's' || sha AS key FROM t UNION ALL SELECT doc_id, 'n' || lang || name FROM n),
    l AS (SELECT key, min(doc_id) AS m FROM k GROUP BY key HAVING count(DISTINCT doc_id) > 1), e AS (SELECT DISTINCT k.doc_id AS a, l.m AS b FROM k JOIN l USING (key) WHERE k.doc_id <> l.m),
    s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS seen FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.seen = s.a)
    SELECT node, min(seen) AS component FROM r GROUP BY node"""
)
def merge_components(spark, d):
    docs = documents(spark, d)
    keys = docs.select("doc_id", F.concat(F.lit("s"), F.sha2("text", 256)).alias("key")).union(docs.select("doc_id", F.concat(F.lit("n"), "lang", "name")))
    least = keys.groupBy("key").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("hi")).where("b <> hi").select("key", "b")
    return dedup.components(keys.join(least, "key").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct())


# ---- review ----------------------------------------------------------------------------------


def _audit(spark, d) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.when(F.col("doc_id") % 4 == 0, -1).otherwise(16).alias("bit_depth"), F.when(F.col("doc_id") % 5 != 0, "phrase").alias("content_type"), F.lit("").alias("drop_reason"), F.lit("keep").alias("sample_status"), F.array().cast("array<string>").alias("applied_rule_ids"))


def _decisions(spark, d) -> DataFrame:
    labels = read(spark, d, "labels")
    depth = labels.where("doc_id % 4 = 0").select(F.col("doc_id").alias("record_id"), F.lit("bit_depth_review").alias("review_type"), F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("decision"), F.lit("24").alias("value"))
    kind = labels.where("doc_id % 5 = 0").select(F.col("doc_id").alias("record_id"), F.lit("content_type_review").alias("review_type"), F.when(F.col("toxic") == 0, "approved").otherwise("rejected").alias("decision"), F.lit("technique").alias("value"))
    return depth.unionByName(kind)


@query(
    """SELECT d.doc_id AS record_id, CASE WHEN d.doc_id % 4 = 0 AND quality = 1 THEN 24 WHEN d.doc_id % 4 = 0 THEN -1 ELSE 16 END AS bit_depth, CASE WHEN d.doc_id % 5 = 0 AND toxic = 0 THEN 'technique' WHEN d.doc_id % 5 <> 0 THEN 'phrase' END AS content_type,
    CASE WHEN d.doc_id % 5 = 0 AND toxic <> 0 THEN 'label_requires_guess' WHEN d.doc_id % 4 = 0 AND quality <> 1 THEN 'unrecognized_encoding' ELSE '' END AS drop_reason,
    CASE WHEN (d.doc_id % 5 = 0 AND toxic <> 0) OR (d.doc_id % 4 = 0 AND quality <> 1) THEN 'drop' ELSE 'keep' END AS sample_status,
    CASE WHEN (d.doc_id % 5 = 0 AND toxic <> 0) OR (d.doc_id % 4 = 0 AND quality <> 1) THEN 'rejected' WHEN l.doc_id IS NOT NULL AND (d.doc_id % 4 = 0 OR d.doc_id % 5 = 0) THEN 'approved' ELSE '' END AS review_status FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def apply_review(spark, d):
    return review.applied(_audit(spark, d), _decisions(spark, d)).drop("applied_rule_ids")


@query("SELECT doc_id AS record_id, 'bit_depth_review' AS review_type, 'I10' AS trigger_rule_id FROM documents WHERE doc_id % 4 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'content_type_review', 'I01' FROM documents WHERE doc_id % 5 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_queue(spark, d):
    _, items = qc.pending_after_qc(_audit(spark, d))
    return review.pending(items, _decisions(spark, d), ["record_id", "review_type"])


def _pairs(spark, d):
    pairs = cross_group_dup_pairs(spark, d).select(F.col("b").alias("record_id"), F.lit("cross_duplicate_review").alias("review_type"), F.col("a").alias("peer_record_id"))
    decided = pairs.where("(record_id + peer_record_id) % 3 <> 0").select(F.col("peer_record_id").alias("record_id"), "review_type", F.col("record_id").alias("peer_record_id"), F.when((F.col("record_id") + F.col("peer_record_id")) % 3 == 1, "approved").otherwise("rejected").alias("decision"))
    return pairs, decided


_PAIRS = "p AS (" + SQL["cross_group_dup_pairs"].replace("WITH t AS", "SELECT a, b FROM (WITH t AS") + "))"


@query(f"WITH {_PAIRS} SELECT b AS record_id, 'cross_duplicate_review' AS review_type, a AS peer_record_id FROM p WHERE (a + b) % 3 = 0")
def pending_pairs(spark, d):
    pairs, decided = _pairs(spark, d)
    cast = lambda df: df.withColumn("record_id", F.col("record_id").cast("string")).withColumn("peer_record_id", F.col("peer_record_id").cast("string"))
    return review.pending_pairs(cast(pairs), cast(decided)).select(F.col("record_id").cast("long"), "review_type", F.col("peer_record_id").cast("long"))


@query(f"WITH {_PAIRS}, e AS (SELECT a AS record_id, (a + b) % 3 = 2 AS no FROM p WHERE (a + b) % 3 <> 0 UNION ALL SELECT b, (a + b) % 3 = 2 FROM p WHERE (a + b) % 3 <> 0) SELECT record_id, CASE WHEN bool_or(no) THEN 'rejected' ELSE 'approved' END AS review_status FROM e GROUP BY record_id")
def pair_review_status(spark, d):
    return review.pair_status(_pairs(spark, d)[1])


@query("SELECT 'bad_bit_depth' AS check_name, doc_id AS record_id FROM labels WHERE doc_id % 7 = 0 AND quality = 1 UNION ALL SELECT 'unknown_decision', doc_id FROM labels WHERE doc_id % 7 = 1")
def review_violations(spark, d):
    rows = read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("record_id"), F.lit("bit_depth_review").alias("review_type"), F.when(F.col("doc_id") % 7 == 1, "maybe").when(F.col("quality") == 1, "approved").otherwise("rejected").alias("decision"), F.when(F.col("doc_id") % 7 == 0, "8").otherwise("16").alias("value"), F.lit("").alias("peer_record_id"), F.lit("").alias("drop_reason"))
    return review.violations(rows).select(F.col("check").alias("check_name"), F.col("record_id").cast("long").alias("record_id"))


# ---- quotas, gates, splits -------------------------------------------------------------------


@query(
    """WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars > 2000) AS p FROM documents GROUP BY lang), k AS (SELECT lang, least(p, greatest(0, CAST(ceil((p - CAST(0.3 AS DOUBLE) * n) / (CAST(1 AS DOUBLE) - CAST(0.3 AS DOUBLE))) AS BIGINT))) AS k FROM c WHERE p > CAST(0.3 AS DOUBLE) * n),
    r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('101:' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents WHERE n_chars > 2000) SELECT lang, doc_id FROM r JOIN k USING (lang) WHERE r <= k"""
)
def quota_downsample(spark, d):
    return sampling.quota_drops(read(spark, d, "documents").select("doc_id", "lang", "n_chars"), "lang", F.col("n_chars") > 2000, "doc_id", 0.3, 101)


@query(
    """WITH f AS (SELECT source AS family, count(*) AS n, count(DISTINCT lang) AS groups FROM documents GROUP BY source), m AS (SELECT median(n) AS median FROM f)
    SELECT 'R01' AS check_name, family AS key, CAST(n AS DOUBLE) AS detail FROM f WHERE n < 45 UNION ALL SELECT 'R02', family, n FROM f, m WHERE n < CAST(1.0 AS DOUBLE) * median UNION ALL SELECT 'R03_hard', family, groups FROM f WHERE groups < 4 UNION ALL SELECT 'R03', family, groups FROM f WHERE groups >= 4 AND groups < 5"""
)
def replace_gates(spark, d):
    docs = read(spark, d, "documents").select("source", "lang", F.lit("keep").alias("sample_status"))
    return gates.replacement_gates(docs, docs.select("source").distinct(), "source", "lang", 45, 1.0, 4, 5).withColumnRenamed("check", "check_name")


@query("SELECT round(sum(c) / sum(n), 6) AS controlled_share, round(min(n) / max(n), 6) AS class_ratio FROM (SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars % 3 <> 0) AS c FROM documents GROUP BY lang)")
def balance_monitors(spark, d):
    docs = read(spark, d, "documents").select("lang", F.when(F.col("n_chars") % 3 == 0, "phrase").when(F.col("n_chars") % 3 == 1, "technique").otherwise("controlled").alias("content_type"))
    return gates.balance_monitors(docs, "lang").select(six(F.col("controlled_share")).alias("controlled_share"), six(F.col("class_ratio")).alias("class_ratio"))


@query("SELECT doc_id, 'ext_' || lang || '_' || printf('%04d', row_number() OVER (PARTITION BY lang ORDER BY source, doc_id)) AS sample_id FROM documents")
def freeze_ids(spark, d):
    rows = numbering.numbers(read(spark, d, "documents").select("doc_id", "lang", "source"), ["lang"], ["source", "doc_id"])
    return rows.select("doc_id", text.numbered(F.concat(F.lit("ext_"), "lang", F.lit("_")), F.col("n"), 4).alias("sample_id"))


_HASH_SPLIT = """s AS (SELECT lang, source, n, CASE WHEN share <= CAST(0.7 AS DOUBLE) THEN 'train' WHEN share <= CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE) THEN 'val' ELSE 'test' END AS split FROM
  (SELECT *, (sum(n) OVER (PARTITION BY lang ORDER BY sha256('7:' || source), source ROWS UNBOUNDED PRECEDING) - n / 2) / sum(n) OVER (PARTITION BY lang) AS share FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source)))"""


@query(f"WITH {_HASH_SPLIT} SELECT lang, source, n, split FROM s")
def hash_split(spark, d):
    return split.hash_split(read(spark, d, "documents"), "lang", "source", 7)


_AFTER = "list_transform([1, 2, 3], lambda k: counts[k] + CASE WHEN k = s THEN size ELSE 0 END)"
_MOVED = "list_transform([1, 2, 3], lambda k: counts[k] + CASE WHEN k = w THEN sizes[i] WHEN k = place[i] THEN -sizes[i] ELSE 0 END)"
_OFF = "list_max(list_transform([1, 2, 3], lambda j: abs({}[j] / total - targets[j])))"


@query(
    f"""WITH RECURSIVE g AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source
    ), o AS (SELECT lang, list(source ORDER BY sha256('7:' || source), source) AS names, list(n ORDER BY sha256('7:' || source), source) AS sizes, CAST(sum(n) AS BIGINT) AS total, [CAST(0.70 AS DOUBLE), CAST(0.15 AS DOUBLE), CAST(0.15 AS DOUBLE)] AS targets FROM g GROUP BY lang
    ), p AS (
      SELECT lang, sizes, total, targets, 0 AS i, [CAST(0 AS BIGINT), 0, 0] AS counts, CAST([] AS INTEGER[]) AS place FROM o
      UNION ALL
      SELECT lang, sizes, total, targets, i + 1, list_transform([1, 2, 3], lambda k: counts[k] + CASE WHEN k = best.s THEN sizes[i + 1] ELSE 0 END), list_append(place, CAST(best.s AS INTEGER)) FROM (
        SELECT *, list_min(list_transform(list_filter([1, 2, 3], lambda s: len(list_filter({_AFTER.replace('size', 'sizes[i + 1]')}, lambda c: c = 0)) <= len(sizes) - i - 1),
          lambda s: {{'d': {_OFF.format(_AFTER.replace('size', 'sizes[i + 1]'))}, 's': s}})) AS best FROM p WHERE i < len(sizes))
    ), r AS (
      SELECT lang, sizes, total, targets, counts, place, 0 AS step, {_OFF.format('counts')} AS d FROM p WHERE i = len(sizes)
      UNION ALL
      SELECT lang, sizes, total, targets, list_transform([1, 2, 3], lambda k: counts[k] + CASE WHEN k = best.w THEN sizes[best.i] WHEN k = place[best.i] THEN -sizes[best.i] ELSE 0 END),
        list_transform(range(1, len(place) + 1), lambda k: CASE WHEN k = best.i THEN CAST(best.w AS INTEGER) ELSE place[k] END), step + 1, best.d FROM (
        SELECT *, list_min(list_filter(flatten(list_transform(list_filter(range(1, len(sizes) + 1), lambda i: counts[place[i]] > sizes[i]), lambda i: list_transform(list_filter([1, 2, 3], lambda w: w <> place[i]),
          lambda w: {{'d': {_OFF.format(_MOVED)}, 'i': i, 'w': w}}))), lambda m: m.d < d - CAST(1e-12 AS DOUBLE))) AS best FROM r WHERE step > 0 OR d > CAST(0.01 AS DOUBLE)) WHERE best IS NOT NULL
    ), f AS (SELECT lang, arg_max(place, step) AS place FROM r GROUP BY lang)
    SELECT lang, names[k] AS source, sizes[k] AS n, ['train', 'val', 'test'][place[k]] AS split FROM f JOIN o USING (lang), unnest(range(1, len(sizes) + 1)) AS u(k)"""
)
def group_split(spark, d):
    return split.group_split(read(spark, d, "documents"), "lang", "source", 7)


@query(f"WITH {_HASH_SPLIT}, t AS (SELECT lang, split, sum(n) AS n FROM s GROUP BY lang, split) SELECT lang, split, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY lang), 6) AS share FROM t")
def split_shares(spark, d):
    docs = read(spark, d, "documents")
    rows = docs.join(hash_split(spark, d).select("lang", "source", "split"), ["lang", "source"])
    return split.split_shares(rows, ["lang"], dict(zip(split.SPLITS, split.TARGETS, strict=True))).select("lang", "split", "n", "share")


@query(
    f"""WITH {_HASH_SPLIT}, r AS (SELECT d.lang, d.source, CASE WHEN doc_id % 50 = 0 THEN 'test' ELSE s.split END AS split FROM documents d JOIN s USING (lang, source)), g AS (SELECT DISTINCT lang FROM documents UNION SELECT 'zz'), k(split) AS (VALUES ('train'), ('val'), ('test'))
    SELECT 'empty_split' AS gate, lang, split AS detail FROM g, k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.lang = g.lang AND r.split = k.split) UNION ALL SELECT 'group_in_several_splits', lang, source FROM r GROUP BY lang, source HAVING count(DISTINCT split) > 1"""
)
def split_gates(spark, d):
    """Gates over a split that breaks them: every fiftieth document is in the test part whatever its group, and one family has no rows."""
    docs = read(spark, d, "documents").select("doc_id", "lang", "source").join(hash_split(spark, d).select("lang", "source", "split"), ["lang", "source"])
    rows = docs.withColumn("split", F.when(F.col("doc_id") % 50 == 0, "test").otherwise(F.col("split")))
    return split.split_gates(rows, rows.select("lang").distinct().unionByName(small(spark, ["zz"], "lang")), "lang", "source")


@query(f"WITH {_HASH_SPLIT}, r AS (SELECT d.doc_id, d.source, d.text, s.split FROM documents d JOIN s USING (lang, source)) SELECT 'source' AS key_name, source AS key, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM r GROUP BY source HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'sha', sha256(coalesce(text, '')), array_to_string(list_sort(list(DISTINCT split)), ',') FROM r GROUP BY 2 HAVING count(DISTINCT split) > 1")
def leakage_audit(spark, d):
    docs = documents(spark, d).select("lang", "source", F.sha2("text", 256).alias("sha"))
    rows = docs.join(hash_split(spark, d).select("lang", "source", "split"), ["lang", "source"])
    return split.leaks(rows, ["source", "sha"]).select("key_name", "key", F.array_join("splits", ",").alias("splits"))


@query("WITH g AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY sha256('5:' || source), source) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT DISTINCT lang, source FROM documents)) SELECT lang, source, r AS selection_rank FROM g WHERE r < greatest(1, ceil(n * CAST(0.25 AS DOUBLE)))")
def group_subset(spark, d):
    return sampling.group_subset(read(spark, d, "documents"), "lang", "source", 0.25, 5).select("lang", "source", F.col("selection_rank").cast("long"))


@query("WITH g AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY sha256('5:' || source), source) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT DISTINCT lang, source FROM documents)), c AS (SELECT lang, source, r < greatest(1, ceil(n * CAST(0.25 AS DOUBLE))) AS chosen FROM g) SELECT lang, count(DISTINCT source) AS full_groups, count(DISTINCT source) FILTER (WHERE chosen) AS subset_groups, count(DISTINCT doc_id) AS full_records, count(DISTINCT doc_id) FILTER (WHERE chosen) AS subset_records, round(count(DISTINCT source) FILTER (WHERE chosen) / count(DISTINCT source), 4) AS groups_ratio, round(count(DISTINCT doc_id) FILTER (WHERE chosen) / count(DISTINCT doc_id), 4) AS records_ratio FROM documents JOIN c USING (lang, source) GROUP BY lang")
def subset_statistics(spark, d):
    docs = read(spark, d, "documents").select("lang", "source", "doc_id")
    rows = docs.join(group_subset(spark, d).select("lang", "source", F.lit(True).alias("chosen")), ["lang", "source"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    return sampling.subset_statistics(rows, ["lang"], "source", "doc_id", "doc_id", "chosen").select("lang", "full_groups", "subset_groups", "full_records", "subset_records", "groups_ratio", "records_ratio")


# ---- models over vectors ---------------------------------------------------------------------


@query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(avg(CAST(embedding[i + 1] AS DOUBLE) * CAST(embedding[j + 1] AS DOUBLE)), 6) AS moment FROM embeddings, unnest(range(64)) AS u(i), unnest(range(64)) AS w(j) WHERE len(embedding) = 64 AND i <= j GROUP BY i, j")
def second_moments(spark, d):
    m = learning.moments(read(spark, d, "embeddings"), "embedding").second
    cells = [(i, j, float(m[i, j])) for i in range(len(m)) for j in range(i, len(m))]  # by dimensions, not by rows
    return spark.createDataFrame(cells, "i int, j int, moment double").select("i", "j", six(F.col("moment")).alias("moment"))


def _unit(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", "label", arrays.l2_normalized(F.col("embedding")).alias("x"))


@query()
def pca_projection(spark, d):
    """Normalised vectors in two dimensions, the linear stand-in for a neighbour embedding."""
    rows = _unit(spark, d)
    return learning.projected(rows, "x", learning.principal_components(rows, "x"), ["x0", "x1"]).select("vec_id", "label", six(F.col("x0")).alias("x0"), six(F.col("x1")).alias("x1"))


def _parts(spark, d) -> DataFrame:
    """Vectors with a part by number: six in ten to learn from, two to choose by, two to test."""
    part = F.col("vec_id") % 10
    return read(spark, d, "embeddings").select("vec_id", "label", "embedding", F.when(part < 6, "train").when(part < 8, "val").otherwise("test").alias("split"))


def _classified(spark, d, **how) -> DataFrame:
    rows = _parts(spark, d)
    labels = sorted(r["label"] for r in rows.select("label").distinct().where("label is not null").limit(1000).collect())
    seen = rows.where("split <> 'test'").withColumn("validation", F.col("split") == "val")
    features = learning.kernel_features(seen.where("not validation"), "embedding") if how.get("loss") == "squared_hinge" else None
    head = learning.train_head(seen, "embedding", "label", "validation", labels, features=features, **how)
    return learning.predictions(rows, "embedding", head).select("vec_id", "split", "label", "pred_label", F.round("top1_score", 6).alias("top1_score"))


@query()
def linear_head(spark, d):
    """Predictions of a linear head that gradients summed over the tasks have trained."""
    return _classified(spark, d, lr=0.05, epochs=30, patience=8)


@query()
def kernel_head(spark, d):
    """Predictions of a margin classifier over random features of a kernel: another model than an exact kernel machine, for the same use."""
    return _classified(spark, d, loss="squared_hinge", lr=0.05, weight_decay=0.001, epochs=30, patience=8)


@query()
def head_metrics(spark, d):
    """The linear head's predictions of the test part through the evaluation's metrics."""
    return metrics.macro(metrics.confusion(linear_head(spark, d).where("split = 'test'"), "label", "pred_label"))


@query("SELECT label, count(*) AS n, round(1 / count(*), 9) AS weight FROM embeddings GROUP BY label")
def class_weights(spark, d):
    return sampling.class_weights(read(spark, d, "embeddings"), "label").select("label", "n", F.round("weight", 9).alias("weight"))


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= CASE lang WHEN 'en' THEN 12 ELSE 6 END")
def sample_per_split(spark, d):
    docs = read(spark, d, "documents").select("lang", "doc_id")
    return sampling.first_per(docs, "lang", ["doc_id"], docs.select("lang").distinct().withColumn("limit", F.when(F.col("lang") == "en", 12).otherwise(6)))


# ---- segments and signals --------------------------------------------------------------------


@query("SELECT doc_id, CAST(u.i AS INTEGER) AS segment_position, CAST(u.i * 400 AS BIGINT) AS start, CAST(CASE WHEN n < 400 THEN n ELSE (u.i + 1) * 400 END AS BIGINT) AS stop, n < 400 AS is_padded FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents) d, unnest(range(0, CASE WHEN n < 240 THEN 0 WHEN n < 400 THEN 1 ELSE n // 400 END)) AS u(i)")
def segment_blocks(spark, d):
    docs = documents(spark, d).select("doc_id", F.explode(segments.segment_bounds(F.length("text"), 400, 240)).alias("s"))
    return docs.select("doc_id", F.col("s.index").alias("segment_position"), F.col("s.start").alias("start"), F.col("s.stop").alias("stop"), F.col("s.padded").alias("is_padded"))


@query("SELECT l_orderkey, l_linenumber, i AS segment_index FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) - 1 AS i, l_returnflag FROM lineitem) JOIN (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag) USING (l_returnflag) WHERE i < greatest(2, ceil(n * CAST(0.0001 AS DOUBLE)))")
def concentration_cap(spark, d):
    items = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    out = segments.capped(items, "l_orderkey", "l_returnflag", "l_linenumber", items.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows")), 2, 0.0001, tie=["l_returnflag"])
    return out.select("l_orderkey", "l_linenumber", F.col("segment_index").cast("long"))


@query("WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000 AS t FROM events), m AS (SELECT *, CASE WHEN t - lag(t) OVER w > 3600 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT user_id, CAST(island AS BIGINT) AS island, round(min(t), 6) AS start, round(max(t), 6) AS stop, count(*) AS n FROM g GROUP BY user_id, island")
def gap_islands(spark, d):
    events = read(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return segments.islands(events, ["user_id"], "t", 3600.0, "event_id").withColumn("start", six(F.col("start"))).withColumn("stop", six(F.col("stop")))


@query(
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000 AS t FROM events), m AS (SELECT *, CASE WHEN t - lag(t) OVER w > 3600 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m), s AS (SELECT user_id, round(min(t), 6) AS a, round(max(t), 6) AS b FROM g GROUP BY user_id, island),
    k AS (SELECT user_id, (a + b) / 2.0 AS mid, row_number() OVER (PARTITION BY user_id ORDER BY a, b) AS i FROM s), u AS (SELECT user_id, max(b) AS total, count(*) AS n FROM s GROUP BY user_id),
    p AS (SELECT u.user_id, x.i, coalesce(l.mid, 0.0) AS start, coalesce(r.mid, u.total) AS stop FROM u, unnest(range(0, u.n + 1)) AS x(i) LEFT JOIN k l ON l.user_id = u.user_id AND l.i = x.i LEFT JOIN k r ON r.user_id = u.user_id AND r.i = x.i + 1),
    j AS (SELECT *, sum(CASE WHEN i = 0 OR stop - start >= 7200.0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS piece FROM p),
    q AS (SELECT user_id, piece, min_by(start, i) AS start, max_by(stop, i) AS stop FROM j GROUP BY user_id, piece), f AS (SELECT user_id, stop - start < 7200.0 AS short FROM q WHERE piece = 1),
    z AS (SELECT q.user_id, CASE WHEN short AND piece = 2 THEN 1 ELSE piece END AS piece, start, stop FROM q JOIN f USING (user_id))
    SELECT user_id, min(start) AS start, max(stop) AS stop FROM z GROUP BY user_id, piece"""
)
def merge_short_islands(spark, d):
    runs_ = gap_islands(spark, d).groupBy("user_id").agg(F.max("stop").alias("total"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("s"))
    return runs_.select("user_id", F.explode(segments.pieces_between(F.col("total"), F.col("s"), 7200.0)).alias("p")).select("user_id", "p.start", "p.stop")


def _levels(spark, d) -> DataFrame:
    events = read(spark, d, "events").select("user_id", "event_id", "value")
    return events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda e: F.coalesce(e["value"], F.lit(0.0)) / 1000).alias("x"))


@query("WITH a AS (SELECT user_id, list(coalesce(value, 0) / 1000 ORDER BY event_id) AS x FROM events GROUP BY user_id), f AS (SELECT user_id, len(x) AS n, CASE WHEN len(x) < 4 THEN [] ELSE list_transform(range(1, len(x) - 2, 2), lambda s: 20 * log10(sqrt(list_sum(list_transform(x[s:s + 3], lambda v: v * v)) / 4) + 1e-10)) END AS db FROM a) SELECT user_id, round(CASE WHEN n < 4 THEN 1.0 ELSE len(list_filter(db, lambda v: v < -40)) / len(db) END, 6) AS silence_ratio FROM f")
def silence_ratio(spark, d):
    return _levels(spark, d).select("user_id", six(signal.frame_silence_ratio(F.col("x"), 4, 2)).alias("silence_ratio"))


@query("SELECT vec_id, round(len(list_filter(embedding, lambda x: abs(x) >= CAST(0.2 AS DOUBLE))) / len(embedding), 6) AS clipping_ratio FROM embeddings")
def clipping_ratio(spark, d):
    return read(spark, d, "embeddings").select("vec_id", six(signal.clipping_ratio(F.transform("embedding", lambda x: x.cast("double")), 0.2)).alias("clipping_ratio"))


@query("WITH n AS (SELECT vec_id, embedding, greatest(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 1e-12) AS n FROM embeddings) SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x / n)), 6) AS total, round(embedding[1] / n, 6) AS first FROM n")
def l2_normalize(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", arrays.l2_normalized(F.col("embedding")).alias("v"))
    return v.select("vec_id", six(arrays.total(F.col("v"))).alias("total"), six(F.element_at("v", 1)).alias("first"))


@query("WITH s AS (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - list_max(embedding)))) AS z FROM embeddings) SELECT vec_id, round(1 / z, 6) AS score, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred FROM s")
def softmax_top1(spark, d):
    return read(spark, d, "embeddings").select("vec_id", six(F.array_max(arrays.softmax(F.col("embedding")))).alias("score"), arrays.argmax(F.col("embedding")).alias("pred"))


@query("SELECT label, i, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY label, i")
def mean_pooling(spark, d):
    return read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", F.col("i").cast("long").alias("i")).agg(six(F.avg(F.col("x").cast("double"))).alias("mean"))


# ---- joins -----------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, o_custkey, o_orderstatus FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def segment_join_validated(spark, d):
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    return joins.many_to_one(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), orders, ["l_orderkey"])


@query("SELECT l_orderkey, 'late' AS field, CAST(l_shipdate > o_orderdate + INTERVAL 60 DAY AS VARCHAR) AS \"left\", CAST(o_orderstatus = 'F' AS VARCHAR) AS \"right\" FROM (SELECT l_orderkey, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY l_orderkey) JOIN orders ON l_orderkey = o_orderkey WHERE (l_shipdate > o_orderdate + INTERVAL 60 DAY) IS DISTINCT FROM (o_orderstatus = 'F')")
def join_violations(spark, d):
    orders = read(spark, d, "orders")
    last = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ship"))
    dated = last.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey").select("l_orderkey", (F.col("ship") > F.date_add(F.col("o_orderdate").cast("date"), 60)).alias("late"))
    return joins.disagreements(dated, orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") == "F").alias("late")), ["l_orderkey"], ["late"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def orders_without_items(spark, d):
    """All orders; only large lines count as items, so that some orders have none (the filter is the case)."""
    big = read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.unmatched(read(spark, d, "orders").select("o_orderkey"), big, ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey, c.place FROM orders JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer WHERE c_acctbal > 5000) c ON o_custkey = c_custkey")
def semi_ordered(spark, d):
    """All orders of the customers on a list; the list is of those above a balance (the filter is the case)."""
    rich = read(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    listed = numbering.numbers(rich, [], [-F.col("c_acctbal"), "o_custkey"], "place").drop("c_acctbal")
    return joins.in_listed_order(read(spark, d, "orders").select("o_orderkey", "o_custkey"), listed, "o_custkey", "place")


@query("SELECT n_nationkey, status FROM nation, (VALUES ('F'), ('O'), ('P'), ('X')) v(status) WHERE NOT EXISTS (SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND o_orderstatus = status)")
def completeness_grid(spark, d):
    have = read(spark, d, "orders").join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("n_nationkey"), F.col("o_orderstatus").alias("status"))
    return joins.missing_cells([read(spark, d, "nation").select("n_nationkey"), small(spark, ["F", "O", "P", "X"], "status")], have, ["n_nationkey", "status"])


@query("SELECT nationkey, status, CAST(count(DISTINCT m) AS BIGINT) AS n FROM (SELECT n_nationkey AS nationkey, status FROM nation, (VALUES ('F'), ('O'), ('P')) v(status)) g LEFT JOIN (SELECT c_nationkey, o_orderstatus, dayofyear(o_orderdate) AS m FROM orders JOIN customer ON o_custkey = c_custkey) h ON c_nationkey = nationkey AND o_orderstatus = status GROUP BY nationkey, status HAVING count(DISTINCT m) <> 366")
def incomplete_cells(spark, d):
    have = read(spark, d, "orders").join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nationkey"), F.col("o_orderstatus").alias("status"), F.dayofyear("o_orderdate").alias("m"))
    grid = read(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey")).crossJoin(small(spark, ["F", "O", "P"], "status"))
    return rollup.incomplete(have, grid, ["nationkey", "status"], "m", 366)


@query("SELECT key, source_rank, amount FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source_rank, amount) AS r FROM (SELECT c_nationkey AS key, 0 AS source_rank, round(max(c_acctbal), 6) AS amount FROM customer WHERE c_nationkey < 12 GROUP BY 1 UNION ALL SELECT s_nationkey, 1, round(max(s_acctbal), 6) FROM supplier GROUP BY 1)) WHERE r = 1")
def union_keep_first(spark, d):
    """Customers of some nations first, then all suppliers, so that either side has keys of its own (the filter is the case)."""
    a = read(spark, d, "customer").where("c_nationkey < 12").groupBy(F.col("c_nationkey").alias("key")).agg(six(F.max("c_acctbal")).alias("amount"))
    b = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(six(F.max("s_acctbal")).alias("amount"))
    return joins.keep_first([a, b], ["key"]).select("key", "source_rank", "amount")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, 'missing_file' AS problem FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.05) UNION ALL SELECT CAST(k AS VARCHAR), 'unlisted_file' FROM (SELECT DISTINCT l_partkey + 0 AS k FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.05) WHERE k NOT IN (SELECT p_partkey FROM part)")
def listing_differences(spark, d):
    """All parts against a listing; the listing is of the parts of some lines, so that files are missing (the filter is the case)."""
    part = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"))
    return joins.listing_differences(part, read(spark, d, "lineitem").where("l_quantity > 49 and l_discount > 0.05").select(F.col("l_partkey").cast("string").alias("path")))


# ---- metrics and rollups ---------------------------------------------------------------------


def _predicted(spark, d) -> DataFrame:
    return metrics.nearest_centroid(read(spark, d, "embeddings"), "embedding", "label", "vec_id")


_PREDICTED = """c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
p AS (SELECT vec_id, e.label AS true_label, arg_min(c.label, {'d': round(list_sum(list_transform(list_zip(e.embedding, c.centre), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))), 9), 'l': c.label}) AS pred_label FROM embeddings e, c GROUP BY vec_id, e.label),
t AS (SELECT true_label, pred_label, count(*) AS n FROM p GROUP BY ALL)"""
_SCORED = """l AS (SELECT label, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (SELECT true_label AS label, n AS support, 0 AS predicted, CASE WHEN true_label = pred_label THEN n ELSE 0 END AS tp FROM t UNION ALL SELECT pred_label, 0, n, 0 FROM t) GROUP BY label),
s AS (SELECT label, support, tp, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN predicted + support > 0 THEN 2 * tp / (predicted + support) ELSE 0 END AS f1 FROM l)"""


@query(f"WITH {_PREDICTED}, {_SCORED} SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, CAST(sum(support) AS BIGINT) AS num_samples FROM s")
def metrics_macro(spark, d):
    out = metrics.macro(metrics.confusion(_predicted(spark, d), "true_label", "pred_label"))
    return out.select(*(six(F.col(c)).alias(c) for c in ("accuracy", "macro_f1", "macro_precision", "macro_recall")), "num_samples")


@query(f"WITH {_PREDICTED}, {_SCORED} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM s")
def per_class(spark, d):
    cells = metrics.confusion(_predicted(spark, d), "true_label", "pred_label")
    out = metrics.per_class(cells, read(spark, d, "embeddings").select("label").distinct())
    return out.select("label", *(six(F.col(c)).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"WITH {_PREDICTED}, k AS (SELECT DISTINCT label FROM embeddings), g AS (SELECT a.label AS true_label, b.label AS pred_label, coalesce(n, 0) AS n FROM k a CROSS JOIN k b LEFT JOIN t ON t.true_label = a.label AND t.pred_label = b.label) SELECT true_label, pred_label, n, round(CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w ELSE 0 END, 6) AS rate FROM g WINDOW w AS (PARTITION BY true_label)")
def confusion_long(spark, d):
    cells = metrics.confusion(_predicted(spark, d), "true_label", "pred_label")
    return metrics.dense(cells, read(spark, d, "embeddings").select("label").distinct()).select("true_label", "pred_label", "n", six(F.col("rate")).alias("rate"))


@query("SELECT l_returnflag AS true_label, count(*) FILTER (WHERE l_linestatus = 'F') AS \"pred_F\", count(*) FILTER (WHERE l_linestatus = 'O') AS \"pred_O\" FROM lineitem GROUP BY l_returnflag")
def confusion_wide(spark, d):
    return metrics.wide(metrics.confusion(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus"), ["F", "O"])


@query("WITH t AS (SELECT l_returnflag AS true_label, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY l_returnflag) SELECT true_label, 'F' AS pred_label, f AS n FROM t UNION ALL SELECT true_label, 'O', o FROM t")
def unpivot_pivot(spark, d):
    return metrics.melted(confusion_wide(spark, d))


@query("WITH t AS (SELECT l_method AS method, l_linenumber AS seed, l_returnflag AS true_label, l_linestatus AS pred_label, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY method, seed, true_label) AS rate FROM t) SELECT method, true_label, pred_label, round(avg(n), 6) AS n_mean, round(stddev_samp(n), 6) AS n_std, round(avg(rate), 6) AS rate_mean, round(stddev_samp(rate), 6) AS rate_std, count(DISTINCT seed) AS seed_count FROM r GROUP BY method, true_label, pred_label")
def confusion_mean_std(spark, d):
    cells = metrics.confusion(read(spark, d, "lineitem").withColumnsRenamed({"l_method": "method", "l_linenumber": "seed"}), "l_returnflag", "l_linestatus", ["method", "seed"])
    out = metrics.mean_cells(cells, ["method"])
    return out.select("method", "true_label", "pred_label", *(six(F.col(c)).alias(c) for c in ("n_mean", "n_std", "rate_mean", "rate_std")), "seed_count")


@query(f"WITH m AS ({SQL['confusion_mean_std']}) SELECT method, true_label, pred_label, round(n_mean / sum(n_mean) OVER (PARTITION BY method, true_label), 5) AS rate_of_means FROM m")
def confusion_mean_matrix(spark, d):
    out = metrics.mean_matrix(confusion_mean_std(spark, d), ["method"])
    return out.select("method", "true_label", "pred_label", F.round("rate_of_means", 5).alias("rate_of_means"))


@query("WITH m AS (SELECT l_orderkey, l_returnflag, round(avg(l_tax), 9) AS score FROM lineitem GROUP BY ALL) SELECT l_orderkey, arg_min(l_returnflag, {'s': -score, 'l': l_returnflag}) AS pred_label, max(score) AS score FROM m GROUP BY l_orderkey")
def template_average(spark, d):
    return metrics.averaged_predictions(read(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_tax")


@query("SELECT l_orderkey, l_linenumber AS layer_index FROM lineitem WHERE l_linenumber = (SELECT max(l_linenumber) FROM lineitem)")
def last_layer(spark, d):
    items = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("layer_index"))
    return metrics.last_layer(items).select("l_orderkey", "layer_index")


_RUNS = "r AS (SELECT l_method AS method, l_returnflag AS split, l_linenumber AS seed, avg(l_discount) AS accuracy, avg(l_tax) AS macro_f1, count(*) AS num_samples FROM lineitem GROUP BY ALL)"


def _runs(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").groupBy(F.col("l_method").alias("method"), F.col("l_returnflag").alias("split"), F.col("l_linenumber").alias("seed")).agg(F.avg("l_discount").alias("accuracy"), F.avg("l_tax").alias("macro_f1"), F.count(F.lit(1)).alias("num_samples"))


@query(f"WITH {_RUNS} SELECT method, split, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_samp(accuracy), 6) AS accuracy_std, round(avg(macro_f1), 6) AS macro_f1_mean, round(stddev_samp(macro_f1), 6) AS macro_f1_std, count(DISTINCT seed) AS seed_count, CASE WHEN min(num_samples) = max(num_samples) THEN min(num_samples) ELSE CAST(floor(median(num_samples)) AS BIGINT) END AS num_samples_per_seed FROM r GROUP BY method, split")
def mean_std_rollup(spark, d):
    out = rollup.mean_std(_runs(spark, d), ["method", "split"], ("accuracy", "macro_f1"), samples="num_samples")
    return out.select("method", "split", *(six(F.col(c)).alias(c) for c in ("accuracy_mean", "accuracy_std", "macro_f1_mean", "macro_f1_std")), "seed_count", "num_samples_per_seed")


@query("SELECT event_type, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std, round(avg(value) FILTER (WHERE user_id % 50 = 0), 6) AS memory_mean, round(CASE WHEN count(*) FILTER (WHERE user_id % 50 = 0) = 1 THEN 0.0 ELSE stddev_samp(value) FILTER (WHERE user_id % 50 = 0) END, 6) AS memory_std, count(*) FILTER (WHERE user_id % 50 = 0) AS memory_runs FROM events GROUP BY event_type")
def cost_rollup(spark, d):
    events = read(spark, d, "events").select("event_type", "value", F.col("value").alias("memory"), (F.col("user_id") % 50 == 0).alias("available"))
    out = rollup.cost_summary(events, ["event_type"], ["value"], "memory", "available")
    return out.select("event_type", *(six(F.col(c)).alias(c) for c in ("value_mean", "value_std", "memory_mean", "memory_std")), "memory_runs")


@query(f"WITH {_RUNS}, p AS (SELECT method, round(avg(macro_f1), 6) AS f1 FROM r GROUP BY method), c AS (SELECT l_method AS method, count(DISTINCT l_suppkey) AS cost FROM lineitem GROUP BY 1) SELECT method, f1, cost FROM p JOIN c USING (method) ORDER BY f1 DESC, cost, method LIMIT 1")
def select_best(spark, d):
    perf = _runs(spark, d).groupBy("method").agg(six(F.avg("macro_f1")).alias("f1"))
    cost = read(spark, d, "lineitem").groupBy(F.col("l_method").alias("method")).agg(F.count_distinct("l_suppkey").alias("cost"))
    return rollup.best(perf.join(cost, "method"), [F.desc("f1"), F.col("cost"), F.col("method")])


@query("WITH t AS (SELECT event_type AS kind, event_id, round(value, 6) AS score, row_number() OVER (PARTITION BY event_type ORDER BY round(value, 6) DESC, event_id) AS r FROM events WHERE value IS NOT NULL), o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN r = 1 THEN 0 ELSE 1 END, score DESC, event_id) AS case_rank FROM t) SELECT kind, event_id, score, case_rank FROM o WHERE case_rank <= 20")
def topk_diverse(spark, d):
    """All events with a score; rows without one cannot be ranked."""
    events = read(spark, d, "events").where("value is not null").select(F.col("event_type").alias("kind"), "event_id", six(F.col("value")).alias("score"))
    return rollup.diverse_top_k(events, "kind", "score", "event_id", 20).select("kind", "event_id", "score", F.col("case_rank").cast("long"))


@query("SELECT pair, count(*) AS n, round(avg(q), 6) AS score_mean, round(min(q), 6) AS score_min, round(max(q), 6) AS score_max FROM (SELECT l_returnflag || ' → ' || l_linestatus AS pair, l_quantity AS q FROM lineitem WHERE l_returnflag <> l_linestatus) GROUP BY pair")
def error_pairs(spark, d):
    errors = rollup.error_cases(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus").withColumn("score", F.col("l_quantity").cast("double"))
    return rollup.pair_summary(errors).select(F.col("error_pair").alias("pair"), "n", *(six(F.col(c)).alias(c) for c in ("score_mean", "score_min", "score_max")))


@query("SELECT p_brand, p_partkey, CAST(row_number() OVER w AS INTEGER) AS rank, row_number() OVER w = 1 AS is_best FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)")
def rank_in_class(spark, d):
    return rollup.ranked(read(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", ["p_partkey"]).drop("p_retailprice")


@query("SELECT p_brand, arg_min(p_partkey, {'a': p_retailprice, 'b': p_partkey}) AS worst, arg_min(p_partkey, {'a': -p_retailprice, 'b': p_partkey}) AS best FROM part GROUP BY p_brand")
def class_extremes(spark, d):
    return rollup.extremes(read(spark, d, "part"), ["p_brand"], "p_partkey", "p_retailprice")


def _layers(spark, d) -> DataFrame:
    items = read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("layer_index"), F.when(F.col("l_linestatus") == "F", "test").otherwise("external_test").alias("split"), F.col("l_method").alias("seed")).agg(F.round(F.avg("l_tax"), 6).alias("macro_f1"))
    return rollup.mean_std(items, ["layer_index", "split"], ("macro_f1",))


@query(
    """WITH r AS (SELECT l_linenumber AS layer_index, CASE WHEN l_linestatus = 'F' THEN 'test' ELSE 'external_test' END AS split, l_method, round(avg(l_tax), 6) AS f FROM lineitem GROUP BY ALL), m AS (SELECT layer_index, split, avg(f) AS a, stddev_samp(f) AS s FROM r GROUP BY layer_index, split),
    b AS (SELECT split, arg_min(layer_index, {'a': -a, 'l': layer_index}) AS best FROM m GROUP BY split), c AS (SELECT layer_index, split, CASE WHEN layer_index = best THEN '**' || printf('%.4f±%.4f', a, s) || '**' ELSE printf('%.4f±%.4f', a, s) END AS cell FROM m JOIN b USING (split))
    SELECT layer_index, coalesce(max(cell) FILTER (WHERE split = 'test'), '-') AS test, coalesce(max(cell) FILTER (WHERE split = 'external_test'), '-') AS external_test FROM c GROUP BY layer_index"""
)
def layer_table(spark, d):
    return rollup.layer_table(_layers(spark, d))


@query(f"WITH {_RUNS}, c AS (SELECT l_method AS method, avg(l_extendedprice) AS x FROM lineitem GROUP BY l_method, l_linenumber) SELECT * FROM (SELECT method, split, round(avg(macro_f1), 6) AS macro_f1_mean, round(stddev_samp(macro_f1), 6) AS macro_f1_std FROM r GROUP BY method, split) LEFT JOIN (SELECT method, round(avg(x), 4) AS cost_mean, round(stddev_samp(x), 4) AS cost_std FROM c GROUP BY method) USING (method)")
def learning_curve(spark, d):
    cost = read(spark, d, "lineitem").groupBy(F.col("l_method").alias("method"), "l_linenumber").agg(F.avg("l_extendedprice").alias("cost"))
    out = rollup.curve_points(_runs(spark, d), cost, ["method"], ("macro_f1",), ("cost",))
    return out.select("method", "split", six(F.col("macro_f1_mean")).alias("macro_f1_mean"), six(F.col("macro_f1_std")).alias("macro_f1_std"), F.round("cost_mean", 4).alias("cost_mean"), F.round("cost_std", 4).alias("cost_std"))


@query("SELECT l_returnflag, l_linestatus, l_method, count(*) AS n, count(DISTINCT l_suppkey) AS n_distinct FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_method), ())")
def size_by_all_groupings(spark, d):
    return rollup.grouping_sizes(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_method"], "l_suppkey")


# ---- registries and JSON ---------------------------------------------------------------------


@query("WITH l AS (SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'purchase') WHERE r = 1) SELECT coalesce(c_custkey, user_id) AS run_id, CASE WHEN user_id IS NOT NULL THEN event_type ELSE 'new' END AS status, CASE WHEN user_id IS NOT NULL THEN event_id END AS event_id, CASE WHEN c_custkey IS NOT NULL THEN c_mktsegment END AS segment FROM customer FULL JOIN l ON c_custkey = user_id")
def registry_upsert(spark, d):
    """All customers as old rows; events but purchases as new ones, so that some rows stay as they were (the filter is the case)."""
    events = read(spark, d, "events").where("event_type <> 'purchase'")
    new = registry.latest(events, "user_id", [F.desc("ts"), F.desc("event_id")]).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("status"), "event_id")
    old = read(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.lit("new").alias("status"), F.col("c_mktsegment").alias("segment"))
    return registry.upserted(old, new, "run_id")


@query("SELECT user_id, count(*) AS runs, CASE WHEN bool_and(s = 'completed') AND count(*) = 12 THEN 'completed' WHEN bool_or(s IN ('failed', 'blocked')) THEN 'failed' ELSE 'partial' END AS status FROM (SELECT user_id, CASE WHEN event_id % 41 = 0 THEN 'failed' WHEN event_id % 43 = 0 THEN 'running' ELSE 'completed' END AS s FROM events) GROUP BY user_id")
def status_rollup(spark, d):
    status = F.when(F.col("event_id") % 41 == 0, "failed").when(F.col("event_id") % 43 == 0, "running").otherwise("completed")
    return rollup.status_rollup(read(spark, d, "events").select("user_id", status.alias("status")), "user_id")


@query("SELECT n AS run_id, coalesce(s, 'missing') AS problem FROM (SELECT doc_id AS n FROM documents) LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'completed' ELSE 'failed' END AS s FROM labels) ON n = doc_id WHERE s IS DISTINCT FROM 'completed'")
def registry_gaps(spark, d):
    have = read(spark, d, "labels").select(F.col("doc_id").alias("run_id"), F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"))
    return registry.not_completed(have, read(spark, d, "documents").select(F.col("doc_id").alias("run_id")))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props)) AS n_keys FROM events")
def json_props(spark, d):
    events = read(spark, d, "events")
    return events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.json_object_keys("props").alias("keys")).select("event_id", "k", F.size("keys").cast("long").alias("n_keys"))


# ---- analysis tables -------------------------------------------------------------------------

#: A line's method, the split of its status, and its return flag as the class.
_CLASSES = "SELECT l_method AS method, CASE WHEN l_linestatus = 'F' THEN 'test' ELSE 'external_test' END AS split, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label_id, round(avg(l_tax), 6) AS f1_mean FROM lineitem GROUP BY ALL"


@query(
    f"""WITH c AS ({_CLASSES}), t AS (SELECT *, CASE WHEN method IN ('m0', 'm1') THEN 1 ELSE 2 END AS source_phase, CASE method WHEN 'm1' THEN 'one' WHEN 'm2' THEN 'two' WHEN 'm0' THEN 'zero' END AS method_short FROM c), p AS (SELECT *, CASE method_short WHEN 'two' THEN 0 WHEN 'zero' THEN 1 WHEN 'one' THEN 2 ELSE 99 END AS place FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY split, label_id ORDER BY f1_mean DESC, source_phase, place, method) AS rank FROM p)
    SELECT method, split, label_id, f1_mean, source_phase, method_short, method = 'm3' AS is_best_phase2, method = 'm2' AS is_best_lora, rank AS rank_in_split_class_by_f1_mean, rank = 1 AS is_best_in_class FROM r"""
)
def class_table(spark, d):
    """Classes of two phases' methods in one table, ranked within split and class."""
    items = read(spark, d, "lineitem")
    split_ = F.when(F.col("l_linestatus") == "F", "test").otherwise("external_test")
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    classes = items.groupBy(F.col("l_method").alias("method"), split_.alias("split"), label.alias("label_id")).agg(six(F.avg("l_tax")).alias("f1_mean"))
    first, second = classes.where("method in ('m0', 'm1')"), classes.where("method not in ('m0', 'm1')")
    return analysis.class_tables(first, second, {"m1": "one", "m2": "two", "m0": "zero"}, ["two", "zero", "one"], "m3", "m2")


_CELLS = "SELECT l_method AS method, 's' || CAST(l_linenumber % 3 AS VARCHAR) AS seed, l_returnflag AS true_label, CASE l_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS pred_label, count(*) AS n FROM lineitem GROUP BY ALL"


@query(
    f"""WITH o AS ({_CELLS}), v(x) AS (VALUES ('A'), ('N'), ('R')), g AS (SELECT DISTINCT method, seed FROM (SELECT DISTINCT method FROM o), (VALUES ('s0'), ('s1'), ('s2')) w(seed)),
    c AS (SELECT g.method, g.seed, a.x AS true_label, b.x AS pred_label, coalesce(n, 0) AS n FROM g, v a, v b LEFT JOIN o ON o.method = g.method AND o.seed = g.seed AND o.true_label = a.x AND o.pred_label = b.x),
    r AS (SELECT *, coalesce(n / nullif(sum(n) OVER (PARTITION BY method, seed, true_label), 0), 0) AS rate FROM c)
    SELECT method, true_label, pred_label, round(avg(n), 6) AS count_mean, round(stddev_samp(n), 6) AS count_std, round(avg(rate), 6) AS rate_mean, round(stddev_samp(rate), 6) AS rate_std, count(DISTINCT seed) AS n_seeds FROM r GROUP BY ALL"""
)
def confusion_table(spark, d):
    """Confusion counts and row rates over seeds, as mean and deviation."""
    pred = F.when(F.col("l_partkey") % 3 == 0, "A").when(F.col("l_partkey") % 3 == 1, "N").otherwise("R")
    cells = read(spark, d, "lineitem").groupBy(F.col("l_method").alias("method"), F.concat(F.lit("s"), (F.col("l_linenumber") % 3).cast("string")).alias("seed"), F.col("l_returnflag").alias("true_label"), pred.alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))
    labels = [small(spark, ["A", "N", "R"], c) for c in ("true_label", "pred_label")]
    grid = cells.select("method").distinct().crossJoin(small(spark, ["s0", "s1", "s2"], "seed")).crossJoin(labels[0]).crossJoin(labels[1])  # a row a cell, as confusion files have it
    dense = grid.join(cells, grid.columns, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = analysis.confusion_tables(dense, ["method"])
    return out.select("method", "true_label", "pred_label", *(six(F.col(c)).alias(c) for c in ("count_mean", "count_std", "rate_mean", "rate_std")), "n_seeds")


@query(
    """WITH k(ratio_name, ratio, step) AS (VALUES ('train25', CAST(0.25 AS DOUBLE), 0), ('train100', CAST(1 AS DOUBLE), 1000)), s(seed_name, seed) AS (VALUES ('seed0', 5), ('seed1', 11)),
    g AS (SELECT ratio_name, seed_name, lang, source, row_number() OVER (PARTITION BY ratio_name, seed_name, lang ORDER BY sha256(CAST(seed + step AS VARCHAR) || ':' || source), source) - 1 AS r, count(*) OVER (PARTITION BY ratio_name, seed_name, lang) AS n, ratio FROM (SELECT DISTINCT lang, source FROM documents), k, s),
    c AS (SELECT ratio_name, seed_name, lang, source, r < greatest(1, ceil(n * ratio)) AS chosen FROM g)
    SELECT ratio_name, seed_name, lang AS family_label, count(DISTINCT source) AS full_groups, count(DISTINCT source) FILTER (chosen) AS subset_groups, count(DISTINCT doc_id) AS full_records, count(DISTINCT doc_id) FILTER (chosen) AS subset_records, round(count(DISTINCT source) FILTER (chosen) / count(DISTINCT source), 4) AS groups_ratio, round(count(DISTINCT doc_id) FILTER (chosen) / count(DISTINCT doc_id), 4) AS records_ratio
    FROM documents JOIN c USING (lang, source) GROUP BY ratio_name, seed_name, lang"""
)
def subset_table(spark, d):
    """Every ratio's and seed's train subset by class: groups and records of all and of the subset."""
    docs = read(spark, d, "documents").select(F.col("lang").alias("family_label"), F.col("source").alias("recording_group_id"), F.col("doc_id").alias("record_id"), F.col("doc_id").alias("segment_id"))
    train = docs.withColumn("seed_name", F.explode(F.array(F.lit("seed0"), F.lit("seed1"))))
    chosen = analysis.subsets(train, {"train25": 0.25, "train100": 1.0}, {"seed0": 5, "seed1": 11})
    return analysis.subset_tables(train, chosen)[0].select("ratio_name", "seed_name", "family_label", "full_groups", "subset_groups", "full_records", "subset_records", "groups_ratio", "records_ratio")


@query(f"WITH c AS ({_CLASSES}), l AS (SELECT split, label_id AS layer_index, round(avg(f1_mean), 6) AS macro_f1_mean FROM c GROUP BY split, label_id) SELECT split, layer_index, macro_f1_mean FROM l QUALIFY row_number() OVER (PARTITION BY split ORDER BY macro_f1_mean DESC, layer_index) = 1")
def best_layers(spark, d):
    """The best layer of each split, the class of a line standing for the layer."""
    rows = class_table(spark, d).groupBy("split", F.col("label_id").alias("layer_index")).agg(six(F.avg("f1_mean")).alias("macro_f1_mean"))
    return analysis.best_layers(rows)


# ---- audits ----------------------------------------------------------------------------------


@query("SELECT 'repeated_segment' AS check_name, CAST(l_orderkey AS VARCHAR) AS key FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 UNION ALL SELECT 'source_in_wrong_split', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus <> 'F' UNION ALL SELECT 'class_missing', 'Q' UNION ALL SELECT 'leak', 'segment_id=' || CAST(l_orderkey AS VARCHAR) FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus = 'F') > 1")
def contract_audit(spark, d):
    items = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("segment_id"), F.col("l_returnflag").alias("source_dataset"), F.when(F.col("l_linestatus") == "F", "train").otherwise("test").alias("split"), F.col("l_method").alias("family_label"), F.lit(0).alias("label_id"))
    labels = items.select("family_label").distinct().withColumn("label_id", F.lit(0)).unionByName(small(spark, ["Q"], "family_label").withColumn("label_id", F.lit(0)))
    allowed = small(spark, ["A"], "source_dataset").withColumn("split", F.lit("train"))
    found = gates.contract_audit(items, {"label_id": 0}, labels, allowed, ["segment_id"])
    return found.select(F.col("check").alias("check_name"), "key")


@query(f"WITH t AS ({SQL['contract_audit']}) SELECT check_name, count(*) AS n FROM t GROUP BY check_name")
def audit_report(spark, d):
    found = contract_audit(spark, d).select(F.col("check_name").alias("check"), "key", F.lit("").alias("detail"))
    return gates.audit_report(found).select(F.col("check").alias("check_name"), "n")


@query("SELECT metrics_file, classes_file, split FROM (VALUES ('val', 'val_metrics_best.json', 'val_per_class_metrics_best.csv'), ('test', 'test_metrics.json', 'test_per_class_metrics.csv'), ('external_test', 'external_test_metrics.json', 'external_test_per_class_metrics.csv')) v(split, metrics_file, classes_file)")
def file_names(spark, d):
    splits = small(spark, ["val", "test", "external_test"], "split")
    return splits.select("split", runs.metrics_file(F.col("split")).alias("metrics_file"), runs.classes_file(F.col("split")).alias("classes_file"))
