"""Directory scans: files to manifest rows, with their status and reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import class_id, dotted_key
from ..operators.numbering import numbers

COLUMNS = ["record_id", "source_dataset", "source_path", "file_name", "file_ext", "raw_dir_label", "scan_status", "mapped_family_label", "drop_reason"]


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path and size of the files under ``root``; contents are not read, and empty files not listed."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select(F.col("path"), F.col("length"))


def parts(files: DataFrame, root: str) -> DataFrame:
    """Adds rel (below ``root``), depth, dir (the first folder), file_name and file_ext."""
    base = root.split(":", 1)[-1].rstrip("/").lstrip("/")
    rel = F.regexp_replace("path", f"^.*?{_quoted(base)}/", "")
    out = files.withColumn("rel", rel).withColumn("_p", F.split("rel", "/"))
    return out.select("path", "length", "rel", (F.size("_p") - 1).alias("depth"), F.col("_p")[0].alias("dir"), F.element_at("_p", -1).alias("file_name"), F.lower(F.regexp_extract("rel", r"(\.[^./]*)$", 1)).alias("file_ext"), F.col("_p").alias("steps"))


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def scan_folders(files: DataFrame, whitelist: DataFrame, source: str) -> DataFrame:
    """``<subtype>/<file>.wav``; the whitelist(dir, family) tells what is in scope."""
    rows = files.where("depth = 1 and file_ext = '.wav'").join(F.broadcast(_fixed(whitelist)), "dir", "left")
    inside = F.col("family").isNotNull()
    return _rows(rows, source, F.col("dir"), F.when(inside, "in_scope").otherwise("out_of_scope"), F.col("family"), F.when(~inside, "subtype_out_of_scope"))


def scan_numbered(files: DataFrame, ids: DataFrame, source: str) -> DataFrame:
    """``<id>.<seq>.wav``; ids(class_id, status, family, reason). Other numeric names fail to map."""
    rows = files.where("depth = 0 and file_ext = '.wav'").withColumn("class_id", class_id(F.col("file_name")))
    rows = rows.join(F.broadcast(_fixed(ids)), "class_id", "left")
    known = F.col("status").isNotNull()
    return _rows(rows, source, F.lit(""), F.when(known, F.col("status")).otherwise("mapping_failed"), F.col("family"), F.when(known, F.col("reason")).otherwise("mapping_failed"))


def scan_tracks(files: DataFrame, abbreviations: DataFrame, active: DataFrame, source: str) -> DataFrame:
    """``<abbr>/tracks/<file>.wav``; abbreviations(dir, family), active(family)."""
    rows = files.where((F.col("depth") == 2) & (F.col("steps")[1] == "tracks") & (F.col("file_ext") == ".wav"))
    rows = rows.join(F.broadcast(_fixed(abbreviations)), "dir", "left").join(F.broadcast(_fixed(active).withColumn("_on", F.lit(True))), "family", "left")
    unknown, off = F.col("family").isNull(), F.col("_on").isNull()
    return _rows(rows, source, F.col("dir"), F.when(unknown | off, "out_of_scope").otherwise("in_scope"), F.col("family"), F.when(unknown, "unknown_family_abbr").when(off, "class_not_active"))


def _fixed(lookup: DataFrame, most: int = 100_000) -> DataFrame:
    """A configuration table, checked to be small enough to be broadcast."""
    if lookup.limit(most + 1).count() > most:
        raise ValueError(f"a lookup table has more than {most} rows")
    return lookup


def _rows(rows: DataFrame, source: str, folder: Column, status: Column, family: Column, reason: Column) -> DataFrame:
    empty = F.lit("")
    return rows.select(F.lit(source).alias("source_dataset"), F.col("rel").alias("source_path"), "file_name", "file_ext", folder.alias("raw_dir_label"), status.alias("scan_status"), F.coalesce(family, empty).alias("mapped_family_label"), F.coalesce(reason, empty).alias("drop_reason"))


def scanned(frames: dict[str, DataFrame]) -> DataFrame:
    """All sources, each numbered in its order: ``<prefix>_000001``."""
    out = None
    for prefix, rows in frames.items():
        order = ["raw_dir_label", dotted_key(F.col("file_name")) if prefix == "chm" else "file_name", "file_name"]
        rows = numbers(rows, ["source_dataset"], order, "_n").withColumn("record_id", F.format_string(f"{prefix}_%06d", "_n")).select(*COLUMNS)
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("source_dataset", "raw_dir_label", "file_name")


def whitelist_lookup(spark: SparkSession, whitelist: dict[str, list[str]]) -> DataFrame:
    """(dir, family) of a family-to-folders mapping; a folder of two families is an error."""
    pairs = [(d, f) for f, dirs in whitelist.items() for d in dirs]
    if len({d for d, _ in pairs}) < len(set(pairs)):
        raise ValueError("a folder is listed for two families")
    return spark.createDataFrame(sorted(set(pairs)) or [("", "")], "dir string, family string").where("dir <> ''")


def id_lookup(spark: SparkSession, enabled: list[int], excluded: list[int], families: dict[int, str]) -> DataFrame:
    """(class_id, status, family, reason); an enabled id wins over an excluded one."""
    rows = [(i, "in_scope", families[i], "") for i in enabled] + [(i, "out_of_scope", families.get(i, ""), "class_out_of_scope") for i in excluded if i not in set(enabled)]
    return spark.createDataFrame(rows or [(None, None, None, None)], "class_id int, status string, family string, reason string").where("class_id is not null")
