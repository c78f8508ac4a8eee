"""String functions of manifests: names, keys, identifiers and cell formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, spelled out so that every engine agrees.
SPACE = r"[\s\x{3000}\x{00A0}]"
#: Fixed value: the suffix that marks a repeated take.
TAKE = f"{SPACE}*第[一二三]遍{SPACE}*$"
#: Keywords that tell a recording's kind, by priority.
CONTENT = (("phrase", ("乐曲片段", "选段", "节选")), ("technique", ("演奏技法", "演奏技巧", "技法", "技巧")), ("controlled", ("音阶", "音程", "筒音", "空弦音")))


def normalized_name(name: Column) -> Column:
    """The name without extension and take suffix, white space collapsed and trimmed."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), TAKE, "")
    return trimmed(F.regexp_replace(stem, f"{SPACE}+", " "))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def merge_key(name: Column) -> Column:
    """The name without any white space."""
    return F.regexp_replace(name, f"{SPACE}+", "")


def first_keyword(text: Column, kinds=CONTENT) -> Column:
    """The first kind, by priority, one of whose keywords the text holds; else null."""
    return F.coalesce(*(F.when(reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words)), F.lit(kind)) for kind, words in kinds))


def class_id(file_name: Column) -> Column:
    """The number before the first dot of ``<id>.<seq>.wav``; null if there is none."""
    return F.regexp_extract(file_name, r"^(\d+)\.\d+\.[^.]+$", 1).try_cast("int")


def take_id(name: Column) -> Column:
    """1 to 3 by the take suffix, else 0."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.when(stem.endswith("第一遍"), 1).when(stem.endswith("第二遍"), 2).when(stem.endswith("第三遍"), 3).otherwise(0)


def dotted_key(name: Column) -> Column:
    """Orders ``1.9`` before ``1.10``: the numbers of the stem as an array."""
    return F.transform(F.split(F.regexp_replace(name, r"\.[^.0-9]+$", ""), r"\."), lambda x: x.try_cast("int"))


def without_prefix(name: Column) -> Column:
    """The name without an artist or label prefix that ends in a dash."""
    return F.trim(F.regexp_replace(name, "^[^-—]+[-—]", ""))


def cell(value: Column, kind: str) -> Column:
    """A manifest cell: lower-case booleans, six decimals without trailing zeros, empty for null."""
    if kind == "boolean":
        shown = F.when(value, "true").otherwise("false")
    elif kind in ("double", "float"):
        short = F.regexp_replace(F.format_string("%.6f", value.cast("double")), "0+$", "")
        shown = F.regexp_replace(short, r"\.$", ".0")
    else:
        shown = value.cast("string")
    return F.when(value.isNull(), "").otherwise(shown)


def numbered(prefix: Column, number: Column, digits: int = 6) -> Column:
    """The prefix and the number, with zeros in front up to ``digits``; longer numbers stay whole."""
    return F.concat(prefix, F.format_string(f"%0{digits}d", number.cast("long")))


def mean_std(mean: Column, std: Column, best: Column | None = None, digits: int = 4) -> Column:
    """``mean±std``, bold if it is the best."""
    shown = F.format_string(f"%.{digits}f±%.{digits}f", mean, std)
    return shown if best is None else F.when(best, F.concat(F.lit("**"), shown, F.lit("**"))).otherwise(shown)


def version_key(version: Column, parts: int = 4) -> Column:
    """Numeric parts padded with zeros; arrays compare as versions do."""
    numbers = F.transform(F.split(version, r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^\d+", 0).try_cast("int"), F.lit(0)))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0), parts)), 1, parts)


def prompts(classes, templates):
    """The prompt matrix: every template for every class, as (class, template, prompt) columns."""
    pairs = [F.struct(F.lit(c).alias("label"), F.lit(i).alias("template"), F.lit(t.replace("{label}", c)).alias("prompt")) for c in classes for i, t in enumerate(templates)]
    return F.array(*pairs)
