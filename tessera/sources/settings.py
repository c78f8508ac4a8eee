"""The curation's YAML configuration, read and checked, and what a run needs of its surroundings."""

from __future__ import annotations

import re
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession

from ..operators.gates import GateError
from ..plans.curation import Config
from . import files

#: What a configuration must have, and the ranges of its thresholds.
REQUIRED = ["active_classes", "family_abbr", "ccmusic_whitelist", "chmusic_enabled_ids", "chmusic_excluded_ids", "thresholds", "split_seeds", "seed_namespaces"]
RANGES = {"d05a_default": (0.0, 1.0), "d06a_default": (0.0, 1.0), "active_frame_ratio": (0.0, 1.0), "phrase_ratio_cap": (0.0, 1.0), "concentration_cap_floor": (1, 50)}
SOURCES = ("CCMusic", "ChMusic", "External")


def read_yaml(spark: SparkSession, path: str) -> dict:
    import yaml

    if not files.exists(spark, path):
        raise GateError(f"no configuration at {path}")
    try:
        return yaml.safe_load(files.read_text(spark, path)) or {}
    except yaml.YAMLError as e:
        raise GateError(f"{path} is not YAML: {e}") from e


def out_of_range(values: dict, key: str, low: float, high: float) -> list[str]:
    value = values.get(key)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return [f"thresholds.{key} is missing or no number"]
    return [] if low <= value <= high else [f"thresholds.{key} = {value} is not in {low}..{high}"]


def problems(given: dict, n_classes: int = 6, n_seeds: int = 3) -> list[str]:
    """Everything wrong with a configuration; nothing else is looked at while a required key is missing."""
    if missing := [k for k in REQUIRED if k not in given]:
        return [f"missing {k}" for k in missing]
    out, classes, short = [], given["active_classes"], given["family_abbr"]
    if not isinstance(classes, list) or len(classes) != n_classes or len(set(classes)) != n_classes:
        out.append(f"active_classes must be {n_classes} different ones")
        classes = []
    if not isinstance(short, dict) or set(classes) - set(short):
        out.append("family_abbr must cover active_classes")
    thresholds = given["thresholds"]
    out += ["thresholds must be a mapping"] if not isinstance(thresholds, dict) else [x for k, (low, high) in RANGES.items() for x in out_of_range(thresholds, k, low, high)]
    if not isinstance(given["split_seeds"], list) or len(given["split_seeds"]) != n_seeds:
        out.append(f"split_seeds must be {n_seeds}")
    spaces = given["seed_namespaces"]
    out += ["seed_namespaces must be a mapping"] if not isinstance(spaces, dict) else [f"seed_namespaces lacks {k}" for k in ("split", "phrase_downsampling") if k not in spaces]
    enabled, excluded = set(given["chmusic_enabled_ids"] or []), set(given["chmusic_excluded_ids"] or [])
    if enabled & excluded:
        out.append(f"ids both enabled and excluded: {sorted(enabled & excluded)}")
    known, ids = set(classes) | set(short if isinstance(short, dict) else ()), given.get("chmusic_id_map") or {}
    for i in sorted(enabled) if ids else []:
        if i not in ids:
            out.append(f"chmusic_id_map lacks {i}")
        elif ids[i] not in known:
            out.append(f"chmusic_id_map[{i}] names an unknown class")
    return out


def config_of(given: dict) -> Config:
    """The flow's settings from a checked configuration."""
    if wrong := problems(given):
        raise GateError("; ".join(wrong))
    limits = given["thresholds"]
    return Config(
        families={c: given["family_abbr"][c] for c in given["active_classes"]},
        silence_threshold=limits["d05a_default"],
        clipping_threshold=limits["d06a_default"],
        phrase_cap=limits["phrase_ratio_cap"],
        active_share=limits["active_frame_ratio"],
        segment_floor=limits["concentration_cap_floor"],
        seeds=tuple(s + given["seed_namespaces"]["split"] for s in given["split_seeds"]),
        phrase_seed=given["split_seeds"][0] + given["seed_namespaces"]["phrase_downsampling"],
        accepted_external=tuple(d["family_label"] for d in given.get("chmusic_r05_decisions") or [] if d.get("decision") == "accept_limited"),
    )


def overrides_of(spark: SparkSession, given: dict) -> DataFrame:
    """(pos, family, threshold_key, scope, value) of the per-family overrides, in their order."""
    names = {"d05a": "silence_threshold", "d06a": "clipping_threshold", "concentration_cap_floor": "segment_floor"}
    rows = [(i, o["family_label"], key, o.get("scope") or "", float(o[own])) for i, o in enumerate(given.get("threshold_overrides") or []) for own, key in names.items() if o.get(own) is not None]
    return spark.createDataFrame(rows, "pos int, family string, threshold_key string, scope string, value double")


def exemptions_of(spark: SparkSession, given: dict) -> DataFrame:
    """(split_seed, family_label, split) cells that may be empty."""
    rows = [(e["seed"], e["family_label"], "external_test") for e in given.get("external_test_exemptions") or []]
    return spark.createDataFrame(rows, "split_seed int, family_label string, split string")


def newer(have: str, least: str) -> bool:
    """Whether a version is at least another one, by their numbers."""
    a, b = ([int(x) for x in re.findall(r"\d+", (re.match(r"[\d.]+", v) or [""])[0])] for v in (have, least))
    n = max(len(a), len(b))
    return a + [0] * (n - len(a)) >= b + [0] * (n - len(b))


def lacking_packages(least: dict[str, str]) -> list[str]:
    """Packages that are missing or older than they must be."""
    out = []
    for name, version in least.items():
        try:
            have = metadata.version(name)
        except metadata.PackageNotFoundError:
            out.append(f"{name} is not installed")
            continue
        if not newer(have, version):
            out.append(f"{name} {have} is older than {version}")
    return out


def lacking_tool(command: list[str], least: str) -> list[str]:
    """An external program that is missing, does not answer or is too old."""
    import subprocess

    try:
        said = subprocess.run(command, capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired) as e:
        return [f"{command[0]}: {e}"]
    found = re.search(r"\d+\.\d+(?:\.\d+)?", said.stdout or said.stderr)
    if not found:
        return [f"{command[0]} names no version"]
    return [] if newer(found[0], least) else [f"{command[0]} {found[0]} is older than {least}"]


def preflight(spark: SparkSession, path: str, packages: dict[str, str] | None = None, tools: dict[str, tuple[list[str], str]] | None = None) -> dict:
    """Read ``config.yaml`` and ``freeze_config.yaml`` beside it, and check all before anything runs.

    Everything that is wrong is told at once. Relative folders count from the
    configuration's own. Gives config, freeze_config, roots, output_dir.
    """
    home = path.rpartition("/")[0] or "."
    whole = lambda p: p if p.startswith("/") or "://" in p else f"{home}/{p.removeprefix('./')}"
    config, wrong = read_yaml(spark, path), lacking_packages(packages or {})
    for command, least in (tools or {}).values():
        wrong += lacking_tool(command, least)
    roots = {k: whole(v) for k, v in (config.get("data_root_paths") or {}).items()}
    wrong += [f"data_root_paths lacks {s}" for s in SOURCES[:2] if s not in roots]
    wrong += [f"data_root_paths has an unknown source {s}" for s in roots if s not in SOURCES]
    wrong += [f"{s}: no folder at {p}" for s, p in roots.items() if not files.is_folder(spark, p)]
    frozen = read_yaml(spark, f"{home}/freeze_config.yaml")
    wrong += problems(frozen)
    if wrong:
        raise GateError("; ".join(wrong))
    return {"config": config, "freeze_config": frozen, "roots": roots, "output_dir": whole(config.get("output_dir", "./output"))}
