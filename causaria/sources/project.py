"""Projects on disk: manifest, domain, rulesets and catalogues. Small JSON, read on the driver; catalogues are DataFrames."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Domain, ModelError, check_ruleset, parse_domain, parse_ruleset

#: Names a manifest may have, in order.
MANIFESTS = ("project.json", "causaria.json")
UNITS = ("day", "week", "month", "year")


@dataclass(frozen=True)
class Project:
    root: Path
    domain: Domain
    start_cycle: int
    release: date
    unit: str
    output: Path
    rules: dict[str, list] = field(default_factory=dict)
    params: dict = field(default_factory=dict)
    catalogues: dict[str, Path] = field(default_factory=dict)


def read_json(path: Path):
    try:
        return json.loads(path.read_text(encoding="utf-8"))
    except ValueError as e:
        raise ModelError([f"{path}: {e}"]) from e


def rulesets(path: Path) -> tuple[dict[str, list], dict]:
    """All modules of a folder (or the one file that stands in for a missing one) joined: rules and parameters."""
    files = sorted(path.glob("*.json")) if path.is_dir() else [path.with_suffix(".json")] if path.with_suffix(".json").exists() else []
    rules: dict[str, list] = {}
    params: dict = {}
    for f in files:
        d = read_json(f)
        if not isinstance(d, dict):
            raise ModelError([f"{f}: a module is an object"])
        for k, v in parse_ruleset(d).items():
            rules.setdefault(k, []).extend(v)
        params |= d.get("params", {})
    return rules, params


def find_catalogues(root: Path, declared: dict[str, str] | None = None) -> dict[str, Path]:
    """Declared catalogues, then those found in catalogs/ and data/catalogs/; the first of a name wins."""
    out = {k: root / v for k, v in (declared or {}).items()}
    for folder in (root / "catalogs", root / "data" / "catalogs"):
        for f in sorted(folder.glob("*.json")) if folder.is_dir() else []:
            out.setdefault(f.stem, f)
    return out


def load(path: str | Path) -> Project:
    """A project from its manifest or folder; everything is checked before any job runs, and all problems of a file are told at once."""
    p = Path(path)
    manifest = p if p.is_file() else next((p / n for n in MANIFESTS if (p / n).exists()), None)
    if manifest is None:
        raise ModelError([f"{p}: no {' or '.join(MANIFESTS)}"])
    m, root = read_json(manifest), manifest.parent
    bad = [f"{manifest}: {k} is missing" for k in ("uuidNamespace", "startCycle", "releaseDate", "cycleUnit") if k not in m]
    if m.get("cycleUnit") not in (None, *UNITS):
        bad.append(f"{manifest}: unknown cycle unit {m['cycleUnit']!r}")
    if bad:
        raise ModelError(bad)
    domain = parse_domain({"namespace": m["uuidNamespace"], **read_json(root / m.get("domainPath", "domain.json"))})
    rules, params = rulesets(root / m.get("rulesetPath", "ruleset"))
    check_ruleset(rules, domain)
    output = m.get("output", "data")
    output = output.get("metadataDir", "data") if isinstance(output, dict) else output
    return Project(root, domain, m["startCycle"], date.fromisoformat(m["releaseDate"]), m["cycleUnit"], root / output, rules, params, find_catalogues(root, m.get("catalogs")))


def catalogue(spark: SparkSession, path: str | Path) -> DataFrame:
    """Records of a catalogue: an array, {records}, {data}, one object, or buckets {name: [values]} as (bucket, value)."""
    d = read_json(Path(path))
    if isinstance(d, dict):
        held = next((d[k] for k in ("records", "data") if isinstance(d.get(k), list)), None)
        if held is None and d and all(isinstance(v, list) for v in d.values()):
            return spark.createDataFrame([(k, str(x)) for k, v in d.items() for x in v], "bucket string, value string")
        d = held if held is not None else [d]
    return spark.read.json(spark.sparkContext.parallelize([json.dumps(r) for r in d])) if d else spark.createDataFrame([], "value string")


def buckets(df: DataFrame) -> dict[str, list[str]]:
    """A small bucket catalogue as lists, for generators."""
    return {r["bucket"]: list(r["values"]) for r in df.groupBy("bucket").agg(F.sort_array(F.collect_list("value")).alias("values")).collect()}


def names(spark: SparkSession, female: list[str], male: list[str]) -> DataFrame:
    """A given-name catalogue (name, gender), names on both lists unisex."""
    both = {x.lower() for x in female} & {x.lower() for x in male}
    rows = [(x, "Unisex" if x.lower() in both else g) for g, xs in (("Female", female), ("Male", male)) for x in xs]
    return spark.createDataFrame(rows, "name string, gender string").distinct()


def given_names(catalogues: dict[str, DataFrame]) -> DataFrame | None:
    """(name, gender) of the catalogue given-names, in rows of name and gender or in buckets by gender; None without one."""
    df = catalogues.get("given-names")
    if df is None:
        return None
    of = {c.lower(): c for c in df.columns}
    name, gender = (of["value"], of["bucket"]) if "bucket" in of else (of["name"], of["gender"])
    return df.select(F.col(name).alias("name"), F.initcap(gender).alias("gender"))
