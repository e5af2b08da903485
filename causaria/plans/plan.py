"""Authored plans of a cycle: intake numbers and records with references, checked as a whole before any row is added."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import norm
from ..model import Domain
from .graph import lineage


class PlanError(ValueError):
    def __init__(self, problems: list[str]):
        super().__init__("\n".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Record:
    entity: str
    ref: str | None
    fields: dict
    extends: str | None = None


@dataclass(frozen=True)
class Plan:
    as_of: date
    summary: str
    intake: dict[str, int] = field(default_factory=dict)
    records: tuple[Record, ...] = ()


def parse(d: dict) -> Plan:
    bad = [f"unknown key {k!r}" for k in d if k not in ("asOf", "summary", "intake", "records")]
    bad += [f"{k} is missing" for k in ("asOf", "summary") if k not in d]
    for i, r in enumerate(d.get("records", ())):
        bad += [f"record {i}: unknown key {k!r}" for k in r if k not in ("entity", "ref", "extends", "fields")]
        bad += [f"record {i}: {k} is missing" for k in ("entity", "fields") if k not in r]
    bad += [f"intake of {k} is no count: {v!r}" for k, v in d.get("intake", {}).items() if not isinstance(v, int) or v < 0]
    try:
        as_of = date.fromisoformat(d.get("asOf", "1970-01-01"))
    except ValueError as e:
        bad.append(f"asOf: {e}")
    if bad:
        raise PlanError(bad)
    return Plan(as_of, d["summary"], d.get("intake", {}), tuple(Record(r["entity"], r.get("ref"), r["fields"], r.get("extends")) for r in d.get("records", ())))


def load(path: str | Path) -> Plan:
    try:
        return parse(json.loads(Path(path).read_text()))
    except ValueError as e:
        raise e if isinstance(e, PlanError) else PlanError([f"{path}: {e}"]) from e


_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
_UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)


def fits(value, kind: str) -> bool:
    """Whether a literal is of a field's type."""
    return {"number": isinstance(value, int | float) and not isinstance(value, bool), "boolean": isinstance(value, bool), "date": isinstance(value, str) and bool(_DATE.match(value)), "uuid": isinstance(value, str) and bool(_UUID.fullmatch(value)), "json": True}.get(kind, isinstance(value, str))


def lookup_counts(spark: SparkSession, data: dict[str, DataFrame], asked: list[tuple[str, str, str]]) -> dict[tuple[str, str, str], tuple[int, str | None]]:
    """For each (entity, field, value): how many rows have it, and the key of one. One scan an entity and field."""
    out = dict.fromkeys(asked, (0, None))
    by: dict[tuple[str, str], set[str]] = {}
    for e, f, v in asked:
        by.setdefault((e, f), set()).add(v)
    for (e, f), values in by.items():
        if e in data and f in data[e].columns:
            df = data[e]
            hit = norm(df[f])
            for r in df.where(hit.isin([v.lower() for v in values])).groupBy(hit.alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("ID").alias("id")).collect():
                for v in values:
                    if v.lower() == r["v"]:
                        out[e, f, v] = (r["n"], r["id"])
    return out


def applied(spark: SparkSession, plan: Plan, domain: Domain, data: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The plan's rows by entity. Every problem of every record is told before any row is made.

    Values are literals, {"ref": name} of another record (its key), or
    {"lookup": {entity, field, value}}, which must find exactly one row among
    existing and planned ones. Keys come from business keys; an extension has
    the key of what it extends. Unset fields are null.
    """
    bad: list[str] = []
    refs = {r.ref: r for r in plan.records if r.ref}
    if len(refs) < sum(r.ref is not None for r in plan.records):
        bad.append("two records have one ref")
    asked = [(v["lookup"]["entity"], v["lookup"]["field"], str(v["lookup"]["value"])) for r in plan.records for v in r.fields.values() if isinstance(v, dict) and "lookup" in v]
    found = lookup_counts(spark, data, asked)
    keys: dict[int, str | None] = {}

    def key(r: Record, seen: tuple = ()) -> str | None:
        if id(r) in keys:
            return keys[id(r)]
        if r.entity not in domain.entities or r.ref in seen:
            return None
        e = domain.entity(r.entity)
        if r.extends:
            keys[id(r)] = key(refs[r.extends], (*seen, r.ref)) if r.extends in refs else None
        else:
            parts = [value(r, f, (*seen, r.ref)) for f in e.business_key]
            keys[id(r)] = str(uuid.uuid5(uuid.UUID(domain.namespace), f"{r.entity}:{'|'.join(map(str, parts))}")) if all(p is not None for p in parts) else None
        return keys[id(r)]

    def value(r: Record, f: str, seen: tuple = ()):
        v = r.fields.get(f)
        if isinstance(v, dict) and "ref" in v:
            return key(refs[v["ref"]], seen) if v["ref"] in refs else None
        if isinstance(v, dict) and "lookup" in v:
            spec = v["lookup"]
            n, existing = found[spec["entity"], spec["field"], str(spec["value"])]
            planned = [x for x in plan.records if x.entity == spec["entity"] and str(x.fields.get(spec["field"])).lower() == str(spec["value"]).lower()]
            if n + len(planned) != 1:
                return None
            return existing if n else key(planned[0], seen)
        return v

    rows: dict[str, list[dict]] = {}
    for i, r in enumerate(plan.records):
        at = f"record {i} ({r.ref or r.entity})"
        if r.entity not in domain.entities:
            bad.append(f"{at}: unknown entity")
            continue
        e, out = domain.entity(r.entity), {}
        kinds = {f.name: f for f in e.fields}
        bad += [f"{at}: unknown field {f!r}" for f in r.fields if f not in kinds]
        if r.extends and (r.extends not in refs or refs[r.extends].entity not in lineage(domain, r.entity)[1:]):
            bad.append(f"{at}: extends {r.extends!r}, which is nothing it is a kind of")
        for f, spec in kinds.items():
            raw = r.fields.get(f)
            if isinstance(raw, dict) and "ref" in raw and raw["ref"] not in refs:
                bad.append(f"{at}: {f} refers to unknown {raw['ref']!r}")
            elif isinstance(raw, dict) and "lookup" in raw and value(r, f) is None:
                bad.append(f"{at}: {f} doesn't find exactly one row")
            elif raw is not None and not isinstance(raw, dict) and not fits(raw, spec.type):
                bad.append(f"{at}: {f} is no {spec.type}: {raw!r}")
            elif raw is None and not spec.nullable and not spec.primary and spec.default is None:
                bad.append(f"{at}: {f} is missing")
            out[f] = value(r, f) if raw is not None else spec.default
        if (k := key(r)) is None:
            bad.append(f"{at}: no key")
        else:
            out[e.primary[0]] = k
        rows.setdefault(r.entity, []).append(out)
    for name, made in rows.items():
        ids = [x.get(domain.entity(name).primary[0]) for x in made]
        bad += [f"{name}: two records have the key {k}" for k in {k for k in ids if k and ids.count(k) > 1}]
        if name in data:
            taken = data[name].where(F.lower("ID").isin([k for k in ids if k])).select("ID").collect()
            bad += [f"{name}: {t['ID']} exists already" for t in taken]
    bad += [f"intake of unknown entity {k!r}" for k in plan.intake if k not in domain.entities]
    if bad:
        raise PlanError(bad)
    out = {}
    for name, made in rows.items():
        schema = domain.entity(name).schema()
        cast = lambda v, t: None if v is None else float(v) if t == "double" else date.fromisoformat(v[:10]) if t == "date" else v
        out[name] = spark.createDataFrame([[cast(m.get(f.name), f.dataType.typeName()) for f in schema] for m in made], schema)
    return out
