"""The declared world: entities, keys, compositions, factors, eras, heroes, motifs and ladders, read from JSON-like dicts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import BooleanType, DateType, DoubleType, StringType, StructField, StructType

from . import forms

#: Field types and what they are in Spark; json is kept as text.
TYPES = {"string": StringType(), "number": DoubleType(), "boolean": BooleanType(), "date": DateType(), "uuid": StringType(), "json": StringType()}


class ModelError(ValueError):
    """Everything that is wrong with a declaration, one problem a line."""

    def __init__(self, problems: list[str]):
        super().__init__("\n".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    nullable: bool = False
    primary: bool = False
    unique: bool = False
    max_length: int | None = None
    values: tuple = ()
    weights: tuple[float, ...] = ()
    generator: dict | None = None
    default: object = None


@dataclass(frozen=True)
class ForeignKey:
    field: str
    entity: str
    target: str = "ID"
    dependent: bool = False
    lookup: str | None = None


@dataclass(frozen=True)
class Composition:
    """How a parent holds another entity: isA (one row, shared key), collection (rows that point to it), embed (a row it points to)."""

    kind: str
    entity: str
    field: str
    #: for isA: the parent's field that says which kind a row is, where that is known
    when: str | None = None


@dataclass(frozen=True)
class Entity:
    name: str
    fields: tuple[Field, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    business_key: tuple[str, ...] = ()
    compositions: tuple[Composition, ...] = ()
    immutable: bool = False
    cycle_field: str | None = None
    pack: str | None = None

    @property
    def primary(self) -> list[str]:
        return [f.name for f in self.fields if f.primary] or ["ID"]

    def schema(self) -> StructType:
        return StructType([StructField(f.name, TYPES[f.type], f.nullable, {"unique": f.unique} | ({"maxLength": f.max_length} if f.max_length else {})) for f in self.fields])


@dataclass(frozen=True)
class Domain:
    name: str
    namespace: str
    entities: dict[str, Entity]
    packs: dict[str, tuple[str, ...]] = field(default_factory=dict)
    rules: tuple[dict, ...] = ()

    def entity(self, name: str) -> Entity:
        if name not in self.entities:
            raise ModelError([f"unknown entity {name!r}"])
        return self.entities[name]


@dataclass(frozen=True)
class Arrow:
    beta: float
    dial: str | None = None
    feature: dict | None = None
    name: str | None = None


@dataclass(frozen=True)
class Factor:
    id: str
    entity: str
    target: float
    tolerance: float
    outcome: dict
    arrows: tuple[Arrow, ...] = ()


@dataclass(frozen=True)
class Dial:
    name: str
    mean: float = 0.0
    sd: float = 1.0
    wander: float = 0.0
    correlations: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Era:
    cycles: tuple[int, ...]
    name: str = ""
    factors: dict[str, float] = field(default_factory=dict)
    #: (entity, multiplier, where or None)
    volumes: tuple[tuple[str, float, tuple[tuple[str, object], ...] | None], ...] = ()


@dataclass(frozen=True)
class Hero:
    key: str
    entity: str
    match: dict
    fixed: dict = field(default_factory=dict)
    dials: dict[str, float] = field(default_factory=dict)
    #: (kind, cycle or None, what, op, expected)
    pins: tuple[tuple[str, int | None, object, str, object], ...] = ()
    birth: int | None = None
    #: (ladder, state, enter cycle, exit cycle or None)
    ladders: tuple[tuple[str, str, int, int | None], ...] = ()


@dataclass(frozen=True)
class Motif:
    id: str
    entity: str
    quota: float
    unit: str = "count"
    rounding: str = "round"
    births: tuple[int, ...] = ()
    dials: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    trajectory: dict[str, float] = field(default_factory=dict)
    fixed: dict = field(default_factory=dict)
    overrides: dict[str, float] = field(default_factory=dict)
    #: child entity -> (low, high) rows a cycle
    children: dict[str, tuple[int, int]] = field(default_factory=dict)
    ladder: tuple[str, str] | None = None
    #: (factor, arrow's name) -> the beta that its members have instead
    betas: dict[tuple[str, str], float] = field(default_factory=dict)
    #: eras in which trajectory, overrides and betas act; none: always
    eras: tuple[str, ...] = ()


@dataclass(frozen=True)
class State:
    name: str
    duration: int
    capacity: int | None = None
    prior: tuple[str, ...] = ()
    min_cycles: int | None = None
    dials: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    effects: dict[str, float] = field(default_factory=dict)
    exit_effects: dict[str, float] = field(default_factory=dict)
    stored: str | None = None
    #: what being in the state adds to a factor's score
    factor_effects: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Ladder:
    id: str
    entity: str
    states: tuple[State, ...]
    share: float = 1.0
    binding: dict | None = None


def parse_field(name: str, d: dict) -> Field:
    d = forms.field(d)
    return Field(name, d.get("type", "string"), bool(d.get("nullable", False)), bool(d.get("isPrimaryKey", False)), bool(d.get("unique", False)), d.get("maxLength"), tuple(d.get("values", ())), tuple(d.get("weights", ())), d.get("generator"), d.get("defaultValue"))


def parse_entity(name: str, d: dict, held: list[tuple[str, str, str]] = ()) -> Entity:
    fks = tuple(ForeignKey(v.get("fieldName", k), v["targetEntity"], v.get("targetField", "ID"), bool(v.get("dependent", False)), v.get("lookupPattern")) for k, v in d.get("foreignKeys", {}).items())
    parts = tuple(Composition(*c) for c in held)
    return Entity(name, tuple(parse_field(k, v) for k, v in d.get("fields", {}).items()), fks, tuple(d.get("businessKey", ())), parts, bool(d.get("isImmutable", False)), d.get("cycleField"), d.get("pack"))


def parse_domain(d: dict) -> Domain:
    declared = d.get("entities", {})
    held = forms.compositions(declared)
    out = Domain(d["name"], d["namespace"], {k: parse_entity(k, v, held.get(k, [])) for k, v in declared.items()}, {k: tuple(v.get("dependsOn", ())) for k, v in d.get("packs", {}).items()}, tuple(forms.rule(r, declared) for r in d.get("relationalRules", ())))
    check_domain(out)
    return out


def check_domain(domain: Domain) -> None:
    """Every problem at once."""
    bad = []
    for e in domain.entities.values():
        names = {f.name for f in e.fields}
        bad += [f"{e.name}.{f.name}: unknown type {f.type!r}" for f in e.fields if f.type not in TYPES]
        bad += [f"{e.name}.{f.name}: {len(f.weights)} weights for {len(f.values)} values" for f in e.fields if f.weights and len(f.weights) != len(f.values)]
        bad += [f"{e.name}: business key {k!r} is no field" for k in e.business_key if names and k not in names]
        bad += [f"{e.name}.{k.field}: no field" for k in e.foreign_keys if names and k.field not in names]
        bad += [f"{e.name}: holds unknown entity {c.entity!r}" for c in e.compositions if c.entity not in domain.entities]
        if e.pack and e.pack not in domain.packs:
            bad.append(f"{e.name}: unknown pack {e.pack!r}")
    for r in domain.rules:
        if r.get("kind") not in forms.RULES:
            bad.append(f"unknown rule kind {r.get('kind')!r}")
        else:
            bad += [f"rule {r.get('name', r['kind'])}: unknown entity {n!r}" for n in forms.named(r) if n not in domain.entities]
    if bad:
        raise ModelError(bad)


def parse_ruleset(d: dict) -> dict[str, list]:
    """factors, dials, eras, heroes, motifs and ladders of a ruleset module, with what is missing left empty."""
    if strange := forms.unknown(d):
        raise ModelError(strange)
    d = forms.ruleset(d)
    bounds = lambda x: {k: (v.get("min"), v.get("max")) for k, v in x.items()}
    out: dict[str, list] = {}
    out["factors"] = [Factor(f["id"], f["effect"], f["target"], f["tolerance"], f["outcome"], tuple(Arrow(a["beta"], a.get("dial"), a.get("feature"), a.get("name")) for a in f.get("arrows", ()))) for f in d.get("factors", ())]
    out["dials"] = [Dial(x["name"], x.get("mean", 0.0), x.get("stdDev", 1.0), x.get("annualWanderStdDev", 0.0), x.get("correlations", {})) for x in d.get("dials", ())]
    out["eras"] = [Era(tuple(x["cycles"]), x.get("name", ""), {a["factor"]: a["deltaIntercept"] for a in x.get("factorAdjustments", ())}, tuple((v["entity"], v["multiplier"], tuple(v["where"].items()) if v.get("where") else None) for v in x.get("volumeMultipliers", ()))) for x in d.get("eras", ())]
    out["heroes"] = [Hero(x["key"], x["entity"], x["match"], x.get("fixedFields", {}), x.get("dials", {}), tuple((p["kind"], p.get("cycle"), p["of"], p.get("op", "eq"), p.get("value")) for p in x.get("pins", ())), x.get("birthCycle"), tuple(map(tuple, x.get("ladders", ())))) for x in d.get("heroes", ())]
    out["motifs"] = [Motif(x["id"], x["entity"], x["quota"]["value"], x["quota"].get("type", "count"), x["quota"].get("rounding", "round"), tuple(x.get("birthCycles", ())), bounds(x.get("dials", {})), x.get("trajectory", {}), x.get("fixedFields", {}), x.get("overrides", {}), {k: tuple(v) if isinstance(v, list) else (v, v) for k, v in x.get("childRates", {}).items()}, tuple(x["ladder"]) if x.get("ladder") else None, x.get("betas", {}), tuple(x.get("eras", ()))) for x in d.get("motifs", ())]
    state = lambda s: State(s["name"], s["duration"], s.get("capacity"), tuple(s.get("prior", ())), s.get("minCyclesSinceBirth"), bounds(s.get("dials", {})), s.get("effects", {}), s.get("exitEffects", {}), s.get("stored"), s.get("factorEffects", {}))
    out["ladders"] = [Ladder(x["id"], x["entity"], tuple(map(state, x["states"])), x.get("share", 1.0), x.get("binding")) for x in d.get("ladders", ())]
    return out


def check_ruleset(rules: dict[str, list], domain: Domain) -> None:
    bad = []
    for kind, rows in rules.items():
        for r in rows:
            names = [r.entity] if hasattr(r, "entity") else [v[0] for v in r.volumes] if isinstance(r, Era) else []
            bad += [f"{kind}: unknown entity {n!r}" for n in names if n not in domain.entities]
    known = {f.id for f in rules.get("factors", ())}
    eras = {e.name for e in rules.get("eras", ())}
    bad += [f"motif {m.id}: unknown era {k!r}" for m in rules.get("motifs", ()) for k in m.eras if k not in eras]
    bad += [f"eras: unknown factor {k!r}" for e in rules.get("eras", ()) for k in e.factors if k not in known]
    if bad:
        raise ModelError(bad)


def domain_from_frames(name: str, namespace: str, frames: dict, business_keys: dict[str, list[str]] | None = None) -> Domain:
    """Entities from DataFrames' schemas: types by kind, business keys by fields that end in Code, Number or Key, else by Name."""
    entities = {}
    for e, df in frames.items():
        fields = []
        for f in df.schema:
            kind = f.dataType.typeName()
            t = "boolean" if kind == "boolean" else "date" if kind in ("date", "timestamp", "timestamp_ntz") else "json" if kind in ("struct", "array", "map") else "string" if kind in ("string", "binary") else "number"
            fields.append(Field(f.name, t, f.nullable, f.name == "ID"))
        names = [f.name for f in fields]
        guess = [n for n in names if n.lower().endswith(("code", "number", "key"))][:1] or [n for n in names if n.lower().endswith("name")][:1]
        entities[e] = Entity(e, tuple(fields), (), tuple((business_keys or {}).get(e, guess)))
    return Domain(name, namespace, entities)
