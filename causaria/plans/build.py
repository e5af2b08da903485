"""Whole runs of a project: build its history, add one cycle, fill generated fields."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import cycle_field, day, timing
from ..functions.keys import entity_id, norm, primary_key, uuid5
from ..functions.rng import stream, uniform
from ..model import Dial, Entity, Factor, Ladder
from ..operators import generate, heroes, patterns
from ..operators.compose import ordinal
from ..operators.delta import status_transitions
from ..operators.features import compile_feature, resolved
from ..sources import files, journal, records, state, versions
from ..sources import project as projects
from ..streaming import accumulate, ladders, simulate
from . import kin, reversals, suppression
from .graph import common_scope, entity_order
from .plan import Plan, applied, parse

CHECKPOINT = "checkpoint.json"


@dataclass(frozen=True)
class Built:
    data: dict[str, DataFrame]
    checkpoint: accumulate.Checkpoint
    states: DataFrame | None = None


@dataclass(frozen=True)
class Cycle:
    """What a cycle adds, which entities' rows change (whole, as they will be), ladders' states, transitions, and the checkpoint."""

    new: dict[str, DataFrame]
    updated: dict[str, DataFrame]
    states: DataFrame | None
    transitions: list[DataFrame]
    checkpoint: accumulate.Checkpoint


def _catalogues(spark: SparkSession, p: projects.Project) -> dict:
    return {n: projects.buckets(c) for n, f in p.catalogues.items() if "bucket" in (c := projects.catalogue(spark, f)).columns}


def _windows(p: projects.Project) -> dict[str, dict]:
    """Entities whose rows are role windows that a date-window rule declares: one for each parent and window."""
    return {r["window"]: r for r in p.domain.rules if r["kind"] == "date-window" and r.get("roleWindows")}


def _ballots(p: projects.Project) -> dict[str, dict]:
    """Entities of ballots, by the rule that derives outcomes from them."""
    return {r["ballots"]: r for r in p.domain.rules if r["kind"] == "outcome-derived-from-ballots"}


def seats(spark: SparkSession, p: projects.Project, e: Entity, r: dict, parents: DataFrame, seed: int, data: dict[str, DataFrame]) -> DataFrame:
    """A row for each parent and declared role window, held by an actor.

    Where the actor's field points to an entity, actors are drawn from its rows,
    without replacement for a parent: windows that overlap are in different
    slots, and a parent seats another actor in each slot, so that nobody holds
    two of its seats at once, and who holds one may hold a later one. Slots
    beyond the number of actors stay empty. Otherwise each seat has an actor of
    its own, by id alone.
    """
    actor = next((k for k in e.foreign_keys if k.field == r["windowKey"] and k.entity in data), None)
    fk = next(k for k in e.foreign_keys if k.entity in p.domain.entities and k is not actor)
    start = lambda w: w.get("startDate") or f"{p.start_cycle + int(w.get('startOffsetYears', 0))}-01-01"
    end = lambda w: w.get("endDate") or (f"{p.start_cycle + int(w.get('startOffsetYears', 0) + w['durationYears'])}-12-31" if w.get("durationYears") else None)
    windows = [(start(w), end(w)) for w in r["roleWindows"]]
    schedule = [{"__w": i, "__s": s, "__e": t, "__slot": k} for i, ((s, t), k) in enumerate(zip(windows, kin.slots(windows), strict=True))]
    bodies = parents.select(F.col(fk.target).alias(fk.field))
    rows = generate.scheduled(bodies, schedule)
    place = F.concat_ws(":", F.col(fk.field).cast("string"), F.col("__w").cast("string"))
    made = {fk.field: F.col(fk.field), r["startField"]: F.to_date("__s"), r["endField"]: F.to_date("__e")}
    if actor is None:
        made[r["windowKey"]] = uuid5(p.domain.namespace, F.concat(F.lit("actor:"), place))
    else:
        drawn = generate.seated(bodies, fk.field, data[actor.entity].select(F.col(actor.target).alias("__actor")), "__actor", max(x["__slot"] for x in schedule) + 1, seed)
        rows = rows.join(drawn.withColumn("__slot", F.col("seat") - 1).drop("seat"), [fk.field, "__slot"])
        made[r["windowKey"]] = F.col("__actor")
    return _filled(p, e, rows, made, place, seed)


def _filled(p: projects.Project, e: Entity, rows: DataFrame, made: dict[str, Column], place: Column, seed: int) -> DataFrame:
    return kin.filled(p.domain, e, rows, made, place, seed, _start(p))


def _start(p: projects.Project) -> str:
    return f"{p.start_cycle}-01-01"


def voted(p: projects.Project, r: dict, data: dict[str, DataFrame], seed: int) -> tuple[DataFrame, DataFrame]:
    """(ballots, decisions): everyone who holds a role on a decision's day, of the body it belongs to, votes; outcomes follow from the tally.

    The body is the nearest entity that decisions and roles both lead to; a
    ballot's day is its decision's.
    """
    decision, ballot = p.domain.entity(r["source"]), p.domain.entity(r["ballots"])
    cover = next(x for x in p.domain.rules if x["kind"] == "date-window" and x["source"] == ballot.name)
    role, actor = p.domain.entity(cover["window"]), cover["windowKey"]
    scope = common_scope(p.domain, decision.name, role.name)
    if scope is None:
        raise ValueError(f"{decision.name} and {role.name} lead to no entity in common")
    rows = data[decision.name]
    for i, (step, at) in enumerate(_steps(p, decision.name, scope[1])):
        target = p.domain.entity(at)
        own = data[at].select(norm(target.primary[0]).alias("__k"), *[F.col(k.field).alias(f"__to_{k.field}") for k in target.foreign_keys])
        key = F.col(step) if i == 0 else F.col(f"__to_{step}")
        rows = rows.withColumn("__at", norm(key)).drop(*[c for c in rows.columns if c.startswith("__to_")]).join(own, F.col("__at") == F.col("__k"), "left").withColumn("__scope", F.col("__at")).drop("__at", "__k")
    dated_by = _decided_on(decision)
    # In days that no role covers nobody could vote: a decision stands on a day of its body's roles.
    held = data[role.name].select(norm(scope[2][0]).alias("__scope_of"), F.col(actor).alias("__actor"), day(F.col(cover["startField"])).alias("__s"), day(F.col(cover["endField"])).alias("__e"))
    events = rows.select(F.col(decision.primary[0]).alias("__event"), F.col("__scope"), day(F.col(dated_by)).alias("__day"))
    eligible = patterns.temporal_role(events, F.col("__day"), "__scope", held, "__scope_of", "__actor", F.col("__s"), F.col("__e")).select("__event", "__day", "actor")
    rate = float(r.get("abstainRate") or 0.0)
    weights = r.get("weights") or {}
    factor = next((f for f in p.rules.get("factors", ()) if f.entity == decision.name and r["outcomeField"] in f.outcome.get("where", {})), None)
    rule = {"rule": r["rule"], "quorum": r["quorum"], "tie": r["tie"], "count_abstain": r["countAbstain"], "passed": r["passed"], "failed": r["failed"]}
    target = approval(factor.target if factor else 0.5, eligible) if not weights else None
    ballots, decided = patterns.scoped_decision(data[decision.name], decision.primary[0], eligible, "__event", "actor", seed, f"ballots:{decision.name}", (float(weights.get("Yes", 0.5)), float(weights.get("No", 0.5))), rate, target, **rule)
    label = {"Yes": r["yes"], "No": r["no"], "Abstain": r["abstain"]}
    vote = F.element_at(F.create_map(*[F.lit(x) for kv in label.items() for x in kv]), F.col("vote"))
    place = F.concat_ws(":", F.col("__event").cast("string"), F.col("actor").cast("string"))
    made = {r["decisionField"]: F.col("__event"), cover["key"]: F.col("actor"), r["voteField"]: vote, cover["dateField"]: F.col("__day")}
    outcome = decided.withColumn(r["outcomeField"], F.col("outcome")).select(*data[decision.name].columns)
    return _filled(p, ballot, ballots, made, place, seed), outcome


#: Votes beyond which the chance of a majority is the normal law's.
MANY_VOTES = 1000


def approval(share: float, eligible: DataFrame) -> float:
    """The chance of a Yes at which a majority of the usual number of votes passes with the share: found by halving, as the chance of a majority rises with it."""
    n = eligible.groupBy("__event").count().agg(F.percentile_approx("count", 0.5)).first()[0] or 1
    low, high = 0.0, 1.0
    for _ in range(50):
        q = (low + high) / 2
        low, high = (q, high) if majority(n, q) < share else (low, q)
    return (low + high) / 2


def majority(n: int, q: float) -> float:
    """The chance that more than half of n votes are Yes, each with chance q: terms by their logarithms, or the normal law for many votes."""
    if not 0 < q < 1:
        return float(q >= 1)
    if n > MANY_VOTES:
        return math.erfc((n // 2 + 0.5 - n * q) / math.sqrt(2 * n * q * (1 - q))) / 2
    whole, yes, no = math.lgamma(n + 1), math.log(q), math.log1p(-q)
    return math.fsum(math.exp(whole - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * yes + (n - k) * no) for k in range(n // 2 + 1, n + 1))


def _steps(p: projects.Project, entity: str, fields: list[str]) -> list[tuple[str, str]]:
    out, at = [], entity
    for f in fields:
        at = next(k.entity for k in p.domain.entity(at).foreign_keys if k.field == f)
        out.append((f, at))
    return out


def inside(p: projects.Project, name: str, df: DataFrame, data: dict[str, DataFrame], seed: int) -> DataFrame:
    """df with the dates that rules bind to a window of what a row points to: some days after its start, within it."""
    for r in p.domain.rules:
        if r["kind"] == "date-window" and r["source"] == name and not r.get("link") and r["window"] in data and any(k.field == r["key"] and k.entity == r["window"] for k in p.domain.entity(name).foreign_keys):
            key = p.domain.entity(name).primary[0]
            w = data[r["window"]].select(norm(p.domain.entity(r["window"]).primary[0]).alias("__k"), day(F.col(r["startField"])).alias("__s"), day(F.col(r["endField"])).alias("__e"))
            days = F.floor(timing(r.get("timing") or {"kind": "uniform", "min": 0, "max": 7}, stream(seed, F.col(key).cast("string"), f"window:{name}:")) + 0.5).cast("int")
            at = F.least(F.coalesce("__e", F.date_add("__s", days)), F.date_add("__s", days))
            df = df.join(w, norm(df[r["key"]]) == F.col("__k"), "left").withColumn(r["dateField"], F.coalesce(at, F.col(r["dateField"]))).drop("__k", "__s", "__e")
    return df


def windowed(p: projects.Project, e: Entity, df: DataFrame, seed: int) -> DataFrame:
    """df whose windows end after they start: an end field gets days after the start's."""
    names = [f.name for f in e.fields]
    for start, end in (("StartDate", "EndDate"),):
        if start in names and end in names:
            days = F.floor(uniform(stream(seed, F.col(e.primary[0]).cast("string"), f"{end}:")) * 360).cast("int") + 5
            df = df.withColumn(end, F.date_add(start, days))
    return df


def _weights(p: projects.Project, name: str, since: int | None = None) -> dict[int, float]:
    """Each year's share of an entity's rows: the eras' unscoped multipliers of it."""
    unscoped = lambda y: [m for era in p.rules.get("eras", ()) if y in era.cycles for n, m, w in era.volumes if n == name and w is None]
    return {y: math.prod(unscoped(y) or [1.0]) for y in _cycles(p) if since is None or y >= since}


def _dealt(p: projects.Project, name: str, place: Column, n: int, since: int | None = None) -> Column:
    """The year of the row at a place (from 0) among n: years in order, each with its share of the rows."""
    weight = _weights(p, name, since)
    whole, done, year = sum(weight.values()), 0.0, None
    for y, w in weight.items():
        done += w
        until = int(n * done / whole + 0.5) if whole else n
        year = F.when(place < until, F.lit(y)) if year is None else year.when(place < until, F.lit(y))
    return year.otherwise(F.lit(list(weight)[-1]))


def spread(p: projects.Project, e: Entity, df: DataFrame, seed: int) -> DataFrame:
    """df with its rows dealt over the project's years, in proportion to the eras' unscoped multipliers of each year; without a field that dates rows as it is.

    Years are quotas of the rows' order by hash, so that each has its share exactly.
    """
    dates = [f.name for f in e.fields if f.type == "date"]
    field = e.cycle_field or cycle_field(df.schema, None)
    if field is None or field not in dates:
        return df
    if not sum(_weights(p, e.name).values()):
        return df.limit(0)
    out = ordinal(df.withColumn("__h", F.xxhash64(e.primary[0])), ["__h", e.primary[0]], "__n")
    year = _dealt(p, e.name, F.col("__n") - 1, df.count())
    last = F.when(year == p.release.year, F.lit(p.release.timetuple().tm_yday)).otherwise(365)
    at = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), F.floor(uniform(stream(seed, F.col(e.primary[0]).cast("string"), "day:")) * last).cast("int"))
    return out.withColumn(field, at).drop("__h", "__n")


def generated(spark: SparkSession, p: projects.Project, volumes: Callable[[str], int], seed: int, first: dict[str, int] | None = None, parents: dict[str, DataFrame] | None = None, catalogues: dict | None = None, history: bool = False, window: tuple[date, date] | None = None, numbered: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """Rows of every entity in dependency order, each with what it points to made before.

    first: the last ordinal that earlier cycles gave out; numbered gets the last of this one.

    Role windows and ballots are made by their rules, not by number; an entity
    that each row of another must have gets as many rows as that has, at least.
    history: rows are dealt over the project's years. window: a cycle's rows are
    dated after its start, up to its end.
    """
    data: dict[str, DataFrame] = {}
    roles, polls = _windows(p), _ballots(p)
    for name in entity_order(p.domain):
        e, n = p.domain.entity(name), volumes(name)
        known = {**(parents or {}), **{k: v.unionByName(parents[k], allowMissingColumns=True) if parents and k in parents else v for k, v in data.items()}}
        if name in roles and any(k.entity in data for k in e.foreign_keys):
            actor = roles[name]["windowKey"]
            body = next((k.entity for k in e.foreign_keys if k.entity in data and k.field != actor), None)
            if body is not None:
                data[name] = seats(spark, p, e, roles[name], data[body], seed, known)
            continue
        if name in polls and any(x["kind"] == "date-window" and x["source"] == name for x in p.domain.rules):
            continue  # voted() makes them
        if name in roles:
            continue
        must = [k for k in e.foreign_keys if k.dependent and k.entity in data]
        n = max([n, *[data[k.entity].count() for k in must]]) if n > 0 or must else n
        if n <= 0:
            continue
        begin = (first or {}).get(name, 0)
        if numbered is not None:
            numbered[name] = begin + n
        df = generate.rows(spark, p.domain, e, n, seed, {**known, **{k.entity: data[k.entity] for k in must}}, _start(p), begin + 1).drop("i")
        if history:
            df = windowed(p, e, spread(p, e, df, seed), seed)
        elif window and (field := e.cycle_field or cycle_field(df.schema, None)) in [f.name for f in e.fields if f.type == "date"]:
            at = F.floor(uniform(stream(seed, F.col(e.primary[0]).cast("string"), "day:")) * (window[1] - window[0]).days).cast("int") + 1
            df = windowed(p, e, df.withColumn(field, F.date_add(F.lit(window[0]), at)), seed)
        df = inside(p, name, df, known, seed)
        data[name] = records.decorated(df, e, e.primary[0], seed, catalogues, [(k.field, known[k.entity], k.target) for k in e.foreign_keys if k.entity in known]) if any(f.generator for f in e.fields) else df
    return data


def _cycles(p: projects.Project) -> list[int]:
    return list(range(p.start_cycle, p.release.year + 1))


def _of(p: projects.Project, kind: str, name: str) -> list:
    return [x for x in p.rules.get(kind, ()) if x.entity == name]


def injected(spark: SparkSession, p: projects.Project, data: dict[str, DataFrame], seed: int) -> dict[str, DataFrame]:
    """data with a row for each hero that has none, and children that their feature pins ask for. No other row changes.

    A hero's row is one of its entity, generated apart, with its own fields put in.
    """
    out = dict(data)
    for i, h in enumerate(p.rules.get("heroes", ())):
        if h.entity not in out:
            continue
        e = p.domain.entity(h.entity)
        if heroes.match(out[h.entity], [h]).where("hero IS NOT NULL").limit(1).count():
            continue
        row = generate.rows(spark, p.domain, e, 1, seed, out, f"{p.start_cycle}-01-01", 1_000_000_000 + i).drop("i")
        own = {**h.match, **h.fixed}
        row = row.withColumns({k: F.lit(v).cast(row.schema[k].dataType) for k, v in own.items() if k in row.columns})
        for kind, _, what, op, value in h.pins:
            if kind == "field" and op == "eq" and what not in own and what in row.columns:
                row = row.withColumn(what, F.lit(value).cast(row.schema[what].dataType))
        row = simulate.saved(row.withColumn("ID", entity_id(p.domain.namespace, e.name, [k for k in e.business_key if k != "ID"] or [F.lit(h.key)])) if "ID" in row.columns else row)
        out[h.entity] = out[h.entity].unionByName(row)
        for j, (kind, _, q, op, value) in enumerate(h.pins):
            if kind == "feature" and q["from"] in out and q.get("aggregation") in ("count", "exists") and op in ("eq", "gte", "gt"):
                child = p.domain.entity(q["from"])
                fk = next((k for k in child.foreign_keys if k.entity == h.entity), None)
                n = (int(value) if q["aggregation"] == "count" else 1) + (op == "gt")
                if fk is None or n <= 0:
                    continue
                made = {fk.field: F.lit(row.first()[fk.target])}
                if on := kin.dated_by(child, out[child.name]):
                    made[on] = F.date_add(F.make_date(_dealt(p, child.name, F.col("id"), n, h.birth), F.lit(1), F.lit(1)), F.pmod(F.xxhash64(F.lit(h.key), "id"), F.lit(365)).cast("int"))
                place = F.concat_ws(":", F.lit(h.key), F.lit(str(j)), F.col("id").cast("string"))
                kids = kin.belonging(p.domain, child, spark.range(n), made, place, out, seed, _start(p))
                kids = kids.withColumns({k: F.lit(v).cast(kids.schema[k].dataType) for k, v in (q.get("where") or {}).items()})
                kids = simulate.saved(kids.select(*out[q["from"]].columns))
                out = kin.added(out, {q["from"]: kids, **kin.dependents(p.domain, kids, child, out, seed, _start(p))})
    return out


def totalled(p: projects.Project, data: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """data whose headers' totals are the sums of the lines that depend on them."""
    out = dict(data)
    for e in p.domain.entities.values():
        for k in e.foreign_keys:
            if k.dependent and e.name in out and k.entity in out:
                amount = next((c for c in ("ExtendedPrice", "LineTotal") if c in out[e.name].columns), None)
                if amount and "TotalAmount" in out[k.entity].columns:
                    names = out[k.entity].columns
                    if {"Quantity", "UnitPrice"} <= set(out[e.name].columns):
                        out[e.name] = out[e.name].withColumn(amount, F.round(F.col("Quantity") * F.col("UnitPrice"), 2))
                    out[k.entity] = generate.rolled_up(out[k.entity], k.target, out[e.name], k.field, amount, "TotalAmount").select(*names)
    return out


def children_of_motifs(spark: SparkSession, p: projects.Project, name: str, people: DataFrame, data: dict[str, DataFrame], seed: int) -> dict[str, DataFrame]:
    """data with the rows that motifs' members get of other entities, each cycle after their birth, times the eras' multipliers."""
    out, key = dict(data), p.domain.entity(name).primary[0]
    for m in _of(p, "motifs", name):
        for child in m.children:
            e = p.domain.entity(child)
            fk = next((k for k in e.foreign_keys if k.entity == name), None)
            if fk is None or child not in out:
                continue
            factor = {c: math.prod([x for era in p.rules.get("eras", ()) if c in era.cycles for n, x, w in era.volumes if n == child and w is None] or [1.0]) for c in _cycles(p)}
            rows = simulate.motif_children(people, key, m, child, _cycles(p), seed, factor)
            place = F.concat_ws(":", F.lit(m.id), F.col("key").cast("string"), F.col("cycle").cast("string"), F.col("place").cast("string"))
            made = {fk.field: F.col("key")}
            if on := kin.dated_by(e, out[child]):
                made[on] = F.date_add(F.make_date("cycle", F.lit(1), F.lit(1)), F.pmod(F.xxhash64(place), F.lit(365)).cast("int"))
            # The business key may not tell such rows apart: their place does.
            new = simulate.saved(kin.belonging(p.domain, e, rows, made, place, out, seed, _start(p)).select(*out[child].columns))
            out = kin.added(out, {child: new, **kin.dependents(p.domain, new, e, out, seed, _start(p))})
    return out


def _unrolled(p: projects.Project, name: str, data: dict[str, DataFrame], factors: list[Factor], seed: int) -> tuple[dict[str, DataFrame], DataFrame | None, DataFrame]:
    """(data with the entity's outcomes of the last cycle and its ladders' states written to their fields, those states, the entity's rows with what moved them)."""
    df, e, cycles = data[name], p.domain.entity(name), _cycles(p)
    key, own = e.primary[0], _of(p, "heroes", name)
    dated_by = e.cycle_field or cycle_field(df.schema, None)
    born = (F.pmod(F.xxhash64(key), F.lit(len(cycles))) + cycles[0]).cast("int")
    if dated_by and e.name not in _windows(p):  # a dated row is born in its year
        born = F.coalesce(F.least(F.greatest(F.year(day(df[dated_by])), F.lit(cycles[0])), F.lit(cycles[-1])), born).cast("int")
    people = heroes.match(df, own)
    for h in own:
        if h.birth:
            born = F.when(F.col("hero") == h.key, F.lit(int(h.birth))).otherwise(born)
    people = people.withColumn("birth_cycle", born)
    dials = p.rules.get("dials", []) or [Dial(n, 0.0, 0.0) for n in _dial_names(p, name)]
    people = simulate.with_dials(people, key, dials, seed) if dials else people
    for h in own:
        people = people.withColumns({d: F.when(F.col("hero") == h.key, F.lit(float(v))).otherwise(F.col(d)) for d, v in h.dials.items() if d in people.columns})
    features = {}
    for f in factors:
        for i, a in enumerate(f.arrows):
            if not a.dial:
                people = compile_feature(resolved(a.feature, p.domain, name), people, data, key, f"__x_{f.id}_{i}")
                people = people.withColumn(f"__x_{f.id}_{i}", F.col(f"`__x_{f.id}_{i}`").cast("double"))
                features[f.id, i] = F.col(f"`__x_{f.id}_{i}`")
    people = simulate.saved(people)
    motifs = _of(p, "motifs", name)
    people = simulate.sample_motifs(people, key, motifs, seed) if motifs else people.withColumn("motif", F.lit(None).cast("string"))
    world = simulate.World(people, key, factors, seed, dials, p.rules.get("eras", []), motifs, own, [x for x in _of(p, "ladders", name) if x.binding])
    out = dict(data)
    rows = people.select(*df.columns)
    if factors or world.ladders:
        outcomes = simulate.unroll(world, cycles, features)
        outcomes = simulate.saved(outcomes) if outcomes is not None else None
        fixed = people.where("hero IS NOT NULL").select(F.col(key).cast("string").alias("key"), _fixed(own).alias("fixed")) if own else None
        values = {x.name: list(x.values) for x in e.fields}
        derived = {r["outcomeField"] for r in p.domain.rules if r["kind"] == "outcome-derived-from-ballots" and r["source"] == name}
        if factors and dated_by:  # a dated row tells of its own year, so that eras show in it
            outcomes = outcomes.join(people.select(F.col(key).alias("key"), F.col("birth_cycle").alias("cycle")), ["key", "cycle"], "left_semi")
        for f in factors:
            if f.outcome.get("from", "self") == "self" and f.outcome.get("where") and not derived & set(f.outcome["where"]):
                rows = simulate.written_back(rows, key, outcomes, f, values, fixed)
        for lad in world.ladders:
            mine = world.states.where(F.col("ladder") == lad.id)
            held, by, field = bound_to(p, lad) or (None, None, None)
            if held == name:
                rows = ladders.bind(rows, by, mine, lad, field, lad.binding.get("fixedFields"))
            elif held in out:  # the state stands in the rows that point to the entity
                out[held] = ladders.bind(out[held], by, mine, lad, field, lad.binding.get("fixedFields"))
    out[name] = rows
    return out, _with_dials(world), people


def _with_dials(w: simulate.World) -> DataFrame | None:
    """The ladders' states with the dials that their entities ended with, which the next cycle's prerequisites are about."""
    if w.states is None:
        return None
    names = [d.name for d in w.dials]
    table = F.create_map(*[x for d in names for x in (F.lit(d), F.col(d).cast("double"))]) if names else F.create_map().cast("map<string,double>")
    ended = w.ended if w.ended is not None else w.population
    return simulate.saved(w.states.join(ended.select(F.col(w.key).cast("string").alias("key"), table.alias("dials")), "key"))


def _dial_names(p: projects.Project, name: str) -> list[str]:
    """Dials that nothing declares but something names: they begin at 0 and move by what moves them."""
    used = [a.dial for f in _of(p, "factors", name) for a in f.arrows if a.dial] + [d for h in _of(p, "heroes", name) for d in h.dials]
    used += [d for m in _of(p, "motifs", name) for d in (*m.dials, *m.trajectory)]
    used += [d for x in _of(p, "ladders", name) for s in x.states for d in (*s.dials, *s.effects, *s.exit_effects)]
    return list(dict.fromkeys(used))


def _fixed(own: list) -> Column:
    out = F.array().cast("array<string>")
    for h in own:
        names = [*h.match, *h.fixed, *[w for kind, _, w, _, _ in h.pins if kind == "field"]]
        out = F.when(F.col("hero") == h.key, F.array(*map(F.lit, names)).cast("array<string>")).otherwise(out)
    return out


def build(spark: SparkSession, p: projects.Project, seed: int = 42) -> Built:
    """The project's dataset, unrolled through its cycles; nothing is written."""
    volume = lambda n: int(p.params.get(f"volume_{n}", p.params.get("volume_default", 10)))
    numbers: dict[str, int] = {}
    data = generated(spark, p, volume, seed, catalogues=_catalogues(spark, p), history=True, numbered=numbers)
    data = injected(spark, p, data, seed)
    data = {n: simulate.saved(df) for n, df in kin.aligned(p.domain, data, data).items()}
    states: DataFrame | None = None
    for name in list(data):
        own = [f for f in _of(p, "factors", name)]
        if own or _of(p, "motifs", name) or any(x.binding for x in _of(p, "ladders", name)):
            data, kept, people = _unrolled(p, name, data, own, seed)
            data = children_of_motifs(spark, p, name, people, data, seed)
            if kept is not None:
                states = kept if states is None else states.unionByName(kept)
    for r in _ballots(p).values():
        if r["source"] in data and any(x["kind"] == "date-window" and x["source"] == r["ballots"] and x["window"] in data for x in p.domain.rules):
            data[r["ballots"]], data[r["source"]] = voted(p, r, data, seed)
    data = suppression.suppressed(p.domain, data, p.rules.get("eras", []), seed)
    data = {n: simulate.saved(df) for n, df in reversals.cohered(p.domain, totalled(p, data)).items()}
    data = {n: simulate.saved(df) if df is not data[n] else df for n, df in kin.aligned(p.domain, data, data).items()}
    counts = {r["entity"]: r["n"] for r in accumulate.counted(data, {n: list(p.domain.entity(n).primary) for n in data}).collect()}
    return Built(data, accumulate.Checkpoint(p.domain.name, seed, p.release.year, p.release, p.domain.namespace, counts, numbers), states)


def write(p: projects.Project, built: Built) -> None:
    """Data first, the checkpoint last."""
    records.write(p.domain, built.data, str(p.output), mode="overwrite")
    Path(p.output).mkdir(parents=True, exist_ok=True)
    spark = SparkSession.active()
    files.delete(spark, f"{p.output}/{versions.LOG}")  # a build begins a history of its own
    files.delete(spark, f"{p.output}/{versions.KEPT}")
    versions.commit(spark, str(p.output), list(built.data), note=f"built as of {built.checkpoint.as_of}")
    if built.states is not None:
        built.states.write.mode("overwrite").parquet(_states(p, built.checkpoint.cycle))
    state.save_checkpoint(Path(p.output) / CHECKPOINT, built.checkpoint)


def _states(p: projects.Project, cycle: int) -> str:
    return f"{p.output}/_ladders/cycle-{cycle}"


def _stepped(spark: SparkSession, p: projects.Project, data: dict[str, DataFrame], cycle: int, by: int) -> tuple[DataFrame | None, dict[str, DataFrame]]:
    """(ladders' states a cycle on, rows of the entities whose bound fields they change: the ladder's own, or those that point to it)."""
    bound = [x for x in p.rules.get("ladders", ()) if x.binding and x.entity in data]
    if not bound:
        return None, {}
    if not files.exists(spark, _states(p, cycle)):
        raise accumulate.ContinuityError(f"{_states(p, cycle)}: the ladders' states are missing")
    states, out, rows = spark.read.parquet(_states(p, cycle)), None, {}
    for lad in bound:
        own = simulate.saved(ladders.step(states, lad, cycle + 1, by).where("NOT exited").drop("from_state", "exited"))
        out = own if out is None else out.unionByName(own)
        if (where := bound_to(p, lad)) and where[0] in data:
            name, key, field = where
            rows[name] = ladders.bind(rows.get(name, data[name]), key, own, lad, field, lad.binding.get("fixedFields"))
    return out, rows


def bound_to(p: projects.Project, lad: Ladder) -> tuple[str, str, str] | None:
    """(entity, its field that holds the ladder's entity's key, its field for the state)."""
    b = lad.binding or {}
    if b.get("field"):
        return lad.entity, p.domain.entity(lad.entity).primary[0], b["field"]
    if b.get("childEntity"):
        keys = p.domain.entity(b["childEntity"]).foreign_keys
        return b["childEntity"], next((k.field for k in keys if k.field == b["foreignKey"]), b["foreignKey"]), b["stateField"]
    return None


def _open(p: projects.Project, r: dict, data: dict[str, DataFrame], start: date, end: date) -> DataFrame | None:
    """Committed rows of a rule's decisions that fall into the window and have no ballot yet; none of an entity whose rows never change."""
    decision = p.domain.entity(r["source"])
    on = _decided_on(decision)
    if decision.immutable or r["source"] not in data or r["ballots"] not in data:
        return None
    key = decision.primary[0]
    rows = data[r["source"]].withColumn("__k", norm(key))
    ballots = data[r["ballots"]].select(norm(r["decisionField"]).alias("__b"))
    return accumulate.undecided(rows, "__k", on, start, end, ballots, "__b").drop("__k")


def _decided_on(decision: Entity) -> str:
    return next(f.name for f in decision.fields if f.type == "date" and f.name not in ("CreatedAt", "UpdatedAt"))


def next_cycle(spark: SparkSession, p: projects.Project, plan: Plan | None = None, seed: int | None = None, units: int = 1) -> Cycle:
    """One cycle on the project's committed state. All guards have passed when it returns, and nothing is written."""
    recovered(spark, p)
    prior = state.load_checkpoint(Path(p.output) / CHECKPOINT)
    if prior is None:
        raise accumulate.ContinuityError(f"{p.output}: no checkpoint to go on from")
    start, end = accumulate.window(prior, p.unit, units)
    accumulate.check_continuity(prior, p.domain.name, p.domain.namespace, seed, plan.as_of if plan else None, end)
    data = records.read(spark, p.domain, str(p.output), list(prior.counts))
    planned = applied(spark, plan, p.domain, data) if plan else {}
    seed = seed if seed is not None else prior.seed
    number = lambda n: accumulate.intake(n, p.params, p.rules.get("eras", []), end.year, plan.intake.get(n) if plan else None) if n in prior.counts else 0
    numbers: dict[str, int] = {}
    new = generated(spark, p, number, seed, prior.first(), data, _catalogues(spark, p), window=(start, end), numbered=numbers)
    decided: dict[str, DataFrame] = {}
    for r in _ballots(p).values():  # what is to be decided in the window and has no ballots yet, new or committed
        if r["ballots"] not in data or not any(x["kind"] == "date-window" and x["source"] == r["ballots"] for x in p.domain.rules):
            continue
        new = {n: simulate.saved(df) for n, df in new.items()}
        waiting = _open(p, r, data, start, end)
        todo = [df for df in (new.get(r["source"]), waiting) if df is not None]
        if not todo:
            continue
        todo = simulate.saved(todo[0] if len(todo) == 1 else todo[0].unionByName(todo[1], allowMissingColumns=True))
        whole = {n: (df.unionByName(new[n], allowMissingColumns=True) if n in new else df) for n, df in data.items()}
        new[r["ballots"]], outcomes = voted(p, r, {**whole, r["source"]: todo}, seed)
        key = p.domain.entity(r["source"]).primary[0]
        outcomes = simulate.saved(outcomes)
        if r["source"] in new:
            new[r["source"]] = outcomes.join(new[r["source"]].select(key), key, "left_semi")
        if waiting is not None:
            of = outcomes.join(waiting.select(key), key, "left_semi").select(F.col(key).alias("__k"), F.col(r["outcomeField"]).alias("__o"))
            rows = decided.get(r["source"], data[r["source"]])
            columns = rows.columns
            told = F.when(F.col("__k").isNotNull(), F.col("__o")).otherwise(F.col(r["outcomeField"]))
            decided[r["source"]] = simulate.saved(rows.join(of, rows[key] == F.col("__k"), "left").withColumn(r["outcomeField"], told).select(*columns))
    for n, df in new.items():
        key = p.domain.entity(n).primary[0]
        derived = {r["outcomeField"] for r in p.domain.rules if r["kind"] == "outcome-derived-from-ballots" and r["source"] == n}
        for f in (f for f in p.rules.get("factors", ()) if f.entity == n and f.outcome.get("from", "self") == "self" and f.outcome.get("where") and not derived & set(f.outcome["where"])):
            shift = sum(e.factors.get(f.id, 0.0) for e in p.rules.get("eras", ()) if end.year in e.cycles)
            drawn = simulate.intake_draws(df, key, f, seed, prior.cycle + 1, shift).select(F.lit(0).alias("cycle"), F.lit(f.id).alias("factor"), F.col(key).alias("key"), "outcome")
            values = {x.name: list(x.values) for x in p.domain.entity(n).fields}
            df = simulate.written_back(df, key, drawn, f, values)
        new[n] = df
    new = {n: simulate.saved(df) for n, df in new.items()}
    known = {n: df.unionByName(new[n], allowMissingColumns=True) if n in new else df for n, df in {**data, **decided}.items()}
    new = kin.aligned(p.domain, totalled(p, new), known)
    for n, df in planned.items():
        new[n] = new[n].unionByName(df, allowMissingColumns=True) if n in new else df
    new = {n: simulate.saved(df) for n, df in new.items()}
    keys = {n: p.domain.entity(n).primary for n in prior.counts}
    clashes = []
    for n, df in new.items():
        own = df.select(F.lower(primary_key(list(keys[n]))).alias("k"))
        twice = own.groupBy("k").count().where("count > 1").count()
        taken = own.join(data[n].select(F.lower(primary_key(list(keys[n]))).alias("k")), "k", "left_semi").count() if n in data else 0
        clashes += [f"{n}: {twice} keys twice among new rows"] if twice else []
        clashes += [f"{n}: {taken} new rows have keys that exist"] if taken else []
    if clashes:
        raise accumulate.ContinuityError("; ".join(clashes))
    pairs = {tuple(sorted((e.name, c.entity))) for e in p.domain.entities.values() for c in e.compositions if c.kind == "isA"}
    states, moved = _stepped(spark, p, {**data, **decided}, prior.cycle, units)
    moved = {**decided, **{n: simulate.saved(df) for n, df in moved.items()}}
    now = {n: moved.get(n, data[n]) for n in data}
    current = {n: now[n].unionByName(new[n], allowMissingColumns=True) if n in new else now[n] for n in data}
    found = accumulate.cycle(data, current, keys, {n for n in data if p.domain.entity(n).immutable}, pairs)
    added = {n: df.count() for n, df in new.items()}
    fields = {(to[0], to[2]) for x in p.rules.get("ladders", ()) if (to := bound_to(p, x)) and to[0] in moved}
    transitions = [status_transitions(found[n], n, f, prior.cycle + 1) for n, f in sorted(fields)]
    updated = {n: df for n, df in moved.items() if found[n].where("change = 'changed'").limit(1).count()}
    return Cycle(new, updated, states, transitions, accumulate.committed(prior, end, added, numbers))


def commit(spark: SparkSession, p: projects.Project, cycle: Cycle, prior: dict[str, DataFrame], batch: int | None = None) -> None:
    """Changed entities in place, new rows as new files, states, and the checkpoint last: all or nothing.

    Everything is written beside the state, then a journal names the renames
    that put it in place. Whoever is lost before the journal has changed
    nothing; after it, recovered() makes what is left of them.
    """
    recovered(spark, p)
    out = str(p.output)
    beside, version = f"{out}/_pending", max(versions.ids(spark, out), default=0) + 1
    files.delete(spark, beside)
    records.check_parents(p.domain, cycle.new, {n: cycle.updated.get(n, df) for n, df in prior.items()})
    moves: list[tuple[str, str, str]] = []
    kept: dict[str, str] = {}
    for n, df in cycle.updated.items():
        df.write.parquet(f"{beside}/changed/{n}")
        kept[n] = f"{versions.KEPT}/{version}/{n}"
        moves += [(journal.KEEP, f"{out}/{n}", f"{out}/{kept[n]}"), (journal.MOVE, f"{beside}/changed/{n}", f"{out}/{n}")]
    for n, df in cycle.new.items():
        df.write.parquet(f"{beside}/new/{n}")
        moves += [(journal.MOVE, f"{beside}/new/{n}/{f}", f"{out}/{n}/{f}") for f in files.data(spark, f"{beside}/new/{n}")]
    if cycle.states is not None:
        cycle.states.write.parquet(f"{beside}/states")
        moves.append((journal.MOVE, f"{beside}/states", _states(p, cycle.checkpoint.cycle)))
    checkpoint = replace(cycle.checkpoint, batch=cycle.checkpoint.batch if batch is None else batch)
    files.write_text(spark, f"{beside}/{CHECKPOINT}", state.dumped(checkpoint))
    moves.append((journal.MOVE, f"{beside}/{CHECKPOINT}", f"{out}/{CHECKPOINT}"))
    note = f"cycle {checkpoint.cycle} as of {checkpoint.as_of}"
    journal.begin(spark, out, moves, beside, {"version": version, "tables": list(checkpoint.counts), "moved": kept, "note": note})
    recovered(spark, p)


def recovered(spark: SparkSession, p: projects.Project) -> bool:
    """Puts in place what a lost commit has journalled; True if there was such a one. To be called before the state is read."""
    out = str(p.output)

    def told(then: dict) -> None:
        if then["version"] not in versions.ids(spark, out):
            versions.commit(spark, out, then["tables"], moved=then["moved"], note=then["note"])

    return journal.play(spark, out, told)


def cycle_of_batch(p: projects.Project):
    """What a stream of authored plans (value: a plan's JSON, or empty for a cycle without one) runs for each micro-batch: one cycle a plan, each batch once.

    The number of the batch is in the checkpoint, which is put in place with
    the data: a batch that Spark runs again, for the stream was lost before it
    could note it, adds nothing.
    """

    def run(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        recovered(spark, p)
        prior = state.load_checkpoint(Path(p.output) / CHECKPOINT)
        if prior is not None and prior.batch is not None and batch <= prior.batch:
            return
        told = [r["value"] for r in df.select("value").limit(2).collect()]
        if len(told) != 1:
            raise accumulate.ContinuityError(f"batch {batch}: {'no' if not told else 'more than one'} plan; a batch is one cycle")
        plan = parse(json.loads(told[0])) if told[0].strip() else None
        done = next_cycle(spark, p, plan)
        commit(spark, p, done, records.read(spark, p.domain, str(p.output), list(prior.counts)), batch)

    return run


def stream_plans(spark: SparkSession, p: projects.Project, folder: str, checkpoint_dir: str):
    """A streaming query that runs a cycle for each plan file of a folder that it hasn't run, oldest first, one a micro-batch."""
    frames = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", 1).text(folder)
    return accumulate.stream_cycles(frames, cycle_of_batch(p), checkpoint_dir)


def as_of(p: projects.Project) -> date | None:
    c = state.load_checkpoint(Path(p.output) / CHECKPOINT)
    return c.as_of if c else None
