"""Retrospective simulation: dials, motifs, heroes and factors unrolled over cycles.

Draws are keyed by (seed, purpose, entity, cycle, factor), never taken from a
shared sequence, so one row's history doesn't depend on who else is there: an
added hero leaves all others as they were. A cycle is one DataFrame step; the
state between cycles is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import bernoulli, keyed, normal, stream, uniform
from ..functions.scalars import logit, sigmoid
from ..model import Dial, Era, Factor, Hero, Ladder, Motif
from ..operators.calibrate import intercepts
from ..operators.compose import ordinal

#: Rows that a top-k may bring together in one task.
TOP_K = 10_000


def fresh(spark: SparkSession, kind: str, folder: str | None = None) -> str:
    """A new path in the folder that the cluster shares: spark.checkpoint.dir, or a temporary one where that is unset and all runs on one machine."""
    base = folder or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='causaria-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def saved(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df written to the cluster's shared folder and read back."""
    at = fresh(df.sparkSession, "state", folder)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


# Dials


def cholesky(dials: list[Dial]) -> list[list[float]]:
    """The lower factor of the dials' correlation matrix; correlations are clamped to 0.999, and a matrix that isn't positive definite is an error."""
    n, low = len(dials), [[0.0] * len(dials) for _ in dials]
    corr = lambda a, b: max(-0.999, min(0.999, a.correlations.get(b.name, b.correlations.get(a.name, 0.0))))
    for i in range(n):
        for j in range(i + 1):
            x = (1.0 if i == j else corr(dials[i], dials[j])) - sum(low[i][k] * low[j][k] for k in range(j))
            if i == j:
                if x <= 0:
                    raise ValueError(f"correlations of {', '.join(d.name for d in dials)} are inconsistent")
                low[i][i] = math.sqrt(x)
            else:
                low[i][j] = x / low[j][j]
    return low


def with_dials(df: DataFrame, key: str, dials: list[Dial], seed: int) -> DataFrame:
    """A column per dial: correlated normals, shifted and scaled."""
    low, s = cholesky(dials), stream(seed, F.col(key).cast("string"), "dials:")
    z = [normal(s, k + 1) for k in range(len(dials))]
    df = df.withColumns({f"__z{k}": x for k, x in enumerate(z)})
    out = {}
    for i, d in enumerate(dials):
        mixed = F.lit(0.0)
        for k in range(i + 1):
            if low[i][k]:
                mixed = mixed + F.lit(low[i][k]) * F.col(f"__z{k}")
        out[d.name] = F.lit(float(d.mean)) + F.lit(float(d.sd)) * mixed
    return df.withColumns(out).drop(*[f"__z{k}" for k in range(len(dials))])


def wander(key: Column, dial: Dial, cycle: Column | int, seed: int, years: float = 1.0) -> Column:
    """One cycle's step of a dial's random walk."""
    c = F.lit(cycle) if isinstance(cycle, int) else cycle
    return normal(stream(seed, F.concat_ws(":", key.cast("string"), F.lit(dial.name), c.cast("string")), "wander:"), 1, 0.0, dial.wander * math.sqrt(years))


def walk(df: DataFrame, key: str, dial: Dial, cycles: list[int], seed: int, drift: float = 0.0) -> DataFrame:
    """(row, cycle, value): the whole walk at once, as steps are keyed and add up; one window over an entity's few cycles."""
    out = df.withColumn("cycle", F.explode(F.array(*map(F.lit, cycles))))
    move = wander(F.col(key), dial, F.col("cycle"), seed) + F.lit(drift)
    return out.withColumn("__step", move).withColumn("value", F.col(dial.name) + F.sum("__step").over(Window.partitionBy(key).orderBy("cycle"))).drop("__step")


# Quotas


def quota(m: Motif, n: int) -> int:
    """How many of n candidates a motif takes."""
    if m.unit == "count":
        return min(n, math.floor(m.quota + 0.5))
    share = m.quota * n
    return min(n, {"floor": math.floor, "ceil": math.ceil}.get(m.rounding, lambda x: math.floor(x + 0.5))(share))


def quota_sample(df: DataFrame, key: str, k: int, seed: int, purpose: str) -> DataFrame:
    """Exactly k rows (or all, if fewer) by keyed order: a top-k while k is small, beyond that by places counted in two steps, never in one task."""
    u = keyed(seed, F.col(key).cast("string"), 1, f"{purpose}:")
    if k <= TOP_K:
        return df.orderBy(u, key).limit(k)
    return ordinal(df.withColumn("__u", u), ["__u", key], "__place").where(F.col("__place") <= k).drop("__u", "__place")


def sample_motifs(population: DataFrame, key: str, motifs: list[Motif], seed: int, birth: str = "birth_cycle", hero: str = "hero") -> DataFrame:
    """population with motif: for each motif in turn an exact quota of those still free that are no hero, born in its cycles and within its dials' bounds."""
    out = population.withColumn("motif", F.lit(None).cast("string"))
    for m in motifs:
        ok = F.col("motif").isNull() & F.col(hero).isNull()
        if m.births:
            ok = ok & F.col(birth).isin(list(m.births))
        for d, (low, high) in m.dials.items():
            ok = ok & (F.lit(True) if low is None else F.col(d) >= low) & (F.lit(True) if high is None else F.col(d) <= high)
        free = out.where(ok)
        chosen = saved(quota_sample(free, key, quota(m, free.count()), seed, f"motif:{m.id}").select(F.col(key).alias("__chosen")))
        out = out.join(chosen, F.col(key) == F.col("__chosen"), "left")
        hit = F.col("__chosen").isNotNull()
        fixed = {f: F.when(hit, F.lit(v)).otherwise(F.col(f)) if f in population.columns else F.when(hit, F.lit(v)) for f, v in m.fixed.items()}
        out = saved(out.withColumns(fixed | {"motif": F.when(hit, F.lit(m.id)).otherwise(F.col("motif"))}).drop("__chosen"))
    return out


# Factors


def conditioned(p: Column, seed: Column, pin: Column, tries: int = 100) -> tuple[Column, Column]:
    """(outcome, whether a try met the pin): draws of the row's own sub-streams are retaken until the outcome is the pinned one."""
    hit = F.exists(F.sequence(F.lit(1), F.lit(tries)), lambda k: bernoulli(uniform(seed, k), p) == pin)
    return F.when(pin.isNull(), bernoulli(uniform(seed, 1), p)).otherwise(pin), F.when(pin.isNull(), F.lit(True)).otherwise(hit)


@dataclass
class World:
    """What an unrolling reads: population (key, birth_cycle, hero, dials as columns), factors and what moves them."""

    population: DataFrame
    key: str
    factors: list[Factor]
    seed: int
    dials: list[Dial] = field(default_factory=list)
    eras: list[Era] = field(default_factory=list)
    motifs: list[Motif] = field(default_factory=list)
    heroes: list[Hero] = field(default_factory=list)
    ladders: list[Ladder] = field(default_factory=list)
    #: set by unroll(): who stands on which ladder after the last cycle, and everyone with the dials they ended with
    states: DataFrame | None = None
    ended: DataFrame | None = None


def acting(motifs: list[Motif], eras: list[Era], cycle: int) -> list[Motif]:
    """Motifs that move their members in a cycle: those that name no eras, or one that is on."""
    on = {e.name for e in eras if cycle in e.cycles}
    return [m for m in motifs if not m.eras or on & set(m.eras)]


def score(f: Factor, features: dict[tuple[str, int], Column], motifs: list[Motif] = (), ladders: list[Ladder] = ()) -> Column:
    """Sum of beta x over a factor's arrows, and of what ladders' states add.

    features: (factor, arrow's place) -> column, for arrows that aren't dials.
    A motif's members have its own beta where it gives one.
    """
    out = F.lit(0.0)
    for i, a in enumerate(f.arrows):
        x = F.col(a.dial) if a.dial else features[f.id, i]
        beta = F.lit(float(a.beta))
        for m in motifs:
            if (own := m.betas.get((f.id, a.name))) is not None:
                beta = F.when(F.col("motif") == m.id, F.lit(float(own))).otherwise(beta)
        out = out + beta * x
    for lad in ladders:
        for s in lad.states:
            if f.id in s.factor_effects:
                out = out + F.when(F.col(f"__state_{lad.id}") == s.name, F.lit(float(s.factor_effects[f.id]))).otherwise(F.lit(0.0))
    return out


def enrolled(w: World, cycle: int) -> DataFrame | None:
    """Who stands on which ladder when the unrolling begins: the share of each, motifs' members in their first state, heroes where they enter that cycle or before."""
    from . import ladders

    out = None
    for lad in w.ladders:
        free = w.population.where("hero IS NULL")
        states = ladders.enrol(free, w.key, lad, cycle, w.seed)
        for m in w.motifs:
            if m.ladder and m.ladder[0] == lad.id:
                states = ladders.force(states, free.where(F.col("motif") == m.id).select(w.key), lad.id, m.ladder[1], cycle)
        for h in w.heroes:
            for name, state, enter, leave in h.ladders:
                if name == lad.id and enter <= cycle and (leave is None or leave > cycle):
                    states = ladders.force(states, w.population.where(F.col("hero") == h.key).select(w.key), lad.id, state, cycle)
        states = states.withColumn("key", F.col("key").cast("string"))
        out = states if out is None else out.unionByName(states)
    return None if out is None else saved(out)


def climbed(w: World, people: DataFrame, states: DataFrame, cycle: int) -> tuple[DataFrame, DataFrame]:
    """(people, states) after a cycle on the ladders: prerequisites see the people's dials, and states entered and left move those."""
    from . import ladders

    dials = [d.name for d in w.dials]
    for lad in w.ladders:
        table = F.create_map(*[x for d in dials for x in (F.lit(d), F.col(d).cast("double"))]) if dials else F.create_map().cast("map<string,double>")
        own = states.where(F.col("ladder") == lad.id).join(people.select(F.col(w.key).cast("string").alias("key"), table.alias("dials")), "key")
        stepped = saved(ladders.step(own, lad, cycle))
        changed = [d for d in dials if any(d in s.effects or d in s.exit_effects for s in lad.states)]
        if changed:
            moved = stepped.select(F.col("key").alias("__k"), *[F.col("dials")[d].alias(f"__d_{d}") for d in changed])
            people = people.join(moved, people[w.key].cast("string") == F.col("__k"), "left").withColumns({d: F.coalesce(F.col(f"__d_{d}"), F.col(d)) for d in changed}).drop("__k", *[f"__d_{d}" for d in changed])
            people = saved(people)
        states = states.where(F.col("ladder") != lad.id).unionByName(stepped.where("NOT exited").select(*states.columns))
        for h in w.heroes:
            for name, state, enter, _ in h.ladders:
                if name == lad.id and enter == cycle:
                    states = ladders.force(states, people.where(F.col("hero") == h.key).select(F.col(w.key).cast("string").alias("key")), lad.id, state, cycle)
        states = saved(states)
    return people, states


def unroll(world: World, cycles: list[int], features: dict[tuple[str, int], Column] | None = None) -> DataFrame | None:
    """(cycle, factor, key, probability, outcome) of everyone alive, cycle by cycle; None without factors, where only dials and ladders move.

    Per cycle: dials wander and follow the trajectories of the motifs that act
    in it (those that name no era, or one that is on; overrides and betas
    alike); ladders are
    climbed, by the dials as they then are, and move them; each factor's scores are calibrated to its target over those who are no heroes and have
    no override (over all without override if none is left), all factors in one
    aggregate a round; the eras' shifts are added; then the keyed draws are
    made, and heroes' pins conditioned on.
    """
    w, key = world, world.key
    people, out = w.population, None
    pins = {(h.key, c, str(what)): expected for h in w.heroes for kind, c, what, _, expected in h.pins if kind == "outcome"}
    w.states = enrolled(w, cycles[0]) if w.ladders else None
    for cycle in cycles:
        motifs = acting(w.motifs, w.eras, cycle)
        overrides = {(m.id, f): p for m in motifs for f, p in m.overrides.items()}
        moves = {}
        for d in w.dials:
            move = wander(F.col(key), d, cycle, w.seed) if d.wander else F.lit(0.0)
            for m in motifs:
                if d.name in m.trajectory:
                    move = move + F.when(F.col("motif") == m.id, float(m.trajectory[d.name])).otherwise(0.0)
            moves[d.name] = F.when(F.col("birth_cycle") < cycle, F.col(d.name) + move).otherwise(F.col(d.name))
        people = saved(people.withColumns(moves)) if moves else people
        if w.ladders and cycle > cycles[0]:
            people, w.states = climbed(w, people, w.states, cycle)
        if not w.factors:
            continue
        alive = people.where(F.col("birth_cycle") <= cycle)
        for lad in w.ladders:
            on = w.states.where(F.col("ladder") == lad.id).select(F.col("key").alias("__k"), F.col("state").alias(f"__state_{lad.id}"))
            alive = alive.join(on, alive[key].cast("string") == F.col("__k"), "left").drop("__k")
        free = {}
        for f in w.factors:
            pinned = [m for m, fid in overrides if fid == f.id]
            open_ = ~F.coalesce(F.col("motif").isin(pinned), F.lit(False)) if pinned and "motif" in people.columns else F.lit(True)
            free[f.id] = (score(f, features or {}, motifs, w.ladders), open_)
        counts = alive.agg(*[F.count_if(o & F.col("hero").isNull()).alias(f"c{i}") for i, (_, o) in enumerate(free.values())]).first()
        b = intercepts(alive, {fid: (s, next(x.target for x in w.factors if x.id == fid), (o & F.col("hero").isNull()) if counts[f"c{i}"] else o) for i, (fid, (s, o)) in enumerate(free.items())})
        for f in w.factors:
            shift = sum(e.factors.get(f.id, 0.0) for e in w.eras if cycle in e.cycles)
            p = sigmoid(free[f.id][0] + F.lit(b[f.id] + shift))
            for (m, fid), x in overrides.items():
                if fid == f.id:
                    p = F.when(F.col("motif") == m, float(x)).otherwise(p)
            seed = stream(w.seed, F.concat_ws(":", F.lit(f.entity), F.col(key).cast("string"), F.lit(str(cycle)), F.lit(f.id)), "factor:")
            pin = F.lit(None).cast("boolean")
            for (h, c, what), v in pins.items():
                if what == f.id and c in (None, cycle):
                    pin = F.when(F.col("hero") == h, F.lit(bool(v))).otherwise(pin)
            outcome, met = conditioned(p, seed, pin)
            outcome = F.when(met, outcome).otherwise(F.raise_error(F.concat(F.lit(f"{f.id} in {cycle}: no draw meets the pin of "), F.col("hero"))).cast("boolean"))
            one = alive.select(F.lit(cycle).alias("cycle"), F.lit(f.id).alias("factor"), F.col(key).alias("key"), p.alias("probability"), outcome.alias("outcome"))
            out = one if out is None else out.unionByName(one)
    w.ended = people
    return out


def snapshot(outcomes: DataFrame) -> DataFrame:
    """Positives and population by cycle and factor."""
    return outcomes.groupBy("cycle", "factor").agg(F.count_if("outcome").alias("positives"), F.count(F.lit(1)).alias("population"))


def written_back(rows: DataFrame, key: str, outcomes: DataFrame, f: Factor, values: dict[str, list] | list | None = None, heroes: DataFrame | None = None) -> DataFrame:
    """rows with the factor's conjunction realised: its fields' values where positive; where not, otherwise, the other boolean, or the other of two values.

    values: a field's declared values by name (or those of the only field).
    heroes: (key, fixed array<string>): a row's fields that are fixed stay as they are.
    """
    last = outcomes.where(F.col("factor") == f.id).groupBy("key").agg(F.max_by("outcome", "cycle").alias("__o")).withColumnRenamed("key", "__key")
    out = rows.join(last, rows[key] == F.col("__key"), "left")
    if heroes is not None:
        out = out.join(heroes.select(F.col("key").alias("__hero"), F.col("fixed").alias("__fixed")), rows[key].cast("string") == F.col("__hero"), "left")
    rest = f.outcome.get("otherwise")
    for name, yes in f.outcome["where"].items():
        known = values.get(name) if isinstance(values, dict) else values
        if isinstance(rest, dict) and name in rest:
            no = rest[name]
        elif rest is not None and not isinstance(rest, dict):
            no = rest
        elif isinstance(yes, bool):
            no = not yes
        elif known and len(known) == 2 and yes in known:
            no = next(v for v in known if v != yes)
        else:
            raise ValueError(f"{f.id}: no value of {name} for a negative outcome")
        set_ = F.when(F.col("__o"), F.lit(yes)).when(~F.col("__o"), F.lit(no)).otherwise(F.col(name))
        if heroes is not None:
            set_ = F.when(F.array_contains(F.coalesce("__fixed", F.array().cast("array<string>")), name), F.col(name)).otherwise(set_)
        out = out.withColumn(name, set_)
    return out.drop("__key", "__o", "__hero", "__fixed")


def motif_children(people: DataFrame, key: str, motif: Motif, child: str, cycles: list[int], seed: int, multiplier: dict[int, float] | None = None) -> DataFrame:
    """(key, cycle, place) of the children that a motif's members get: a constant or drawn count a cycle, times the era's multiplier, rounded."""
    from ..functions.rng import integer

    low, high = motif.children[child]
    out = people.where(F.col("motif") == motif.id).select(F.col(key).alias("key"), F.explode(F.array(*map(F.lit, cycles))).alias("cycle"))
    n = F.lit(low) if low == high else integer(keyed(seed, F.concat_ws(":", F.col("key").cast("string"), F.lit(child), F.col("cycle").cast("string")), 1, "child:"), low, high)
    table = F.create_map(*[F.lit(x) for c in cycles for x in (c, float((multiplier or {}).get(c, 1.0)))])
    count = F.floor(n * table[F.col("cycle")] + 0.5).cast("int")
    return out.withColumn("__n", count).where("__n > 0").withColumn("place", F.explode(F.expr("sequence(1, __n)"))).drop("__n")


def inject(rows: DataFrame, heroes: list[dict]) -> DataFrame:
    """rows with heroes' own rows added; nothing else changes."""
    spark: SparkSession = rows.sparkSession
    if not heroes:
        return rows
    names = [f for f in rows.schema if any(f.name in h for h in heroes)]
    from pyspark.sql.types import StructType

    return rows.unionByName(spark.createDataFrame([[h.get(f.name) for f in names] for h in heroes], StructType(names)), allowMissingColumns=True)


def intake_draws(rows: DataFrame, key: str, f: Factor, seed: int, cycle: int, shift: float = 0.0) -> DataFrame:
    """rows of a cycle's intake with the factor drawn at its target, moved by the era's shift."""
    p = F.lit(f.target) if not shift else sigmoid(logit(F.lit(f.target)) + F.lit(shift))
    u = keyed(seed, F.concat_ws(":", F.col(key).cast("string"), F.lit(str(cycle)), F.lit(f.id)), 1, "intake:")
    return rows.withColumn("outcome", bernoulli(u, p))
