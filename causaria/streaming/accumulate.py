"""One cycle on committed state: window, intake, decisions, delta, checks, then the write.

A cycle is a micro-batch. All invariants are evaluated before anything is
written; data goes to its final place only then, and the checkpoint last, so
that a failed cycle leaves the state as it was.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import primary_key
from ..model import Era
from ..operators import delta as deltas


class ContinuityError(ValueError):
    pass


@dataclass(frozen=True)
class Checkpoint:
    domain: str
    seed: int
    cycle: int
    as_of: date
    namespace: str
    #: rows of each entity
    counts: dict[str, int]
    #: the last ordinal given out for each: rows that belong to others have none, so counts may run ahead
    numbered: dict[str, int] = field(default_factory=dict)
    #: the last micro-batch of a stream that was committed
    batch: int | None = None

    def first(self) -> dict[str, int]:
        return {n: max(self.counts.get(n, 0), self.numbered.get(n, 0)) for n in {*self.counts, *self.numbered}}


def advanced(d: date, unit: str, n: int = 1) -> date:
    """d moved by n cycles, with the rules of functions.dates.advance."""
    if unit in ("day", "week"):
        return d + timedelta(days=n * (7 if unit == "week" else 1))
    months = d.year * 12 + d.month - 1 + n * (12 if unit == "year" else 1)
    y, m = divmod(months, 12)
    last = (date(y + (m == 11), (m + 1) % 12 + 1, 1) - timedelta(days=1)).day
    own_last = (d + timedelta(days=1)).month != d.month
    return date(y, m + 1, last if unit == "month" and own_last else min(d.day, last))


def window(prior: Checkpoint, unit: str, n: int = 1) -> tuple[date, date]:
    """(start, end] of the next cycle."""
    return prior.as_of, advanced(prior.as_of, unit, n)


def intake(entity: str, params: dict, eras: list[Era], cycle: int, planned: int | None = None) -> int:
    """Rows to add: the entity's own parameter, else the default of 2, times unscoped era multipliers, rounded; a plan's number wins."""
    if planned is not None:
        return planned
    n = params.get(f"intake_{entity}", params.get("intake_default", 2))
    for e in eras:
        if cycle in e.cycles:
            for name, m, where in e.volumes:
                if name == entity and where is None:
                    n = n * m
    return math.floor(n + 0.5)


def counted(data: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """(entity, n, active): rows of each entity, and how many ids they have."""
    out = None
    for name, df in data.items():
        key = primary_key([F.col(k).cast("string") for k in keys[name]])
        one = df.select(key.alias("id")).groupBy("id").count().agg(F.lit(name).alias("entity"), F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("id").alias("active"))
        out = one if out is None else out.unionByName(one)
    return out


def undecided(events: DataFrame, key: str, date_field: str, start: date, end: date, decided: DataFrame, decided_key: str, limit: int | None = None) -> DataFrame:
    """Events of the window that no decision names, by date; the first so many if asked."""
    d = F.to_date(date_field)
    out = events.where((d > F.lit(start)) & (d <= F.lit(end))).join(decided.select(F.col(decided_key).alias("__d")).distinct(), F.col(key) == F.col("__d"), "left_anti")
    return out.orderBy(date_field, key).limit(limit) if limit is not None else out


def check_continuity(prior: Checkpoint, domain: str, namespace: str, seed: int | None, plan_as_of: date | None, as_of: date) -> list[str]:
    """Warnings; a mismatch that would corrupt the state raises, with every problem."""
    bad = []
    if prior.domain != domain:
        bad.append(f"the state is of domain {prior.domain!r}, not {domain!r}")
    if prior.namespace != namespace:
        bad.append("the namespace of identifiers has changed")
    if plan_as_of is not None and plan_as_of != as_of:
        bad.append(f"the plan is for {plan_as_of}, the cycle for {as_of}")
    if bad:
        raise ContinuityError("; ".join(bad))
    return [f"seed {seed} replaces {prior.seed}"] if seed is not None and seed != prior.seed else []


#: Shared ids that an error names one by one.
SHARED_SHOWN = 3


def cycle(prior: dict[str, DataFrame], new: dict[str, DataFrame], keys: dict[str, list[str]], immutable: set[str], is_a: set[tuple[str, str]] = frozenset()) -> dict[str, DataFrame]:
    """Deltas by entity, after all guards: nothing deleted, nothing immutable changed, no id shared by unrelated entities.

    new holds the entities' full current rows. Raises ContinuityError with every problem before anything is returned;
    of more than SHARED_SHOWN shared ids, so many and the number of all.
    """
    bad, out = [], {}
    for name, current in new.items():
        d = deltas.state_delta(prior[name], current, keys[name]) if name in prior else current.select(primary_key([current[k] for k in keys[name]]).alias("id"), F.lit("new").alias("change"), F.array().cast("array<string>").alias("changed"), F.lit(None).alias("prior"), F.struct(*current.columns).alias("current"))
        counts = {r["change"]: r["count"] for r in d.groupBy("change").count().collect()}
        if counts.get("deleted"):
            bad.append(f"{name}: {counts['deleted']} rows are gone")
        if name in immutable and counts.get("changed"):
            bad.append(f"{name}: {counts['changed']} immutable rows have changed")
        out[name] = d
    shared = deltas.reused_ids({n: df.select(primary_key([df[k] for k in keys[n]]).alias("ID")) for n, df in new.items()}, set(is_a)) if len(new) > 1 else None
    if shared is not None and (some := shared.limit(SHARED_SHOWN + 1).collect()):
        bad += [f"id {r['id']} is used by {', '.join(r['entities'])}" for r in some[:SHARED_SHOWN]]
        if len(some) > SHARED_SHOWN:
            bad.append(f"{shared.count()} ids in all are used by unrelated entities")
    if bad:
        raise ContinuityError("; ".join(bad))
    return out


def committed(checkpoint: Checkpoint, as_of: date, added: dict[str, int], numbered: dict[str, int] | None = None) -> Checkpoint:
    counts = {k: checkpoint.counts.get(k, 0) + added.get(k, 0) for k in {*checkpoint.counts, *added}}
    return replace(checkpoint, cycle=checkpoint.cycle + 1, as_of=as_of, counts=counts, numbered={**checkpoint.numbered, **(numbered or {})})


def stream_cycles(frames: DataFrame, run: Callable[[DataFrame, int], None], checkpoint_dir: str):
    """A streaming query that runs a cycle for each micro-batch of a stream; available data, then stop.

    A batch that was cut short is run again under its own number: run must
    know what it has committed (plans.build.cycle_of_batch does).
    """
    return frames.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def workflow(accumulate: Callable[[], object], validate: Callable[[object], bool], push: Callable[[object], bool] | None = None, inspect: Callable[[object], bool] | None = None) -> dict[str, object]:
    """accumulate, validate, push, inspect; the first that fails ends it."""
    state = accumulate()
    done = {"accumulated": state}
    for name, stage in (("validated", validate), ("pushed", push), ("inspected", inspect)):
        if stage is None:
            continue
        done[name] = bool(stage(state))
        if not done[name]:
            break
    return done
