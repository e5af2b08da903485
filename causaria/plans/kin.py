"""Rows that belong to other rows: their keys say to what, so that none occurs twice however many kinds of parent there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import cycle_field, day
from ..functions.keys import entity_id, norm
from ..functions.rng import integer, keyed
from ..model import Domain, Entity, ForeignKey
from ..operators import generate
from ..operators.compose import ordinal
from ..operators.features import path
from ..streaming import simulate


def filled(domain: Domain, e: Entity, rows: DataFrame, made: dict[str, Column], place: Column, seed: int, start: str, by_place: bool = False) -> DataFrame:
    """rows as the entity's: given columns, an id by the business key, or by place where there is none or by_place, and all other fields by declaration."""
    out = rows.select("*", F.xxhash64(place).alias("i"), place.alias("__place"))
    for f in e.fields:
        if f.name in made:
            out = out.withColumn(f.name, made[f.name])
        elif f.name != "ID":
            out = out.withColumn(f.name, generate.value(f, e.name, seed, start))
    if "ID" in [f.name for f in e.fields]:
        own = [] if by_place else [k for k in e.business_key if k != "ID"]
        out = out.withColumn("ID", entity_id(domain.namespace, e.name, own or ["__place"]))
    return out.select(*[f.name for f in e.fields])


def belonging(domain: Domain, e: Entity, rows: DataFrame, made: dict[str, Column], place: Column, data: dict[str, DataFrame], seed: int, start: str) -> DataFrame:
    """rows as the entity's, with ids by place; foreign keys that made doesn't give point to rows of data chosen by hash of the place."""
    made = dict(made)
    for k in e.foreign_keys:
        if k.field in made or k.entity not in data:
            continue
        parents = data[k.entity].select(F.col(k.target).alias(f"__p_{k.field}"))
        parents = simulate.saved(ordinal(parents.withColumn("__h", F.xxhash64(f"__p_{k.field}")), ["__h", f"__p_{k.field}"], "__n"))
        at = F.pmod(F.xxhash64(place, F.lit(k.field)), F.lit(max(1, parents.count()))) + 1
        rows = rows.withColumn("__n", at).join(parents.drop("__h"), "__n", "left").drop("__n")
        made[k.field] = F.col(f"__p_{k.field}")
    return filled(domain, e, rows, made, place, seed, start, by_place=True)


def dated_by(e: Entity, df: DataFrame) -> str | None:
    """The date field that tells a row's cycle."""
    field = e.cycle_field or cycle_field(df.schema, None)
    return field if field in [f.name for f in e.fields if f.type == "date"] else None


def needed(domain: Domain, name: str) -> list[tuple[Entity, ForeignKey]]:
    """Entities of which each row of another must have one, with the key that points to it."""
    return [(e, k) for e in domain.entities.values() for k in e.foreign_keys if k.entity == name and k.dependent]


def dependents(domain: Domain, parents: DataFrame, parent: Entity, data: dict[str, DataFrame], seed: int, start: str, most: int = 1) -> dict[str, DataFrame]:
    """What rows of parent must have: for each entity that depends on it 1 to most rows a parent, dated as their parent is, and what those must have in turn."""
    out: dict[str, DataFrame] = {}
    for e, fk in needed(domain, parent.name):
        if e.name not in data:
            continue
        own = parents.select(F.col(fk.target).alias("__parent"), *([day(F.col(on)).alias("__day")] if (on := dated_by(parent, parents)) else []))
        n = integer(keyed(seed, F.concat_ws(":", F.lit(e.name), F.col("__parent").cast("string")), 1, "lines:"), 1, most) if most > 1 else F.lit(1)
        own = own.withColumn("__line", F.explode(F.sequence(F.lit(1), n.cast("int"))))
        made = {fk.field: F.col("__parent")}
        if "__day" in own.columns and (mine := dated_by(e, data[e.name])):
            made[mine] = F.col("__day")
        place = F.concat_ws(":", F.lit(parent.name), F.col("__parent").cast("string"), F.col("__line").cast("string"))
        rows = simulate.saved(belonging(domain, e, own, made, place, {**data, parent.name: parents}, seed, start).select(*data[e.name].columns))
        out[e.name] = out[e.name].unionByName(rows) if e.name in out else rows
        for n_, more in dependents(domain, rows, e, data, seed, start, most).items():
            out[n_] = out[n_].unionByName(more) if n_ in out else more
    return out


def added(data: dict[str, DataFrame], more: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """data with more rows of some entities."""
    return {n: df.unionByName(more[n]) if n in more else df for n, df in data.items()}


def slots(windows: list[tuple[str, str | None]]) -> list[int]:
    """For each (start, end) the least slot in which no earlier-starting window is still open: windows of one slot never overlap. Ends are inclusive; none is open."""
    ends: list[str] = []
    out = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: (windows[i][0], windows[i][1] or "9999", i)):
        start, end = windows[i][0], windows[i][1] or "9999"
        free = next((s for s, e in enumerate(ends) if e < start), None)
        if free is None:
            ends.append(end)
            free = len(ends) - 1
        else:
            ends[free] = end
        out[i] = free
    return out


def aligned(domain: Domain, rows: dict[str, DataFrame], data: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """rows that keep the rules on what they point to, all of which is in data: a field that a path must match has the path's value, and a text holds what it must name."""
    out = dict(rows)
    for r in domain.rules:
        name = r["source"]
        if name not in out or r["kind"] not in ("path-match", "text-contains-path") or any(h["entity"] not in data for h in r["path"]):
            continue
        columns = out[name].columns
        hops = [(h["field"], data[h["entity"]], h["key"]) for h in r["path"]]
        if r["kind"] == "path-match":
            if r.get("sourceField") and not r.get("inclusion"):
                found = path(out[name], hops, r["targetField"], "__end", raw=True)
                kind = found.schema[r["sourceField"]].dataType
                out[name] = found.withColumn(r["sourceField"], F.coalesce(F.col("__end").cast(kind), F.col(r["sourceField"]))).select(*columns)
            continue
        df, said = out[name], []
        for i, f in enumerate(r["targetFields"]):
            df = path(df, hops, f, f"__said{i}", raw=True)
            said.append(F.col(f"__said{i}").cast("string"))
        if (c := r.get("children")) and c["entity"] in data:
            child = data[c["entity"]]
            named = child.select(norm(c["key"]).alias("__of"), F.trim(child[c["field"]].cast("string")).alias("__name")).where("__name <> ''")
            named = named.groupBy("__of").agg(F.array_join(F.sort_array(F.collect_set("__name")), ", ").alias("__names"))
            *before, (field, _, _) = hops
            key = field
            if before:  # the key of the last row on the path stands in the row before it
                df, key = path(df, before, field, "__key", raw=True), "__key"
            df = df.join(named, norm(key) == F.col("__of"), "left")
            said.append(F.col("__names"))
        text = F.concat_ws(" - ", *said)
        out[name] = df.withColumn(r["textField"], F.when(text != "", text).otherwise(F.col(r["textField"]))).select(*columns)
    return out
