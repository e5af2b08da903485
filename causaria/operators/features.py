"""Feature queries: a field or conjunction of the row, a path of foreign keys, or an aggregate over children.

A query is {from: self | path | children, ...}; each compiles to columns on the
entity's DataFrame, so Catalyst sees plain joins and aggregates. Several child
aggregates over one child entity and key share one group-by.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from ..functions.keys import norm, pair
from ..functions.scalars import number
from ..model import Domain

AGGREGATES = ("count", "exists", "sum", "avg", "min", "max")


def kind(df: DataFrame, field: str) -> str:
    t = df.schema[field].dataType
    return "boolean" if isinstance(t, BooleanType) else "string" if isinstance(t, StringType) else "number"


def where(df: DataFrame, conditions: Mapping[str, object] | None) -> Column:
    """All fields equal their values, strictly; null never matches."""
    out = F.lit(True)
    for f, v in (conditions or {}).items():
        out = out & F.coalesce(df[f] == F.lit(v), F.lit(False))
    return out


def self_feature(df: DataFrame, query: Mapping) -> Column:
    """The field as a number, or 1 where the conjunction holds and 0 elsewhere."""
    if query.get("where"):
        return where(df, query["where"]).cast("int").cast("double")
    return number(df[query["field"]], kind(df, query["field"]))


def raw_self(df: DataFrame, query: Mapping) -> Column:
    return where(df, query["where"]) if query.get("where") else df[query["field"]]


def children(df: DataFrame, child: DataFrame, key: str, fks: str | list[str], features: Mapping[str, Mapping], raw: bool = False) -> DataFrame:
    """df with a column per feature, over the child rows that point to it by any of fks (each row once).

    features: name -> {aggregation, field?, where?}. Numbers are coerced, nulls
    ignored, and empty sets give 0; raw: uncoerced, empty sets give null (count
    and exists aside).
    """
    fks = [fks] if isinstance(fks, str) else fks
    own = norm(df[key])
    if len(fks) == 1:
        own, theirs = pair(df, key, child, fks[0])
        linked = child.withColumn("__to", theirs)
    else:  # a child that points to one parent twice counts once
        linked = child.withColumn("__to", F.explode(F.array_distinct(F.array_compact(F.array(*[norm(child[k]) for k in fks])))))
    aggs = []
    for name, q in features.items():
        a, hit = q["aggregation"], where(child, q.get("where"))
        if a not in AGGREGATES:
            raise ValueError(f"{name}: unknown aggregation {a!r}; known: {', '.join(AGGREGATES)}")
        if a in ("count", "exists"):
            n = F.count_if(hit)
            aggs.append((n if a == "count" else (n > 0)).alias(name))
        else:
            x = child[q["field"]]
            value = x if raw else (x.cast("double") if kind(child, q["field"]) == "boolean" else x.try_cast("double"))
            aggs.append(getattr(F, a)(F.when(hit, value)).alias(name))
    found = linked.where("__to IS NOT NULL").groupBy("__to").agg(*aggs)
    out = df.withColumn("__key", own).join(found, F.col("__key") == F.col("__to"), "left")
    empty = {n: F.lit(0) if features[n]["aggregation"] == "count" else F.lit(False) if features[n]["aggregation"] == "exists" else None if raw else F.lit(0.0) for n in features}
    return out.withColumns({n: F.coalesce(F.col(n), e) for n, e in empty.items() if e is not None}).drop("__key", "__to")


def path(df: DataFrame, hops: list[tuple[str, DataFrame, str]], field: str, name: str, raw: bool = False) -> DataFrame:
    """df with the field found by following foreign keys: hops are (key in the row before, target, its key).

    A broken hop gives 0, or null if raw. Only keys and the last field of the
    targets are read.
    """
    sides = [pair(df if i == 0 else hops[i - 1][1], fk, target, key) for i, (fk, target, key) in enumerate(hops)]
    out = df.withColumn("__k0", sides[0][0])
    for i, (_, target, _) in enumerate(hops):
        last = i == len(hops) - 1
        onward = target[field] if last and raw else number(target[field], kind(target, field)) if last else sides[i + 1][0]
        side = target.select(sides[i][1].alias(f"__j{i}"), onward.alias(name if last else f"__k{i + 1}")).where(F.col(f"__j{i}").isNotNull()).dropDuplicates([f"__j{i}"])
        out = out.join(side, F.col(f"__k{i}") == F.col(f"__j{i}"), "left").drop(f"__k{i}", f"__j{i}")
    return out if raw else out.withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))


def resolved(query: Mapping, domain: Domain, entity: str) -> dict:
    """The query with what its declaration leaves to the domain: a path's keys by name, and the key by which children point to the entity."""
    q = dict(query)
    q.setdefault("from", "self")
    if q["from"] == "path":
        steps, at = [], entity
        for s in q["path"][:-1]:
            fk, _, to = s.partition(":")
            known = next((k for k in domain.entity(at).foreign_keys if fk == k.field or to and k.entity == to and fk.lower().endswith(f"_{to}".lower())), None)
            steps.append(f"{known.field if known else fk}:{to or known.entity}.{known.target if known else 'ID'}" if "." not in to else s)
            at = to.partition(".")[0] or known.entity
        q["path"] = [*steps, q["path"][-1]]
    elif q["from"] != "self" and not q.get("via"):
        q["via"] = [k.field for k in domain.entity(q["from"]).foreign_keys if k.entity == entity]
        if not q["via"]:
            raise ValueError(f"{q['from']} has no key to {entity}")
    return q


def compile_feature(query: Mapping, df: DataFrame, data: Mapping[str, DataFrame], key: str, name: str, raw: bool = False) -> DataFrame:
    """df with the query's value as column name. Paths are 'FK:Entity' or 'FK:Entity.key' hops and the last field."""
    source = query["from"]
    if source == "self":
        return df.withColumn(name, raw_self(df, query) if raw else self_feature(df, query))
    if source == "path":
        *steps, field = query["path"]
        hops = []
        for s in steps:
            fk, _, to = s.partition(":")
            entity, _, k = to.partition(".")
            hops.append((fk, data[entity], k or "ID"))
        return path(df, hops, field, name, raw)
    if source not in data:
        raise ValueError(f"feature {name}: unknown entity {source!r}")
    return children(df, data[source], key, query["via"], {name: query}, raw)


def static_assignment(rules: list[tuple[Column, object]]) -> Column:
    """The value of the first rule whose condition holds; a row that none fits raises."""
    out = None
    for when, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(when, v) if out is None else out.when(when, v)
    stop = F.raise_error(F.lit("no rule fits the row"))
    return stop if out is None else out.otherwise(stop.cast("string") if not isinstance(rules[0][1], Column) and isinstance(rules[0][1], str) else stop)


def fall_through(df: DataFrame, conditions: Mapping[str, object], parents: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """df with __scoped: whether all fields equal their values as lower-case text; a field the row lacks or has null is its first parent's that has it."""
    out, values = df, {f: [norm(df[f])] if f in df.columns else [] for f in conditions}
    for i, (fk, parent, key) in enumerate(parents):
        own = [f for f in conditions if f in parent.columns]
        if own:
            side = parent.select(norm(parent[key]).alias(f"__p{i}"), *[norm(parent[f]).alias(f"__p{i}_{f}") for f in own]).dropDuplicates([f"__p{i}"])
            out = out.join(side, norm(df[fk]) == F.col(f"__p{i}"), "left")
            for f in own:
                values[f].append(F.col(f"__p{i}_{f}"))
    scoped = F.lit(True)
    for f, v in conditions.items():
        scoped = scoped & (F.coalesce(F.coalesce(*values[f]) == F.lit(str(v).lower()), F.lit(False)) if values[f] else F.lit(False))
    out = out.withColumn("__scoped", scoped)
    return out.select(*df.columns, "__scoped")


def template(row: Mapping[str, Mapping], seed: Column, scope: Mapping[str, Column] | None = None) -> list[Column]:
    """Columns of a row template. Each field is one of const, from, fromOptional, fmt, seq, pick, mix, chance, int; draws are numbered by field.

    from: a dotted path that must not be null; fmt: text with {path} parts, empty where null.
    """
    from ..functions.rng import bernoulli, integer, pick, uniform, weighted

    at = lambda p: (scope or {}).get(p, F.col(p))
    out = []
    for n, (name, spec) in enumerate(row.items(), 1):
        (tag, arg), u = next(iter(spec.items())), uniform(seed, n)
        if tag == "const":
            c = F.lit(arg)
        elif tag == "from":
            c = at(arg)
        elif tag == "fromOptional":
            c = at(arg)
        elif tag == "fmt":
            c = fmt(arg, at)
        elif tag == "seq":
            c = at(arg.get("of", "seq")) + F.lit(arg.get("start", 1)) if isinstance(arg, Mapping) else at("seq")
        elif tag == "pick":
            c = pick(u, list(arg))
        elif tag == "mix":
            c = weighted(u, list(arg), [float(w) for w in arg.values()])
        elif tag == "chance":
            c = bernoulli(u, float(arg))
        elif tag == "int":
            c = integer(u, int(arg[0]), int(arg[1]))
        else:
            raise ValueError(f"{name}: unknown template tag {tag!r}")
        if tag == "from":
            c = F.when(c.isNull(), F.raise_error(F.lit(f"{name}: {arg} is null"))).otherwise(c)
        out.append(c.alias(name))
    return out


def fmt(text: str, at) -> Column:
    """Text with {path} parts put in; null parts are empty."""
    import re

    parts = [F.coalesce(at(p[1:-1]).cast("string"), F.lit("")) if p.startswith("{") and p.endswith("}") else F.lit(p) for p in re.split(r"(\{[\w.]+\})", text) if p]
    return F.concat(*parts) if parts else F.lit("")


def last_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows of an order, which must be total: a top-k, never a sort of all."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def examples(judged: DataFrame, key: str, n: int = 3, by: list[str] = ()) -> DataFrame:
    """How many rows are violated, and the first n keys of them in order: what a gate's message shows. Tasks send n keys each."""
    bad = judged.where("violated")
    first = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__few")))), 1, n)
    part = bad.groupBy(*by, F.spark_partition_id().alias("__p")).agg(F.count(F.lit(1)).alias("__n"), F.slice(F.array_sort(F.collect_set(F.col(key))), 1, n).alias("__few"))
    return part.groupBy(*by).agg(F.sum("__n").alias("violations"), first.alias("examples"))
