"""Record generation: rows of an entity as one select over a range of ordinals, and what depends on them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import relative_date
from ..functions.keys import entity_id, hex_bucket, norm, uuid5
from ..functions.rng import integer, keyed, normal, pick, stream, uniform, weighted
from ..model import TYPES, Domain, Entity, Field

FIRST = ("Ada", "Ben", "Cora", "Dan", "Eve", "Finn", "Gail", "Hugo", "Iris", "Jon")
LAST = ("Abel", "Brook", "Crane", "Dale", "Ely", "Ford", "Gray", "Hart", "Ives", "Jarvis")


def ordinals(spark: SparkSession, n: int, start: int = 1) -> DataFrame:
    """(i) from start, n rows, in as many partitions as Spark likes."""
    return spark.range(start, start + n).withColumnRenamed("id", "i")


def round_robin(values: tuple | list, i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(i - 1, F.lit(len(values))) + 1).cast("int"))


def parent_index(i: Column, parents: int, k: int = 0) -> Column:
    """Which parent (from 0) row i has for its k-th key: (i - 1) mod n, then the higher digits of i - 1 in base n."""
    return F.pmod(F.floor((i - 1) / (parents**k)), F.lit(parents)).cast("long")


def conditional(u: Column, on: Column, table: Mapping[str, Mapping[str, float]]) -> Column:
    """A value by the distribution of the row's condition: exact, else case aside, else * or default."""
    out = None
    for by in (lambda k: on == k, lambda k: F.lower(on) == k.lower()):
        for k, dist in table.items():
            if k not in ("*", "default"):
                v = weighted(u, list(dist), list(dist.values()))
                out = F.when(by(k), v) if out is None else out.when(by(k), v)
    rest = table.get("*") or table.get("default")
    other = weighted(u, list(rest), list(rest.values())) if rest else F.lit(None)
    return other if out is None else out.otherwise(other)


def from_catalogue(u: Column, on: Column | None, buckets: Mapping[str, list], mapping: Mapping[str, str] | None = None) -> Column:
    """An entry of the bucket that the condition maps to; else of default, unisex, or the first."""
    rest = next((buckets[k] for k in ("default", "unisex") if k in buckets), next(iter(buckets.values())))
    out = pick(u, rest)
    if on is None:
        return out
    name = on
    if mapping:
        name = F.coalesce(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[on], on)
    hit = None
    for k, values in buckets.items():
        hit = F.when(F.lower(name) == k.lower(), pick(u, values)) if hit is None else hit.when(F.lower(name) == k.lower(), pick(u, values))
    return hit.otherwise(out)


def condition_value(df: DataFrame, path: str, parents: list[tuple[str, DataFrame, str]], name: str = "__condition") -> DataFrame:
    """df with the value that a condition names: a field of the row, or parent.Field of its first parent (foreign key, parent, its key) that has the field."""
    if not path.startswith("parent."):
        return df.withColumn(name, F.col(path))
    field = path.removeprefix("parent.")
    for fk, parent, key in parents:
        if field in parent.columns:
            side = parent.select(norm(parent[key]).alias("__pk"), parent[field].alias(name)).dropDuplicates(["__pk"])
            return df.join(side, norm(df[fk]) == F.col("__pk"), "left").drop("__pk")
    raise ValueError(f"no parent has {field}")


def generated(df: DataFrame, key: str, fields: Mapping[str, Mapping], seed: int, catalogues: Mapping[str, Mapping[str, list]] | None = None, parents: list[tuple[str, DataFrame, str]] | None = None) -> DataFrame:
    """df with generated fields, in order, later ones seeing earlier ones. Draws are keyed by row and field.

    A field is {kind: conditional, on, table}, {kind: catalogue, name, on?, map?},
    {kind: relativeDate, anchor, mean, sd?, minAge?}, {kind: values, values,
    weights?} (fills nulls and empties only), or {kind: monogram | avatar, of, ...};
    an avatar without a service's base is a glyph of our own.
    """
    from ..functions.scalars import avatar_url, glyph, monogram

    for name, g in fields.items():
        s = stream(seed, F.col(key).cast("string"), f"{name}:")
        u = uniform(s)
        kind = g["kind"]
        if kind == "conditional":
            df = condition_value(df, g["on"], parents or [])
            c = conditional(u, F.col("__condition"), g["table"])
        elif kind == "catalogue":
            df = condition_value(df, g["on"], parents or []) if g.get("on") else df
            c = from_catalogue(u, F.col("__condition") if g.get("on") else None, (catalogues or {})[g["name"]], g.get("map"))
        elif kind == "relativeDate":
            c = relative_date(g["anchor"], s, lambda st, g=g: normal(st, 3, float(g["mean"]), float(g.get("sd", 0))) if g.get("sd") else F.lit(float(g["mean"])), g.get("minAge"))
        elif kind == "values":
            c = weighted(u, g["values"], g["weights"]) if g.get("weights") else pick(u, g["values"])
            if name in df.columns:
                c = F.coalesce(F.nullif(F.col(name), F.lit("")), c)
        elif kind == "monogram":
            c = monogram(g["of"])
        elif kind == "avatar" and not g.get("base"):
            c = glyph(g["of"], g.get("background"))
        elif kind == "avatar":
            c = avatar_url(g["of"], g["style"], g["base"], g.get("trait"), g.get("traits"), g.get("default"), g.get("background"))
        else:
            raise ValueError(f"{name}: unknown generator {kind!r}")
        df = df.withColumn(name, c).drop("__condition")
    return df


def value(f: Field, entity: str, seed: int, start: str) -> Column:
    """A field's value from its declaration, or by its name and type. i is the row's ordinal."""
    i = F.col("i")
    u = keyed(seed, F.concat_ws(":", F.lit(entity), i.cast("string"), F.lit(f.name)))
    low = f.name.lower()
    if f.default is not None:
        return F.lit(f.default)
    if f.values:
        return weighted(u, f.values, f.weights) if f.weights else round_robin(f.values, i)
    if f.nullable and f.type != "number":
        return F.lit(None).cast(TYPES[f.type])
    if f.type == "number":
        return F.round(10 + u * 990, 2) if any(x in low for x in ("price", "amount", "fee", "total", "revenue")) else integer(u, 1, 100).cast("double")
    if f.type == "boolean":
        return u < 0.5
    if f.type == "date":
        return F.date_add(F.lit(start).cast("date"), integer(u, 0, 364).cast("int"))
    if f.type == "uuid":
        return uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.concat_ws(":", F.lit(entity), F.lit(f.name), i.cast("string")))
    first, last = round_robin(FIRST, i), round_robin(LAST, F.floor((i - 1) / len(FIRST)) + 1)
    if low == "firstname":
        return first
    if low == "lastname":
        return last
    if "email" in low:
        return F.lower(F.concat(first, F.lit("."), last, i.cast("string"), F.lit("@example.org")))
    if low == "sku" or low.endswith(("number", "code")):
        return F.format_string(f"{entity[:3].upper()}-%06d", i)
    if low == "status":
        return F.lit("Active")
    return F.concat(F.lit(f"{entity} "), i.cast("string")) if "name" in low or low == "title" else F.concat(F.lit(f"{f.name} "), i.cast("string"))


def rows(spark: SparkSession, domain: Domain, entity: Entity, n: int, seed: int, parents: Mapping[str, DataFrame], start: str = "2020-01-01", first: int = 1) -> DataFrame:
    """n rows of an entity: keys by ordinal to parents, fields by declaration, the id from the business key (or the ordinal).

    parents: entity -> DataFrame with its key column. Parents are numbered by
    hash order of their key within buckets, and joined on the computed index.
    """
    df = ordinals(spark, n, first)
    fk_names = {k.field for k in entity.foreign_keys}
    df = df.select("i", *[value(f, entity.name, seed, start).alias(f.name) for f in entity.fields if f.name not in fk_names and not (f.name == "ID")])
    for k, fk in enumerate(entity.foreign_keys):
        optional = next((f.nullable for f in entity.fields if f.name == fk.field), False)
        if fk.entity not in parents:
            df = df.withColumn(fk.field, F.lit(None).cast("string"))
            if not optional:
                raise ValueError(f"{entity.name}.{fk.field}: no rows of {fk.entity} to point to")
            continue
        p = parents[fk.entity].select(F.col(fk.target).alias(fk.field))
        count = p.count()
        if count == 0:
            raise ValueError(f"{entity.name}.{fk.field}: {fk.entity} is empty")
        from .compose import ordinal

        numbered = ordinal(p.withColumn("__h", F.xxhash64(fk.field)), ["__h", fk.field], "__n").select(fk.field, (F.col("__n") - 1).cast("long").alias("__at"))
        df = df.withColumn("__at", parent_index(F.col("i"), count, k)).join(numbered, "__at").drop("__at")
    names = [f.name for f in entity.fields]
    if "ID" in names:
        df = df.withColumn("ID", entity_id(domain.namespace, entity.name, [k for k in entity.business_key if k != "ID"] or ["i"]))
    return df.select("i", *names)


def lines(parents: DataFrame, key: str, catalogue: DataFrame, item: str, price: str, seed: int, most: int = 2) -> DataFrame:
    """1 to most lines for each parent, items by hash of (parent, place) from a numbered catalogue, with quantity, unit and extended price."""
    from .compose import ordinal

    n = catalogue.count()
    numbered = ordinal(catalogue.select(F.xxhash64(item).alias("__h"), F.col(item).alias("item"), F.col(price).cast("double").alias("unit_price")), ["__h", "item"], "__n").select((F.col("__n") - 1).alias("at"), "item", "unit_price")
    s = stream(seed, F.col(key).cast("string"), "lines:")
    out = parents.withColumn("line", F.explode(F.sequence(F.lit(1), integer(uniform(s), 1, most).cast("int"))))
    own = stream(seed, F.concat_ws(":", F.col(key).cast("string"), F.col("line").cast("string")), "line:")
    out = out.withColumn("at", F.floor(uniform(own, 1) * n)).withColumn("quantity", integer(uniform(own, 2), 1, 5)).join(numbered, "at").drop("at")
    return out.withColumn("extended_price", F.round(F.col("quantity") * F.col("unit_price"), 2))


def rolled_up(parents: DataFrame, key: str, lines_: DataFrame, line_key: str, amount: str, total: str) -> DataFrame:
    """parents with the sum of their lines' amounts; 0 without lines."""
    sums = lines_.groupBy(norm(lines_[line_key]).alias("__l")).agg(F.round(F.sum(amount), 2).alias("__sum"))
    return parents.join(sums, norm(parents[key]) == F.col("__l"), "left").withColumn(total, F.coalesce("__sum", F.lit(0.0))).drop("__l", "__sum")


def thinned(rows_: DataFrame, key: str, multiplier: float | Column, seed: int, purpose: str) -> DataFrame:
    """A keyed share of rows: an era's multiplier below one drops rows, one above adds none."""
    return rows_.where(keyed(seed, F.col(key).cast("string"), 1, f"{purpose}:") < multiplier)


def scheduled(parents: DataFrame, schedule: list[dict]) -> DataFrame:
    """Every parent with every window of a declared schedule: an explode of literals, not a join."""
    if not schedule:
        return parents.limit(0)
    windows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in w.items()]) for w in schedule])
    return parents.select("*", F.inline(windows))


def seated(parents: DataFrame, key: str, candidates: DataFrame, actor: str, seats: int, seed: int, taken: DataFrame | None = None, pool: int = 64) -> DataFrame:
    """(key, actor, seat): for each parent, seats actors not already seated with it, by keyed draws without replacement; all that are free, if those are fewer.

    Candidates are dealt into buckets by hash. A parent draws from one bucket, of
    about pool actors at least, and goes on to the next for the seats that are
    left, so that no parent meets all candidates while seats can be filled.
    """
    from ..streaming.simulate import saved

    n = candidates.count()
    buckets = max(1, n // max(pool, 4 * seats))
    c = saved(candidates.select(F.col(actor).alias("actor")).distinct().withColumn("__b", F.pmod(F.xxhash64("actor"), F.lit(buckets))))
    open_ = saved(parents.select(F.col(key).alias("key")).distinct().withColumns({"__b": F.pmod(F.xxhash64("key"), F.lit(buckets)), "left": F.lit(seats)}))
    gone = None if taken is None else taken.select(F.col(key).alias("key"), F.col(actor).alias("actor")).distinct()
    u = keyed(seed, F.concat_ws(":", F.col("key").cast("string"), F.col("actor").cast("string")), 1, "seat:")
    out = None
    for _ in range(buckets):
        met = open_.join(c, "__b")
        met = met.join(gone, ["key", "actor"], "left_anti") if gone is not None else met
        ranked = met.withColumn("__r", F.row_number().over(Window.partitionBy("key").orderBy(u, "actor"))).where(F.col("__r") <= F.col("left"))
        one = saved(ranked.select("key", "actor", (F.lit(seats) - F.col("left") + F.col("__r")).cast("int").alias("seat")))
        out = one if out is None else out.unionByName(one)
        filled = one.groupBy("key").agg(F.count(F.lit(1)).alias("__n"))
        open_ = saved(open_.join(filled, "key", "left").select("key", F.pmod(F.col("__b") + 1, F.lit(buckets)).alias("__b"), (F.col("left") - F.coalesce("__n", F.lit(0))).cast("int").alias("left")).where("left > 0"))
        if open_.isEmpty():
            break
    return out.select(F.col("key").alias(key), F.col("actor").alias(actor), "seat")


def by_hash(df: DataFrame, id_: str, values: list) -> Column:
    """One of the values by the identifier's first hex digits."""
    return F.element_at(F.array(*map(F.lit, values)), (hex_bucket(df[id_], len(values)) + 1).cast("int"))
