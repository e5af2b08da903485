"""State deltas: what a cycle adds, changes and removes, and the guards on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import primary_key


def changed_fields(prior: str, current: str, fields: list[str]) -> Column:
    """Sorted names of fields that differ between two structs, null-safe; nested values by content."""
    return F.array_sort(F.array_compact(F.array(*[F.when(~F.col(f"{prior}.{f}").eqNullSafe(F.col(f"{current}.{f}")), F.lit(f)) for f in fields])))


def state_delta(prior: DataFrame, current: DataFrame, key: list[str], fields: list[str] | None = None, immutable: bool = False) -> DataFrame:
    """(id, change, changed, prior, current): new, changed or deleted rows by primary key, compared over fields (all of current's by default).

    immutable: a changed or deleted row raises when the delta is read.
    """
    fields = fields or current.columns
    side = lambda df, name: df.select(primary_key([df[k] for k in key]).alias("id"), F.struct(*[df[f] for f in fields]).alias(name))
    joined = side(prior, "prior").join(side(current, "current"), "id", "full_outer")
    changed = changed_fields("prior", "current", fields)
    out = joined.withColumn("changed", F.when(F.col("prior").isNotNull() & F.col("current").isNotNull(), changed).otherwise(F.array().cast("array<string>")))
    change = F.when(F.col("prior").isNull(), "new").when(F.col("current").isNull(), "deleted").when(F.size("changed") > 0, "changed")
    out = out.withColumn("change", change).where("change IS NOT NULL")
    if immutable:
        out = out.withColumn("change", F.when(F.col("change") == "new", F.col("change")).otherwise(F.raise_error(F.concat(F.lit("immutable row "), F.col("id"), F.lit(" is "), F.col("change")))))
    return out.select("id", "change", "changed", "prior", "current")


def status_transitions(delta: DataFrame, entity: str, field: str, cycle: int | None = None) -> DataFrame:
    """(entity, id, from_status, to_status, cycle) of changed rows whose field differs."""
    was, now = F.col(f"prior.{field}"), F.col(f"current.{field}")
    return delta.where((F.col("change") == "changed") & ~was.eqNullSafe(now)).select(F.lit(entity).alias("entity"), "id", was.alias("from_status"), now.alias("to_status"), F.lit(cycle).cast("int").alias("cycle"))


def reused_ids(frames: dict[str, DataFrame], is_a: set[tuple[str, str]], key: str = "ID") -> DataFrame:
    """Ids that two entities share without one being a kind of the other: (id, entities)."""
    union = None
    for name, df in frames.items():
        one = df.select(F.lower(df[key].cast("string")).alias("id"), F.lit(name).alias("entity")).distinct()
        union = one if union is None else union.union(one)
    shared = union.groupBy("id").agg(F.array_sort(F.collect_set("entity")).alias("entities")).where("size(entities) > 1")
    allowed = F.lit(False)
    for a, b in is_a:
        allowed = allowed | (F.col("entities") == F.array(*map(F.lit, sorted((a, b)))))
    return shared.where(~allowed)


def removed(prior: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Keys of prior that current lacks."""
    side = lambda df: df.select(primary_key([df[k] for k in key]).alias("id")).where("id IS NOT NULL")
    return side(prior).distinct().join(side(current), "id", "left_anti")


def appended(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Prior and new rows; fields one side lacks are null."""
    return prior.unionByName(new, allowMissingColumns=True)
