"""Nested records: children inside their parents, and out again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import norm, pair


def with_collection(parent: DataFrame, key: str, child: DataFrame, fk: str, name: str, child_key: list[str]) -> DataFrame:
    """parent with its child rows as an array of structs, without the foreign key, sorted by the child's key; no children: empty.

    A parent's children are one array: memory is bounded by the largest parent.
    """
    kept = [c for c in child.columns if c != fk]
    order = [*child_key, *[c for c in kept if c not in child_key]]
    own, theirs = pair(parent, key, child, fk)
    rows = child.groupBy(theirs.alias("__p")).agg(F.array_sort(F.collect_list(F.struct(*[child[c] for c in order]))).alias(name))
    return parent.join(rows, own == F.col("__p"), "left").drop("__p").withColumn(name, F.coalesce(F.col(name), F.array().cast(rows.schema[name].dataType)))


def with_extension(parent: DataFrame, key: str, child: DataFrame, child_key: str, name: str) -> DataFrame:
    """parent with the row that extends it (same key) as a struct; null where it has none."""
    side = child.select(norm(child[child_key]).alias("__x"), F.struct(*[child[c] for c in child.columns if c != child_key]).alias(name))
    return parent.join(side, norm(parent[key]) == F.col("__x"), "left").drop("__x")


def with_embed(parent: DataFrame, fk: str, child: DataFrame, child_key: str, name: str) -> DataFrame:
    """parent with the row its foreign key points to as a struct."""
    side = child.select(norm(child[child_key]).alias("__e"), F.struct(*child.columns).alias(name)).dropDuplicates(["__e"])
    return parent.join(side, norm(parent[fk]) == F.col("__e"), "left").drop("__e")


def without_collection(parent: DataFrame, key: str, name: str, fk: str, carry: Sequence[str] = ()) -> DataFrame:
    """The child rows of a collection, with the foreign key from their parent, and its columns in carry."""
    return parent.select(F.col(key).alias(fk), F.inline(name), *carry)


def without_extension(parent: DataFrame, key: str, name: str, child_key: str, carry: Sequence[str] = ()) -> DataFrame:
    return parent.where(F.col(name).isNotNull()).select(F.col(key).alias(child_key), f"{name}.*", *carry)


def without_embed(parent: DataFrame, name: str, child_key: str) -> DataFrame:
    """The embedded rows, each once."""
    return parent.where(F.col(name).isNotNull()).select(f"{name}.*").dropDuplicates([child_key])


def orphans(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows that no parent could hold."""
    own, theirs = pair(child, fk, parent, key)
    return child.join(parent.select(theirs.alias("__p")).distinct(), own == F.col("__p"), "left_anti")


def overlapping_extensions(extensions: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Keys that two extensions of one parent share: (id, extensions)."""
    union = None
    for name, (df, key) in extensions.items():
        one = df.select(norm(df[key]).alias("id"), F.lit(name).alias("extension")).distinct()
        union = one if union is None else union.union(one)
    return union.groupBy("id").agg(F.array_sort(F.collect_set("extension")).alias("extensions")).where("size(extensions) > 1")


def parts(rows: DataFrame, order: list[str], size: int, last_part: int = 0, last_rows: int = 0, by: list[str] | None = None) -> DataFrame:
    """rows with part: the last part filled up to size, then new ones, in order.

    The ordinal is global: numbered in two steps, within range partitions and
    by their counts, so that no task holds all rows; by keeps it within groups.
    """
    from pyspark.sql import Window

    at = lambda n: (F.floor((n - 1 + last_rows) / size) + last_part).cast("long")
    if by:
        return rows.withColumn("part", at(F.row_number().over(Window.partitionBy(*by).orderBy(*order))))
    return ordinal(rows, order, "__n").withColumn("part", at(F.col("__n"))).drop("__n")


def ordinal(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their 1-based place in the order, which must be total.

    Rows are dealt into ranges of the whole order, so that a first key of one
    value is cut by the next, and sorted within them; what is written then has
    each row's range and place in it, and the ranges' counts, a row a range,
    are summed on the driver.
    """
    from ..streaming.simulate import saved

    dealt = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33).cast("int")
    counts = {r["b"]: r["n"] for r in dealt.groupBy(part.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for b in range(max(counts, default=-1) + 1):
        starts.append(before)
        before += counts.get(b, 0)
    start = F.element_at(F.array(*[F.lit(b).cast("long") for b in starts or [0]]), part + 1)
    return dealt.withColumn(name, start + F.col("__m").bitwiseAND((1 << 33) - 1) + 1).drop("__m")
