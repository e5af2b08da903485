"""Era gates: volumes by year against baseline years, and factor shifts.

Everything follows from one aggregate of (year) -> rows, rows in scope and rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import gate

#: How far a volume may be off, and by how much a factor must shift.
VOLUME_TOLERANCE, LEAST_SHIFT = 0.20, 0.05


def by_year(df: DataFrame, year: Column, scoped: Column | None = None, outcome: Column | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(scoped if scoped is not None else F.lit(True)).alias("s")]
    if outcome is not None:
        aggs.append(F.sum(outcome).alias("o"))
    return df.where(year.isNotNull()).groupBy(year.cast("long").alias("year")).agg(*aggs)


def baseline(years: DataFrame, target: int, era_years: list[int], value: str) -> Column:
    """Mean of value over years outside all eras: those before the target if there are any with rows, else all. Null without any."""
    free = ~F.col("year").isin(list(era_years)) if era_years else F.lit(True)
    before = free & (F.col("year") < target)
    return F.coalesce(F.avg(F.when(before, F.col(value))), F.avg(F.when(free, F.col(value))))


def volume(name: str, years: DataFrame, target: int, multiplier: float, era_years: list[int], retention: float = 1.0) -> DataFrame:
    """The target year's rows are baseline x multiplier x retention, within the tolerance; 0 asked for means none."""
    c = years.agg(F.coalesce(F.sum(F.when(F.col("year") == target, F.col("n"))), F.lit(0)).alias("actual"), baseline(years, target, era_years, "n").alias("base"))
    want = F.coalesce("base", "actual") * F.lit(multiplier * retention)
    if multiplier == 0 or retention == 0:
        ok, want = F.col("actual") == 0, F.lit(0.0)
    else:
        ok = (F.coalesce("base", "actual") > 0) & (F.abs(F.col("actual") - want) / F.greatest(want, F.lit(1.0)) <= VOLUME_TOLERANCE)
    return c.select(*gate(name, "era", ok, F.col("actual"), F.round(want.cast("double"), 4), F.col("actual")))


def retention(children: list[tuple[int, float]], target: int) -> float:
    """What scoped zero multipliers of dependent children leave of a parent's rows: two or more nothing, one half. children: (cycle, multiplier)."""
    zeros = sum(1 for cycle, m in children if cycle == target and m == 0)
    return 0.0 if zeros > 1 else 0.5 if zeros else 1.0


def scoped_volume(name: str, years: DataFrame, target: int, multiplier: float, era_years: list[int], parent_multiplier: float = 1.0) -> DataFrame:
    """Scoped rows follow the multiplier, and all rows what that takes away or adds, both within the tolerance."""
    at = lambda v: F.coalesce(F.sum(F.when(F.col("year") == target, F.col(v))), F.lit(0))
    c = years.agg(at("n").alias("actual"), at("s").alias("scoped"), baseline(years, target, era_years, "n").alias("base"), baseline(years, target, era_years, "s").alias("base_s"))
    total = F.greatest(F.lit(0.0), F.coalesce("base", "actual") * parent_multiplier + F.coalesce("base_s", F.lit(0.0)) * (parent_multiplier * (multiplier - 1)))
    near = lambda a, b: F.abs(a - b) / F.greatest(b, F.lit(1.0)) <= VOLUME_TOLERANCE
    want = F.col("base_s") * (parent_multiplier * multiplier)
    own = F.col("scoped") == 0 if multiplier == 0 else (F.col("base_s") > 0) & near(F.col("scoped"), want)
    return c.select(*gate(name, "era", near(F.col("actual"), total) & own, F.col("actual"), F.concat_ws(" / ", F.round(total, 4), F.round(F.coalesce(want, F.lit(0.0)), 4)), F.concat_ws(" / ", "actual", "scoped")))


def factor_shift(name: str, years: DataFrame, target: int, delta: float, era_years: list[int]) -> DataFrame:
    """The rate in the era's cycle differs from the pooled rate of cycles outside eras by LEAST_SHIFT at least, in delta's direction."""
    free = ~F.col("year").isin(list(era_years))
    c = years.agg(F.sum(F.when(F.col("year") == target, F.col("n"))).alias("n"), F.sum(F.when(F.col("year") == target, F.col("o"))).alias("o"), F.sum(F.when(free, F.col("n"))).alias("bn"), F.sum(F.when(free, F.col("o"))).alias("bo"))
    shift = F.try_divide(F.col("o").cast("double"), F.col("n")) - F.try_divide(F.col("bo").cast("double"), F.col("bn"))
    ok = shift >= LEAST_SHIFT if delta > 0 else shift <= -LEAST_SHIFT
    return c.select(*gate(name, "era", ok, F.coalesce("n", F.lit(0)), f"shift {'>=' if delta > 0 else '<='} {LEAST_SHIFT if delta > 0 else -LEAST_SHIFT}", F.round(shift, 6)))


def dataset_years(frames: list[tuple[DataFrame, Column]]) -> DataFrame:
    """The distinct years over all entities."""
    out = None
    for df, year in frames:
        one = df.select(year.cast("long").alias("year")).where("year IS NOT NULL").distinct()
        out = one if out is None else out.union(one)
    return out.distinct()


def year_with_parents(df: DataFrame, own: Column | None, parents: list[tuple[str, DataFrame, str, Column]]) -> DataFrame:
    """df with year: the row's own, else its first parent's that has one. parents: (foreign key, parent, its key, its year)."""
    from ..functions.keys import norm

    out, found = df, [] if own is None else [own.cast("long")]
    for i, (fk, parent, key, year) in enumerate(parents):
        side = parent.select(norm(parent[key]).alias(f"__y{i}"), year.cast("long").alias(f"__year{i}")).dropDuplicates([f"__y{i}"])
        out = out.join(side, norm(df[fk]) == F.col(f"__y{i}"), "left")
        found.append(F.col(f"__year{i}"))
    return out.withColumn("__year", F.coalesce(*found)).select(*df.columns, F.col("__year").alias("year"))
