"""What eras suppress: rows thinned by scoped multipliers, and whatever is nothing without them withdrawn.

A multiplier below one that is scoped (where) keeps that share of the rows of
its years that match, by keyed draws; 0 keeps none, and one above adds none. A
row that must have a row of an entity (a dependent key) and has lost all of them goes,
as does whatever points to a row that is gone; both go on until nothing does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import norm
from ..functions.rng import keyed
from ..model import Domain, Era
from ..operators.features import fall_through
from ..streaming.simulate import saved
from .validate import dated


def suppressed(domain: Domain, data: dict[str, DataFrame], eras: list[Era], seed: int) -> dict[str, DataFrame]:
    """data after all scoped multipliers below one; data itself where there are none."""
    out, thinned = dict(data), set()
    for i, era in enumerate(eras):
        for j, (name, m, where) in enumerate(era.volumes):
            if not where or m >= 1 or name not in out:
                continue
            e, df = domain.entity(name), out[name]
            if dated(domain, name, df)[0] is None:
                continue  # its gate will say why
            parents = [(k.field, out[k.entity], k.target) for k in e.foreign_keys if k.entity in out]
            rows = fall_through(df, dict(where), parents)
            meant = F.coalesce(dated(domain, name, rows)[0].isin(list(era.cycles)) & F.col("__scoped"), F.lit(False))
            stays = keyed(seed, F.col(e.primary[0]).cast("string"), 1, f"suppress:{i}:{j}:") < float(m) if m > 0 else F.lit(False)
            out[name] = saved(rows.where(~meant | stays).select(*df.columns))
            thinned.add(name)
    return withdrawn(domain, out, thinned)


def withdrawn(domain: Domain, data: dict[str, DataFrame], lost: set[str]) -> dict[str, DataFrame]:
    """data without what is nothing without rows that entities (lost) have lost: a fix-point over the entities, each step a semi-join."""
    out = dict(data)
    while lost:
        more: set[str] = set()

        def keep(name: str, rows: DataFrame, more: set[str] = more) -> None:
            rows = saved(rows.select(*out[name].columns))
            if rows.count() < out[name].count():
                out[name] = rows
                more.add(name)

        for name in sorted(lost):
            for k in domain.entity(name).foreign_keys:
                if k.dependent and k.entity in out:
                    has = out[name].select(norm(k.field).alias("__has")).distinct()
                    keep(k.entity, out[k.entity].join(has, norm(k.target) == F.col("__has"), "left_semi"))
            for e in domain.entities.values():
                for k in e.foreign_keys:
                    if k.entity == name and e.name in out:
                        there = out[name].select(norm(k.target).alias("__there")).distinct().withColumn("__is", F.lit(True))
                        points = out[e.name].join(there, norm(k.field) == F.col("__there"), "left")
                        keep(e.name, points.where(F.col("__is") | F.col(k.field).isNull() | (F.col(k.field).cast("string") == "")))
        lost = more
    return out
