"""Heroes: authored rows that must be there, with what is pinned on them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pin
from ..model import Domain, Hero
from .features import compile_feature, kind, resolved
from .gates import gate


def match(df: DataFrame, heroes: list[Hero]) -> DataFrame:
    """df with hero: the key of the hero whose fields all equal the row's, as text; null for everyone else."""
    out = None
    for h in heroes:
        same = F.lit(True)
        for f, v in h.match.items():
            same = same & F.coalesce(df[f].cast("string") == F.lit(str(v)), F.lit(False))
        out = F.when(same, F.lit(h.key)) if out is None else out.when(same, F.lit(h.key))
    return df.withColumn("hero", F.lit(None).cast("string") if out is None else out)


def pins(df: DataFrame, hero: Hero, data: Mapping[str, DataFrame], key: str = "ID", domain: Domain | None = None) -> DataFrame:
    """(place, held) of the hero's field and feature pins, over its row; no row gives no rows."""
    own, cols = match(df, [hero]).where("hero IS NOT NULL"), []
    for i, (what, _, of, op, expected) in enumerate(hero.pins):
        if what == "field":
            held = pin(op, own[of], expected, kind(df, of) == "number")
        elif what == "feature":
            own = compile_feature(resolved(of, domain, hero.entity) if domain else of, own, data, key, f"__f{i}", raw=True)
            numeric = own.schema[f"__f{i}"].dataType.typeName() not in ("string", "boolean", "date")
            seen = own.schema[f"__f{i}"].dataType.typeName() == "boolean" and isinstance(expected, int) and not isinstance(expected, bool)
            held = pin(op, F.col(f"__f{i}").cast("int") if seen else F.col(f"__f{i}"), expected, numeric or seen)
        else:  # outcomes are conditioned on when they are drawn
            continue
        cols.append((i, held))
    if not cols:
        return own.select(F.lit(0).alias("place"), F.lit(True).alias("held")).limit(0)
    return own.select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), h.alias("held")) for i, h in cols])))


def gates(data: Mapping[str, DataFrame], heroes: list[Hero], domain: Domain | None = None) -> list[DataFrame]:
    """A gate per hero: exactly one row matches, and all its pins hold."""
    out = []
    for h in heroes:
        rows = match(data[h.entity], [h]).where("hero IS NOT NULL").select(F.lit(1).alias("n"), F.lit(True).alias("held"))
        found = rows.union(pins(data[h.entity], h, data, domain=domain).select(F.lit(0), "held")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(~F.col("held")).alias("broken"))
        out.append(found.select(*gate(f"hero {h.key}", "hero", (F.col("n") == 1) & (F.col("broken") == 0), F.col("n"), "1 row, 0 broken pins", F.format_string("%d rows, %d broken pins", "n", "broken"))))
    return out
