"""Dates: cycle arithmetic, windows, timing draws, and which field dates a row."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType, TimestampType

from .keys import Name, col
from .rng import normal, uniform


def day(c: Name) -> Column:
    """A date column, or the date that a text starts with; null where there is none."""
    return F.to_date(F.substring(col(c).cast("string"), 1, 10).try_cast("date"))


def advance(d: Name, unit: str, n: int | Column) -> Column:
    """d moved by n cycles. By months, a month's end stays one; by years, the day is clamped alone."""
    d, n = col(d), (F.lit(n) if isinstance(n, int) else n).cast("int")
    if unit in ("day", "week"):
        return F.date_add(d, n * (7 if unit == "week" else 1))
    if unit == "month":
        moved = F.add_months(d, n)
        return F.when(d == F.last_day(d), F.last_day(moved)).otherwise(moved)
    if unit == "year":
        return F.add_months(d, n * 12)
    raise ValueError(f"unknown cycle unit {unit!r}")


def in_cycle(d: Name, start: Name, end: Name) -> Column:
    """The half-open window (start, end]."""
    return (col(d) > col(start)) & (col(d) <= col(end))


def within(d: Name, start: Name, end: Name) -> Column:
    """Inclusive at both ends; a null end is open."""
    d = col(d)
    return (col(start).isNull() | (d >= col(start))) & (col(end).isNull() | (d <= col(end)))


def in_window(u: Column, start: Name, end: Name) -> Column:
    """A uniform day of (start, end]."""
    days = F.datediff(col(end), col(start))
    return F.date_add(col(start), (F.floor(u * days) + 1).cast("int"))


def age(birth: Name, at: Name) -> Column:
    """Years, of 365.2425 days."""
    return F.datediff(col(at), col(birth)) / 365.2425


def cycle_field(schema: StructType, declared: str | None = None) -> str | None:
    """The field that dates a row: the declared one, else Cycle, Year, the first ...Date, ...At, ...On, else the first date; births and audit dates never."""
    names = schema.fieldNames()
    if declared:
        if declared not in names:
            raise ValueError(f"cycle field {declared!r} is not among {', '.join(names)}")
        return declared
    usable = [f for f in schema if not re.fullmatch(r"(?i)(dob|dateofbirth|birthdate|createdat|updatedat)", f.name)]
    for pattern in (r"(?i)cycle", r"(?i)year", r".*[dD]ate", r".*At", r".*On"):
        if found := next((f.name for f in usable if re.fullmatch(pattern, f.name)), None):
            return found
    return next((f.name for f in usable if isinstance(f.dataType, DateType | TimestampType)), None)


def row_year(schema: StructType, field: str, c: Name | None = None) -> Column:
    """The year that a cycle field gives: a number as it is, a date's or text's year."""
    x = col(field if c is None else c)
    kind = schema[field].dataType.typeName()
    if kind in ("integer", "long", "double", "short"):
        return x.cast("long")
    return F.year(x).cast("long") if kind in ("date", "timestamp", "timestamp_ntz") else F.substring(x, 1, 4).try_cast("long")


def timing(spec: dict, seed: Column, n: int = 1) -> Column:
    """Days by a timing: const {days}, uniform {min, max}, lognormal {median, sigma, min, cap}, or mixture {parts: [{weight, timing}]}.

    Draw n is the stream's; a mixture uses it to choose and the next ones within.
    """
    kind = spec["kind"]
    if kind == "const":
        return F.lit(float(spec["days"]))
    if kind == "uniform":
        return F.floor(uniform(seed, n) * (spec["max"] - spec["min"] + 1)).cast("double") + float(spec["min"])
    if kind == "lognormal":
        days = F.lit(float(spec["median"])) * F.exp(F.lit(float(spec["sigma"])) * normal(seed, n))
        return F.least(F.greatest(days, F.lit(float(spec.get("min", 0)))), F.lit(float(spec.get("cap", 1e9))))
    if kind == "mixture":
        parts, total, run, out = spec["parts"], sum(p["weight"] for p in spec["parts"]), 0.0, None
        for p in parts:
            run += p["weight"]
            hit = uniform(seed, n) * total <= run
            at = timing(p["timing"], seed, n + 1)
            out = F.when(hit, at) if out is None else out.when(hit, at)
        return out.otherwise(timing(parts[-1]["timing"], seed, n + 1))
    raise ValueError(f"unknown timing {kind!r}")


def relative_date(anchor: Name, seed: Column, years: Callable[[Column], Column], min_age: int | None = None) -> Column:
    """A date years before the anchor, on a random month and day (1-28), at least min_age years before it."""
    a = col(anchor)
    d = F.make_date(F.year(a) - F.floor(years(seed)).cast("int"), (F.floor(uniform(seed, 11) * 12) + 1).cast("int"), (F.floor(uniform(seed, 12) * 28) + 1).cast("int"))
    return F.least(d, F.add_months(a, -12 * min_age)) if min_age is not None else d


def tenure(unit: str, start: Name, end: Name) -> Column:
    """Whole cycles between two dates."""
    if unit in ("day", "week"):
        return F.floor(F.datediff(col(end), col(start)) / (7 if unit == "week" else 1)).cast("long")
    months = F.floor(F.months_between(col(end), col(start))).cast("long")
    return months if unit == "month" else F.floor(months / 12).cast("long")
