"""Key normalisation, primary keys and name-based identifiers as Column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Name = str | Column


def col(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c: Name) -> Column:
    """A key as text; the empty string counts as null."""
    return F.nullif(col(c).cast("string"), F.lit(""))


def norm(c: Name) -> Column:
    """A key as it compares: text, lower case, empty as null."""
    return F.lower(filled(c))


INTEGRAL = ("byte", "short", "integer", "long")


def pair(a: DataFrame, x: str, b: DataFrame, y: str) -> tuple[Column, Column]:
    """Two tables' keys as they compare: whole numbers as such, which shuffle and hash at a fraction of the cost, all else as norm."""
    if all(df.schema[c].dataType.typeName() in INTEGRAL for df, c in ((a, x), (b, y))):
        return a[x].cast("long"), b[y].cast("long")
    return norm(a[x]), norm(b[y])


def primary_key(fields: list[Name]) -> Column:
    """The fields joined by |; null if any is null or empty."""
    parts = [filled(f) for f in fields]
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole = whole & p.isNotNull()
    return F.when(whole, F.concat_ws("|", *parts))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID, version 5: SHA-1 of the namespace's bytes and the name, with version and variant set."""
    raw = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(raw, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(raw, 1, 8), F.substring(raw, 9, 4), F.concat(F.lit("5"), F.substring(raw, 14, 3)), F.concat(variant, F.substring(raw, 18, 3)), F.substring(raw, 21, 12))


def entity_id(namespace: str, entity: str, keys: list[Name]) -> Column:
    """The identifier that an entity's business key stands for."""
    return uuid5(namespace, F.concat(F.lit(f"{entity}:"), F.concat_ws("|", *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys])))


def hex_bucket(id_: Name, buckets: int) -> Column:
    """The first eight hex digits of an identifier, modulo buckets."""
    return (F.conv(F.substring(col(id_), 1, 8), 16, 10).cast("long") % buckets).cast("long")


def lookup_parts(c: Name) -> tuple[Column, Column, Column]:
    """(entity, field, value) of '@lookup:Entity.Field=Value' with ?parameters cut; nulls if it isn't one. '@lookup:Value' leaves entity and field null."""
    text = F.regexp_extract(col(c), r"(?s)^@lookup:([^?]*)", 1)
    entity, field, value = (F.regexp_extract(text, r"(?s)^([^.=]+)\.([^=]+)=(.*)$", k) for k in (1, 2, 3))
    named = text.rlike(r"(?s)^[^.=]+\.[^=]+=")
    is_one = col(c).startswith("@lookup:")
    return F.when(is_one & named, entity), F.when(is_one & named, field), F.when(is_one, F.when(named, value).otherwise(text))
