"""Entity data at rest: wrapped JSON records in and out, Parquet parts, appends that leave committed files alone."""

from __future__ import annotations

import json as json_
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..model import Domain, Entity
from ..operators import compose
from ..plans.graph import composed, directories
from . import files

#: Records of one file at most.
PART_ROWS = 5000
#: The files that name a folder's entity and the order of folders; readers of records pass them over.
SIDECAR, ORDER = "_entity.json", "_order.json"


def read_wrapped(spark: SparkSession, path: str, schema: StructType, key: list[str], entity: str | None = None, placed: bool = False) -> DataFrame:
    """Rows of files that each hold an array of {primaryKey, fields}, or one such record a line.

    A file that doesn't parse, one that is neither, or an element without
    either part fails the read; an empty file or array has no rows. Where
    entity is given, the folder's sidecar must name it. Files are parsed whole:
    write() puts at most PART_ROWS records in one. placed: also the file
    (__file) and the place in it (__at) of each.
    """
    from pyspark.sql.types import StructField

    if entity is not None:
        check_sidecar(spark, path, entity)
    element = StructType([StructField("primaryKey", StructType([schema[k] for k in key])), StructField("fields", StructType([f for f in schema if f.name not in key]))])
    space = " \t\n\x0b\f\r"
    text = F.rtrim(F.ltrim("value", F.lit(space + "\ufeff")), F.lit(space))
    files = spark.read.text(path, wholetext=True).select(text.alias("text"), F.col("_metadata.file_path").alias("__file"))
    lines = F.filter(F.split("text", r"[\r\n]+"), lambda x: F.trim(x) != "")
    arrays = F.when(F.col("text") == "", F.array().cast("array<string>")).when(F.col("text").startswith("[") & F.col("text").endswith("]"), F.array("text")).when(F.col("text").startswith("{"), F.transform(lines, lambda x: F.concat(F.lit("["), x, F.lit("]")))).otherwise(F.raise_error(F.lit(f"{path}: a file that is neither an array nor records")).cast("array<string>"))
    rows = files.select("__file", F.posexplode(arrays).alias("__line", "array")).select("__file", "__line", F.posexplode(F.from_json("array", ArrayType(element), {"mode": "FAILFAST"})).alias("__at", "row"))
    part = lambda x: F.when(F.col(f"row.{x}").isNull(), F.raise_error(F.lit(f"{path}: an element without {x}"))).otherwise(F.col(f"row.{x}"))
    where = ["__file", (F.col("__line") + F.col("__at")).cast("long").alias("__at")] if placed else []
    rows = rows.select(part("primaryKey").alias("primaryKey"), part("fields").alias("fields"), *where)
    return rows.select(*[F.col(f"primaryKey.{k}") for k in key], *[F.col(f"fields.{f.name}") for f in schema if f.name not in key], *[F.col(c) for c in ("__file", "__at") if placed])


def wrapped(df: DataFrame, key: list[str]) -> DataFrame:
    """{primaryKey, fields} records."""
    return df.select(F.struct(*[df[k] for k in key]).alias("primaryKey"), F.struct(*[df[c] for c in df.columns if c not in key]).alias("fields"))


def write_wrapped(df: DataFrame, path: str, entity: str, key: list[str], mode: str = "errorifexists") -> None:
    """df as files of one JSON array of PART_ROWS records each, in order of the key, and a sidecar that names the entity.

    Absent values are left out of a record, as the reader takes them for null.
    A part is gathered in one task, and holds PART_ROWS records at most.
    """
    write_numbered(compose.ordinal(df, key, "__n"), path, entity, key, mode)


def write_numbered(df: DataFrame, path: str, entity: str, key: list[str], mode: str = "errorifexists") -> None:
    """The same of rows whose places in the order are there (__n), each once.

    A record is a line of its file. All parts but the last are full, and a task
    has its parts in order, so that a file ends where PART_ROWS lines are written.
    """
    numbered = df.withColumn("__part", F.floor((F.col("__n") - 1) / PART_ROWS))
    lines = laid(numbered, ["__part"], ["__n"], key).select("value")
    lines.write.mode(mode).option("maxRecordsPerFile", PART_ROWS).text(path)
    files.write_text(df.sparkSession, f"{path}/{SIDECAR}", json_.dumps({"entity": entity, "primaryKey": key}))


def laid(df: DataFrame, by: list[str], order: list[str], key: list[str]) -> DataFrame:
    """The lines (value) of files that each hold an array of one group's records, with by: sorted by group and order, which must be total.

    Columns of by and order are no fields.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    fields = [c for c in df.columns if c not in (*key, *by, *order)]
    record = F.struct(F.struct(*[F.col(k) for k in key]).alias("primaryKey"), F.struct(*[F.col(c) for c in fields]).alias("fields"))
    ends = df.withColumns({"__first": F.row_number().over(w) == 1, "__last": F.lead(F.lit(1)).over(w).isNull()})
    line = F.concat(F.when(F.col("__first"), "[").otherwise(""), F.to_json(record), F.when(F.col("__last"), "]").otherwise(","))
    return ends.sortWithinPartitions(*by, *order).select(line.alias("value"), *by)


def check_sidecar(spark: SparkSession, path: str, entity: str) -> None:
    """Raises unless the folder's sidecar is there and names the entity."""
    at = f"{path.rstrip('/')}/{SIDECAR}"
    if not files.exists(spark, at):
        raise ValueError(f"{at}: missing")
    try:
        found = json_.loads(files.read_text(spark, at)).get("entity")
    except (ValueError, AttributeError) as e:
        raise ValueError(f"{at}: {e}") from e
    if found != entity:
        raise ValueError(f"{at}: holds {found!r}, not {entity!r}")


def nested(domain: Domain, data: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Entities with their own directory, what they hold composed into them; children that no parent could hold raise when read."""
    out = {}

    def whole(name: str) -> DataFrame:
        e, df = domain.entity(name), data[name]
        for c in e.compositions:
            if c.entity not in data:
                continue
            child = whole(c.entity)
            if c.kind == "collection":
                df = compose.with_collection(df, e.primary[0], child, c.field, c.entity, domain.entity(c.entity).primary)
            elif c.kind == "isA":
                df = compose.with_extension(df, e.primary[0], child, domain.entity(c.entity).primary[0], c.entity)
            else:
                df = compose.with_embed(df, c.field, child, domain.entity(c.entity).primary[0], c.entity)
        return df

    for name in directories(domain):
        if name in data:
            out[name] = whole(name)
    return out


def shared(domain: Domain) -> set[str]:
    """Entities whose rows may stand in several places: those that are embedded or held in two ways, and all that they hold."""
    held = [c for e in domain.entities.values() for c in e.compositions]
    ways = Counter(c.entity for c in held)
    out: set[str] = set()
    more = {c.entity for c in held if c.kind == "embed" or ways[c.entity] > 1}
    while more:
        out |= more
        more = {c.entity for n in more for c in domain.entity(n).compositions} - out
    return out


def flat(domain: Domain, nested_: dict[str, DataFrame], carry: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The inverse of nested: every entity's rows, keys put back from their parents, those that may stand in several places each once.

    carry: columns of a record that go with all its rows, but for those of such entities.
    """
    out: dict[str, DataFrame] = {}
    many = shared(domain)

    def unpack(name: str, df: DataFrame) -> None:
        e = domain.entity(name)
        held = [c for c in e.compositions if c.entity in df.columns]
        for c in held:
            inner, along = domain.entity(c.entity), () if c.entity in many else carry
            if c.kind == "collection":
                child = compose.without_collection(df, e.primary[0], c.entity, c.field, along)
            elif c.kind == "isA":
                child = compose.without_extension(df, e.primary[0], c.entity, inner.primary[0], along)
            else:
                child = compose.without_embed(df, c.entity, inner.primary[0])
            unpack(c.entity, child)
        own = df.drop(*[c.entity for c in held])
        out[name] = out[name].unionByName(own, allowMissingColumns=True) if name in out else own

    for name, df in nested_.items():
        unpack(name, df)
    return {n: d.dropDuplicates(domain.entity(n).primary) if n in many else d for n, d in out.items()}


def orphan_counts(domain: Domain, data: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """For each composed entity, the rows that no parent holds."""
    out = {}
    for e in domain.entities.values():
        for c in e.compositions:
            if c.entity in data and e.name in data and c.kind == "collection":
                out[c.entity] = compose.orphans(data[c.entity], c.field, data[e.name], e.primary[0])
    return out


def of_two_kinds(domain: Domain, data: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """For each entity with several extensions, the keys that more than one of them has: a row is of one kind."""
    out = {}
    for e in domain.entities.values():
        kinds = {c.entity: (data[c.entity], domain.entity(c.entity).primary[0]) for c in e.compositions if c.kind == "isA" and c.entity in data}
        if len(kinds) > 1:
            out[e.name] = compose.overlapping_extensions(kinds)
    return out


def write(domain: Domain, data: dict[str, DataFrame], folder: str, mode: str = "errorifexists", json: bool = False, year: dict[str, str] | None = None) -> list[str]:
    """All root entities under folder, at most PART_ROWS records a file in JSON; returns their names in dependency order.

    Orphans, and rows that two extensions claim, stop it before anything is written. Parquet may be partitioned by a
    year column, so that windows of cycles prune.
    """
    bad = [f"{n}: {k} rows without a parent" for n, df in orphan_counts(domain, data).items() if (k := df.count())]
    bad += [f"{n}: {k} rows are of two kinds" for n, df in of_two_kinds(domain, data).items() if (k := df.count())]
    if bad:
        raise ValueError("; ".join(bad))
    # Records are numbered before they hold anything, but where an extension's rows could make one twice.
    early = {n for n in directories(domain) if json and n in data and not any(c.kind == "isA" for c in domain.entity(n).compositions)}
    data = {n: compose.ordinal(df, domain.entity(n).primary, "__n") if n in early else df for n, df in data.items()}
    whole = nested(domain, data) if json else data
    order = [n for n in directories(domain) if n in whole] + [n for n in whole if n in composed(domain)]
    for n in order:
        if json:
            (write_numbered if n in early else write_wrapped)(whole[n], f"{folder}/{n}", n, domain.entity(n).primary, mode)
            continue
        w = whole[n].write.mode(mode)
        if year and n in year:
            w.partitionBy(year[n]).parquet(f"{folder}/{n}")
        else:
            w.parquet(f"{folder}/{n}")
    if json and order:
        files.write_text(whole[order[0]].sparkSession, f"{folder}/{ORDER}", json_.dumps({"directoryOrder": order}))
    return order


def read(spark: SparkSession, domain: Domain, folder: str, entities: list[str] | None = None) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in entities or list(domain.entities)}


def append(domain: Domain, folder: str, new: dict[str, DataFrame], prior: dict[str, DataFrame]) -> None:
    """New rows as new files beside the committed ones. A new row of a composed entity must find its parent among prior or new rows."""
    check_parents(domain, new, prior)
    for n, df in new.items():
        df.write.mode("append").parquet(f"{folder}/{n}")


def check_parents(domain: Domain, new: dict[str, DataFrame], prior: dict[str, DataFrame]) -> None:
    """Raises where a new row of a composed entity has no parent among prior or new rows."""
    data = {n: prior[n].unionByName(new[n], allowMissingColumns=True) if n in prior else new[n] for n in new}
    parents = {n: data.get(n, prior.get(n)) for n in {*data, *prior}}
    for e in domain.entities.values():
        for c in e.compositions:
            if c.kind == "collection" and c.entity in new and (k := compose.orphans(new[c.entity], c.field, parents[e.name], e.primary[0]).count()):
                raise ValueError(f"{c.entity}: {k} new rows without a parent")


def decorated(df: DataFrame, entity: Entity, key: str, seed: int, catalogues: dict | None = None, parents: list | None = None) -> DataFrame:
    """df with the entity's generated fields filled."""
    from ..operators.generate import generated

    return generated(df, key, {f.name: f.generator for f in entity.fields if f.generator}, seed, catalogues, parents)


def replaced(spark: SparkSession, path: str, df: DataFrame) -> None:
    """df in place of what it may itself read: written beside first, then swapped in by renames."""
    files.recovered(spark, path)
    beside = f"{path.rstrip('/')}.new"
    df.write.mode("overwrite").parquet(beside)
    files.swap(spark, path, beside)


def upserted(spark: SparkSession, path: str, changed: DataFrame, key: list[str], partition: str) -> None:
    """Changed rows in place of their old ones: only the partitions that hold any are written again and swapped in, all others keep their files."""
    live, beside = path.rstrip("/"), f"{path.rstrip('/')}.new"
    rows = spark.read.parquet(path)
    touched = changed.select(partition).distinct()
    old = rows.join(touched, partition, "left_semi").join(changed.select(*key), key, "left_anti")
    old.unionByName(changed.select(*rows.columns)).write.mode("overwrite").partitionBy(partition).parquet(beside)
    for part in files.folders(spark, beside):
        aside = f"{live}/_{part}"  # hidden from readers while it waits to be deleted
        files.move(spark, f"{live}/{part}", aside)
        files.move(spark, f"{beside}/{part}", f"{live}/{part}")
        files.delete(spark, aside)
    files.delete(spark, beside)
