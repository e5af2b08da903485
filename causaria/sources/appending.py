"""Appends into committed wrapped files: new records in the last part and in new ones, new children inside committed parents, changed fields in place.

Only files that hold something touched are written again; all others keep
their bytes. Committed records are parsed once; every row taken out of one
knows its file and place, so that only new and changed rows look for their
records. Files are rebuilt from flat rows, so children of any depth, extensions
and embedded rows find their records alike.

New files are written beside the live ones; then a journal names every move,
and the moves are made. A driver lost before the journal leaves the state as
it was, one lost after it leaves a journal that the next read or append plays
forward: a move whose source is gone has been made. Readers and appends on one
folder don't run at once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.keys import INTEGRAL, norm
from ..model import Domain
from ..operators import compose
from ..plans.graph import composed, directories, insert_directory
from ..streaming.simulate import saved
from . import files, journal, records

#: Where a record stands: its file, and its place in it.
PLACED = ("__file", "__at")


def nested_schemas(spark: SparkSession, domain: Domain, flat: dict[str, StructType]) -> dict[str, StructType]:
    """The schema of each directory's records, with what they hold."""
    return {n: df.schema for n, df in records.nested(domain, {n: spark.createDataFrame([], s) for n, s in flat.items()}).items()}


def read(spark: SparkSession, domain: Domain, folder: str, flat: dict[str, StructType]) -> dict[str, DataFrame]:
    """Every entity's rows out of a folder of wrapped directories, after playing an append's journal forward."""
    journal.play(spark, folder)
    found = {n: x.drop(*PLACED) for n, x in indexed(spark, domain, folder, flat).items()}
    # Records of several entities' rows are parsed once for all of them.
    return records.flat(domain, {n: saved(x) if domain.entity(n).compositions else x for n, x in found.items()})


def indexed(spark: SparkSession, domain: Domain, folder: str, flat: dict[str, StructType]) -> dict[str, DataFrame]:
    """Each directory's records with the file they are in (__file) and their place in it (__at)."""
    schemas = nested_schemas(spark, domain, flat)
    there = [n for n in directories(domain) if n in schemas and files.exists(spark, f"{folder}/{n}")]
    return {n: records.read_wrapped(spark, f"{folder}/{n}", schemas[n], domain.entity(n).primary, n, placed=True) for n in there}


def holders(domain: Domain) -> dict[str, tuple[str, str, str]]:
    """For each entity that lives inside another: (that one, kind, foreign key)."""
    return {c.entity: (e.name, c.kind, c.field) for e in domain.entities.values() for c in e.compositions}


def root_of(domain: Domain, name: str) -> str:
    """The entity whose records hold an entity's rows."""
    inside = holders(domain)
    while name in inside:
        name = inside[name][0]
    return name


def comparable(domain: Domain, kinds: dict[str, StructType]) -> Callable[[str], Column]:
    """How keys compare: as whole numbers where all of them are, which sort and hash at a fraction of the cost, else as norm."""
    fields = [kinds[n][f].dataType.typeName() for n, e in domain.entities.items() for f in (e.primary[0], *[k.field for k in e.foreign_keys]) if f in kinds[n].names]
    return (lambda c: F.col(c).cast("long")) if all(t in INTEGRAL for t in fields) else norm


def records_of(domain: Domain, name: str, rows: DataFrame, known: dict[str, DataFrame], same: Callable[[str], Column]) -> DataFrame:
    """(row, key, __file): the directory's records that hold rows of an entity, and their files; a row that no record holds has no key, a new record no file.

    known: all rows of every entity. Each step up is a join by key.
    """
    inside, at = holders(domain), name
    df = rows.select(same(domain.entity(name).primary[0]).alias("row"), *[same(k.field).alias(f"__{k.field}") for k in domain.entity(name).foreign_keys])
    df = df.withColumn("__me", F.col("row"))
    while at in inside:
        parent, kind, field = inside[at]
        p = domain.entity(parent)
        file = [] if parent in inside else ["__file"]
        up = known[parent].select(same(p.primary[0]).alias("__up"), *[same(k.field).alias(f"__{k.field}") for k in p.foreign_keys], *file)
        if kind == "embed":  # the parent points here
            mine = df.select("row", "__me")
            df = mine.join(up.withColumn("__to", F.col(f"__{field}")), F.col("__to") == F.col("__me"), "left").drop("__me", "__to").withColumn("__me", F.col("__up")).drop("__up")
        else:
            mine = df.select("row", F.col("__me" if kind == "isA" else f"__{field}").alias("__to"))
            df = mine.join(up, F.col("__to") == F.col("__up"), "left").drop("__to").withColumn("__me", F.col("__up")).drop("__up")
        at = parent
    return df.select("row", F.col("__me").alias("key"), "__file")


def append(spark: SparkSession, domain: Domain, folder: str, new: dict[str, DataFrame], changed: dict[str, DataFrame] | None = None, part_rows: int = records.PART_ROWS) -> list[str]:
    """Appends new rows and replaces changed ones (whole rows, by key); returns the files that were written again or first.

    A new row of a composed entity whose parent is neither committed nor new, a
    new row whose key is committed, and a changed one whose key isn't, stop it
    before anything is written.
    """
    journal.play(spark, folder)
    new, changed = ({n: saved(df) for n, df in rows.items()} for rows in (new, changed or {}))
    kinds = {n: df.schema for n, df in {**changed, **new}.items()}
    kinds = {n: kinds.get(n) or domain.entity(n).schema() for n in domain.entities}
    key, same, many = {n: domain.entity(n).primary[0] for n in domain.entities}, comparable(domain, kinds), records.shared(domain)
    ids = lambda n, df: df.select(same(key[n]).alias("__id"))
    index = {n: saved(df) for n, df in indexed(spark, domain, folder, kinds).items()}
    committed = records.flat(domain, index, PLACED)
    for n in domain.entities:
        if n not in committed:
            df = spark.createDataFrame([], kinds[n])
            committed[n] = df if n in many else df.withColumns({"__file": F.lit(None).cast("string"), "__at": F.lit(None).cast("long")})
    stay = {n: _replaced(df, changed[n], key[n], same) if n in changed else df for n, df in committed.items()}
    with_new = lambda n, df: df.unionByName(new[n].select(*_own(df)), allowMissingColumns=True) if n in new else df
    # A record that embeds nothing is found by its key alone, which its changed row has as well.
    by_key = {n for n in directories(domain) if not any(c.kind == "embed" for c in domain.entity(n).compositions)}
    now = {n: with_new(n, committed[n] if n in by_key else df) for n, df in stay.items()}
    lost, touched = {}, {n: [] for n in directories(domain)}
    for rows in (new, changed):
        for n, df in rows.items():
            if n in composed(domain):
                found = records_of(domain, n, df, now, same)
                nowhere = F.col("key").isNull() | F.col("row").isNull()
                per = saved(found.groupBy("__file").agg(F.count(F.when(nowhere, 1)).alias("lost")))
                k = per.agg(F.sum("lost")).first()[0]
                if k and n in many:  # one of its holders is enough
                    k = ids(n, df).join(found.where("key IS NOT NULL").select(F.col("row").alias("__id")), "__id", "left_anti").count()
                lost[n] = (lost.get(n) or []) + [k or 0]
                touched[root_of(domain, n)].append(per.select("__file"))
    for n, df in changed.items():
        if n not in many:  # where it stands, should it move as well
            touched[root_of(domain, n)].append(committed[n].join(ids(n, df), same(key[n]) == F.col("__id"), "left_semi").select("__file"))
    _check(new, changed, committed, lost, ids)
    moves, written = [], []
    beside = f"{folder}/_append-{uuid.uuid4().hex}"
    order = _order(spark, folder, domain)
    for root in directories(domain):
        e, held = domain.entity(root), index.get(root)
        n_fresh = new[root].count() if root in new else 0
        dirty = [t.where("__file IS NOT NULL") for t in touched[root]]
        room = None
        if held is not None and n_fresh:
            # The part with room: the one of fewest records, if it isn't full.
            counts = held.groupBy("__file").agg(F.count(F.lit(1)).alias("n"))
            room = counts.orderBy("n", "__file").where(F.col("n") < part_rows).limit(1).first()
            dirty += [spark.createDataFrame([(room["__file"],)], "__file string")] if room else []
        dirty = saved(reduce(DataFrame.union, dirty).distinct()) if dirty else None
        if not n_fresh and (dirty is None or dirty.isEmpty()):
            continue
        some = {n: now[n] for n in domain.entities if n in many and root_of(domain, n) == root}
        for n in domain.entities:
            if n in many or root_of(domain, n) != root:
                continue
            rows = stay[n].join(dirty, "__file", "left_semi") if dirty is not None else stay[n].limit(0)
            if n != root:
                some[n] = with_new(n, rows.drop(*PLACED))
                continue
            some[n] = rows.select(*_own(rows), F.col("__file").alias("__to"), "__at")
            if n_fresh:
                fresh = compose.parts(new[n], e.primary, part_rows, 0, room["n"] if room else part_rows)  # part 0 is the one with room
                named = F.when(F.col("part") == 0, F.lit(room["__file"] if room else "")).otherwise(F.concat(F.lit(f"new-{uuid.uuid4().hex[:8]}-"), F.lpad("part", 6, "0")))
                some[n] = some[n].unionByName(fresh.select(*_own(rows), named.alias("__to"), F.lit(1 << 40).cast("long").alias("__at")))
        # The file's own name is the partition's; a new one gets a name of its own.
        whole = records.nested(domain, some)[root].withColumn("__name", F.coalesce(F.element_at(F.split("__to", "/"), -1), F.lit(""))).drop("__to")
        lines = records.laid(whole, ["__name"], ["__at", *e.primary], e.primary)
        lines.write.partitionBy("__name").option("maxRecordsPerFile", 0).text(f"{beside}/{root}")
        if held is None:
            files.write_text(spark, f"{beside}/{root}/{records.SIDECAR}", json.dumps({"entity": root, "primaryKey": e.primary}))
            moves.append((journal.MOVE, f"{beside}/{root}/{records.SIDECAR}", f"{folder}/{root}/{records.SIDECAR}"))
            order = insert_directory(order, domain, root)
        for name, made in files.partitions(spark, f"{beside}/{root}", "__name"):
            to = f"{folder}/{root}/{name if name.endswith('.txt') else name + '.txt'}"
            moves.append((journal.MOVE, made, to))
            written.append(to)
    if moves:
        files.write_text(spark, f"{beside}/{records.ORDER}", json.dumps({"directoryOrder": order}))
        moves.append((journal.MOVE, f"{beside}/{records.ORDER}", f"{folder}/{records.ORDER}"))
        journal.begin(spark, folder, moves, beside)
        journal.play(spark, folder)
    return written


def _order(spark: SparkSession, folder: str, domain: Domain) -> list[str]:
    at = f"{folder}/{records.ORDER}"
    return json.loads(files.read_text(spark, at))["directoryOrder"] if files.exists(spark, at) else []


def _own(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in PLACED]


def _replaced(df: DataFrame, changed: DataFrame, key: str, same: Callable[[str], Column]) -> DataFrame:
    """df with changed rows in place of those of their keys."""
    own = _own(df)
    rows = changed.select(same(key).alias("__id"), F.struct(*own).alias("__row"))
    put = [F.when(F.col("__id").isNotNull(), F.col("__row")[c]).otherwise(F.col(c)).alias(c) for c in own]
    return df.join(rows, same(key) == F.col("__id"), "left").select(*put, *[c for c in df.columns if c in PLACED])


def _check(new: dict, changed: dict, committed: dict, lost: dict, ids) -> None:
    """Raises for keys that are there, are there twice or aren't there, and for rows without a parent: an entity's keys are counted once."""
    bad = []
    for n in {**new, **changed}:
        kinds = {"__new": new.get(n), "__changed": changed.get(n), "__old": committed[n]}
        one = [ids(n, df).select("__id", *[F.lit(int(k == kind)).cast("long").alias(k) for k in kinds]) for kind, df in kinds.items() if df is not None]
        per = reduce(DataFrame.union, one).groupBy("__id").agg(*[F.sum(k).alias(k) for k in kinds])
        there = F.col("__id").isNotNull() & (F.col("__old") > 0)
        found = per.agg(F.sum(F.when(there, F.col("__new"))).alias("there"), F.count(F.when(F.col("__new") > 1, 1)).alias("twice"), F.sum(F.when(~there, F.col("__changed"))).alias("gone")).first()
        bad += [f"{n}: {found['there']} new rows have keys that exist"] if found["there"] else []
        bad += [f"{n}: {found['twice']} keys twice among new rows"] if found["twice"] else []
        bad += [f"{n}: {found['gone']} changed rows aren't there"] if found["gone"] else []
        bad += [f"{n}: {k} rows without a parent" for k in lost.get(n, []) if k]
    if bad:
        raise ValueError("; ".join(sorted(set(bad))))
