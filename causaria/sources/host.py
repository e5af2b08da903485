"""A domain from the tables in which a host application keeps its own metadata, the comparison of the two, and metadata from data.

Three tables, of any number of rows:

* entities: id, name, parent_id (what it is a kind of), selector (JSON on the
  parent: a Path, or a Map's Field, says which kind a row is);
* fields: entity_id, place, name, type, nullable, primary_key, default_value,
  related_entity, related_field, embedded;
* relations: entity_id, related_entity, join_field, collection (JSON: Name, Mode).

Columns may be missing, they count as null then. Names compare regardless of case.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import norm
from ..model import Composition, Domain, Entity, Field, ForeignKey, ModelError, check_domain
from ..operators.gates import fk_closures
from ..plans.graph import held_loops

ENTITIES = "id string, name string, parent_id string, selector string"
FIELDS = "entity_id string, place int, name string, type string, nullable boolean, primary_key boolean, default_value string, related_entity string, related_field string, embedded string"
RELATIONS = "entity_id string, related_entity string, join_field string, collection string"
PARTS = ("entity", "kind", "place", "name", "type", "nullable", "target", "target_field", "note")

#: Parts of a host's type names and what they mean, first match first; all else is text.
HOST_TYPES = (("number", ("int", "money", "decimal", "numeric", "float")), ("boolean", ("bit", "bool")), ("date", ("date", "time")), ("uuid", ("uniqueidentifier", "uuid")))
#: Ends of names that a business key is known by.
KEY_ENDS = ("Code", "Number", "Key")


def shaped(df: DataFrame, ddl: str) -> DataFrame:
    """df with exactly the columns of the schema, null where it has none."""
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in ddl.split(", "))])


def field_type(host: Column) -> Column:
    """What a host's type is here."""
    low, out = F.lower(host), None
    for kind, words in HOST_TYPES:
        hit = reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("string")


def selected(selector: Column) -> Column:
    """The field that says which kind a row of the parent is; null if only the host's code knows."""
    return F.coalesce(*[F.nullif(F.get_json_object(selector, p), F.lit("")) for p in ("$.Path", "$.Map.Field")])


def described(entities: DataFrame, fields: DataFrame, relations: DataFrame | None = None, business_keys: Mapping[str, list[str]] | None = None) -> DataFrame:
    """One row for each part (PARTS): entity, field, foreignKey, businessKey, isA, collection, embed; and error and warning, told in note.

    isA: target is the parent, target_field its selector. collection: name is
    its name, target the member, target_field the member's key, note the mode.
    The business key is that given, else the first field that isn't primary
    and is called Name or ends in Code, Number or Key; without one the entity
    has an error.
    """
    e = shaped(entities, ENTITIES)
    f = shaped(fields, FIELDS).join(e.select(F.col("id").alias("entity_id"), F.col("name").alias("entity")), "entity_id")
    part = lambda df, kind, **c: df.select(*[(c[n] if n in c else F.lit(kind) if n == "kind" else F.lit(None)).cast("boolean" if n == "nullable" else "int" if n == "place" else "string").alias(n) for n in PARTS])
    own = {"entity": F.col("entity"), "place": F.col("place"), "name": F.col("name")}
    out = [part(e, "entity", entity=F.col("name"), name=F.col("name"))]
    out.append(part(f, "field", **own, type=field_type(F.col("type")), nullable=F.coalesce("nullable", F.lit(False)), note=F.when(F.coalesce("primary_key", F.lit(False)), "primary")))
    related = f.where("related_entity IS NOT NULL AND related_field IS NOT NULL")
    out.append(part(related, "foreignKey", **own, target=F.col("related_entity"), target_field=F.col("related_field")))
    given = [(n, i, k) for n, ks in (business_keys or {}).items() for i, k in enumerate(ks)]
    stated = e.sparkSession.createDataFrame(given, "entity string, place int, name string")
    named = (F.col("name") == "Name") | reduce(Column.__or__, [F.col("name").endswith(k) for k in KEY_ENDS])
    guess = f.where(named & ~F.coalesce("primary_key", F.lit(False))).groupBy("entity").agg(F.min(F.struct("place", "name")).alias("k")).select("entity", "k.place", "k.name")
    keys = stated.join(e.select(F.col("name").alias("entity")), "entity", "left_semi").unionByName(guess.join(stated, "entity", "left_anti"))
    out.append(part(keys, "businessKey", **own))
    keyless = e.join(keys, F.col("entity") == e["name"], "left_anti")
    out.append(part(keyless, "error", entity=F.col("name"), note=F.concat(F.col("name"), F.lit(": no business key, and no field is called like one"))))
    parents = e.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"), selected(F.col("selector")).alias("when"))
    kinds = e.drop("selector").join(parents, "parent_id")
    out.append(part(kinds, "isA", entity=F.col("name"), name=F.col("name"), target=F.col("parent"), target_field=F.col("when")))
    out.append(part(kinds.where("when IS NULL"), "warning", entity=F.col("name"), note=F.concat(F.col("name"), F.lit(": which rows of "), F.col("parent"), F.lit(" are of this kind is known at run time only"))))
    out.append(part(f.where("embedded <> '' AND related_entity IS NOT NULL"), "embed", **own, target=F.col("related_entity"), target_field=F.coalesce("related_field", F.lit("ID"))))
    if relations is not None:
        r = shaped(relations, RELATIONS).where("collection <> '' AND related_entity IS NOT NULL AND join_field IS NOT NULL").join(e.select(F.col("id").alias("entity_id"), F.col("name").alias("entity")), "entity_id")
        sound = F.try_parse_json("collection").isNotNull()
        label, mode = (F.get_json_object("collection", p) for p in ("$.Name", "$.Mode"))
        out.append(part(r.where(sound), "collection", entity=F.col("entity"), name=F.coalesce(label, F.col("related_entity")), target=F.col("related_entity"), target_field=F.col("join_field"), note=F.when(mode == "authoritative", mode).otherwise("upsert")))
        out.append(part(r.where(~sound), "warning", entity=F.col("entity"), note=F.concat(F.col("entity"), F.lit(": the collection of "), F.col("related_entity"), F.lit(" can't be read"))))
    return reduce(DataFrame.unionByName, out)


def imported(name: str, namespace: str, entities: DataFrame, fields: DataFrame, relations: DataFrame | None = None, business_keys: Mapping[str, list[str]] | None = None) -> tuple[Domain, list[str]]:
    """The domain that a host's metadata describes, and warnings. Raises ModelError with all errors at once: entities without a business key, held entities that aren't there, loops of what holds what.

    Foreign keys that lead out of the metadata are kept, as of a domain of a
    part of a host; compositions aren't.
    """
    rows = described(entities, fields, relations, business_keys).collect()
    of = lambda kind, e=None: sorted((r for r in rows if r["kind"] == kind and e in (None, r["entity"])), key=lambda r: (r["place"] is None, r["place"] or 0, r["name"] or "", r["target"] or ""))
    bad, warnings = [r["note"] for r in of("error")], [r["note"] for r in of("warning")]
    names = [r["entity"] for r in of("entity")]
    bad += [f"{n}: declared {names.count(n)} times" for n in sorted(set(names)) if names.count(n) > 1]
    made = {}
    for n in dict.fromkeys(names):
        held = [Composition("isA", r["entity"], "ID", r["target_field"]) for r in of("isA") if r["target"] == n]
        held += [Composition("collection", r["target"], r["target_field"]) for r in of("collection", n)]
        held += [Composition("embed", r["target"], r["name"]) for r in of("embed", n)]
        own = tuple(Field(r["name"], r["type"], r["nullable"], r["note"] == "primary") for r in of("field", n))
        keys = tuple(ForeignKey(r["name"], r["target"], r["target_field"]) for r in of("foreignKey", n))
        made[n] = Entity(n, own, keys, tuple(r["name"] for r in of("businessKey", n)), tuple(held))
    out = Domain(name, namespace, made)
    try:
        check_domain(out)
    except ModelError as e:
        bad += e.problems
    bad += [f"held in a loop: {' > '.join(loop)}" for loop in held_loops(out)]
    if bad:
        raise ModelError(bad)
    return out, warnings


def compared(domain: Domain, entities: DataFrame, fields: DataFrame) -> DataFrame:
    """(entity, part, severity, problem) of what a domain and its host's metadata disagree about, by one join for entities, kinds, fields and keys each.

    Errors: a kind whose host entity has no parent, or another one; a field
    that the host hasn't; one of another type; a key to another entity.
    Warnings: an entity that the host hasn't; a parent that isn't declared; a
    field that the host demands and the domain hasn't.
    """
    s = entities.sparkSession
    e, f = shaped(entities, ENTITIES), shaped(fields, FIELDS)
    above = {c.entity: x.name for x in domain.entities.values() for c in x.compositions if c.kind == "isA"}
    mine = s.createDataFrame([(n, above.get(n)) for n in domain.entities], "entity string, kind_of string")
    own = s.createDataFrame([(x.name, d.name, d.type, next((k.entity for k in x.foreign_keys if k.field == d.name), None)) for x in domain.entities.values() for d in x.fields], "entity string, field string, kind string, leads string")
    host = e.join(e.select(F.col("id").alias("parent_id"), F.col("name").alias("parent")), "parent_id", "left").select("id", F.col("name").alias("host"), "parent_id", "parent")
    both = mine.join(host, norm("entity") == norm("host"), "left")
    told = lambda df, hit, severity, part, *text: df.where(hit).select("entity", F.lit(None if part is None else "").cast("string").alias("part") if part is None else F.col(part).alias("part"), F.lit(severity).alias("severity"), F.concat(*[F.lit(t) if t.startswith(" ") else F.coalesce(F.col(t), F.lit("?")) for t in text]).alias("problem"))
    out = [
        told(both, F.col("host").isNull(), "warning", None, "entity", " isn't in the host"),
        told(both, "host IS NOT NULL AND kind_of IS NOT NULL AND parent_id IS NULL", "error", None, "entity", " is declared a kind of ", "kind_of", " and has no parent in the host"),
        told(both, F.col("kind_of").isNotNull() & F.col("parent").isNotNull() & (norm("kind_of") != norm("parent")), "error", None, "entity", " is declared a kind of ", "kind_of", " and is one of ", "parent", " in the host"),
        told(both, "host IS NOT NULL AND kind_of IS NULL AND parent_id IS NOT NULL", "warning", None, "entity", " has a parent in the host and none is declared: its kind can't be checked"),
    ]
    known = both.where("host IS NOT NULL").select("entity", "id")
    theirs = f.join(known, F.col("entity_id") == F.col("id")).select(F.col("entity").alias("__e"), F.col("name").alias("theirs"), field_type(F.col("type")).alias("host_kind"), F.col("related_entity").alias("host_leads"), (~F.coalesce("nullable", F.lit(True)) & F.col("default_value").isNull() & ~F.coalesce("primary_key", F.lit(False))).alias("demanded"))
    sides = own.join(known.select("entity"), "entity", "left_semi").join(theirs, (F.col("entity") == F.col("__e")) & (norm("field") == norm("theirs")), "full").withColumn("entity", F.coalesce("entity", "__e")).withColumn("part", F.coalesce("field", "theirs"))
    out += [
        told(sides, F.col("theirs").isNull(), "error", "part", "entity", " has no field ", "field", " in the host"),
        told(sides, (F.col("kind") != F.col("host_kind")) & ~((F.col("kind") == "json") & (F.col("host_kind") == "string")), "error", "part", "part", " is a ", "kind", " and in the host a ", "host_kind"),
        told(sides, F.col("leads").isNotNull() & F.col("host_leads").isNotNull() & (norm("leads") != norm("host_leads")), "error", "part", "part", " leads to ", "leads", " and in the host to ", "host_leads"),
        told(sides, F.col("field").isNull() & F.col("demanded"), "warning", "part", "part", " is demanded by the host and not declared"),
    ]
    return reduce(DataFrame.unionByName, out)


def checked(domain: Domain, entities: DataFrame, fields: DataFrame) -> list[str]:
    """Warnings of compared(); raises ModelError with all errors at once."""
    rows = compared(domain, entities, fields).collect()
    bad = sorted(r["problem"] for r in rows if r["severity"] == "error")
    if bad:
        raise ModelError(bad)
    return sorted(r["problem"] for r in rows)


# Metadata of data that no host describes


def profile(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(entity, place, name, type, rows, nulls, longest) of all fields; a table is read once, in one aggregate without keys."""
    out = []
    for n, df in frames.items():
        aggs = [F.count(F.lit(1)).alias("__rows")]
        for i, f in enumerate(df.schema):
            c = df[f"`{f.name}`"]
            text = c if f.dataType.typeName() == "string" else F.lit(None).cast("string")
            aggs += [F.count_if(c.isNull()).alias(f"__n{i}"), F.max(F.length(text)).alias(f"__l{i}")]
        told = [F.struct(F.lit(n).alias("entity"), F.lit(i).alias("place"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.col("__rows").alias("rows"), F.col(f"__n{i}").alias("nulls"), F.col(f"__l{i}").cast("long").alias("longest")) for i, f in enumerate(df.schema)]
        out.append(df.agg(*aggs).select(F.inline(F.array(*told))))
    return reduce(DataFrame.unionByName, out)


def named_alike(field: str, key: str) -> bool:
    """Whether both are called the same, up to a prefix that ends in the first underscore."""
    return field.split("_", 1)[-1].lower() == key.split("_", 1)[-1].lower()


def links(frames: Mapping[str, DataFrame], keys: Mapping[str, str], alike: Callable[[str, str], bool] = named_alike) -> DataFrame:
    """(entity, field, target, target_field, examined, dangling) of all fields that are called like another entity's key: those without dangling values are foreign keys. A table is read once for all its fields."""
    out = []
    for n, df in frames.items():
        pairs = [(f, other, k) for f in df.columns for other, k in keys.items() if other != n and alike(f, k)]
        if not pairs:
            continue
        found = fk_closures(df, [(f"{i}", f, frames[other], k, True) for i, (f, other, k) in enumerate(pairs)])
        whose = F.array(*[F.struct(F.lit(n).alias("entity"), F.lit(f).alias("field"), F.lit(o).alias("target"), F.lit(k).alias("target_field")) for f, o, k in pairs])
        out.append(found.select(F.element_at(whose, F.col("check").cast("int") + 1).alias("w"), "n", "bad").select("w.*", F.col("n").alias("examined"), F.col("bad").alias("dangling")))
    if not out:
        raise ValueError("no field is called like another entity's key")
    return reduce(DataFrame.unionByName, out)


def metadata(frames: Mapping[str, DataFrame], keys: Mapping[str, str], alike: Callable[[str, str], bool] = named_alike) -> tuple[DataFrame, DataFrame]:
    """entities and fields in this module's form, from data alone: types from schemas, nullable where a null occurs, keys as given, foreign keys where links() found no dangling value."""
    s = next(iter(frames.values())).sparkSession
    entities = s.createDataFrame([(n, n) for n in frames], "id string, name string")
    sure = links(frames, keys, alike).where("dangling = 0").groupBy("entity", "field").agg(F.min(F.struct("target", "target_field")).alias("t"))
    fields = profile(frames).alias("p").join(sure.alias("l"), F.expr("p.entity = l.entity AND p.name = l.field"), "left")
    primary = reduce(Column.__or__, [(F.col("p.entity") == n) & (F.col("p.name") == k) for n, k in keys.items()], F.lit(False))
    return entities, fields.select(F.col("p.entity").alias("entity_id"), "p.place", "p.name", F.regexp_replace("p.type", "^double$", "float").alias("type"), (F.col("p.nulls") > 0).alias("nullable"), primary.alias("primary_key"), F.col("l.t.target").alias("related_entity"), F.col("l.t.target_field").alias("related_field"))
