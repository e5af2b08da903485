"""Gates: queries that say whether a dataset keeps a promise, one row each.

All return DataFrames of one schema (GATE), lazily; several over one table are
one aggregate. Nothing is collected: a gate's row comes out of Spark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import INTEGRAL, filled, lookup_parts, norm, pair, primary_key

GATE = ("name", "category", "passed", "population_count", "expected", "actual", "message")


def gate(name: str, category: str, passed: Column, n: Column, expected: Column | str, actual: Column, message: Column | None = None) -> list[Column]:
    expected = F.lit(expected) if isinstance(expected, str) else expected
    return [F.lit(name).alias("name"), F.lit(category).alias("category"), F.coalesce(passed, F.lit(False)).alias("passed"), n.cast("long").alias("population_count"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"), (F.concat_ws(": ", F.lit(name), actual.cast("string")) if message is None else message).alias("message")]


def all_gates(gates: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, gates)


def report(gates: DataFrame) -> DataFrame:
    """passed, failed and examined over all gates."""
    return gates.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.sum("population_count").alias("examined"))


# Examples: a gate that fails names some of its offenders

#: Hexadecimal digits of a key's MD5 that its group is known by: 4096 groups, of each of which one key is kept.
DIGITS = 3


def rolled(judged: DataFrame, by: list[str], few: int = 3, also: list[str] = ()) -> DataFrame:
    """by, n, bad, also, examples of rows (by, key, n, bad): sums, and the first few, in order, of the least keys of 4096 groups of the offenders.

    A clean table is one group, and a task sends 4096 keys at most however many
    offend. Fewer than few are told only of fewer offenders, or where all of
    them share fewer groups (three: one time in 1365).
    """
    off = (F.col("bad") > 0) & F.col("key").isNotNull()
    group = F.when(off, F.substring(F.md5(F.col("key").cast("string")), 1, DIGITS))
    part = judged.groupBy(*by, group.alias("__g")).agg(*[F.sum(c).alias(c) for c in ("n", "bad", *also)], F.min(F.when(off, F.col("key").cast("string"))).alias("__k"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return part.groupBy(*by).agg(*[zero(c).alias(c) for c in ("n", "bad", *also)], F.slice(F.array_sort(F.collect_list("__k")), 1, few).alias("examples"))


def told(name: Column | str, actual: Column, examples: Column) -> Column:
    """A gate's message: its name, what is the case, and the examples, if there are any."""
    name = F.lit(name) if isinstance(name, str) else name
    such = F.when(F.size(examples) > 0, F.concat(F.lit(", such as "), F.array_join(examples, ", "))).otherwise(F.lit(""))
    return F.concat(name, F.lit(": "), actual.cast("string"), such)


# Referential


def keys_of(df: DataFrame, key: Column) -> DataFrame:
    """The distinct keys there are: one narrow column."""
    return df.select(key.alias("__t")).where("__t IS NOT NULL").distinct()


def dangling(child: DataFrame, fk: str, target: DataFrame, key: str) -> DataFrame:
    """Child rows whose filled key is in no target row."""
    own, theirs = pair(child, fk, target, key)
    return child.where(filled(child[fk]).isNotNull()).join(keys_of(target, theirs), own == F.col("__t"), "left_anti")


def fk_counts(child: DataFrame, fk: str, target: DataFrame, key: str) -> DataFrame:
    """examined, dangling, missing: keys are counted by value first, so a hot key crosses the join once."""
    own, theirs = pair(child, fk, target, key)
    grouped = child.select(own.alias("__k")).groupBy("__k").agg(F.count(F.lit(1)).alias("__n"))
    joined = grouped.join(keys_of(target, theirs).withColumn("__hit", F.lit(True)), F.col("__k") == F.col("__t"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.agg(zero(F.sum("__n")).alias("examined"), zero(F.sum(F.when(F.col("__k").isNotNull() & F.col("__hit").isNull(), F.col("__n")))).alias("dangling"), zero(F.sum(F.when(F.col("__k").isNull(), F.col("__n")))).alias("missing"))


def fk_closure(name: str, child: DataFrame, fk: str, target: DataFrame, key: str, nullable: bool = False) -> DataFrame:
    c = fk_counts(child, fk, target, key)
    bad = F.col("dangling") if nullable else F.col("dangling") + F.col("missing")
    return c.select(*gate(name, "referential", bad == 0, F.col("examined"), "0 dangling", F.concat(bad.cast("string"), F.lit(" dangling"))))


def fk_closures(child: DataFrame, keys: list[tuple[str, str, DataFrame, str, bool]], few: int = 3) -> DataFrame:
    """check, n, bad, examples for (check, field, target, its key, nullable) of one table, which is read once for all of them.

    Keys are counted by value before they join, as in fk_counts; a target that
    several fields point to is read once. A cell that holds @lookup: is
    another gate's and isn't counted.
    """
    targets: list[tuple[DataFrame, str, bool]] = []
    cells = []
    for check, field, target, key, nullable in keys:
        whole = all(df.schema[c].dataType.typeName() in INTEGRAL for df, c in ((child, field), (target, key)))
        at = next((i for i, (df, k, w) in enumerate(targets) if df is target and k == key and w == whole), len(targets))
        if at == len(targets):
            targets.append((target, key, whole))
        mine = child[f"`{field}`"]
        own = mine.cast("long").cast("string") if whole else norm(mine)
        looked = F.coalesce(mine.cast("string").startswith("@lookup:"), F.lit(False))
        cells.append(F.struct(F.lit(check).alias("check"), F.lit(at).alias("__to"), F.lit(nullable).alias("__may"), own.alias("key"), looked.alias("__other")))
    c = child.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("NOT __other")
    c = c.groupBy("check", "__to", "__may", "key").agg(F.count(F.lit(1)).alias("n"))
    there = [keys_of(df, df[k].cast("long").cast("string") if whole else norm(df[k])).select(F.lit(i).alias("__at"), "__t") for i, (df, k, whole) in enumerate(targets)]
    t = reduce(DataFrame.unionByName, there).withColumn("__hit", F.lit(True))
    joined = c.join(t, (F.col("__to") == F.col("__at")) & (F.col("key") == F.col("__t")), "left")
    bad = F.when(F.col("key").isNull(), ~F.col("__may")).otherwise(F.col("__hit").isNull())
    found = rolled(joined.select("check", "key", "n", F.when(bad, F.col("n")).otherwise(0).alias("bad")), ["check"], few)
    asked = child.sparkSession.createDataFrame([(k[0],) for k in keys], "check string")  # an empty table has its gates, too
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return asked.join(F.broadcast(found), "check", "left").select("check", zero("n"), zero("bad"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def closure_gates(child: DataFrame, keys: list[tuple[str, str, DataFrame, str, bool]], few: int = 3) -> DataFrame:
    """A closure gate each, with examples of what dangles in their messages; see fk_closures."""
    actual = F.concat(F.col("bad").cast("string"), F.lit(" dangling"))
    named = gate("", "referential", F.col("bad") == 0, F.col("n"), "0 dangling", actual, told(F.col("check"), actual, F.col("examples")))
    return fk_closures(child, keys, few).select(F.col("check").alias("name"), *named[1:])


def dependent_coverage(name: str, parent: DataFrame, key: str, child: DataFrame, fk: str, few: int = 0) -> DataFrame:
    """Every parent has a child; the ratio that has one. few: how many parents without one the message names."""
    own, theirs = pair(parent, key, child, fk)
    flagged = parent.select(own.alias("__k")).join(keys_of(child, theirs).withColumn("__hit", F.lit(True)), F.col("__k") == F.col("__t"), "left")
    ratio = F.round(F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("n")), F.lit(1.0)), 6)
    if few:
        agg = rolled(flagged.select(F.col("__k").alias("key"), F.lit(1).alias("n"), F.col("__hit").isNull().cast("int").alias("bad")), [], few).withColumn("hit", F.col("n") - F.col("bad"))
        message = told(name, ratio, F.col("examples"))
    else:
        agg, message = flagged.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__hit")).alias("hit")), None
    return agg.select(*gate(name, "referential", F.col("hit") == F.col("n"), F.col("n"), "1.0", ratio, message))


def subset(name: str, category: str, rows: DataFrame, key: str, of: DataFrame, of_key: str, null_fails: bool, few: int = 0) -> DataFrame:
    """All keys of rows are some of of; few: how many that aren't the message names."""
    if few:
        c = fk_closures(rows.where(F.lit(True) if null_fails else filled(rows[key]).isNotNull()), [(name, key, of, of_key, not null_fails)], few)
        return c.select(*gate(name, category, F.col("bad") == 0, F.col("n"), "0", F.col("bad"), told(name, F.col("bad"), F.col("examples"))))
    c = fk_counts(rows, key, of, of_key)
    bad = F.col("dangling") + (F.col("missing") if null_fails else F.lit(0))
    return c.select(*gate(name, category, bad == 0, F.col("examined") - (F.lit(0) if null_fails else F.col("missing")), "0", bad))


def is_a(name: str, child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, few: int = 0) -> DataFrame:
    """Every extension row shares its key with a parent row."""
    return subset(name, "composition", child, child_key, parent, parent_key, True, few)


def collection(name: str, child: DataFrame, fk: str, parent: DataFrame, key: str, few: int = 0) -> DataFrame:
    """Every member points to a parent; null is a violation."""
    return subset(name, "composition", child, fk, parent, key, True, few)


def embed(name: str, parent: DataFrame, fk: str, child: DataFrame, key: str, few: int = 0) -> DataFrame:
    """Every filled embed key is a child's."""
    return subset(name, "composition", parent, fk, child, key, False, few)


def corpus_stability(name: str, base: DataFrame | None, head: DataFrame, key: list[str], error: str | None = None, few: int = 0) -> DataFrame:
    """All of base's keys are still in head. Without a base the gate passes over nothing; a base that could not be read fails it."""
    if error is not None or base is None:
        one = head.sparkSession.range(1)
        return one.select(*gate(name, "stability", F.lit(error is None), F.lit(0), "0 removed", F.lit(error or "skipped: no base")))
    b, h = base.select(primary_key([base[k] for k in key]).alias("__k")), head.select(primary_key([head[k] for k in key]).alias("__k"))
    return subset(name, "stability", b.where("__k IS NOT NULL"), "__k", h, "__k", True, few)


def lookups(name: str, df: DataFrame, fields: list[str], universe: DataFrame) -> DataFrame:
    """Every cell that starts with @lookup: resolves in universe (entity, field, value), data and catalogues alike; without a name, by value alone."""
    cells = df.select(F.explode(F.array(*[df[f].cast("string") for f in fields])).alias("cell")).where("cell LIKE '@lookup:%'")
    e, f, v = lookup_parts("cell")
    cells = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select(F.lower(e).alias("e"), F.lower(f).alias("f"), F.lower(v).alias("v"), "n", "cell")
    u = universe.select(F.lower("entity").alias("ue"), F.lower("field").alias("uf"), F.lower(F.col("value").cast("string")).alias("uv"))
    full = cells.where("e IS NOT NULL").join(u.distinct().withColumn("hit", F.lit(True)), (F.col("e") == F.col("ue")) & (F.col("f") == F.col("uf")) & (F.col("v") == F.col("uv")), "left").select("n", "hit", "cell")
    bare = cells.where("e IS NULL").join(u.select("uv").distinct().withColumn("hit", F.lit(True)), F.col("v") == F.col("uv"), "left").select("n", "hit", "cell")
    agg = rolled(full.union(bare).select(F.col("cell").alias("key"), "n", F.when(F.col("hit").isNull(), F.col("n")).otherwise(0).alias("bad")), [])
    actual = F.concat(F.col("bad").cast("string"), F.lit(" unresolved"))
    return agg.select(*gate(name, "lookup", F.col("bad") == 0, F.col("n"), "0 unresolved", actual, told(name, actual, F.col("examples"))))


# Schema: all of an entity's checks are one aggregate


def units(text: Column) -> Column:
    """A text's length in UTF-16 units: characters beyond the first plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def schema_counts(df: DataFrame, key: list[str], unique: list[str] = (), max_length: dict[str, int] | None = None) -> DataFrame:
    """rows, missing, distinct of the key, and for each field its distinct and empty or too long values."""
    pk = F.lower(primary_key([df[k] for k in key]))
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_if(pk.isNull()).alias("missing"), F.count_distinct(pk).alias("distinct_keys")]
    for f in unique:
        aggs += [F.count_distinct(filled(df[f])).alias(f"u_{f}"), F.count_if(filled(df[f]).isNull()).alias(f"e_{f}")]
    for f, n in (max_length or {}).items():
        aggs.append(F.count_if(units(df[f]) > n).alias(f"l_{f}"))
    return df.agg(*aggs)


def schema_gates(name: str, df: DataFrame, key: list[str], unique: list[str] = (), max_length: dict[str, int] | None = None) -> DataFrame:
    c = schema_counts(df, key, unique, max_length)
    surplus = F.col("rows") - F.col("missing") - F.col("distinct_keys")
    out = [gate(f"{name}: primary key", "schema", (F.col("missing") == 0) & (surplus == 0), F.col("rows"), "0 missing, 0 duplicate", F.format_string("%d missing, %d duplicate", "missing", surplus))]
    out += [gate(f"{name}.{f}: unique", "schema", (F.col(f"u_{f}") == F.col("rows")) & (F.col(f"e_{f}") == 0), F.col("rows"), F.col("rows"), F.col(f"u_{f}")) for f in unique]
    out += [gate(f"{name}.{f}: length", "schema", F.col(f"l_{f}") == 0, F.col("rows"), "0", F.col(f"l_{f}")) for f in max_length or {}]
    return c.select(F.inline(F.array(*[F.struct(*g) for g in out])))


def schema_checks(df: DataFrame, key: list[str], unique: list[str] = (), max_length: dict[str, int] | None = None, few: int = 3) -> DataFrame:
    """check, n, bad, missing, examples: for the key (check "key"), each unique field ("unique f") and each bounded one ("length f"), in one reading.

    bad: rows beyond the first of a key or value, or too long. Values are counted
    first, so one that is everywhere crosses once a task.
    """
    whole = primary_key([df[k] for k in key])
    cell = lambda check, value, long=False: F.struct(F.lit(check).alias("check"), value.alias("key"), F.coalesce(F.lit(long) if isinstance(long, bool) else long, F.lit(False)).alias("long"))
    cells = [cell("key", F.lower(whole)), *[cell(f"unique {f}", filled(df[f])) for f in unique]]
    cells += [cell(f"length {f}", F.when(units(df[f]) > n, whole), units(df[f]) > n) for f, n in (max_length or {}).items()]
    c = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").groupBy("check", "key", "long").agg(F.count(F.lit(1)).alias("n"))
    again = ~F.col("check").startswith("length ")
    surplus = F.when(again & F.col("key").isNotNull(), F.col("n") - 1).when(F.col("long"), F.col("n")).otherwise(0)
    judged = c.select("check", "key", "n", surplus.alias("bad"), F.when(again & F.col("key").isNull(), F.col("n")).otherwise(0).alias("missing"))
    found = rolled(judged, ["check"], few, ["missing"])
    asked = df.sparkSession.createDataFrame([("key",), *[(f"unique {f}",) for f in unique], *[(f"length {f}",) for f in max_length or {}]], "check string")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return asked.join(F.broadcast(found), "check", "left").select("check", zero("n"), zero("bad"), zero("missing"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def schema_gates_with_examples(name: str, df: DataFrame, key: list[str], unique: list[str] = (), max_length: dict[str, int] | None = None, few: int = 3) -> DataFrame:
    """The gates of schema_gates, whose messages name duplicate keys, duplicate values, and the keys of rows that hold what is too long."""
    field = F.regexp_extract("check", r"^\w+ (.*)$", 1)
    is_key, is_unique = F.col("check") == "key", F.col("check").startswith("unique ")
    label = F.when(is_key, F.lit(f"{name}: primary key")).otherwise(F.concat(F.lit(f"{name}."), field, F.when(is_unique, ": unique").otherwise(": length")))
    expected = F.when(is_key, F.lit("0 missing, 0 duplicate")).when(is_unique, F.col("n").cast("string")).otherwise(F.lit("0"))
    actual = F.when(is_key, F.format_string("%d missing, %d duplicate", "missing", "bad")).when(is_unique, (F.col("n") - F.col("missing") - F.col("bad")).cast("string")).otherwise(F.col("bad").cast("string"))
    row = gate(name, "schema", (F.col("bad") == 0) & (F.col("missing") == 0), F.col("n"), expected, actual, told(label, actual, F.col("examples")))
    return schema_checks(df, key, unique, max_length, few).select(label.alias("name"), *row[1:])


# Statistics


def factor_gates(df: DataFrame, factors: list[tuple[str, Column, float, float]]) -> DataFrame:
    """(id, outcome as a number, target, tolerance) over one entity, in one aggregate. An empty entity fails."""
    c = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m{i}") for i, (_, x, _, _) in enumerate(factors)])
    return c.select(F.inline(F.array(*[F.struct(*gate(f"factor {i}", "factor", (F.col("n") > 0) & (F.abs(F.col(f"m{k}") - t) <= tol + 1e-9), F.col("n"), f"{t} +- {tol}", F.round(f"m{k}", 6))) for k, (i, _, t, tol) in enumerate(factors)])))


def distinctness(name: str, df: DataFrame, field: str, least: float = 0.99) -> DataFrame:
    """Share of distinct images, by decoded content where they are data URIs, else by address; an empty table fails."""
    body = F.try_to_binary(F.nullif(F.regexp_extract(df[field], r"(?s)^data:[^,]*;base64,(.*)$", 1), F.lit("")), F.lit("base64"))
    c = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce(F.sha2(body, 256), df[field])).alias("d"))
    share = F.try_divide(F.col("d").cast("double"), F.col("n"))
    return c.select(*gate(name, "identity", (F.col("n") > 0) & (share >= least), F.col("n"), f">= {least}", F.round(share, 6)))


# Identity


def violations(name: str, category: str, df: DataFrame, bad: Column, counted: Column | None = None, empty_fails: bool = True, key: Column | None = None, few: int = 3) -> DataFrame:
    """No row for which bad holds, among those counted; fails over nothing if so asked. key: what the message names few offenders by."""
    counted = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    if key is not None:
        c = rolled(df.select(key.cast("string").alias("key"), counted.cast("int").alias("n"), (counted & F.coalesce(bad, F.lit(False))).cast("int").alias("bad")), [], few)
        return c.select(*gate(name, category, (F.col("bad") == 0) & ((F.col("n") > 0) | F.lit(not empty_fails)), F.col("n"), "0", F.col("bad"), told(name, F.col("bad"), F.col("examples"))))
    c = df.agg(F.count_if(counted).alias("n"), F.count_if(counted & F.coalesce(bad, F.lit(False))).alias("bad"))
    return c.select(*gate(name, category, (F.col("bad") == 0) & ((F.col("n") > 0) | F.lit(not empty_fails)), F.col("n"), "0", F.col("bad")))


def name_gender(name: str, df: DataFrame, given: str, gender: str, catalogue: DataFrame) -> DataFrame:
    """Names that the catalogue (name, gender: Female, Male or Unisex) knows as one gender's only, against the row's; how many it doesn't know is told beside."""
    c = catalogue.groupBy(F.lower(F.trim("name")).alias("__name")).agg(F.collect_set("gender").alias("__g"))
    sure = c.where("size(__g) = 1 AND NOT array_contains(__g, 'Unisex')").select("__name", F.element_at("__g", 1).alias("__of"))
    joined = df.join(sure, F.lower(F.trim(df[given])) == F.col("__name"), "left")
    known = F.col("__of").isNotNull() & df[gender].isNotNull()
    c = joined.agg(F.count_if(known).alias("n"), F.count_if(known & (F.lower("__of") != F.lower(df[gender]))).alias("bad"), F.count_if(~known).alias("rest"))
    return c.select(*gate(name, "identity", (F.col("bad") == 0) & (F.col("n") > 0), F.col("n"), "0", F.when(F.col("rest") > 0, F.format_string("%d, %d not classified", "bad", "rest")).otherwise(F.col("bad").cast("string"))))


#: The titles that go with a gender, and the pronouns.
TITLES = {t: "Male" for t in ("mr", "sir", "lord", "master")} | {t: "Female" for t in ("ms", "mrs", "miss", "madam", "dame", "lady")}
PRONOUNS = {"he/him": "Male", "she/her": "Female"}


def words_of_gender(name: str, df: DataFrame, field: str, gender: Column, table: dict[str, str], key: Column | None = None) -> DataFrame:
    """Titles or pronouns against gender, the row's own or its parent's; words not in the table aren't counted."""
    from ..functions.scalars import clean_name

    of = None
    for w, g in table.items():
        hit = clean_name(df[field]) == w
        of = F.when(hit, F.lit(g)) if of is None else of.when(hit, F.lit(g))
    return violations(name, "identity", df, F.lower(of) != F.lower(F.trim(gender)), of.isNotNull() & gender.isNotNull(), key=key)


def min_age(name: str, df: DataFrame, birth: Column, intake: Column, years: float = 18.0, key: Column | None = None) -> DataFrame:
    """Nobody younger than years (of 365.2425 days, less a thousandth) at intake."""
    at = F.datediff(intake, birth) / 365.2425
    return violations(name, "identity", df, at < years - 0.001, birth.isNotNull() & intake.isNotNull(), key=key)
