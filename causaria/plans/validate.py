"""All gates of a domain over a dataset, in one fixed order, as one DataFrame."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import forms
from ..functions.dates import cycle_field, day, row_year
from ..functions.keys import lookup_parts, norm
from ..model import Domain, Entity, Factor, Hero
from ..operators import eras, gates, rules
from ..operators import heroes as hero_rows
from ..operators.features import compile_feature, fall_through, path, resolved, self_feature
from ..operators.reversal import coherence as gates_of_reversal


def _parent_field(df: DataFrame, hops: list, fields: list[str]) -> tuple[DataFrame, list[Column], str | None]:
    """df with fields of what the path leads to, those columns, and the column of its key."""
    if not hops:
        return df, [df[f] for f in fields], None
    out, names = df, []
    for i, f in enumerate([*fields, hops[-1][2]]):
        out = path(out, hops, f, f"__end{i}", raw=True)
        names.append(f"__end{i}")
    return out, [F.col(n) for n in names[:-1]], names[-1]


def rule_gate(r: Mapping, data: Mapping[str, DataFrame]) -> DataFrame:
    """A declared relational rule's gate."""
    src, name, by = data[r["source"]], r.get("name", r["kind"]), r.get("key", "ID") if r["kind"] != "date-window" else "ID"
    hops = [(h["field"], data[h["entity"]], h.get("key", "ID")) for h in r.get("path", ())]
    if r["kind"] == "path-match":
        inc = r.get("inclusion")
        pool = fields = None
        if inc and "item" in inc:
            pool, fields = data[inc["entity"]].select(F.col(inc["item"]).alias(inc["sourceItem"]), F.col(inc["container"]).alias("__container")), (inc["sourceItem"], "__container")
        elif inc:
            pool, fields = data[inc["entity"]], tuple(inc["fields"])
        return rules.gate_of(name, rules.path_match(src, hops, r["targetField"], r.get("sourceField"), pool, fields), by)
    if r["kind"] == "date-window":
        w, key = data[r["window"]], r["key"]
        if link := r.get("link"):  # a row's window is that of what it is linked to, else its own key's
            to = data[link["entity"]].select(norm(link["source"]).alias("__from"), norm(link["target"]).alias("__to")).dropna().dropDuplicates(["__from"])
            own = norm(key) if key in src.columns else F.lit(None).cast("string")
            src = src.join(to, norm(src["ID"]) == F.col("__from"), "left").withColumn("__key_of_window", F.coalesce("__to", own)).drop("__from", "__to")
            key = "__key_of_window"
        theirs = r["windowKey"] if r["windowKey"] in w.columns else "ID"
        return rules.gate_of(name, rules.date_window(src, day(src[r["dateField"]]), key, w, theirs, day(w[r["startField"]]), day(w[r["endField"]]), bool(r.get("requireWindow"))), by)
    if r["kind"] == "text-contains-path":
        child = r.get("children")
        rows, parts, key = _parent_field(src, hops, list(r.get("targetFields", ())))
        parts += [rows[f] for f in r.get("fields", ())]
        judged = rules.text_contains(rows, r["textField"], parts, data[child["entity"]] if child else None, key or r.get("key", "ID"), child["key"] if child else None, child["field"] if child else None, exact="targetFields" in r)
        if key:  # a path that leads nowhere is a violation
            judged = judged.withColumn("violated", F.col("violated") | F.col(key).isNull())
        return rules.gate_of(name, judged, by)
    options = {k: r[j] for k, j in (("rule", "rule"), ("quorum", "quorum"), ("tie", "tie"), ("count_abstain", "countAbstain"), ("yes", "yes"), ("no", "no"), ("abstain", "abstain"), ("passed", "passed"), ("failed", "failed")) if j in r}
    return rules.gate_of(name, rules.ballots_outcome(src, r.get("key", "ID"), r["outcomeField"], data[r["ballots"]], r["decisionField"], r["voteField"], **options), by)


def dated(domain: Domain, name: str, df: DataFrame) -> tuple[Column | None, str]:
    """(the row's year, why there is none): by the declared cycle field, else by the one field that can date a row; several can't decide it."""
    e = domain.entity(name)
    if not e.cycle_field:
        likely = [f.name for f in e.fields if f.type == "date" and not re.fullmatch(r"(?i)(dob|dateofbirth|birthdate|createdat|updatedat)", f.name)]
        if len(likely) > 1:
            return None, f"{name} has several dates and no cycle field: {', '.join(likely)}"
    field = cycle_field(df.schema, e.cycle_field)
    return (row_year(df.schema, field, df[field]), "") if field else (None, f"{name} has no field that dates a row")


def _failed(df: DataFrame, name: str, why: str) -> DataFrame:
    return df.sparkSession.range(1).select(*gates.gate(name, "era", F.lit(False), F.lit(0), "a dated entity", F.lit(why)))


def era_gates(domain: Domain, data: Mapping[str, DataFrame], ruleset: Mapping[str, list]) -> list[DataFrame]:
    """A gate for each volume multiplier and factor shift of each era and cycle. An entity that can't be dated fails."""
    out, rows = [], ruleset.get("eras", [])
    multiplied = {e: sorted({c for era in rows for n, _, _ in era.volumes if n == e for c in era.cycles}) for e in data}
    for era in rows:
        for name, m, where in era.volumes:
            if name not in data:
                continue
            df, label = data[name], f"{era.name or 'era'}: {name}"
            year, why = dated(domain, name, df)
            if year is None:
                out.append(_failed(df, label, why))
                continue
            parents = [(k.field, data[k.entity], k.target) for k in domain.entity(name).foreign_keys if k.entity in data]
            if where:
                df = fall_through(df, dict(where), parents)
                year = dated(domain, name, df)[0]
            by = eras.by_year(df, year, F.col("__scoped") if where else None)
            for cycle in era.cycles:
                if where:
                    above = 1.0
                    for k in domain.entity(name).foreign_keys:
                        if k.dependent:
                            for other in rows:
                                for n, x, w in other.volumes if cycle in other.cycles else ():
                                    above *= x if n == k.entity and w is None else 1.0
                    out.append(eras.scoped_volume(f"{label} in {cycle}", by, cycle, m, multiplied[name], above))
                else:
                    scoped = [(cycle, x) for other in rows if cycle in other.cycles for n, x, w in other.volumes if w and n in domain.entities and any(k.entity == name and k.dependent for k in domain.entity(n).foreign_keys)]
                    out.append(eras.volume(f"{label} in {cycle}", by, cycle, m, multiplied[name], eras.retention(scoped, cycle)))
        for f in ruleset.get("factors", []):
            if f.id in era.factors and f.entity in data:
                df = data[f.entity]
                year, why = dated(domain, f.entity, df)
                label = f"{era.name or 'era'}: {f.id}"
                if year is None:
                    out.append(_failed(df, label, why))
                    continue
                shifted = sorted({c for x in rows if f.id in x.factors for c in x.cycles})
                by = eras.by_year(df, year, None, self_feature(df, f.outcome))
                out += [eras.factor_shift(f"{label} in {c}", by, c, era.factors[f.id], shifted) for c in era.cycles]
    return out


def universe(domain: Domain, data: Mapping[str, DataFrame], catalogues: Mapping[str, DataFrame] | None = None, named: set[tuple[str | None, str | None]] | None = None) -> DataFrame | None:
    """(entity, field, value) of all text that a lookup may name: of entities and catalogues. named: only the (entity, field) pairs, in lower case, that lookups do name; one without a name may mean any field."""
    out = None
    wanted = lambda n, f: named is None or (None, None) in named or (n.lower(), f.lower()) in named
    for name, df in {**(catalogues or {}), **data}.items():
        fields = [f.name for f in df.schema if f.dataType.typeName() in ("string", "long", "integer", "double") and wanted(name, f.name)]
        if fields:
            cells = df.select(F.explode(F.array(*[F.struct(F.lit(name).alias("entity"), F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields])).alias("c")).select("c.*").where("value IS NOT NULL")
            out = cells if out is None else out.unionByName(cells)
    return out


def names_of(df: DataFrame, fields: list[str], known: Mapping[str, DataFrame]) -> set[tuple[str | None, str | None]]:
    """The (entity, field) pairs, in lower case, that the lookups of these fields name and that are known: as many as there are declared fields at most. (None, None) stands for lookups without a name."""
    e, f, v = lookup_parts("cell")
    cells = df.select(F.explode(F.array(*[df[x].cast("string") for x in fields])).alias("cell")).where("cell LIKE '@lookup:%'")
    fields_of = [(n.lower(), x.lower()) for n, t in known.items() for x in t.columns]
    real = df.sparkSession.createDataFrame(fields_of, "e string, f string").distinct()
    pairs = cells.select(F.lower(e).alias("e"), F.lower(f).alias("f"), v.isNotNull().alias("one")).where("one").groupBy("e", "f").agg(F.count(F.lit(1)).alias("n"))
    bare = pairs.where("e IS NULL").select("e", "f")
    return {(r["e"], r["f"]) for r in pairs.join(F.broadcast(real), ["e", "f"], "left_semi").select("e", "f").unionByName(bare).collect()}


def lookup_gates(domain: Domain, data: Mapping[str, DataFrame], known: DataFrame | None, catalogues: Mapping[str, DataFrame] | None = None) -> list[DataFrame]:
    """A gate for each entity with text. What lookups name is gathered first: of known, or else of data and catalogues, only that is read, and nothing without a lookup."""
    out = []
    all_of = {**(catalogues or {}), **data}
    for n, e in domain.entities.items():
        fields = [f.name for f in e.fields if n in data and f.type in ("string", "uuid") and f.name in data[n].columns]
        if not fields:
            continue
        where = known if known is not None else universe(domain, data, catalogues, names_of(data[n], fields, all_of))
        empty = data[n].sparkSession.createDataFrame([], "entity string, field string, value string")
        out.append(gates.lookups(f"{n}: lookups", data[n], fields, empty if where is None else where))
    return out


def _has(e: Entity, df: DataFrame, *names: str) -> str | None:
    return next((f.name for f in e.fields if f.name in names and f.name in df.columns), None)


def identity_gates(domain: Domain, data: Mapping[str, DataFrame], names: DataFrame | None = None) -> list[DataFrame]:
    """Names, titles and pronouns against gender, and age at intake, for entities that have the fields."""
    first, second, third, fourth = [], [], [], []
    for n, df in data.items():
        e = domain.entity(n)
        gender = _has(e, df, "Gender")
        if gender and names is not None and (given := _has(e, df, "FirstName")):
            first.append(gates.name_gender(f"{n}: names and gender", df, given, gender, names))
        if gender and (title := _has(e, df, "Prefix", "Salutation")):
            second.append(gates.words_of_gender(f"{n}: titles and gender", df, title, df[gender], gates.TITLES, df[e.primary[0]]))
        if pronoun := _has(e, df, "PronounSet", "Pronouns"):
            rows, of = df, df[gender] if gender else None
            for k in () if gender else e.foreign_keys:
                if k.entity in data and "Gender" in data[k.entity].columns:
                    rows = path(df, [(k.field, data[k.entity], k.target)], "Gender", "__gender", raw=True)
                    of = F.col("__gender")
                    break
            if of is not None:
                third.append(gates.words_of_gender(f"{n}: pronouns and gender", rows, pronoun, of, gates.PRONOUNS, F.col(e.primary[0])))
        if born := _has(e, df, "DateOfBirth", "DOB", "BirthDate"):
            since, rows = [day(df[c]) for c in ("IntakeDate", "CreatedAt", "JoinDate") if c in df.columns], df
            for other, k in ((o, k) for o in domain.entities.values() for k in o.foreign_keys if k.entity == n and o.name in data and o.name.endswith("Profile")):
                dates = [day(data[other.name][c]) for c in ("JoinDate", "CreatedAt") if c in data[other.name].columns]
                if dates:  # the earliest profile's date where the row has none
                    least = data[other.name].select(norm(k.field).alias("__p"), F.coalesce(*dates).alias("__d")).groupBy("__p").agg(F.min("__d").alias("__joined"))
                    rows = rows.join(least, norm(df[e.primary[0]]) == F.col("__p"), "left").drop("__p")
                    since.append(F.col("__joined"))
                    break
            if since:
                fourth.append(gates.min_age(f"{n}: age at intake", rows, day(df[born]), F.coalesce(*since), key=df[e.primary[0]]))
    return first + second + third + fourth


def reversal_gates(domain: Domain, data: Mapping[str, DataFrame]) -> list[DataFrame]:
    """Coherence of cancellations, for an entity whose rows can reverse others and one of their lines."""
    head = next((e for e in domain.entities.values() if e.name in data and _has(e, data[e.name], "ReversesOrderHeaderID")), None)
    line = next((e for e in domain.entities.values() if e.name in data and _has(e, data[e.name], "ReversesOrderLineID")), None)
    if head is None or line is None:
        return []
    h, ln = data[head.name], data[line.name]
    to = next(k.field for k in line.foreign_keys if k.entity == head.name and k.field != "ReversesOrderHeaderID")
    customer = next((k.field for k in head.foreign_keys if k.entity != head.name), head.primary[0])
    dated_by = cycle_field(h.schema, head.cycle_field)
    amount = _has(line, ln, "ExtendedPrice", "NetAmount", "GrossAmount", "Amount", "LineTotal")
    both = h.select(norm(head.primary[0]).alias("id"), norm("ReversesOrderHeaderID").alias("link"), norm(customer).alias("customer"), day(h[dated_by]).alias("day"))
    # A line is known by the line that it mirrors; a sale's line by itself.
    lines = ln.select(norm(to).alias("order"), F.coalesce(norm("ReversesOrderLineID"), norm(line.primary[0])).alias("line"), F.col("Quantity").cast("double").alias("quantity"), F.col(amount).cast("double").alias("amount"))
    return [gates_of_reversal(f"{head.name}: reversals", both.where("link IS NOT NULL"), both.where("link IS NULL").drop("link"), lines.join(both.where("link IS NOT NULL").select(F.col("id").alias("order")), "order", "left_semi"), lines)]


def validate(domain: Domain, data: Mapping[str, DataFrame], factors: list[Factor] = (), base: Mapping[str, DataFrame] | None = None, lookup_universe: DataFrame | None = None, heroes: list[Hero] = (), ruleset: Mapping[str, list] | None = None, catalogues: Mapping[str, DataFrame] | None = None, names: DataFrame | None = None, base_errors: Mapping[str, str] | None = None) -> DataFrame:
    """Gates in order: heroes, closure, keys, factors, eras, coverage, lookups, rules, uniqueness and lengths, names, titles, pronouns, age, reversals, images, stability, composition.

    catalogues: what foreign keys and lookups may point to beside entities.
    base: the version that all rows of must still be there, by entity; one
    that is missing is skipped, one of base_errors fails its gate.
    names: a catalogue of given names (name, gender). A rule of an unknown
    entity raises before any job.
    """
    also = dict(catalogues or {})
    known = {**also, **data}
    missing = sorted({n for r in domain.rules for n in forms.named(r) if n not in known})
    if missing:
        raise ValueError(f"rules need entities that are missing: {', '.join(missing)}")
    here = {n: e for n, e in domain.entities.items() if n in data}
    out: list[DataFrame] = hero_rows.gates(data, list(heroes), domain)
    for n, e in here.items():
        nullable = {f.name: f.nullable for f in e.fields}
        to = lambda k: k.target if k.target in known[k.entity].columns else known[k.entity].columns[0]
        closed = [(f"{n}.{k.field}", k.field, known[k.entity], to(k), nullable.get(k.field, False)) for k in e.foreign_keys if k.entity in known]
        if closed:
            out.append(gates.closure_gates(data[n], closed))
    for n, e in here.items():
        out.append(gates.schema_gates_with_examples(n, data[n], e.primary, [f.name for f in e.fields if f.unique], {f.name: f.max_length for f in e.fields if f.max_length}))
    for n, e in here.items():
        own = [f for f in factors if f.entity == n]
        if own:
            rows, scored = data[n], []
            for i, f in enumerate(own):
                if f.outcome.get("from", "self") == "self":
                    scored.append((f.id, self_feature(rows, f.outcome), f.target, f.tolerance))
                else:
                    rows = compile_feature(resolved(f.outcome, domain, n), rows, data, e.primary[0], f"__f{i}")
                    scored.append((f.id, F.col(f"__f{i}").cast("double"), f.target, f.tolerance))
            out.append(gates.factor_gates(rows, scored))
    out += era_gates(domain, data, ruleset) if ruleset else []
    for n, e in here.items():
        out += [gates.dependent_coverage(f"{k.entity} has {n}", data[k.entity], k.target, data[n], k.field, few=3) for k in e.foreign_keys if k.dependent and k.entity in data]
    out += lookup_gates(domain, data, lookup_universe, also)
    out += [rule_gate(r, known) for r in domain.rules]
    out += identity_gates(domain, data, names)
    out += reversal_gates(domain, data)
    for n, e in here.items():
        out += [gates.distinctness(f"{n}.{f.name}: images", data[n], f.name) for f in e.fields if (f.generator or {}).get("kind") == "avatar"]
    if base is not None:
        out += [gates.corpus_stability(f"{n}: kept", base.get(n), data[n], e.primary, (base_errors or {}).get(n), few=3) for n, e in here.items()]
    for n, e in here.items():
        for c in e.compositions:
            if c.entity in data:
                inner = domain.entity(c.entity)
                made = {"isA": lambda c=c, e=e, n=n, inner=inner: gates.is_a(f"{c.entity} is a {n}", data[c.entity], inner.primary[0], data[n], e.primary[0], few=3), "collection": lambda c=c, e=e, n=n: gates.collection(f"{c.entity} in {n}", data[c.entity], c.field, data[n], e.primary[0], few=3), "embed": lambda c=c, n=n, inner=inner: gates.embed(f"{n} embeds {c.entity}", data[n], c.field, data[c.entity], inner.primary[0], few=3)}
                out.append(made[c.kind]())
    return gates.all_gates(out)


def summary(found: DataFrame) -> str:
    """A line a gate, then the totals; for people."""
    rows = found.orderBy(F.col("passed"), "category", "name").collect()
    lines = [f"{'PASS' if r['passed'] else 'FAIL'} {r['category']}: {r['name']} (expected {r['expected']}, actual {r['actual']}, n={r['population_count']})" + (f": {r['message']}" if not r["passed"] and r["message"] else "") for r in rows]
    return "\n".join([*lines, f"{sum(r['passed'] for r in rows)} of {len(rows)} gates passed"])
