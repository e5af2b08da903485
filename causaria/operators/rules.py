"""Relational rules: path-match, date-window, text-contains-path and outcome-derived-from-ballots.

Each returns the source rows with a column violated; gate_of() makes the gate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import within
from ..functions.keys import filled, norm, pair
from .features import path
from .gates import gate, violations

OUTCOMES = ("Passed", "Failed")


def gate_of(name: str, judged: DataFrame, key: str | None = None) -> DataFrame:
    """No source row violates the rule; no rows pass. key: what the message names offenders by."""
    if key is not None and key in judged.columns:
        return violations(name, "rule", judged, F.col("violated"), empty_fails=False, key=F.col(key)).withColumn("expected", F.lit("0 violations"))
    c = judged.agg(F.count(F.lit(1)).alias("n"), F.count_if("violated").alias("bad"))
    return c.select(*gate(name, "rule", F.col("bad") == 0, F.col("n"), "0 violations", F.col("bad")))


def path_match(source: DataFrame, hops: list[tuple[str, DataFrame, str]], target_field: str, source_field: str | None = None, pool: DataFrame | None = None, pair: tuple[str, str] | None = None) -> DataFrame:
    """The path must lead to a row; its field must equal the source's, if one is named; and (source's pair[0], target field) must be among pool's (a, b), if a pool is given."""
    out = path(source, hops, target_field, "__end", raw=True)
    bad = norm("__end").isNull()
    if source_field:
        bad = bad | F.coalesce(norm("__end") != norm(source[source_field]), F.lit(True))
    if pool is not None:
        pairs = pool.select(norm(pool[pair[0]]).alias("__a"), norm(pool[pair[1]]).alias("__b")).dropna().distinct().withColumn("__in", F.lit(True))
        out = out.join(pairs, (norm(source[pair[0]]) == F.col("__a")) & (norm("__end") == F.col("__b")), "left")
        bad = bad | F.col("__in").isNull()
    return out.withColumn("violated", bad).select(*source.columns, "violated")


def pool_membership(source: DataFrame, on: list[str], pool: DataFrame) -> DataFrame:
    """Source rows whose values of on are in no pool row are violations."""
    side = pool.select(*[norm(pool[c]).alias(f"__{c}") for c in on]).dropna().distinct().withColumn("__in", F.lit(True))
    cond = F.lit(True)
    for c in on:
        cond = cond & (norm(source[c]) == F.col(f"__{c}"))
    return source.join(side, cond, "left").select(*source.columns, F.col("__in").isNull().alias("violated"))


def date_window(source: DataFrame, date: Column, key: str, windows: DataFrame, window_key: str, start: Column, end: Column, require: bool = False) -> DataFrame:
    """The date must lie in some window of the row's key, ends included and null ends open. A null date passes; a key without windows does unless require.

    One aggregate over an equi join: windows are gathered by nothing but their
    key, and rows by a distinct (key, date).
    """
    own, theirs = pair(source, key, windows, window_key)
    w = windows.select(theirs.alias("__w"), start.alias("__s"), end.alias("__e"))
    dated = source.select(own.alias("__k"), date.alias("__d")).dropna().distinct()
    met = dated.join(w, F.col("__k") == F.col("__w"), "left").groupBy("__k", "__d").agg(F.bool_or(F.col("__w").isNotNull()).alias("__any"), F.bool_or(F.col("__w").isNotNull() & within("__d", "__s", "__e")).alias("__in"))
    met = met.withColumnsRenamed({"__k": "__mk", "__d": "__md"})
    out = source.withColumn("__date", date).withColumn("__key", own).join(met, (F.col("__key") == F.col("__mk")) & (F.col("__date") == F.col("__md")), "left")
    lost = F.coalesce("__any", F.lit(False)) & ~F.coalesce("__in", F.lit(False))
    bad = (lost | ~F.coalesce("__any", F.lit(False))) if require else lost
    return out.withColumn("violated", F.col("__date").isNotNull() & bad).select(*source.columns, "violated")


def text_contains(source: DataFrame, text: str, parts: list[Column], children: DataFrame | None = None, key: str | None = None, child_key: str | None = None, child_field: str | None = None, exact: bool = False) -> DataFrame:
    """The text must contain every part and the field of every child row (by key), case aside unless exact; null and empty parts ask for nothing.

    Each text meets its key's children one by one, in an aggregate that keeps a
    flag: however many children a key has, none gathers them.
    """
    same = (lambda c: c) if exact else F.lower
    low, ok = same(F.coalesce(source[text], F.lit(""))), F.lit(True)
    for p in parts:
        ok = ok & F.coalesce(low.contains(same(F.trim(p.cast("string")))), F.lit(True))
    if children is None:
        return source.withColumn("violated", ~ok)
    own, theirs = pair(source, key, children, child_key)
    must = children.select(theirs.alias("__c"), same(filled(F.trim(children[child_field].cast("string")))).alias("__must")).dropna().distinct()
    marks = [F.xxhash64(low, F.lit(k)).alias(f"__h{k}") for k in (1, 2)]
    texts = source.select(own.alias("__k"), *marks, low.alias("__t")).dropDuplicates(["__k", "__h1", "__h2"])
    met = texts.join(must, F.col("__k") == F.col("__c")).groupBy("__k", "__h1", "__h2").agg(F.bool_and(F.col("__t").contains(F.col("__must"))).alias("__all"))
    met = met.select(F.col("__k").alias("__mk"), F.col("__h1").alias("__m1"), F.col("__h2").alias("__m2"), "__all")
    keyed = source.withColumns({"__ok": ok, "__k": own, "__h1": F.xxhash64(low, F.lit(1)), "__h2": F.xxhash64(low, F.lit(2))})
    joined = keyed.join(met, (F.col("__k") == F.col("__mk")) & (F.col("__h1") == F.col("__m1")) & (F.col("__h2") == F.col("__m2")), "left")
    return joined.withColumn("violated", ~(F.col("__ok") & F.coalesce("__all", F.lit(True)))).select(*source.columns, "violated")


def tally(ballots: DataFrame, decision: str, vote: str, yes: str = "Yes", no: str = "No", abstain: str = "Abstain") -> DataFrame:
    """Votes by decision: __decision, yes, no, abstain, other."""
    v = ballots[vote]
    return ballots.groupBy(norm(ballots[decision]).alias("__decision")).agg(F.count_if(v == yes).alias("yes"), F.count_if(v == no).alias("no"), F.count_if(v == abstain).alias("abstain"), F.count_if(~F.coalesce(v.isin(yes, no, abstain), F.lit(False))).alias("other"))


def decide(rule: str = "majority", quorum: int = 1, tie: str = "Failed", count_abstain: bool = False, passed: str = OUTCOMES[0], failed: str = OUTCOMES[1]) -> Column:
    """The outcome of a tally: below quorum Failed; majority, two-thirds (of yes and no, and some yes) or unanimous (some yes, no no)."""
    yes, no, present = F.col("yes"), F.col("no"), F.col("yes") + F.col("no") + (F.col("abstain") if count_abstain else F.lit(0))
    if rule == "majority":
        won = F.when(yes > no, passed).when(yes == no, tie).otherwise(failed)
    elif rule == "two-thirds":
        won = F.when((yes >= 2 * no) & (yes > 0), passed).otherwise(failed)
    elif rule == "unanimous":
        won = F.when((no == 0) & (yes > 0), passed).otherwise(failed)
    else:
        raise ValueError(f"unknown decision rule {rule!r}")
    return F.when(present < quorum, failed).otherwise(won)


def ballots_outcome(decisions: DataFrame, key: str, outcome: str, ballots: DataFrame, decision: str, vote: str, **rule) -> DataFrame:
    """Decisions whose stored outcome isn't the tally's, or that have ballots of another label, are violations."""
    labels = {k: rule.pop(k) for k in ("yes", "no", "abstain") if k in rule}
    t = tally(ballots, decision, vote, **labels)
    out = decisions.join(t, norm(decisions[key]) == F.col("__decision"), "left").fillna(0, ["yes", "no", "abstain", "other"])
    bad = (decide(**rule) != F.coalesce(decisions[outcome], F.lit(""))) | (F.col("other") > 0)
    return out.withColumn("violated", bad).select(*decisions.columns, "violated")
