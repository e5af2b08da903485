"""Whole projects in declared form: built, checked by every gate, corrupted, and carried on by a cycle."""

import json
from dataclasses import replace
from datetime import date
from math import comb

import pytest
from pyspark.sql import functions as F

from causaria.model import Dial, ModelError, check_ruleset, parse_domain, parse_ruleset
from causaria.operators.gates import TITLES
from causaria.plans import build as runs
from causaria.plans import kin
from causaria.plans.validate import identity_gates, reversal_gates, validate
from causaria.sources import project, records, state
from causaria.streaming import simulate
from tests import worlds


def built(spark, tmp, domain, rules):
    p = project.load(worlds.write(tmp, domain, rules))
    runs.write(p, runs.build(spark, p))
    return p, records.read(spark, p.domain, str(p.output), list(p.domain.entities))


@pytest.fixture(scope="module")
def apiary(spark, tmp_path_factory):
    return built(spark, tmp_path_factory.mktemp("w") / "apiary", worlds.APIARY, worlds.APIARY_RULES)


@pytest.fixture(scope="module")
def rescue(spark, tmp_path_factory):
    return built(spark, tmp_path_factory.mktemp("w") / "rescue", worlds.RESCUE, worlds.RESCUE_RULES)


def failed(p, data):
    found = validate(p.domain, data, p.rules["factors"], heroes=p.rules["heroes"], ruleset=p.rules).collect()
    assert found
    return {r["name"] for r in found if not r["passed"]}


def test_the_apiary_is_whole(spark, apiary):
    p, data = apiary
    assert failed(p, data) == set()
    oak = data["Hive"].where("HiveCode = 'OAK-1'").first()
    dark = data["Harvest"].where((F.col("HiveID") == oak["ID"]) & (F.col("Grade") == "dark"))
    assert oak["Queen"] == "Carnica" and dark.count() > 120  # more children than one block of numbers
    for n, df in data.items():  # rows of two motifs, their dependents and a hero's many children: no key twice
        assert df.select("ID").distinct().count() == df.count(), n
    for child, parent, key in (("Jar", "Harvest", "HarvestID"), ("Mite", "Visit", "VisitID")):
        assert data[parent].join(data[child], data[parent]["ID"] == F.col(key), "left_anti").count() == 0
    assert {r["Standing"] for r in data["Permit"].select("Standing").distinct().collect()} <= {"N", "M"}
    stored = state.load_checkpoint(f"{p.output}/{runs.CHECKPOINT}")
    assert stored.counts == {n: df.count() for n, df in data.items()}
    states = spark.read.parquet(runs._states(p, stored.cycle))
    assert states.where("size(dials) = 0 OR dials['vigour'] IS NULL").count() == 0


def test_a_motif_acts_in_its_eras_alone(spark, apiary):
    p, _ = apiary
    (parched, shows), eras = p.rules["motifs"], p.rules["eras"]
    assert parched.eras == ("drought",) and [simulate.acting([parched, shows], eras, y) for y in (2019, 2020, 2022)] == [[shows], [parched, shows], [shows]]
    with pytest.raises(ModelError, match="unknown era 'flood'"):
        check_ruleset({**p.rules, "motifs": [replace(parched, eras=("flood",))]}, p.domain)
    people = spark.range(400).select(F.col("id").cast("string").alias("ID"), F.lit(2019).alias("birth_cycle"), F.lit(None).cast("string").alias("hero"), F.lit(0.0).alias("vigour"), F.when(F.col("id") < 60, "parched").alias("motif"))
    world = simulate.World(people, "ID", [replace(p.rules["factors"][0], arrows=())], 7, [Dial("vigour", 0.0, 1.0)], eras, [parched])
    rates = {r["cycle"]: r["rate"] for r in simulate.unroll(world, [2019, 2020, 2021]).where("key < 60").groupBy("cycle").agg(F.avg(F.col("outcome").cast("double")).alias("rate")).collect()}
    assert rates[2020] < 0.2 < min(rates[2019], rates[2021])
    assert {r["vigour"] for r in world.ended.where("motif = 'parched'").select("vigour").distinct().collect()} == {-2.5}  # moved once


def test_corrupted_apiaries_fail_the_gate_that_is_meant(spark, apiary):
    p, data = apiary
    some = F.col("ID") == data["Hive"].where("HiveCode <> 'OAK-1'").first()["ID"]
    bad = {
        "Permit": data["Permit"].withColumn("KeeperID", F.lit("nobody")).withColumn("PermitNumber", F.when(F.col("PermitNumber") == data["Permit"].first()["PermitNumber"], "@lookup:Keeper.Email=gone@x").otherwise(F.col("PermitNumber"))),
        "Hive": data["Hive"].union(data["Hive"].where(some)).withColumn("Health", F.lit("Weak")).withColumn("Queen", F.when(F.col("HiveCode") == "OAK-1", "Ligustica").otherwise(F.col("Queen"))).withColumn("Note", F.lit("none")),
        "Harvest": data["Harvest"].where("NOT (year(HarvestedOn) = 2022 AND pmod(xxhash64(ID), 3) > 0)"),
        "Jar": data["Jar"].limit(3),
        "Visit": data["Visit"].withColumn("YardID", F.lit(data["Yard"].first()["ID"])),
    }
    wrong = failed(p, {**data, **bad})
    assert wrong >= {"Permit.KeeperID", "Hive: primary key", "factor thriving", "hero old oak", "Harvest has Jar", "Permit: lookups", "clover: Harvest in 2022", "visits where the hive stands", "notes name the yard"}
    assert {"Valley: primary key", "Keeper.ValleyID"} & wrong == set()


def test_cycles_go_on_from_the_apiary(spark, apiary):
    p, data = apiary
    before, cycle = data, state.load_checkpoint(f"{p.output}/{runs.CHECKPOINT}").cycle
    for k in (1, 2):
        done = runs.next_cycle(spark, p)
        assert {n: df.count() for n, df in done.new.items()} == dict.fromkeys(("Keeper", "Yard", "Hive", "Permit", "Visit", "Mite", "Harvest", "Jar"), 3)
        days = [r[0] for r in done.new["Harvest"].select("HarvestedOn").collect()]
        assert all(date(2022, 12, 31 - 7) < d for d in days)
        runs.commit(spark, p, done, before)
        after = records.read(spark, p.domain, str(p.output), list(p.domain.entities))
        assert k == 1 or failed(p, after) == set()
        old, new = (spark.read.parquet(runs._states(p, c)) for c in (cycle + k - 1, cycle + k))
        moved = old.alias("o").join(new.alias("n"), ["key", "ladder"]).where("o.state <> n.state")
        if k == 1:  # someone enters a state that a dial guards, and a state's move shows in the row it is bound to
            assert moved.where("n.state IN ('Strong', 'Master')").count() and "Hive" in done.updated
        before = after


def test_the_rescue_decides(spark, rescue):
    p, data = rescue
    assert failed(p, data) == set()
    for ballots in ("Hand", "Slip"):
        assert {r["Said"] for r in data[ballots].select("Said").distinct().collect()} == {"For", "Against", "None"}
    people = data["Rescuer"].select(F.col("ID").alias("RescuerID"))
    for seats, body in (("Post", "StationID"), ("Chair", "MassifID")):
        held = data[seats]
        assert held.join(people, "RescuerID", "left_anti").count() == 0
        a, b = held.alias("a"), held.alias("b")
        twice = a.join(b, (F.col(f"a.{body}") == F.col(f"b.{body}")) & (F.col("a.RescuerID") == F.col("b.RescuerID")) & (F.col("a.ID") < F.col("b.ID")) & (F.col("a.Since") <= F.col("b.Until")) & (F.col("b.Since") <= F.col("a.Until")))
        assert twice.count() == 0 and held.groupBy(body).count().select("count").distinct().count() == 1


def test_open_decisions_are_made(spark, rescue):
    p, data = rescue
    # Proposals put in before, for a day of the coming week: nobody has voted on them.
    late = data["Proposal"].limit(5).withColumn("ID", F.concat(F.lit("late-"), F.substring("ID", 1, 8))).withColumn("PutOn", F.lit(date(2023, 1, 3))).withColumn("Result", F.lit("Open"))
    season = data["Season"].first()
    late.withColumn("SeasonID", F.lit(season["ID"])).write.mode("append").parquet(f"{p.output}/Proposal")
    prior = records.read(spark, p.domain, str(p.output), list(p.domain.entities))
    done = runs.next_cycle(spark, p)
    runs.commit(spark, p, done, prior)
    after = records.read(spark, p.domain, str(p.output), list(p.domain.entities))
    assert failed(p, after) == set()
    assert after["Proposal"].where("ID LIKE 'late-%' AND Result IN ('Agreed', 'Refused')").count() == 5
    assert after["Hand"].where("ProposalID LIKE 'late-%'").count() >= 10
    bad = {
        "Budget": after["Budget"].withColumn("Result", F.when(F.col("Result") == "Refused", "Agreed").otherwise("Refused")),
        "Slip": after["Slip"].withColumn("RescuerID", F.lit("stranger")),
        "Drill": after["Drill"].withColumn("DrillDate", F.date_add("DrillDate", 900)),
    }
    assert {"budgets as voted", "slips of those in the chair", "drills in season"} <= failed(p, {**after, **bad})


def test_votes_of_a_million(spark):
    for n in (1, 2, 7, 1000, 1031, 10**6):
        eligible = spark.range(n).select(F.lit(1).alias("__event"))
        for share in (0.2, 0.5, 0.9):
            q = runs.approval(share, eligible)
            assert 0 < q < 1 and abs(runs.majority(n, q) - share) < 1e-6
    exact = sum(comb(999, k) * 0.52**k * 0.48 ** (999 - k) for k in range(500, 1000))
    assert abs(runs.majority(999, 0.52) - exact) < 1e-9 and abs(runs.majority(1001, 0.52) - exact) < 2e-3


def test_windows_in_slots():
    windows = [("2020-01-01", "2021-12-31"), ("2021-06-01", None), ("2022-01-01", "2022-12-31"), ("2020-01-01", "2020-06-30"), ("2020-07-01", "2020-12-31")]
    found = kin.slots(windows)
    for i, (s, e) in enumerate(windows):
        for j, (t, u) in enumerate(windows[:i]):
            assert found[i] != found[j] or (e or "9999") < t or (u or "9999") < s
    assert max(found) == 1


def test_identity_and_reversal_gates(spark):
    f = worlds.FIELD
    d = parse_domain({"name": "x", "namespace": "6ba7b810-9dad-11d1-80b4-00c04fd430c8", "entities": {
        "Person": {"businessKey": ["ID"], "fields": {**f, "FirstName": {"type": "string"}, "Gender": {"type": "string"}, "Prefix": {"type": "string"}, "DateOfBirth": {"type": "date"}, "IntakeDate": {"type": "date", "nullable": True}}},
        "MemberProfile": {"businessKey": ["ID"], "fields": {**f, "PersonID": {"type": "uuid"}, "Pronouns": {"type": "string"}, "JoinDate": {"type": "date"}}, "foreignKeys": {"PersonID": worlds.fk("Person", "PersonID")}},
        "OrderHeader": {"businessKey": ["ID"], "fields": {**f, "CustomerID": {"type": "uuid"}, "OrderDate": {"type": "date"}, "ReversesOrderHeaderID": {"type": "uuid", "nullable": True}}, "foreignKeys": {"CustomerID": worlds.fk("Person", "CustomerID")}},
        "OrderLine": {"businessKey": ["ID"], "fields": {**f, "OrderID": {"type": "uuid"}, "Quantity": {"type": "number"}, "Amount": {"type": "number"}, "ReversesOrderLineID": {"type": "uuid", "nullable": True}}, "foreignKeys": {"OrderID": worlds.fk("OrderHeader", "OrderID")}},
    }})
    day = date
    person = spark.createDataFrame([("p", "Ann", "Female", "Lady", day(1990, 1, 1), None), ("q", "Kim", "Male", "Lord", day(2000, 1, 1), day(2020, 1, 1)), ("r", "Zed", "Male", "", day(1980, 1, 1), None)], "ID string, FirstName string, Gender string, Prefix string, DateOfBirth date, IntakeDate date")
    profile = spark.createDataFrame([("m", "P", "she/her", day(2010, 1, 1)), ("n", "p", "she/her", day(2009, 1, 1)), ("o", "q", "he/him", day(2021, 1, 1))], "ID string, PersonID string, Pronouns string, JoinDate date")
    order = spark.createDataFrame([("1", "p", day(2020, 1, 1), None), ("2", "p", day(2020, 2, 1), "1")], "ID string, CustomerID string, OrderDate date, ReversesOrderHeaderID string")
    line = spark.createDataFrame([("a", "1", 2.0, 10.0, None), ("b", "2", -2.0, -10.0, "a")], "ID string, OrderID string, Quantity double, Amount double, ReversesOrderLineID string")
    names = spark.createDataFrame([("ann", "Female"), ("kim", "Unisex")], "name string, gender string")
    data = {"Person": person, "MemberProfile": profile, "OrderHeader": order, "OrderLine": line}
    verdicts = lambda x: {r["name"]: (r["passed"], r["population_count"], r["actual"]) for g in identity_gates(d, x, names) + reversal_gates(d, x) for r in g.collect()}
    good = verdicts(data)
    assert good == {"Person: names and gender": (True, 1, "0, 2 not classified"), "Person: titles and gender": (True, 2, "0"), "MemberProfile: pronouns and gender": (True, 3, "0"), "Person: age at intake": (True, 2, "0"), "OrderHeader: reversals": (True, 1, "0")}
    bad = verdicts({**data, "Person": person.withColumn("Gender", F.when(F.col("Gender") == "Male", "Female").otherwise("Male")), "MemberProfile": profile.withColumn("JoinDate", F.lit("2007-06-01").cast("date")), "OrderLine": line.withColumn("Quantity", F.abs("Quantity"))})
    assert not any(v[0] for v in bad.values())
    assert not any(v[0] for k, v in verdicts({n: x.limit(0) for n, x in data.items()}).items())
    assert TITLES["dame"] == "Female" and TITLES["master"] == "Male" and len(TITLES) == 10


def test_declared_forms(spark):
    r = parse_ruleset(worlds.APIARY_RULES["common"])
    (f,) = r["factors"]
    assert f.id == "thriving" and [(a.name, a.dial, a.beta) for a in f.arrows] == [("vigour", "vigour", 0.9), ("visited", None, 0.15), ("height", None, -0.002)]
    m, n = parse_ruleset(worlds.APIARY_RULES["motifs"])["motifs"]
    assert (m.id, m.entity, m.unit, m.trajectory, m.overrides, m.children) == ("parched", "Hive", "count", {"vigour": -2.5}, {"thriving": 0.05}, {"Visit": (1, 3)})
    assert (n.unit, n.rounding, n.dials, n.children) == ("percentage", "floor", {"calm": (0.5, None)}, {"Visit": (2, 2), "Harvest": (1, 1)})
    x, y = parse_ruleset(worlds.APIARY_RULES["ladders"])["ladders"]
    assert y.states[1].stored == "M" and y.states[0].exit_effects == {"calm": 0.2} and x.states[1].factor_effects == {"thriving": 0.6} and x.share == 0.7
    with pytest.raises(ModelError, match="unknown part 'factor'"):
        parse_ruleset({"factor": []})
    with pytest.raises(ModelError, match="unknown entity 'Gone'"):
        bad = json.loads(json.dumps(worlds.RESCUE))
        bad["relationalRules"][0]["windowEntity"] = "Gone"
        parse_domain({**bad, "namespace": "6ba7b810-9dad-11d1-80b4-00c04fd430c8"})
    held = parse_domain({"name": "x", "namespace": "n", "entities": {"A": {"fields": worlds.FIELD, "composition": {"collections": {"bs": {"entity": "B", "foreignKey": "FK"}}}}, "B": {"fields": {**worlds.FIELD, "AID": {"type": "uuid"}}, "foreignKeys": {"FK": worlds.fk("A", "AID")}}, "C": {"fields": worlds.FIELD, "composition": {"isA": {"parentEntity": "A"}}}}})
    assert [(c.kind, c.entity, c.field) for c in held.entity("A").compositions] == [("collection", "B", "AID"), ("isA", "C", "ID")]


def test_linked_windows_and_texts_of_paths(spark):
    from causaria.plans.validate import rule_gate

    item = spark.createDataFrame([("i1", date(2024, 1, 5)), ("i2", date(2024, 3, 1)), ("i3", None)], "ID string, Day date")
    link = spark.createDataFrame([("I1", "s1"), ("i2", "s1"), ("i3", "s1")], "ItemID string, SessionID string")
    session = spark.createDataFrame([("s1", date(2024, 1, 1), date(2024, 1, 31))], "ID string, StartDate date, EndDate date")
    r = {"kind": "date-window", "name": "n", "source": "Item", "dateField": "Day", "key": "SessionID", "window": "Session", "windowKey": "SessionID", "startField": "StartDate", "endField": "EndDate", "requireWindow": True, "link": {"entity": "Link", "source": "ItemID", "target": "SessionID"}}
    got = rule_gate(r, {"Item": item, "Link": link, "Session": session}).first()
    assert (got["population_count"], got["actual"], got["passed"]) == (3, "1", False)
    note = spark.createDataFrame([("n1", "s1", "Spring talks by Ann and Bob"), ("n2", "s1", "Spring talks by Ann"), ("n3", None, "Spring talks by Ann and Bob"), ("n4", "s1", "spring talks by Ann and Bob")], "ID string, SessionID string, Text string")
    named = session.withColumn("Title", F.lit("Spring"))
    speaker = spark.createDataFrame([("s1", "Ann"), ("s1", "Bob"), ("s1", "")], "SessionID string, Name string")
    t = {"kind": "text-contains-path", "name": "t", "source": "Note", "textField": "Text", "path": [{"field": "SessionID", "entity": "Session", "key": "ID"}], "targetFields": ["Title"], "children": {"entity": "Speaker", "key": "SessionID", "field": "Name"}}
    got = rule_gate(t, {"Note": note, "Session": named, "Speaker": speaker}).first()
    assert (got["population_count"], got["actual"]) == (4, "3")
