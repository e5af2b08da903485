"""Cancellations made whole, by hand-made cases and in a built project."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from causaria.model import parse_domain
from causaria.plans import build as runs
from causaria.plans import reversals
from causaria.plans.validate import reversal_gates, validate
from causaria.sources import project
from tests import worlds
from tests.worlds import DAY, NUMBER, TEXT, entity

OPTIONAL = {"type": "uuid", "nullable": True}
ENTITIES = {
    "Grower": entity(None, ["Name"], {"Name": TEXT}),
    "Crate": entity(None, ["CrateNumber"], {"CrateNumber": TEXT, "OrderDate": DAY, "OrderType": {"type": "string", "values": ["Sale", "Sale", "Sale", "Cancellation"]}, "Status": {"type": "string", "defaultValue": "Confirmed"}, "TotalAmount": NUMBER, reversals.HEAD_LINK: OPTIONAL}, {"GrowerID": "Grower"}),
    "Fruit": entity(None, ["ID"], {"Quantity": NUMBER, "UnitPrice": NUMBER, "LineTotal": NUMBER, reversals.LINE_LINK: OPTIONAL}, {"CrateID": "Crate!"}),
}
for e in ENTITIES.values():
    e.pop("pack")
DOMAIN = parse_domain({"name": "orchard", "namespace": "9f0c2b1e-51c3-5a64-8d6a-0e7c7d3f4b52", "entities": ENTITIES})


def drawn(spark, seed):
    rng = random.Random(seed)
    day = lambda: date(2024, 1, 1) + timedelta(days=rng.randrange(200))
    heads, lines = [], []
    for i in range(60):
        cancel = rng.random() < 0.35
        link = f"H{rng.randrange(60)}" if cancel and rng.random() < 0.3 else None
        heads.append((f"h{i}", f"n{i}", day(), "Cancellation" if cancel else "Sale", rng.choice(["Confirmed"] * 4 + ["Open"]), float(rng.randint(5, 90)), link, f"g{rng.randrange(5)}"))
        lines += [(f"l{i}-{k}", float(rng.randint(1, 5)), 2.5, 2.5, None, f"h{i}") for k in range(rng.randint(1, 3))]
    h = spark.createDataFrame(heads, "ID string, CrateNumber string, OrderDate date, OrderType string, Status string, TotalAmount double, ReversesOrderHeaderID string, GrowerID string")
    ln = spark.createDataFrame(lines, "ID string, Quantity double, UnitPrice double, LineTotal double, ReversesOrderLineID string, CrateID string")
    return {"Crate": h, "Fruit": ln, "Grower": spark.createDataFrame([(f"g{i}", f"g{i}") for i in range(5)], "ID string, Name string")}


def test_every_cancellation_mirrors_a_sale_of_its_own(spark):
    for seed in (1, 2):
        data = drawn(spark, seed)
        done = reversals.cohered(DOMAIN, data)
        (verdict,) = [g.first() for g in reversal_gates(DOMAIN, done)]
        assert verdict["passed"] and verdict["population_count"] > 10
        heads = {r["ID"]: r for r in done["Crate"].collect()}
        before = {r["ID"]: r for r in data["Crate"].collect()}
        linked = {k: r["ReversesOrderHeaderID"] for k, r in heads.items() if r["ReversesOrderHeaderID"]}
        assert len(set(linked.values())) == len(linked)
        for c, s in linked.items():
            assert before[s]["OrderType"] == "Sale" and before[s]["Status"] == "Confirmed" and s not in linked
            assert heads[c]["GrowerID"] == heads[s]["GrowerID"] and heads[c]["OrderDate"] >= heads[s]["OrderDate"] and heads[c]["TotalAmount"] == -heads[s]["TotalAmount"]
        of = {}
        for r in done["Fruit"].collect():
            of.setdefault(r["CrateID"], []).append(r)
        for c, s in linked.items():
            assert sorted((r["ReversesOrderLineID"], -r["Quantity"]) for r in of[c]) == sorted((r["ID"], r["Quantity"]) for r in of[s])
        # As many as there are sales for are linked, and whoever is neither sale nor cancellation is left alone.
        cancels = [k for k, r in before.items() if r["OrderType"] == "Cancellation"]
        sales = [k for k, r in before.items() if r["OrderType"] == "Sale" and r["Status"] == "Confirmed"]
        assert len(linked) == min(len(cancels), len(sales))
        assert all(tuple(heads[k]) == tuple(before[k]) for k in before if k not in cancels)
        assert done["Fruit"].select("ID").distinct().count() == done["Fruit"].count()


def test_nothing_to_reverse_is_nothing_changed(spark):
    data = drawn(spark, 3)
    assert reversals.cohered(DOMAIN, {"Crate": data["Crate"]}) == {"Crate": data["Crate"]}
    none = {**data, "Crate": data["Crate"].where("OrderType = 'Sale'").withColumn("ReversesOrderHeaderID", F.lit(None).cast("string"))}
    done = reversals.cohered(DOMAIN, none)
    assert sorted(done["Crate"].collect()) == sorted(none["Crate"].collect()) and done["Fruit"].count() == data["Fruit"].count()
    empty = {n: df.limit(0) for n, df in data.items()}
    assert reversals.cohered(DOMAIN, empty)["Fruit"].count() == 0


def test_a_built_orchard_is_coherent(spark, tmp_path):
    domain = {"name": "orchard", "entities": ENTITIES}
    p = project.load(worlds.write(tmp_path / "w", domain, {"common": {"params": {"volume_Grower": 6, "volume_Crate": 90, "volume_Fruit": 5}}}))
    built = runs.build(spark, p)
    found = {r["name"]: r for r in validate(p.domain, built.data).collect()}
    assert all(r["passed"] for r in found.values()) and found["Crate: reversals"]["population_count"] == 22
    assert built.checkpoint.counts["Fruit"] == built.data["Fruit"].count()
