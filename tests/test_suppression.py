"""Eras that suppress some rows: what goes with them, and that the eras' gates pass."""

from pyspark.sql import functions as F

from causaria.model import Era, parse_domain
from causaria.plans import build as runs
from causaria.plans import suppression
from causaria.plans.validate import validate
from causaria.sources import project
from tests import worlds
from tests.worlds import DAY, TEXT, entity

ENTITIES = {
    "Stall": entity(None, ["Name"], {"Name": TEXT}),
    "Basket": entity(None, ["BasketNumber"], {"BasketNumber": TEXT}, {"StallID": "Stall"}),
    "Fruit": entity(None, ["ID"], {"Kind": {"type": "string", "values": ["pear", "plum", "fig"]}, "PickedOn": DAY}, {"BasketID": "Basket!"}),
    "Label": entity(None, ["ID"], {"Text": TEXT}, {"BasketID": "Basket"}),
    "Sticker": entity(None, ["ID"], {"Text": TEXT}, {"LabelID": "Label"}),
}
for e in ENTITIES.values():
    e.pop("pack")
DOMAIN = parse_domain({"name": "market", "namespace": "9f0c2b1e-51c3-5a64-8d6a-0e7c7d3f4b52", "entities": ENTITIES})


def test_what_is_nothing_without_the_lost_rows_goes(spark):
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    data = {
        "Stall": f([("s", "S")], "ID string, Name string"),
        "Basket": f([("b1", "1", "s"), ("b2", "2", "S"), ("b3", "3", "s")], "ID string, BasketNumber string, StallID string"),
        "Fruit": f([("f1", "pear", "2020-05-01", "b1"), ("f2", "PEAR", "2020-06-01", "B2"), ("f3", "fig", "2020-06-01", "b2"), ("f4", "pear", "2021-01-01", "b3")], "ID string, Kind string, PickedOn string, BasketID string").withColumn("PickedOn", F.to_date("PickedOn")),
        "Label": f([("l1", "x", "b1"), ("l2", "x", "b2"), ("l3", "x", None)], "ID string, Text string, BasketID string"),
        "Sticker": f([("t1", "x", "l1"), ("t2", "x", "l2")], "ID string, Text string, LabelID string"),
    }
    ids = lambda d: {n: sorted(r["ID"] for r in df.collect()) for n, df in d.items()}
    eras = [Era((2020,), "frost", {}, (("Fruit", 0.0, (("Kind", "pear"),)),))]
    assert ids(suppression.suppressed(DOMAIN, data, eras, 1)) == {"Stall": ["s"], "Basket": ["b2", "b3"], "Fruit": ["f3", "f4"], "Label": ["l2", "l3"], "Sticker": ["t2"]}
    for volumes in ((("Fruit", 2.0, (("Kind", "pear"),)),), (("Fruit", 0.0, None),), ()):
        assert suppression.suppressed(DOMAIN, data, [Era((2020,), "mild", {}, volumes)], 1) == data
    both = [Era((2020, 2021), "frost", {}, (("Fruit", 0.0, (("Kind", "pear"),)), ("Fruit", 0.0, (("Kind", "fig"),))))]
    assert ids(suppression.suppressed(DOMAIN, data, both, 1)) == {"Stall": ["s"], "Basket": [], "Fruit": [], "Label": ["l3"], "Sticker": []}


def test_a_share_is_kept_by_keyed_draws(spark):
    fruit = spark.range(4000).select(F.col("id").cast("string").alias("ID"), F.when(F.col("id") % 2 == 0, "pear").otherwise("fig").alias("Kind"), F.to_date(F.lit("2020-03-03")).alias("PickedOn"), F.lit("b").alias("BasketID"))
    data = {"Fruit": fruit, "Basket": spark.createDataFrame([("b", "1", None)], "ID string, BasketNumber string, StallID string")}
    eras = [Era((2020,), "hail", {}, (("Fruit", 0.3, (("Kind", "pear"),)),))]
    a, b = (suppression.suppressed(DOMAIN, {**data, "Fruit": x}, eras, 5)["Fruit"] for x in (fruit, fruit.repartition(5)))
    n = {r["Kind"]: r["count"] for r in a.groupBy("Kind").count().collect()}
    assert n["fig"] == 2000 and abs(n["pear"] - 600) < 80 and sorted(a.collect()) == sorted(b.collect())


def test_a_built_market_passes_its_eras(spark, tmp_path):
    rules = {"common": {"params": {"volume_Stall": 4, "volume_Basket": 120, "volume_Fruit": 480, "volume_Label": 150, "volume_Sticker": 60}}, "eras": {"eras": [{"eraKey": "frost", "cycles": [2021], "volumeMultipliers": [{"entity": "Fruit", "multiplier": 0, "where": {"Kind": "pear"}}], "factorAdjustments": []}]}}
    p = project.load(worlds.write(tmp_path / "w", {"name": "market", "entities": ENTITIES}, rules))
    built = runs.build(spark, p)
    found = {r["name"]: (r["passed"], r["actual"]) for r in validate(p.domain, built.data, ruleset=p.rules).collect()}
    assert "frost: Fruit in 2021" in found and all(v[0] for v in found.values()), found
    pears = built.data["Fruit"].where("Kind = 'pear'").groupBy(F.year("PickedOn").alias("y")).count().collect()
    assert {r["y"] for r in pears} == {2019, 2020, 2022}
    assert built.checkpoint.counts == {n: df.count() for n, df in built.data.items()} and built.checkpoint.numbered["Fruit"] == 480
