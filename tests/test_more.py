"""Small operators that have no query of their own."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from causaria.functions import dates, keys, rng, scalars
from causaria.model import Ladder, State, domain_from_frames
from causaria.operators import eras, gates, generate
from causaria.sources import project
from causaria.streaming import ladders

NS = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def test_domain_from_frames(spark):
    df = spark.createDataFrame([], "ID string, OrderNumber string, Amount decimal(9,2), Open boolean, At timestamp, Tags array<string>")
    d = domain_from_frames("x", NS, {"Order": df, "Named": spark.createDataFrame([], "FullName string")}, {"Named": ["FullName"]})
    assert {f.name: f.type for f in d.entity("Order").fields} == {"ID": "string", "OrderNumber": "string", "Amount": "number", "Open": "boolean", "At": "date", "Tags": "json"}
    assert d.entity("Order").business_key == ("OrderNumber",) and d.entity("Named").business_key == ("FullName",) and d.entity("Order").primary == ["ID"]


def test_intervals(spark):
    h = spark.createDataFrame([("k", "l", "A", 1), ("k", "l", "B", 4), ("m", "l", "A", 2)], "key string, ladder string, state string, enter_cycle int")
    assert {(r["key"], r["state"], r["exit_cycle"]) for r in ladders.intervals(h).collect()} == {("k", "A", 4), ("k", "B", None), ("m", "A", None)}


def test_stored_values_map_both_ways(spark):
    lad = Ladder("l", "P", (State("Trial", 1, stored="T"), State("Active", 1)))
    df = spark.createDataFrame([("Trial",), ("Active",), ("T",), ("active",), ("gone",)], "v string")
    assert [r[0] for r in df.select(ladders.stored(lad, F.col("v"))).collect()][:2] == ["T", "Active"]
    assert [r[0] for r in df.select(ladders.state_of(lad, F.col("v"))).collect()] == ["Trial", "Active", "Trial", "Active", None]


def test_names_and_buckets(spark):
    df = spark.createDataFrame([(" EVE ",), ("jon",), ("kim",), (None,)], "n string")
    assert [r[0] for r in df.select(scalars.gender_of("n", ["Eve"], ["Jon", "Eve"])).collect()] == ["Female", "Male", "Unknown", "Unknown"]
    assert {(r["name"], r["gender"]) for r in project.names(spark, ["Eve", "Kim"], ["kim"]).collect()} == {("Eve", "Female"), ("Kim", "Unisex"), ("kim", "Unisex")}
    r = spark.range(1).select(keys.hex_bucket(F.lit("0000000a-x"), 7).alias("b"), scalars.clean_name(F.lit(" Mr. ")).alias("c"), scalars.avatar_url(F.lit("a b"), "s", "http://x/").alias("u")).first()
    assert (r["b"], r["c"], r["u"]) == (3, "mr", "http://x/s/svg?seed=a+b")


def test_dates_in_windows(spark):
    u = rng.keyed(3, F.col("id").cast("string"))
    lo, hi = F.lit("2024-01-01").cast("date"), F.lit("2024-01-08").cast("date")
    days = {r[0] for r in spark.range(400).select(dates.in_window(u, lo, hi)).collect()}
    assert days == {date(2024, 1, d) for d in range(2, 9)}
    s = rng.stream(3, F.col("id").cast("string"))
    born = spark.range(200).select(dates.relative_date(F.lit("2024-06-15").cast("date"), s, lambda st: F.lit(10.0), 18).alias("d")).agg(F.max("d"), F.min("d")).first()
    assert born[0] <= date(2006, 6, 15)
    t = spark.range(1).select(*[dates.tenure(k, F.lit("2023-01-31").cast("date"), F.lit("2024-01-31").cast("date")).alias(k) for k in ("day", "week", "month", "year")]).first()
    assert tuple(t) == (365, 52, 12, 1)
    with pytest.raises(ValueError):
        dates.advance(F.lit(1), "fortnight", 1)


def test_catalogue_generators(spark):
    df = spark.createDataFrame([(k, "f" if k % 2 else "M") for k in range(200)], "ID int, g string")
    fields = {"name": {"kind": "catalogue", "name": "given", "on": "g", "map": {"f": "female", "M": "male"}}, "greeting": {"kind": "conditional", "on": "name", "table": {"Eve": {"Ms": 1.0}, "default": {"Mr": 1.0}}}, "born": {"kind": "relativeDate", "anchor": "day", "mean": 30, "sd": 5, "minAge": 18}}
    out = generate.generated(df.withColumn("day", F.lit("2024-01-01").cast("date")), "ID", fields, 1, {"given": {"female": ["Eve"], "male": ["Jon", "Max"]}}).collect()
    assert {(r["g"], r["name"], r["greeting"]) for r in out} == {("f", "Eve", "Ms"), ("M", "Jon", "Mr"), ("M", "Max", "Mr")}
    assert max(r["born"] for r in out) <= date(2006, 1, 1)
    filled = generate.generated(df.withColumn("g", F.when(F.col("ID") < 5, "").otherwise(F.col("g"))), "ID", {"g": {"kind": "values", "values": ["z"]}}, 1)
    assert {r["g"] for r in filled.where("ID < 5").collect()} == {"z"}
    with pytest.raises(ValueError):
        generate.generated(df, "ID", {"x": {"kind": "magic"}}, 1)


def test_report_and_years(spark):
    df = spark.createDataFrame([("1", 2020, "a"), ("2", None, "b")], "ID string, y int, P string")
    up = spark.createDataFrame([("B", 2019)], "ID string, y int")
    assert {r["ID"]: r["year"] for r in eras.year_with_parents(df, df["y"], [("P", up, "ID", up["y"])]).collect()} == {"1": 2020, "2": 2019}
    r = gates.report(gates.all_gates([gates.schema_gates("T", df, ["ID"]), gates.fk_closure("x", df, "P", up, "ID")])).first()
    assert (r["passed"], r["failed"], r["examined"]) == (1, 1, 4)
    assert gates.distinctness("x", df, "P").first()["passed"] and not gates.distinctness("x", df.limit(0), "P").first()["passed"]


def test_schedules_are_no_join(spark):
    out = generate.scheduled(spark.range(3).toDF("id"), [{"role": "chair", "start": 2021}, {"role": "clerk", "start": 2022}])
    assert out.count() == 6 and out.columns == ["id", "role", "start"] and "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert generate.scheduled(spark.range(3), []).count() == 0


def test_glyphs_are_one_a_seed_and_well_formed(spark):
    import base64
    from xml.etree import ElementTree

    from causaria.functions.scalars import glyph
    from causaria.operators import gates, generate

    df = spark.createDataFrame([(" Ada ",), ("ada",), ("Bo",), ("",), (None,)], "n string")
    images = [r["g"] for r in df.select(glyph("n").alias("g")).collect()]
    assert images[0] == images[1] != images[2] and images[3] == images[4]
    for i in images:
        ground, drawing = ElementTree.fromstring(base64.b64decode(i.split(",", 1)[1]))
        assert ground.get("fill").strip("#cdef") == "" and len(drawing.get("fill")) == 7
        cells = {(int(c.split(" ")[0]), int(c.split(" ")[1][0])) for c in drawing.get("d").split("M")[1:]}
        assert cells == {(4 - x, y) for x, y in cells} and all(0 <= x < 5 and 0 <= y < 5 for x, y in cells)
    many = spark.range(100000).select(glyph("id", "#fed").alias("g"))
    assert gates.distinctness("x", many, "g").first()["actual"] == "1.0"
    made = generate.generated(df, "n", {"Face": {"kind": "avatar", "of": "n"}}, 1)
    assert [r["Face"] for r in made.collect()] == images


def test_periods_grow_with_events():
    from causaria.operators.patterns import EVENTS_A_PERIOD, period_days

    assert period_days(365, 10) == 365 and period_days(1, 0) == 1
    assert period_days(365, 100 * EVENTS_A_PERIOD) == 4 and period_days(3650, 10**9) == 1
