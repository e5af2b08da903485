import math
import statistics
import uuid

import pytest
from pyspark.sql import functions as F

from causaria.functions import dates, keys, rng, scalars


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_fnv_and_draws_equal_the_driver_streams(spark):
    ks = ["", "a", "customer:17", "é☃", "😀x"]
    df = spark.createDataFrame([(k,) for k in ks], "k string")
    rows = df.select("k", rng.fnv(F.col("k")).alias("h"), rng.fnv(F.col("k"), "pre:").alias("p"), *[rng.keyed(42, F.col("k"), n).alias(f"u{n}") for n in (1, 2, 9)]).collect()
    for r in rows:
        assert r["h"] == rng.fnv_text(r["k"]) and r["p"] == rng.fnv_text("pre:" + r["k"])
        s = rng.Stream(42, r["k"])
        draws = [s.next() for _ in range(9)]
        assert (r["u1"], r["u2"], r["u9"]) == (draws[0], draws[1], draws[8])


def test_seed_zero_is_replaced(spark):
    k = "zero"
    assert rng.Stream(rng.fnv_text(k), k).state == rng.ZERO_SEED
    assert one(spark, rng.stream(rng.fnv_text(k), F.lit(k)).alias("s"))["s"] == rng.ZERO_SEED


def test_normal_moments_and_weighted_share(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    r = df.select(rng.normal(rng.stream(7, F.col("k")), 1, 2.0, 3.0).alias("z"), rng.weighted(rng.keyed(7, F.col("k"), 5), ["a", "b"], [9, 1]).alias("w")).agg(F.avg("z"), F.stddev("z"), F.avg((F.col("w") == "a").cast("int"))).first()
    assert abs(r[0] - 2) < 0.15 and abs(r[1] - 3) < 0.15 and 0.85 < r[2] < 0.95


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    f = lambda d: sorted(tuple(r) for r in d.select("k", rng.keyed(1, F.col("k")).alias("u")).collect())
    assert f(df.repartition(1)) == f(df.repartition(7))


def test_weighted_needs_a_total():
    with pytest.raises(ValueError):
        rng.weighted(F.lit(0.5), ["a"], [0.0])


def test_uuid5(spark):
    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    rows = spark.range(200).select("id", keys.entity_id(ns, "X", ["id"]).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.UUID(ns), f"X:{r['id']}")) for r in rows)


def test_keys(spark):
    r = one(spark, keys.norm(F.lit("AbC")).alias("a"), keys.norm(F.lit("")).alias("b"), keys.primary_key([F.lit("x"), F.lit("")]).alias("c"), keys.primary_key([F.lit("x"), F.lit("Y")]).alias("d"))
    assert (r["a"], r["b"], r["c"], r["d"]) == ("abc", None, None, "x|Y")


def test_lookup_parts(spark):
    df = spark.createDataFrame([("@lookup:A.b=c=d?x=1",), ("@lookup:plain",), ("other",), (None,)], "v string")
    assert [tuple(r) for r in df.select(*keys.lookup_parts("v")).collect()] == [("A", "b", "c=d"), (None, None, "plain"), (None, None, None), (None, None, None)]


@pytest.mark.parametrize(("d", "unit", "n", "want"), [("2024-01-31", "month", 1, "2024-02-29"), ("2026-09-30", "month", 1, "2026-10-31"), ("2024-01-30", "month", 1, "2024-02-29"), ("2024-02-29", "year", 1, "2025-02-28"), ("2023-02-28", "year", 1, "2024-02-28"), ("2024-03-01", "week", -1, "2024-02-23"), ("2024-12-31", "day", 1, "2025-01-01"), ("2024-03-31", "month", -1, "2024-02-29")])
def test_advance(spark, d, unit, n, want):
    from datetime import date

    from causaria.streaming.accumulate import advanced

    assert str(one(spark, dates.advance(F.lit(d).cast("date"), unit, n).alias("d"))["d"]) == want
    assert str(advanced(date.fromisoformat(d), unit, n)) == want


def test_windows(spark):
    r = one(spark, dates.in_cycle(F.lit(1), F.lit(1), F.lit(2)).alias("a"), dates.in_cycle(F.lit(2), F.lit(1), F.lit(2)).alias("b"), dates.within(F.lit("2020-01-01"), F.lit(None).cast("string"), F.lit("2020-01-01")).alias("c"))
    assert (r["a"], r["b"], r["c"]) == (False, True, True)


def test_cycle_field():
    from pyspark.sql.types import DateType, StringType, StructField, StructType

    s = lambda *n: StructType([StructField(x, StringType()) for x in n])
    assert dates.cycle_field(s("CreatedAt", "DOB", "OrderDate")) == "OrderDate"
    assert dates.cycle_field(s("Year", "OrderDate")) == "Year"
    assert dates.cycle_field(StructType([StructField("d", DateType())])) == "d"
    assert dates.cycle_field(s("Name")) is None
    with pytest.raises(ValueError):
        dates.cycle_field(s("Name"), "Gone")


def test_coercion(spark):
    df = spark.createDataFrame([("12.5",), ("",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(scalars.number("v", "string")).collect()] == [12.5, 0.0, 1.0, 0.0]


def test_pins(spark):
    p = lambda *a, **k: one(spark, scalars.pin(*a, **k).alias("x"))["x"]
    assert p("eq", F.lit(3), 3) and not p("eq", F.lit(None).cast("int"), 3) and p("ne", F.lit(2), 3)
    assert p("in", F.lit("a"), ["a", "b"]) and p("exists", F.lit(1)) and not p("gt", F.lit("9"), 5, numeric=False)
    assert p("withinCyclesOfAsOf", F.lit(-2), 2) and not p("lte", F.lit(3), 2)
    with pytest.raises(ValueError):
        scalars.pin("like", F.lit(1), 1)


def test_sigmoid_logit_rounding(spark):
    r = one(spark, scalars.sigmoid(F.lit(100.0)).alias("s"), scalars.logit(F.lit(0.0)).alias("l"), scalars.half_up(F.lit(-2.5)).alias("h"), scalars.half_up(F.lit(2.5)).alias("g"))
    assert r["s"] == 1 / (1 + math.exp(-40)) and (r["l"], r["h"], r["g"]) == (-40.0, -2, 3)


def test_timing_bounds(spark):
    df = spark.range(500).select(rng.stream(3, F.col("id").cast("string")).alias("s"))
    t = {"kind": "mixture", "parts": [{"weight": 1, "timing": {"kind": "const", "days": 3}}, {"weight": 1, "timing": {"kind": "lognormal", "median": 20, "sigma": 1.0, "min": 5, "cap": 60}}]}
    v = [r[0] for r in df.select(dates.timing(t, F.col("s"))).collect()]
    assert set(v) & {3.0} and all(x == 3 or 5 <= x <= 60 for x in v) and 0.4 < statistics.mean(x == 3 for x in v) < 0.6
    with pytest.raises(ValueError):
        dates.timing({"kind": "soon"}, F.lit(1))


def test_monogram(spark):
    import base64

    r = one(spark, scalars.monogram(F.lit("The Bank of Ely")).alias("m"))["m"]
    svg = base64.b64decode(r.split(",", 1)[1]).decode()
    assert ">BE<" in svg and len(r) < 1000
