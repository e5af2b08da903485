"""Capacities by a scan over stretches, against the kernel that takes rows one by one."""

import random
import time

import pytest
from pyspark.sql import functions as F

from causaria.model import Ladder, State
from causaria.operators.compose import ordinal
from causaria.streaming import ladders

SCHEMA = "key string, ladder string, state string, tenure int, enter_cycle int, born int, dials map<string,double>"


def drawn(rng):
    names = [f"s{i}" for i in range(rng.randint(2, 5))]
    states = tuple(
        State(
            n,
            rng.randint(1, 3),
            rng.choice([None, rng.randint(0, 12), rng.randint(5, 30)]),
            (names[i - 1],) if i and rng.random() < 0.5 else (),
            rng.choice([None, 1, 2]),
            {"z": (rng.choice([None, -0.3]), rng.choice([None, 0.9]))} if rng.random() < 0.5 else {},
            {"z": 0.25} if rng.random() < 0.4 else {},
            {"z": -0.125, "y": 1.0} if rng.random() < 0.4 else {},
        )
        for i, n in enumerate(names)
    )
    return Ladder("l", "E", states)


def test_steps_equal_the_kernel(spark, monkeypatch):
    monkeypatch.setattr(ladders, "SCANNED", 17)
    for seed in range(6):
        rng = random.Random(seed)
        lad = drawn(rng)
        rows = [{"key": f"k{i:03}", "ladder": "l", "state": rng.choice(lad.states).name, "tenure": rng.randrange(3), "enter_cycle": 0, "born": rng.randrange(4), "dials": {"z": rng.choice([-0.5, 0.0, 0.5, 1.0])} if rng.random() < 0.8 else {}} for i in range(120)]
        counts = {s.name: sum(r["state"] == s.name for r in rows) for s in lad.states}
        want = {r["key"]: r for r in ladders.kernel(lad, 5, 1, counts)(sorted(rows, key=lambda r: (r["born"], r["key"])))}
        df = spark.createDataFrame([tuple(r[k] for k in ("key", "ladder", "state", "tenure", "enter_cycle", "born", "dials")) for r in rows], SCHEMA)
        got = {r["key"]: r.asDict() for r in ladders.step(df.repartition(5), lad, 5).collect()}
        assert got == want, seed
        assert any(r["state"] != r["from_state"] for r in want.values())


def test_stretches_compose():
    rng = random.Random(3)
    for _ in range(300):
        cap = rng.randint(0, 6)
        x, events = rng.randint(0, cap), [rng.random() < 0.6 for _ in range(rng.randrange(30))]
        a, c = ladders.summary(events, cap)
        y = x
        for arrives, ok in zip(events, ladders.fills(events, x, cap)):
            y += (1 if arrives else -1) if ok else 0
        assert y == min(x + a, c)


def test_a_place_freed_goes_to_the_next_in_order(spark):
    lad = Ladder("l", "E", (State("wait", 1), State("in", 1, 1), State("out", 9)))
    rows = [("a", "wait", 0), ("b", "in", 1), ("c", "wait", 2), ("d", "wait", 3)]
    df = spark.createDataFrame([(k, "l", s, 3, 0, born, {}) for k, s, born in rows], SCHEMA)
    assert {r["key"]: r["state"] for r in ladders.step(df, lad, 1).collect()} == {"a": "wait", "b": "out", "c": "in", "d": "wait"}


def test_many_entities_in_parallel(spark):
    n = 300_000
    lad = Ladder("l", "E", (State("wait", 1), State("in", 1, n // 4), State("out", 1)))
    state = F.when(F.col("id") % 3 == 0, "in").otherwise("wait")
    df = spark.range(n).select(F.lpad(F.col("id").cast("string"), 7, "0").alias("key"), F.lit("l").alias("ladder"), state.alias("state"), F.lit(2).alias("tenure"), F.lit(0).alias("enter_cycle"), F.lit(1).alias("born"), F.create_map().cast("map<string,double>").alias("dials"))
    began = time.perf_counter()
    got = {r["state"]: r["count"] for r in ladders.step(df, lad, 1).groupBy("state").count().collect()}
    # a third leaves, one by one among twice as many that wait: the quarter's room is filled with what the order allows.
    occupied, moved = n // 3, 0
    for i in range(n):
        if i % 3 == 0:
            occupied -= 1
        elif occupied < n // 4:
            occupied += 1
            moved += 1
    assert got == {"wait": n - n // 3 - moved, "in": moved, "out": n // 3} and time.perf_counter() - began < 120


def test_ordinal_cuts_the_whole_order(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(60_000).select(F.lit("2024-01-01").alias("day"), F.xxhash64("id").alias("h"), "id")
    seen = ordinal(df.repartition(7), ["day", "h", "id"], "n")
    rows = [r[0] for r in seen.orderBy("h", "id").select("n").collect()]
    assert rows == list(range(1, 60_001))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per_file = sorted(r["count"] for r in seen.groupBy(F.input_file_name()).count().collect())
    assert len(per_file) > 1 and per_file[-1] <= 5 * per_file[len(per_file) // 2]
    nulls = spark.createDataFrame([(None, 2), ("b", 1), ("a", 3), (None, 1)], "k string, i int")
    assert [(r["k"], r["i"]) for r in ordinal(nulls, ["k", "i"], "n").orderBy("n").collect()] == [(None, 1), (None, 2), ("a", 3), ("b", 1)]


@pytest.mark.parametrize("rows", [[]])
def test_nobody_on_the_ladder(spark, rows):
    lad = Ladder("l", "E", (State("wait", 1), State("in", 1, 1)))
    assert ladders.step(spark.createDataFrame(rows, SCHEMA), lad, 1).collect() == []
