from collections import Counter, defaultdict
from datetime import timedelta

import pytest

from pyspark.sql import functions as F

from causaria.operators import patterns
from causaria.queries import QUERIES, SQL
from tests.conftest import DATA
from tests.sqlcheck import both


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    mine, theirs = both(spark, f"{DATA}/sf0.001", QUERIES[name], SQL[name])
    assert mine == theirs and mine


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_plans_prune_and_push(spark):
    plan = QUERIES["path_match_inclusion"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_comment" not in plan
    plan = QUERIES["fk_closure"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint>" in plan and "Python" not in plan


def test_temporal_role_takes_all_events(spark):
    folder = f"{DATA}/sf0.001"
    events = spark.read.parquet(f"{folder}/events.parquet").selectExpr("event_id", "user_id", "event_type", "to_date(ts) AS day", "value").collect()
    days = defaultdict(list)
    for e in events:
        days[e["user_id"], e["event_type"]].append(e["day"])
    roles = [(u, kind, min(d), max(d) - timedelta(5)) for (u, kind), d in days.items()]
    want = {(e["event_id"], u) for e in events for u, kind, a, b in roles if kind == e["event_type"] and a <= e["day"] <= b}
    got = [tuple(r) for r in QUERIES["temporal_role_all"](spark, folder).select("event_id", "actor").collect()]
    assert sorted(got) == sorted(want)
    assert {e for e, _ in want} & {e["event_id"] for e in events if e["value"] <= 95}


def test_temporal_role_makes_no_pairs(spark, monkeypatch):
    def pairs(*_):
        raise AssertionError("pairs")

    monkeypatch.setattr(patterns, "temporal_role", pairs)
    assert QUERIES["temporal_role"](spark, f"{DATA}/sf0.001").count() > 0


def test_role_totals_equal_pairs(spark):
    """Windows of any length, open ones, some that overlap; keys of several days, where actors count once."""
    day = "date_add(DATE '2020-02-27', CAST(pmod(xxhash64(id, {}), {}) AS INT))"
    events = spark.range(400).selectExpr("id % 350 AS k", "if(id = 9, NULL, substr('xyzX', 1 + CAST(id % 4 AS INT), 1)) AS of", f"if(id = 7, NULL, {day.format(1, 700)}) AS d")
    roles = spark.range(300).selectExpr("id % 90 AS who", "substr('xyz', 1 + CAST(id % 3 AS INT), 1) AS of", f"if(id % 50 = 3, NULL, {day.format(2, 800)}) AS s", f"if(id % 60 = 4, NULL, {day.format(3, 800)}) AS e")
    figures = [f("actor") for f in (F.count_distinct, F.sum_distinct, F.min, F.max)]
    args = [F.col("d"), "of", roles, "of", "who", F.col("s"), F.col("e")]
    want = patterns.temporal_role(events, *args).groupBy("k").agg(*figures)
    got = patterns.role_totals(events, "k", *args)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 300
    assert patterns.role_totals(events.where("false"), "k", *args).count() == 0


def test_temporal_role_cuts_hot_spans(spark, monkeypatch):
    """Pairs equal a plain join over spans of every length, with spans cut into parts and blocks, rows repeated, and scopes, dates and actors that are null."""
    for name, rows in (("BLOCK", 3), ("GATHERED", 10), ("PART", 40)):
        monkeypatch.setattr(patterns, name, rows)
    day = "date_add(DATE '2019-12-30', CAST(pmod(xxhash64(id, {}), {}) AS INT))"
    for days in (1, 9, 1500):
        events = spark.range(300).selectExpr("id % 280 AS k", "if(id = 9, NULL, substr('xyzX', 1 + CAST(id % 4 AS INT), 1)) AS of", f"if(id = 7, NULL, {day.format(1, days)}) AS d")
        roles = spark.range(200).selectExpr("if(id % 40 = 1, NULL, id) AS who", "substr('xyz', 1 + CAST(id % 3 AS INT), 1) AS of", f"{day.format(2, days)} AS s", f"if(id % 60 = 4, NULL, {day.format(3, days)}) AS e")
        got = patterns.temporal_role(events, F.col("d"), "of", roles, "of", "who", F.col("s"), F.col("e"))
        events.createOrReplaceTempView("role_events"), roles.createOrReplaceTempView("role_windows")
        want = spark.sql("SELECT DISTINCT v.k, v.of, v.d, r.who AS actor FROM role_events v JOIN role_windows r ON lower(v.of) = r.of AND v.d >= r.s AND v.d <= coalesce(r.e, DATE '9999-12-31')")
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and want.count() > 1000


def test_temporal_role_is_written_in_little_room(spark, tmp_path):
    """As with large tables, which aren't broadcast. A span's pairs of many actors: blocks of them come again with each event, so that files hold far less than an actor's number a row."""
    events = spark.range(400).selectExpr("id AS k", "'x' AS of", "DATE '2024-01-01' AS d")
    roles = spark.range(20000).selectExpr("id * 7919 AS who", "'x' AS of", "DATE '2023-01-01' AS s", "DATE '2024-06-01' AS e")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = patterns.temporal_role(events, F.col("d"), "of", roles, "of", "who", F.col("s"), F.col("e")).select("k", "actor")
        out.write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 8_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 4_000_000
