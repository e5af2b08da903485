"""Gates name some of what fails them: examples in bounded groups, and fused gates equal to those one by one."""

import random

import pytest
from pyspark.sql import functions as F

from causaria.model import parse_domain
from causaria.operators import gates
from causaria.plans.validate import validate

FIELDS = ("name", "passed", "population_count", "expected", "actual")


def rows(df):
    return {r["name"]: r for r in df.collect()}


def plain(df):
    return {n: tuple(r[f] for f in FIELDS) for n, r in rows(df).items()}


def test_rolled_keeps_examples_of_any_number_of_offenders(spark):
    many = spark.range(200000).select(F.col("id").cast("string").alias("key"), F.lit(1).alias("n"), (F.col("id") % 2).cast("int").alias("bad"))
    r = gates.rolled(many, []).first()
    assert (r["n"], r["bad"]) == (200000, 100000) and len(set(r["examples"])) == 3 and all(int(k) % 2 for k in r["examples"])
    assert r["examples"] == sorted(r["examples"]) == gates.rolled(many.repartition(13), []).first()["examples"]
    few = gates.rolled(many.where("id < 4"), []).first()
    assert few["examples"] == ["1", "3"]
    none = gates.rolled(many.limit(0), []).first()
    assert (none["n"], none["bad"], none["examples"]) == (0, 0, [])
    blank = spark.createDataFrame([(None, 2, 2), ("x", 1, 0)], "key string, n int, bad int")
    assert tuple(gates.rolled(blank, []).first()) == (3, 2, [])


def test_fused_closures_equal_single_ones(spark):
    rng = random.Random(5)
    cell = lambda: rng.choice(["a", "B", "c", "", None, "zz", "@lookup:O.Name=a"])
    child = spark.createDataFrame([(i, cell(), cell(), rng.randrange(6)) for i in range(300)], "n int, x string, y string, z int")
    o = spark.createDataFrame([("A",), ("b",), (None,)], "ID string")
    w = spark.createDataFrame([(i,) for i in (0, 1, 2, 2)], "K long")
    keys = [("x", "x", o, "ID", True), ("y", "y", o, "ID", False), ("z", "z", w, "K", False), ("z as text", "z", o, "ID", False)]
    bare = lambda f: child.where(~F.coalesce(F.col(f).cast("string").startswith("@lookup:"), F.lit(False)))
    for some in (child, child.limit(0)):
        singles = gates.all_gates([gates.fk_closure(c, bare(f) if some is child else some, f, t, k, null) for c, f, t, k, null in keys])
        fused = gates.closure_gates(some, keys)
        assert plain(fused) == plain(singles)
    told = rows(gates.closure_gates(child, keys))
    assert told["x"]["message"].endswith("dangling, such as c, zz") and told["z"]["message"].endswith("such as 3, 4, 5")


def test_fused_schema_gates_equal_plain_ones(spark):
    df = spark.createDataFrame([("1", "aa", "ok"), ("1", "b", "😀😀"), ("", "b", "x"), (None, "", "toolong"), ("X", "c", None), ("x", "d", "yy")], "ID string, n string, t string")
    for some in (df, df.limit(0), df.where("ID = 'X'"), df.union(df)):
        assert plain(gates.schema_gates_with_examples("T", some, ["ID"], ["n"], {"t": 3})) == plain(gates.schema_gates("T", some, ["ID"], ["n"], {"t": 3}))
    told = {n: r["message"] for n, r in rows(gates.schema_gates_with_examples("T", df, ["ID"], ["n"], {"t": 3})).items()}
    assert told["T: primary key"] == "T: primary key: 2 missing, 2 duplicate, such as 1, x"
    assert told["T.n: unique"].endswith("such as b") and told["T.t: length"] == "T.t: length: 2, such as 1"


@pytest.fixture(scope="module")
def harbour():
    text = {"type": "string"}
    return parse_domain({
        "name": "harbour", "namespace": "0c8f7b1e-0d55-5c3e-9a41-6c1a0e1f7d10",
        "entities": {
            "Pier": {"businessKey": ["Name"], "fields": {"ID": {"type": "uuid", "isPrimaryKey": True}, "Name": {"type": "string", "unique": True}}},
            "Mooring": {"businessKey": ["ID"], "fields": {"ID": {"type": "uuid", "isPrimaryKey": True}, "PierID": text, "AltID": text, "Note": {"type": "string", "maxLength": 8}}, "foreignKeys": {"PierID": {"targetEntity": "Pier", "dependent": True}, "AltID": {"targetEntity": "Pier"}}},
        },
        "relationalRules": [{"kind": "path-match", "name": "berth", "source": "Mooring", "path": [{"field": "PierID", "entity": "Pier"}], "targetField": "Name", "sourceField": "Note"}],
    })


def test_every_failing_gate_names_three(spark, harbour):
    pier = spark.createDataFrame([(f"p{i}", f"N{i % 9}") for i in range(20)], "ID string, Name string")
    mooring = spark.createDataFrame([(f"m{i % 30}", f"p{i % 5}" if i < 30 else f"q{i}", f"r{i}", "@lookup:Pier.Name=none%d" % i) for i in range(40)], "ID string, PierID string, AltID string, Note string")
    failed = [r for r in validate(harbour, {"Pier": pier, "Mooring": mooring}).collect() if not r["passed"]]
    assert len(failed) >= 8
    assert all(r["message"].count(",") >= 3 and ", such as " in r["message"] for r in failed), [r["message"] for r in failed]


def test_lookups_read_what_they_name(spark, harbour):
    pier = spark.createDataFrame([("p1", "North")], "ID string, Name string")
    note = lambda t: {"Pier": pier, "Mooring": spark.createDataFrame([("m1", "p1", "p1", t)], "ID string, PierID string, AltID string, Note string")}
    verdict = lambda t: {r["name"]: r["passed"] for r in validate(harbour, note(t)).collect()}["Mooring: lookups"]
    assert verdict("@lookup:pier.NAME=north") and verdict("@lookup:North") and verdict("plain")
    assert not verdict("@lookup:Pier.ID=north") and not verdict("@lookup:Quay.Name=North") and not verdict("@lookup:South")
