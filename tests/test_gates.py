"""Every gate passes on a sound dataset and fails on its corrupted twin."""

import pytest
from pyspark.sql import functions as F

from causaria.operators import eras, features, gates, rules


def g(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.fixture(scope="module")
def org(spark):
    o = spark.createDataFrame([("A", "Acme"), ("b", "Bolt")], "ID string, Name string")
    p = spark.createDataFrame([("1", "a", "Active", 1.0), ("2", "B", "Active", 2.0), ("3", None, "Gone", 3.0)], "ID string, CompanyID string, Status string, Fee double")
    return o, p


def test_fk_closure_ignores_case_and_counts_blanks(spark, org):
    o, p = org
    assert g(gates.fk_closure("x", p, "CompanyID", o, "ID", nullable=True))["passed"]
    r = g(gates.fk_closure("x", p, "CompanyID", o, "ID"))
    assert not r["passed"] and r["population_count"] == 3 and r["actual"] == "1 dangling"
    bad = p.withColumn("CompanyID", F.when(F.col("ID") == "1", "nobody").otherwise(F.col("CompanyID")))
    assert not g(gates.fk_closure("x", bad, "CompanyID", o, "ID", nullable=True))["passed"]
    assert gates.dangling(bad, "CompanyID", o, "ID").count() == 1
    assert g(gates.fk_closure("x", p.limit(0), "CompanyID", o, "ID"))["population_count"] == 0


def test_schema_gates(spark):
    df = spark.createDataFrame([("1", "aa"), ("1", "b"), ("", "ccc")], "ID string, n string")
    rows = {r["name"]: r for r in gates.schema_gates("T", df, ["ID"], ["n"], {"n": 2}).collect()}
    assert rows["T: primary key"]["actual"] == "1 missing, 1 duplicate" and not rows["T: primary key"]["passed"]
    assert rows["T.n: unique"]["passed"] and not rows["T.n: length"]["passed"]
    wide = spark.createDataFrame([("1", "😀")], "ID string, n string")
    assert not gates.schema_gates("T", wide, ["ID"], [], {"n": 1}).where("name = 'T.n: length'").first()["passed"]  # two UTF-16 units


def test_coverage_and_composition(spark, org):
    o, p = org
    assert g(gates.dependent_coverage("x", o, "ID", p, "CompanyID"))["passed"]
    assert not g(gates.dependent_coverage("x", o, "ID", p.where("ID = '1'"), "CompanyID"))["passed"]
    assert not g(gates.collection("x", p, "CompanyID", o, "ID"))["passed"]
    assert g(gates.embed("x", p, "CompanyID", o, "ID"))["passed"]
    assert g(gates.is_a("x", o, "ID", o, "ID"))["passed"]


def test_stability(spark, org):
    _, p = org
    assert g(gates.corpus_stability("x", p, p, ["ID"]))["passed"]
    assert not g(gates.corpus_stability("x", p, p.where("ID > '1'"), ["ID"]))["passed"]
    assert g(gates.corpus_stability("x", None, p, ["ID"]))["passed"]
    assert not g(gates.corpus_stability("x", None, p, ["ID"], "unreadable"))["passed"]


def test_lookups(spark, org):
    o, _ = org
    u = o.select(F.lit("Org").alias("entity"), F.lit("Name").alias("field"), F.col("Name").alias("value"))
    df = spark.createDataFrame([("@lookup:Org.Name=ACME",), ("@lookup:bolt?create",), ("plain",)], "v string")
    assert g(gates.lookups("x", df, ["v"], u))["passed"]
    assert not g(gates.lookups("x", spark.createDataFrame([("@lookup:Org.Name=Gone",)], "v string"), ["v"], u))["passed"]


def test_factor_gate_bounds(spark, org):
    _, p = org
    f = lambda t, tol: g(gates.factor_gates(p, [("a", (F.col("Status") == "Active").cast("int"), t, tol)]))["passed"]
    assert f(2 / 3, 0.0) and not f(0.9, 0.1)
    assert not g(gates.factor_gates(p.limit(0), [("a", F.lit(1), 1.0, 1.0)]))["passed"]


def test_identity(spark):
    df = spark.createDataFrame([("Eve", "Female", "Mrs.", "2000-01-01", "2018-01-01")], "n string, g string, t string, b string, i string")
    cat = spark.createDataFrame([("eve", "Female"), ("sam", "Unisex")], "name string, gender string")
    assert g(gates.name_gender("x", df, "n", "g", cat))["passed"]
    assert not g(gates.name_gender("x", df.withColumn("g", F.lit("Male")), "n", "g", cat))["passed"]
    assert g(gates.words_of_gender("x", df, "t", F.col("g"), gates.TITLES))["passed"]
    assert not g(gates.words_of_gender("x", df, "t", F.lit("Male"), gates.TITLES))["passed"]
    assert g(gates.min_age("x", df, F.to_date("b"), F.to_date("i")))["passed"]
    assert not g(gates.min_age("x", df, F.to_date("b"), F.lit("2017-01-01").cast("date")))["passed"]
    assert not g(gates.min_age("x", df.limit(0), F.to_date("b"), F.to_date("i")))["passed"]


def test_path_match(spark, org):
    o, p = org
    hops = [("CompanyID", o, "ID")]
    src = p.where("CompanyID IS NOT NULL")
    assert g(rules.gate_of("x", rules.path_match(src, hops, "Name")))["passed"]
    assert not g(rules.gate_of("x", rules.path_match(p, hops, "Name")))["passed"]
    pool = spark.createDataFrame([("1", "Acme"), ("2", "bolt")], "ID string, Name string")
    assert g(rules.gate_of("x", rules.path_match(src, hops, "Name", None, pool, ("ID", "Name"))))["passed"]
    assert not g(rules.gate_of("x", rules.path_match(src, hops, "Name", None, pool.where("ID = '1'"), ("ID", "Name"))))["passed"]


def test_date_window(spark):
    a = spark.createDataFrame([(1, "k", "2024-01-05"), (2, "K", "2024-03-01"), (3, "none", "2024-01-01"), (4, "k", None)], "id int, m string, d string")
    w = spark.createDataFrame([("k", "2024-01-01", "2024-01-05"), ("k", "2024-02-01", None)], "m string, s string, e string")
    d = lambda c: F.to_date(c)
    v = lambda **k: {r["id"]: r["violated"] for r in rules.date_window(a, d("d"), "m", w, "m", d("s"), d("e"), **k).collect()}
    assert v() == {1: False, 2: False, 3: False, 4: False} and v(require=True)[3]
    late = a.withColumn("d", F.lit("2024-01-20"))
    assert rules.date_window(late, d("d"), "m", w, "m", d("s"), d("e")).where("violated").count() == 3


def test_text_contains(spark):
    s = spark.createDataFrame([(1, "Minutes of May: Budget, Hiring"), (2, "Minutes")], "id int, t string")
    c = spark.createDataFrame([(1, "budget"), (1, "HIRING"), (2, "gone")], "id int, title string")
    assert [r["violated"] for r in rules.text_contains(s, "t", [F.lit("minutes")], c, "id", "id", "title").orderBy("id").collect()] == [False, True]


@pytest.mark.parametrize(("votes", "rule", "want"), [("YYN", {}, "Passed"), ("YN", {}, "Failed"), ("YN", {"tie": "Tied"}, "Tied"), ("YYN", {"rule": "two-thirds"}, "Passed"), ("YNN", {"rule": "two-thirds"}, "Failed"), ("YY", {"rule": "unanimous"}, "Passed"), ("YYN", {"rule": "unanimous"}, "Failed"), ("Y", {"quorum": 2}, "Failed"), ("YA", {"quorum": 2}, "Failed"), ("YA", {"quorum": 2, "count_abstain": True}, "Passed"), ("", {}, "Failed")])
def test_tally(spark, votes, rule, want):
    names = {"Y": "Yes", "N": "No", "A": "Abstain"}
    b = spark.createDataFrame([("d", names[v]) for v in votes] or [("other", "Yes")], "d string, v string")
    dec = spark.createDataFrame([("D", want)], "ID string, o string")
    assert g(rules.gate_of("x", rules.ballots_outcome(dec, "ID", "o", b, "d", "v", **rule)))["passed"]
    wrong = dec.withColumn("o", F.lit("Unknown"))
    assert not g(rules.gate_of("x", rules.ballots_outcome(wrong, "ID", "o", b, "d", "v", **rule)))["passed"]


def test_unknown_ballot_label_fails(spark):
    b = spark.createDataFrame([("d", "Yes"), ("d", "Perhaps")], "d string, v string")
    assert not g(rules.gate_of("x", rules.ballots_outcome(spark.createDataFrame([("d", "Passed")], "ID string, o string"), "ID", "o", b, "d", "v")))["passed"]


def _years(spark, counts, scoped=None):
    rows = [(y, k < (scoped or {}).get(y, 0)) for y, n in counts.items() for k in range(n)]
    df = spark.createDataFrame(rows, "y int, s boolean")
    return eras.by_year(df, F.col("y"), F.col("s"), F.col("s").cast("int"))


def test_era_volume(spark):
    assert g(eras.volume("x", _years(spark, {2019: 10, 2020: 5}), 2020, 0.5, [2020]))["passed"]
    assert not g(eras.volume("x", _years(spark, {2019: 10, 2020: 10}), 2020, 0.5, [2020]))["passed"]
    assert g(eras.volume("x", _years(spark, {2019: 10}), 2020, 0.0, [2020]))["passed"]
    assert not g(eras.volume("x", _years(spark, {2019: 10, 2020: 1}), 2020, 0.0, [2020]))["passed"]
    assert g(eras.volume("x", _years(spark, {2020: 5, 2021: 10}), 2020, 0.5, [2020]))["passed"]  # no earlier year: all others
    assert eras.retention([(2020, 0.0)], 2020) == 0.5 and eras.retention([(2020, 0.0)] * 2, 2020) == 0.0


def test_era_scoped_and_shift(spark):
    assert g(eras.scoped_volume("x", _years(spark, {2019: 20, 2020: 15}, {2019: 10, 2020: 5}), 2020, 0.5, [2020]))["passed"]
    assert not g(eras.scoped_volume("x", _years(spark, {2019: 20, 2020: 20}, {2019: 10, 2020: 10}), 2020, 0.5, [2020]))["passed"]
    y = _years(spark, {2019: 20, 2020: 20}, {2019: 10, 2020: 5})
    assert g(eras.factor_shift("x", y, 2020, -0.5, [2020]))["passed"] and not g(eras.factor_shift("x", y, 2020, 0.5, [2020]))["passed"]


def test_children_features(spark, org):
    o, p = org
    q = {"n": {"aggregation": "count"}, "any": {"aggregation": "exists", "where": {"Status": "Gone"}}, "sum": {"aggregation": "sum", "field": "Fee"}}
    rows = {r["ID"]: r for r in features.children(o, p, "ID", "CompanyID", q).collect()}
    assert rows["A"]["n"] == 1 and rows["b"]["sum"] == 2.0 and not rows["A"]["any"]
    twice = spark.createDataFrame([("c", "a", "A")], "ID string, x string, y string")
    assert features.children(o, twice, "ID", ["x", "y"], {"n": {"aggregation": "count"}}).where("ID = 'A'").first()["n"] == 1
    empty = features.children(o, p.limit(0), "ID", "CompanyID", q, raw=True).first()
    assert empty["n"] == 0 and empty["sum"] is None
    with pytest.raises(ValueError):
        features.children(o, p, "ID", "CompanyID", {"x": {"aggregation": "median"}})


def test_paths_and_fall_through(spark, org):
    o, p = org
    got = {r["ID"]: r["v"] for r in features.compile_feature({"from": "path", "path": ["CompanyID:Org", "Name"]}, p, {"Org": o}, "ID", "v").collect()}
    assert got == {"1": 1.0, "2": 1.0, "3": 0.0}
    scoped = features.fall_through(p, {"Name": "ACME", "Status": "active"}, [("CompanyID", o, "ID")])
    assert {r["ID"] for r in scoped.where("__scoped").collect()} == {"1"}


def test_static_assignment_raises(spark):
    with pytest.raises(Exception, match="no rule fits"):
        spark.range(1).select(features.static_assignment([(F.col("id") > 5, "big")])).collect()


def test_template(spark):
    from causaria.functions import rng

    df = spark.createDataFrame([(1, "Ann"), (2, None)], "id int, name string")
    t = features.template({"hi": {"fmt": "Hi {name}!"}, "k": {"const": 3}, "p": {"pick": ["a", "b"]}}, rng.stream(1, F.col("id").cast("string")))
    assert [r["hi"] for r in df.select("id", *t).orderBy("id").collect()] == ["Hi Ann!", "Hi !"]
    with pytest.raises(Exception, match="is null"):
        df.select(*features.template({"n": {"from": "name"}}, F.lit(1).cast("long"))).collect()
