"""Ordering, deltas, composition, reversal, calibration, patterns, simulation, plans, projects, cycles."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from causaria.model import Arrow, Dial, Era, Factor, Hero, Ladder, ModelError, Motif, State, parse_domain
from causaria.operators import calibrate, compose, delta, generate, patterns, reversal
from causaria.plans import graph, plan
from causaria.plans.validate import summary, validate
from causaria.sources import project, records, state
from causaria.streaming import accumulate, ladders, simulate

NS = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
DOMAIN = {
    "name": "shop",
    "namespace": NS,
    "entities": {
        "Org": {"businessKey": ["Name"], "fields": {"ID": {"type": "uuid", "isPrimaryKey": True}, "Name": {}}, "composition": {"collections": [{"entity": "Person", "field": "OrgID"}]}},
        "Person": {"businessKey": ["Email"], "fields": {"ID": {"type": "uuid", "isPrimaryKey": True}, "Email": {}, "Status": {"values": ["Active", "Gone"], "weights": [8, 2]}, "OrgID": {"type": "uuid"}}, "foreignKeys": {"OrgID": {"targetEntity": "Org", "dependent": True}}},
        "Member": {"fields": {"ID": {"type": "uuid", "isPrimaryKey": True}, "Level": {"type": "number", "nullable": True}}, "businessKey": ["Level"]},
    },
}
DOMAIN["entities"]["Person"]["composition"] = {"isA": {"entity": "Member"}}


def test_graph():
    n = graph.Node
    assert [x.name for x in graph.resolve([n("b", ("x",), ("y",)), n("a", (), ("x",))])] == ["a", "b"]
    for bad in ([n("a", (), ("x",)), n("b", (), ("x",))], [n("a", ("x",))], [n("a", ("x",), ("x",))], [n("a", ("y",), ("x",)), n("b", ("x",), ("y",))]):
        with pytest.raises(graph.GraphError):
            graph.resolve(bad)
    d = parse_domain(DOMAIN)
    assert graph.entity_order(d).index("Org") < graph.entity_order(d).index("Person") < graph.entity_order(d).index("Member")
    assert graph.directories(d) == ["Org"] and graph.lineage(d, "Member") == ["Member", "Person"]
    assert graph.ancestors(d, "Person") == {"Org"} and graph.insert_directory(["Org", "Zed"], d, "Person") == ["Org", "Person", "Zed"]
    assert graph.common_scope(d, "Person", "Org") == ("Org", ["OrgID"], [])


def test_model_tells_all_problems():
    with pytest.raises(ModelError) as e:
        parse_domain({"name": "x", "namespace": NS, "entities": {"A": {"fields": {"f": {"type": "money"}, "g": {"values": [1], "weights": [1, 2]}}, "businessKey": ["h"]}}})
    assert len(e.value.problems) == 3


def test_delta(spark):
    a = spark.createDataFrame([("1", "x", 1), ("2", "x", 2), ("3", None, 3)], "ID string, s string, n int")
    b = spark.createDataFrame([("1", "x", 1), ("2", "y", 2), ("4", "x", 4)], "ID string, s string, n int")
    d = delta.state_delta(a, b, ["ID"])
    assert {(r["id"], r["change"], tuple(r["changed"])) for r in d.collect()} == {("2", "changed", ("s",)), ("3", "deleted", ()), ("4", "new", ())}
    assert [tuple(r) for r in delta.status_transitions(d, "T", "s", 3).collect()] == [("T", "2", "x", "y", 3)]
    with pytest.raises(Exception, match="immutable row"):
        delta.state_delta(a, b, ["ID"], immutable=True).collect()
    assert [r["id"] for r in delta.removed(a, b, ["ID"]).collect()] == ["3"]
    assert delta.reused_ids({"A": a, "B": b}, set()).count() == 2 and delta.reused_ids({"A": a, "B": b}, {("A", "B")}).count() == 0


def test_compose_round_trip(spark):
    d = parse_domain(DOMAIN)
    data = {"Org": spark.createDataFrame([("o1", "A"), ("o2", "B")], "ID string, Name string"), "Person": spark.createDataFrame([("p1", "e1", "Active", "o1"), ("p2", "e2", "Gone", "O1")], "ID string, Email string, Status string, OrgID string"), "Member": spark.createDataFrame([("p1", 3.0)], "ID string, Level double")}
    nested = records.nested(d, data)
    assert set(nested) == {"Org"} and nested["Org"].where("ID = 'o1'").select(F.size("Person")).first()[0] == 2
    flat = records.flat(d, nested)
    assert flat["Person"].count() == 2 and flat["Member"].collect()[0]["Level"] == 3.0 and flat["Org"].count() == 2
    assert compose.orphans(data["Person"].withColumn("OrgID", F.lit("zz")), "OrgID", data["Org"], "ID").count() == 2
    assert compose.overlapping_extensions({"a": (data["Org"], "ID"), "b": (data["Org"].limit(1), "ID")}).count() == 1


def test_write_append_read(spark, tmp_path):
    d = parse_domain(DOMAIN)
    data = {"Org": spark.createDataFrame([("o1", "A")], "ID string, Name string"), "Person": spark.createDataFrame([("p1", "e", "Active", "o1")], "ID string, Email string, Status string, OrgID string")}
    assert records.write(d, data, str(tmp_path)) == ["Org", "Person"]
    before = {p.name: p.read_bytes() for p in (tmp_path / "Person").glob("*.parquet")}
    records.append(d, str(tmp_path), {"Person": data["Person"].withColumn("ID", F.lit("p2"))}, data)
    assert spark.read.parquet(f"{tmp_path}/Person").count() == 2 and all((tmp_path / "Person" / n).read_bytes() == b for n, b in before.items())
    with pytest.raises(ValueError, match="without a parent"):
        records.append(d, str(tmp_path), {"Person": data["Person"].withColumn("OrgID", F.lit("zz"))}, data)
    records.write(d, data, str(tmp_path / "json"), json=True)
    got = records.read_wrapped(spark, str(tmp_path / "json" / "Org"), data["Org"].schema, ["ID"], "Org")
    assert json.loads((tmp_path / "json" / "_order.json").read_text()) == {"directoryOrder": ["Org"]}
    assert got.collect() == data["Org"].collect()


def test_wrapped_records(spark, tmp_path, monkeypatch):
    df = spark.range(25).select(F.format_string("k%02d", "id").alias("ID"), F.when(F.col("id") % 5 > 0, F.format_string('say "%d"\nand [go]', "id")).alias("Name"), F.col("id").cast("double").alias("n"))
    monkeypatch.setattr(records, "PART_ROWS", 10)
    path = str(tmp_path / "Org")
    records.write_wrapped(df, path, "Org", ["ID"])
    texts = [p.read_text() for p in (tmp_path / "Org").glob("part-*")]
    assert sorted(len(json.loads(t)) for t in texts) == [5, 10, 10]
    read = lambda at, **k: sorted(map(tuple, records.read_wrapped(spark, str(at), df.schema, ["ID"], **k).collect()))
    assert read(path, entity="Org") == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError, match="holds 'Org', not 'Person'"):
        read(path, entity="Person")
    with pytest.raises(ValueError, match="missing"):
        read(tmp_path / "none", entity="Org")
    row = lambda k: {"primaryKey": {"ID": k}, "fields": {"Name": "x", "n": 1.0}}
    kinds = {"lines": "\n".join(json.dumps(row(f"l{i}")) for i in range(3)) + "\n", "pretty": json.dumps([row("p0"), row("p1")], indent=2), "empty": "", "none": "[]\n"}
    (tmp_path / "mixed").mkdir()
    for name, text in kinds.items():
        (tmp_path / "mixed" / f"{name}.json").write_text(text)
    assert [r[0] for r in read(tmp_path / "mixed")] == ["l0", "l1", "l2", "p0", "p1"]
    for broken in ('[{"primaryKey": {"ID": "a"}, "fields": {"Na', '[{"primaryKey": {"ID": "a"}}]', '[{"fields": {"Name": "x"}}]', "no json"):
        (tmp_path / "bad").mkdir(exist_ok=True)
        (tmp_path / "bad" / "x.json").write_text(broken)
        with pytest.raises(Exception):
            read(tmp_path / "bad")
    records.write_wrapped(df.limit(0), str(tmp_path / "no"), "Org", ["ID"])
    assert read(tmp_path / "no", entity="Org") == []


def test_a_swap_cut_short_loses_nothing(spark, tmp_path):
    live = str(tmp_path / "t")
    spark.range(3).write.parquet(live)
    (tmp_path / "t").rename(tmp_path / "t.old")
    records.replaced(spark, live, spark.range(4))
    assert spark.read.parquet(live).count() == 4 and not (tmp_path / "t.old").exists()


def test_ordinal_and_parts(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    rows = compose.ordinal(df, ["k"], "n").collect()
    assert all(r["n"] == r["k"] + 1 for r in rows)
    text = df.select(F.format_string("%04d", "k").alias("t")).union(spark.createDataFrame([(None,)], "t string"))
    assert {r["t"]: r["n"] for r in compose.ordinal(text, ["t"], "n").collect()} == {None: 1, **{f"{k:04d}": k + 2 for k in range(1000)}}
    parts = compose.parts(df, ["k"], 100, 2, 50).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {2: 50, **dict.fromkeys(range(3, 12), 100), 12: 50}


def test_reversal(spark):
    c = spark.createDataFrame([(10, "u", date(2024, 3, 1), 1, 1), (11, "u", date(2024, 3, 2), 1, None), (12, "w", date(2024, 3, 3), 2, None), (13, "u", date(2024, 3, 4), 1, 1)], "id int, customer string, day date, lines int, link int")
    s = spark.createDataFrame([(1, "u", date(2024, 1, 1), 1), (2, "u", date(2024, 1, 2), 1), (3, "v", date(2024, 1, 3), 9), (4, "u", date(2024, 1, 4), 1)], "id int, customer string, day date, lines int")
    m = {r["cancel_id"]: (r["sale_id"], r["phase"]) for r in reversal.match(c, s).collect()}
    assert m == {10: (1, 1), 11: (2, 2), 13: (4, 2), 12: (3, 3)}
    lines = spark.createDataFrame([(1, 1, 2.0, 150.0)], "o int, n int, quantity double, amount double")
    t = reversal.totals(reversal.mirror(spark.createDataFrame([(10, 1, 1)], "cancel_id int, sale_id int, phase int"), lines, "o", "n", ["quantity", "amount"]), ["quantity", "amount"]).first()
    assert (t["quantity"], t["amount"]) == (-2.0, -150.0)
    heads = c.where("id = 10")
    sl = lines.select(F.col("o").alias("order"), F.col("n").alias("line"), "quantity", "amount")
    cl = sl.select(F.lit(10).alias("order"), "line", -F.col("quantity").alias("q"), -F.col("amount").alias("a")).toDF("order", "line", "quantity", "amount")
    assert reversal.coherence("x", heads, s, cl, sl).first()["passed"]
    assert not reversal.coherence("x", heads, s, sl.withColumn("order", F.lit(10)), sl).first()["passed"]
    assert not reversal.coherence("x", heads.limit(0), s, cl, sl).first()["passed"]


def test_calibration_and_beta(spark):
    df = simulate.with_dials(spark.range(500), "id", [Dial("t", 0.0, 1.2)], 3)
    b = calibrate.intercepts(df, {"a": (F.col("t"), 0.87, None)})["a"]
    from causaria.functions.scalars import sigmoid

    assert abs(df.agg(F.avg(sigmoid(F.col("t") + F.lit(b)))).first()[0] - 0.87) < 1e-4
    assert calibrate.intercepts(df, {"a": (F.col("t"), 0.0, None), "b": (F.col("t"), 1.0, None)}) == {"a": -40.0, "b": 40.0}
    with pytest.raises(calibrate.CalibrationError):
        calibrate.intercepts(df, {"a": (F.col("t"), 1.5, None)})


def test_dials_correlate(spark):
    df = simulate.with_dials(spark.range(2000), "id", [Dial("a", 1.0, 2.0), Dial("b", 0.0, 1.0, 0.0, {"a": 0.6})], 5)
    r = df.agg(F.corr("a", "b"), F.avg("a"), F.stddev("a")).first()
    assert 0.55 <= r[0] <= 0.65 and abs(r[1] - 1) < 0.15 and abs(r[2] - 2) < 0.15


def test_patterns(spark):
    p = spark.range(3000).select("id", F.lit(0.0).alias("s"))
    out = patterns.child_outcome(p, "id", F.col("s"), 0.8, 1, "x")
    assert abs(out.agg(F.avg(F.col("outcome").cast("int"))).first()[0] - 0.8) < 0.03
    years = patterns.annual_participation(p, "id", [1, 2], lambda y: F.col("id") < (3 if y == 1 else 3000), F.col("s"), 0.5, 1, "y")
    assert {r["year"] for r in years.select("year").distinct().collect()} == {2}
    rec = patterns.recurring_decision(p.limit(50), "id", [1, 2], F.col("s"), 0.5, 1, "z", F.when(F.col("id") == 0, True))
    assert rec.where("id = 0 AND NOT decision").count() == 0 and rec.count() == 100
    e = patterns.nested_events(p.limit(1), "id", F.lit(3), F.lit("2024-01-01").cast("date"), F.lit("2024-01-11").cast("date"))
    assert [str(r["event_date"]) for r in e.orderBy("place").collect()] == ["2024-01-01", "2024-01-06", "2024-01-11"]


PEOPLE = 5000


@pytest.fixture(scope="module")
def world(spark):
    dials = [Dial("t", 0.0, 1.0)]
    people = simulate.with_dials(spark.range(PEOPLE).select(F.col("id").cast("string").alias("id")), "id", dials, 9).withColumns({"birth_cycle": F.lit(1), "hero": F.lit(None).cast("string"), "motif": F.lit(None).cast("string")})
    return simulate.World(people, "id", [Factor("renew", "P", 0.8, 0.02, {"where": {"Status": "Active"}}, (Arrow(0.5, "t"),))], 42, dials)


def test_unroll_rate_and_beta(spark, world):
    out = simulate.unroll(world, [1])
    assert abs(out.agg(F.avg(F.col("outcome").cast("int"))).first()[0] - 0.8) <= 0.02
    joined = out.join(world.population, F.col("key") == F.col("id"))
    assert abs(joined.agg(calibrate.recovered_beta(joined, F.col("t"), F.col("outcome").cast("int"))).first()[0] - 0.5) <= 0.15


def test_hero_does_not_interfere(spark, world):
    from dataclasses import replace

    base = simulate.unroll(world, [1, 2])
    hero = spark.createDataFrame([("hero", -3.0, 1, "star", None)], "id string, t double, birth_cycle int, hero string, motif string")
    w = replace(world, population=world.population.unionByName(hero), heroes=[Hero("star", "P", {}, pins=(("outcome", 2, "renew", "eq", True),))])
    more = simulate.unroll(w, [1, 2])
    assert more.where("key = 'hero' AND cycle = 2").first()["outcome"]
    a, b = base.select("cycle", "key", "outcome"), more.where("key <> 'hero'").select("cycle", "key", "outcome")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_era_shift_and_write_back(spark, world):
    from dataclasses import replace

    out = simulate.snapshot(simulate.unroll(replace(world, eras=[Era((2,), factors={"renew": -1.0})]), [1, 2])).collect()
    rate = {r["cycle"]: r["positives"] / r["population"] for r in out}
    assert rate[2] < rate[1] - 0.1
    rows = world.population.select("id").limit(20).withColumn("Status", F.lit("?"))
    done = simulate.written_back(rows, "id", simulate.unroll(world, [1]), world.factors[0], ["Active", "Gone"])
    assert {r["Status"] for r in done.collect()} <= {"Active", "Gone"}
    with pytest.raises(ValueError):
        simulate.written_back(rows, "id", simulate.unroll(world, [1]), world.factors[0])


def test_motifs(spark, world):
    m = [Motif("a", "P", 100, dials={"t": (0.0, None)}), Motif("b", "P", 0.01, "percentage", "ceil", children={"C": (1, 3)})]
    out = simulate.sample_motifs(world.population, "id", m, 1)
    assert out.where("motif = 'a'").count() == 100 and out.where("motif = 'a' AND t < 0").count() == 0
    assert out.where("motif = 'b'").count() == 49  # of those still free
    kids = simulate.motif_children(out, "id", m[1], "C", [1, 2], 1, {2: 0.0})
    assert {r["cycle"] for r in kids.select("cycle").distinct().collect()} == {1}
    assert simulate.inject(world.population, [{"id": "h", "hero": "h"}]).count() == PEOPLE + 1


def test_large_quotas_take_the_same_rows(spark, monkeypatch):
    df = spark.range(700)
    a = {r["id"] for r in simulate.quota_sample(df, "id", 123, 4, "q").collect()}
    monkeypatch.setattr(simulate, "TOP_K", 5)
    assert {r["id"] for r in simulate.quota_sample(df, "id", 123, 4, "q").collect()} == a and len(a) == 123


def test_ladder_kernel(spark):
    lad = Ladder("l", "P", (State("Trial", 2, exit_effects={"t": -1.0}), State("Active", 3, capacity=1), State("Gone", 1)))
    rows = [{"key": str(k), "ladder": "l", "state": "Trial", "tenure": 1, "enter_cycle": 0, "born": 0, "dials": {"t": 0.0}} for k in range(3)]
    out = list(ladders.kernel(lad, 1, 1, {"Trial": 3})(rows))
    assert [r["state"] for r in out] == ["Active", "Trial", "Trial"] and out[0]["dials"]["t"] == -1.0
    assert ladders.allowed(State("x", 1, prior=("Trial",), dials={"q": (0, None)}), "Trial", 0, 1, {}) is False
    df = spark.createDataFrame(rows, "key string, ladder string, state string, tenure int, enter_cycle int, born int, dials map<string,double>")
    assert {r["key"]: r["state"] for r in ladders.step(df, lad, 1).collect()} == {"0": "Active", "1": "Trial", "2": "Trial"}
    bound = ladders.bind(spark.createDataFrame([("0", "?"), ("9", "?")], "ID string, Status string"), "ID", df, lad, "Status")
    assert {r["ID"]: r["Status"] for r in bound.collect()} == {"0": "Trial", "9": "?"}
    forced = ladders.force(df.drop("dials"), spark.createDataFrame([("0",), ("7",)], "k string"), "l", "Gone", 4)
    assert {r["key"] for r in forced.where("state = 'Gone'").collect()} == {"0", "7"} and forced.count() == 4
    enrolled = ladders.enrol(spark.range(100), "id", Ladder("h", "P", lad.states, 0.5), 0, 1)
    assert enrolled.count() == 50


def test_closed_form_equals_the_kernel(spark):
    lad = Ladder("l", "P", (State("A", 2), State("B", 3)))
    row = {"key": "k", "ladder": "l", "state": "A", "tenure": 0, "enter_cycle": 0, "born": 0, "dials": {}}
    for c in range(1, 5):
        row = next(iter(ladders.kernel(lad, c)([row])))
        want = spark.range(1).select(ladders.closed_form(lad, F.lit(c))).first()[0]
        assert row["state"] == want


def test_streaming_ladder(spark, tmp_path):
    lad = Ladder("l", "P", (State("A", 2), State("B", 3)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = tmp_path / "in"
    spark.createDataFrame([("k", 0), ("k", 3), ("m", 5)], "key string, cycle int").write.parquet(str(src))
    s = spark.readStream.schema("key string, cycle int").parquet(str(src)).groupBy("key").transformWithStateInPandas(ladders.processor(lad)(), "key string, cycle int, state string", "Append", "None")
    q = s.writeStream.format("memory").queryName("progress").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("progress").collect()} == {("k", 0, "A"), ("k", 3, "B"), ("m", 5, "A")}


def test_foreach_batch(spark, tmp_path):
    src, seen = tmp_path / "in", []
    spark.range(10).write.parquet(str(src))
    q = accumulate.stream_cycles(spark.readStream.schema("id long").parquet(str(src)), lambda df, k: seen.append((k, df.count())), str(tmp_path / "cp"))
    q.awaitTermination()
    assert seen == [(0, 10)]


def test_generate_validate_accumulate(spark):
    d = parse_domain(DOMAIN)
    orgs = generate.rows(spark, d, d.entity("Org"), 10, 42, {}).drop("i")
    people = generate.rows(spark, d, d.entity("Person"), 60, 42, {"Org": orgs}).drop("i")
    data = {"Org": orgs, "Person": people}
    found = validate(d, data, [Factor("active", "Person", 0.8, 0.15, {"where": {"Status": "Active"}})])
    assert found.where("NOT passed").count() == 0 and found.count() >= 5 and "gates passed" in summary(found)
    again = generate.rows(spark.newSession(), d, d.entity("Org"), 10, 42, {}).drop("i")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, orgs.collect()))
    grown = {"Org": orgs, "Person": people.unionByName(generate.rows(spark, d, d.entity("Person"), 2, 42, {"Org": orgs}, first=61).drop("i"))}
    deltas = accumulate.cycle(data, grown, {"Org": ["ID"], "Person": ["ID"]}, {"Org"})
    assert deltas["Person"].where("change = 'new'").count() == 2 and deltas["Org"].count() == 0
    with pytest.raises(accumulate.ContinuityError):
        accumulate.cycle(data, {"Org": orgs.limit(3)}, {"Org": ["ID"]}, set())
    with pytest.raises(accumulate.ContinuityError):
        accumulate.cycle(data, {"Org": orgs.withColumn("Name", F.lit("z"))}, {"Org": ["ID"]}, {"Org"})


def test_era_gates_of_a_domain(spark):
    d = parse_domain({"name": "x", "namespace": NS, "entities": {"Order": {"fields": {"ID": {"isPrimaryKey": True}, "OrderDate": {"type": "date"}, "Status": {}, "KindID": {"nullable": True}}, "foreignKeys": {"KindID": {"targetEntity": "Kind"}}}, "Kind": {"fields": {"ID": {"isPrimaryKey": True}, "Category": {}}}, "Two": {"fields": {"ID": {"isPrimaryKey": True}, "A": {"type": "date"}, "B": {"type": "date"}}}}})
    rows = [(f"{y}-{k}", date(y, 1, 1), "Paid" if k % 2 else "Open", "hard" if k < h else "soft") for y, n, h in ((2021, 40, 20), (2022, 20, 10), (2023, 20, 0)) for k in range(n)]
    data = {"Order": spark.createDataFrame(rows, "ID string, OrderDate date, Status string, KindID string"), "Kind": spark.createDataFrame([("HARD", "Hardware"), ("soft", "Software")], "ID string, Category string"), "Two": spark.createDataFrame([("t", date(2022, 1, 1), date(2022, 1, 1))], "ID string, A date, B date")}
    half = Era((2022,), "half", {}, (("Order", 0.5, None),))
    none = Era((2023,), "none", {}, (("Order", 0.0, (("Category", "hardware"),)),))
    shift = Era((2022,), "shift", {"paid": -1.0}, (("Two", 0.5, None),))
    f = Factor("paid", "Order", 0.5, 0.1, {"where": {"Status": "Paid"}})
    got = {r["name"]: (r["passed"], r["actual"]) for r in validate(d, data, ruleset={"eras": [half, none, shift], "factors": [f]}).where("category = 'era'").collect()}
    assert got["half: Order in 2022"][0] and got["none: Order in 2023"] == (True, "20 / 0")
    assert not got["shift: paid in 2022"][0] and "several dates" in got["shift: Two"][1]


def test_condition_of_a_parent(spark):
    df, up = spark.createDataFrame([("1", "A"), ("2", None)], "ID string, P string"), spark.createDataFrame([("a", "F")], "ID string, Gender string")
    assert {r["ID"]: r["__condition"] for r in generate.condition_value(df, "parent.Gender", [("P", up, "ID")]).collect()} == {"1": "F", "2": None}
    with pytest.raises(ValueError):
        generate.condition_value(df, "parent.Size", [("P", up, "ID")])


def test_rules_need_their_entities(spark):
    d = parse_domain({**DOMAIN, "relationalRules": [{"kind": "path-match", "source": "Person", "path": [{"field": "OrgID", "entity": "Org"}], "targetField": "Name"}]})
    with pytest.raises(ValueError, match="Person"):
        validate(d, {"Org": spark.createDataFrame([("o", "n")], "ID string, Name string")})


def test_intake_and_window():
    assert accumulate.intake("P", {"intake_P": 10}, [Era((3,), volumes=(("P", 0.25, None),))], 3) == 3
    assert accumulate.intake("P", {}, [], 1) == 2 and accumulate.intake("P", {}, [], 1, planned=7) == 7
    cp = accumulate.Checkpoint("shop", 42, 3, date(2024, 1, 31), NS, {"P": 5})
    assert accumulate.window(cp, "month") == (date(2024, 1, 31), date(2024, 2, 29))
    assert accumulate.check_continuity(cp, "shop", NS, 7, None, date(2024, 2, 29)) == ["seed 7 replaces 42"]
    with pytest.raises(accumulate.ContinuityError):
        accumulate.check_continuity(cp, "other", NS, None, date(2024, 1, 1), date(2024, 2, 29))
    assert accumulate.committed(cp, date(2024, 2, 29), {"P": 2, "Q": 1}).counts == {"P": 7, "Q": 1}
    assert accumulate.workflow(lambda: 1, lambda s: False, lambda s: True) == {"accumulated": 1, "validated": False}


def test_checkpoint(tmp_path):
    p = tmp_path / "cp.json"
    assert state.load_checkpoint(p) is None
    cp = accumulate.Checkpoint("shop", 42, 3, date(2024, 1, 31), NS, {"P": 5})
    state.save_checkpoint(p, cp)
    assert state.load_checkpoint(p) == cp
    p.write_text("{")
    with pytest.raises(state.CheckpointError, match="cp.json"):
        state.load_checkpoint(p)


def test_plan(spark):
    d = parse_domain(DOMAIN)
    data = {"Org": spark.createDataFrame([("o1", "Acme")], "ID string, Name string")}
    ok = plan.parse({"asOf": "2024-01-01", "summary": "s", "records": [{"entity": "Org", "ref": "new", "fields": {"Name": "Bolt"}}, {"entity": "Person", "fields": {"Email": "e", "Status": "Active", "OrgID": {"ref": "new"}}}, {"entity": "Person", "fields": {"Email": "f", "Status": "Active", "OrgID": {"lookup": {"entity": "Org", "field": "Name", "value": "ACME"}}}}]})
    rows = plan.applied(spark, ok, d, data)
    people = {r["Email"]: r["OrgID"] for r in rows["Person"].collect()}
    assert people == {"e": rows["Org"].first()["ID"], "f": "o1"}
    bad = plan.parse({"asOf": "2024-01-01", "summary": "s", "intake": {"Zed": 1}, "records": [{"entity": "Nope", "fields": {}}, {"entity": "Person", "fields": {"Email": 3, "Status": "x", "OrgID": {"ref": "gone"}, "Odd": 1}}]})
    with pytest.raises(plan.PlanError) as e:
        plan.applied(spark, bad, d, data)
    assert len(e.value.problems) >= 5
    with pytest.raises(plan.PlanError):
        plan.parse({"asOf": "soon", "what": 1})


def test_project(spark, tmp_path):
    (tmp_path / "ruleset").mkdir()
    (tmp_path / "catalogs").mkdir()
    (tmp_path / "project.json").write_text(json.dumps({"uuidNamespace": NS, "startCycle": 2021, "releaseDate": "2026-01-01", "cycleUnit": "week"}))
    (tmp_path / "domain.json").write_text(json.dumps({k: v for k, v in DOMAIN.items() if k != "namespace"}))
    (tmp_path / "ruleset" / "a.json").write_text(json.dumps({"params": {"intake_default": 3}, "factors": [{"id": "f", "effect": "Person", "target": 0.8, "tolerance": 0.1, "outcome": {"where": {"Status": "Active"}}}], "eras": [{"cycles": [2023], "factorAdjustments": [{"factor": "f", "deltaIntercept": -1}]}]}))
    (tmp_path / "catalogs" / "names.json").write_text(json.dumps({"female": ["Eve"], "male": ["Jon", "Max"]}))
    p = project.load(tmp_path)
    assert p.params == {"intake_default": 3} and p.rules["eras"][0].factors == {"f": -1} and p.domain.namespace == NS
    assert project.buckets(project.catalogue(spark, p.catalogues["names"])) == {"female": ["Eve"], "male": ["Jon", "Max"]}
    (tmp_path / "ruleset" / "b.json").write_text("{")
    with pytest.raises(ModelError, match="b.json"):
        project.load(tmp_path)
    with pytest.raises(ModelError):
        project.load(tmp_path / "nothing")


def test_seated(spark):
    out = generate.seated(spark.range(20).toDF("p"), "p", spark.range(300).toDF("a"), "a", 3, 1, spark.createDataFrame([(0, 0)], "p long, a long"))
    assert out.groupBy("p").count().where("count <> 3").count() == 0 and out.dropDuplicates(["p", "a"]).count() == 60


def test_lines_roll_up(spark):
    cat = spark.createDataFrame([(f"i{k}", float(k)) for k in range(1, 9)], "item string, price double")
    parents = spark.range(50).select(F.col("id").cast("string").alias("ID"))
    lines = generate.lines(parents, "ID", cat, "item", "price", 4)
    total = generate.rolled_up(parents, "ID", lines, "ID", "extended_price", "Total")
    assert 50 <= lines.count() <= 100 and total.where("Total <= 0").count() == 0
    assert generate.thinned(parents, "ID", 0.5, 1, "era").count() < 50


def test_errors_name_every_clash(spark):
    d = parse_domain(DOMAIN)
    none = generate.rows(spark, d, d.entity("Org"), 1, 42, {}).drop("i").limit(0)
    many = plan.parse({"asOf": "2024-01-01", "summary": "s", "records": [{"entity": "Org", "fields": {"Name": f"Org {i}"}} for i in range(25)]})
    orgs = plan.applied(spark, many, d, {"Org": none})["Org"]
    with pytest.raises(plan.PlanError) as e:
        plan.applied(spark, many, d, {"Org": orgs})
    assert str(e.value).count("exists already") == 25
    with pytest.raises(accumulate.ContinuityError) as e:
        accumulate.cycle({}, {"Org": orgs, "Other": orgs}, {"Org": ["ID"], "Other": ["ID"]}, set())
    assert str(e.value).count("is used by") == 3 and "25 ids in all" in str(e.value)
