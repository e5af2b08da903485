"""A small project from build to a dozen cycles, as its users run it."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from causaria.__main__ import main
from causaria.model import Hero
from causaria.operators import heroes
from causaria.plans import build as runs
from causaria.sources import project, records, state
from causaria.streaming.accumulate import ContinuityError

NS = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@pytest.fixture()
def root(tmp_path):
    (tmp_path / "ruleset").mkdir()
    field = {"ID": {"type": "uuid", "isPrimaryKey": True}, "Name": {}, "CreatedAt": {"type": "date"}}
    domain = {"name": "coast", "entities": {"Lighthouse": {"businessKey": ["Name"], "isImmutable": True, "fields": field}, "Keeper": {"businessKey": ["Name"], "fields": {**field, "LighthouseID": {"type": "uuid", "nullable": True}, "Status": {}}, "foreignKeys": {"LighthouseID": {"targetEntity": "Lighthouse"}}}}}
    rules = {"params": {"volume_default": 10, "intake_default": 2, "intake_Lighthouse": 0}, "factors": [{"id": "on_duty", "effect": "Keeper", "target": 0.7, "tolerance": 0.3, "outcome": {"where": {"Status": "OnDuty"}, "otherwise": "Away"}}]}
    (tmp_path / "project.json").write_text(json.dumps({"uuidNamespace": NS, "startCycle": 2024, "releaseDate": "2026-01-01", "cycleUnit": "week"}))
    (tmp_path / "domain.json").write_text(json.dumps(domain))
    (tmp_path / "ruleset" / "common.json").write_text(json.dumps(rules))
    return tmp_path


def counts(spark, root, names=("Lighthouse", "Keeper")):
    return {n: spark.read.parquet(f"{root}/data/{n}").count() for n in names}


def test_build_accumulate_validate(spark, root, capsys):
    assert main(["build", str(root)]) == 0 and counts(spark, root) == {"Lighthouse": 10, "Keeper": 10}
    assert main(["validate", str(root)]) == 0 and "gates passed" in capsys.readouterr().out
    before = {p: p.read_bytes() for p in Path(root, "data").rglob("*.parquet")}
    ids = {r["ID"] for r in spark.read.parquet(f"{root}/data/Keeper").collect()}
    assert main(["accumulate", str(root)]) == 0 and counts(spark, root) == {"Lighthouse": 10, "Keeper": 12}
    assert all(p.read_bytes() == b for p, b in before.items())  # committed files are left alone
    assert main(["accumulate", str(root)]) == 0
    people = spark.read.parquet(f"{root}/data/Keeper")
    assert people.count() == 14 == people.select("ID").distinct().count() and ids <= {r["ID"] for r in people.collect()}
    assert str(runs.as_of(project.load(root))) == "2026-01-15" and main(["validate", str(root), "--base", str(root / "data")]) == 0
    assert {r["Status"] for r in people.collect()} <= {"OnDuty", "Away"}


def test_builds_agree(spark, root):
    p = project.load(root)
    a, b = ({n: sorted(map(tuple, d.collect()), key=str) for n, d in runs.build(spark, p).data.items()} for _ in range(2))
    assert a == b


def test_a_failed_cycle_leaves_the_state(spark, root, tmp_path):
    main(["build", str(root)])
    before = {p: p.read_bytes() for p in Path(root, "data").rglob("*") if p.is_file()}
    bad = tmp_path / "plan.json"
    bad.write_text(json.dumps({"asOf": "2020-01-01", "summary": "late"}))
    with pytest.raises(ContinuityError):
        main(["accumulate", str(root), "--plan", str(bad)])
    (root / "data" / runs.CHECKPOINT).write_text("{")
    with pytest.raises(state.CheckpointError):
        main(["accumulate", str(root)])
    (root / "data" / runs.CHECKPOINT).unlink()
    with pytest.raises(ContinuityError):
        runs.next_cycle(spark, project.load(root))
    assert all(p.read_bytes() == b for p, b in before.items() if p.name != runs.CHECKPOINT)


def test_planned_cycle(spark, root, tmp_path):
    main(["build", str(root)])
    plan = tmp_path / "plan.json"
    plan.write_text(json.dumps({"asOf": "2026-01-08", "summary": "one", "intake": {"Keeper": 0}, "records": [{"entity": "Keeper", "fields": {"Name": "Tor", "Status": "OnDuty", "CreatedAt": "2026-01-05"}}]}))
    assert main(["accumulate", str(root), "--plan", str(plan)]) == 0
    assert spark.read.parquet(f"{root}/data/Keeper").where("Name = 'Tor'").count() == 1 and counts(spark, root)["Keeper"] == 11


def test_heroes(spark):
    df = spark.createDataFrame([("1", "Ann", 5.0), ("2", "Bob", 1.0)], "ID string, Name string, Fee double")
    kids = spark.createDataFrame([("a", "1")], "ID string, P string")
    one = {"from": "K", "via": "P", "aggregation": "count"}
    good = Hero("ann", "P", {"Name": "Ann"}, pins=(("field", None, "Fee", "gte", 5), ("feature", None, one, "eq", 1), ("outcome", 2020, "x", "eq", True)))
    bad = Hero("bob", "P", {"Name": "Bob"}, pins=(("field", None, "Fee", "gt", 5),))
    gone = Hero("cyd", "P", {"Name": "Cyd"})
    assert [g.first()["passed"] for g in heroes.gates({"P": df, "K": kids}, [good, bad, gone])] == [True, False, False]


def test_upsert_and_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a", 2020), (2, "b", 2020), (3, "c", 2021)], "ID int, v string, year int")
    df.write.partitionBy("year").parquet(path)
    kept = {p: p.read_bytes() for p in Path(path, "year=2021").glob("*.parquet")}
    records.upserted(spark, path, df.where("ID = 1").withColumn("v", F.lit("z")), ["ID"], "year")
    assert {r["ID"]: r["v"] for r in spark.read.parquet(path).collect()} == {1: "z", 2: "b", 3: "c"} and all(p.read_bytes() == b for p, b in kept.items())
    records.replaced(spark, path, spark.read.parquet(path).withColumn("v", F.upper("v")))
    assert {r["v"] for r in spark.read.parquet(path).collect()} == {"Z", "B", "C"} and not Path(f"{path}.new").exists()


def test_ladders_go_on_between_cycles(spark, root):
    rules = json.loads((root / "ruleset" / "common.json").read_text())
    rules["ladders"] = [{"id": "life", "entity": "Keeper", "share": 1.0, "binding": {"field": "Stage"}, "states": [{"name": "Trial", "duration": 3}, {"name": "Active", "duration": 1, "capacity": 4, "stored": "A"}, {"name": "Gone", "duration": 9}]}]
    (root / "ruleset" / "common.json").write_text(json.dumps(rules))
    domain = json.loads((root / "domain.json").read_text())
    domain["entities"]["Keeper"]["fields"]["Stage"] = {"nullable": True}
    (root / "domain.json").write_text(json.dumps(domain))
    p = project.load(root)
    runs.write(p, runs.build(spark, p))
    stage = lambda: {r["Stage"]: r["count"] for r in spark.read.parquet(f"{root}/data/Keeper").groupBy("Stage").count().collect()}
    assert stage() == {"Trial": 10}
    seen = []
    for _ in range(3):
        done = runs.next_cycle(spark, p)
        seen.append(sum(t.count() for t in done.transitions))
        runs.commit(spark, p, done, records.read(spark, p.domain, str(p.output)))
    assert seen == [4, 8, 6] and stage() == {"Gone": 8, "A": 2, None: 6}
