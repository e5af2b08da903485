"""Appends into committed wrapped files: what is touched, what keeps its bytes, and what a crash leaves."""

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from causaria.model import parse_domain
from causaria.sources import appending, files, journal, records
from tests.worlds import FIELD, TEXT, entity

DOMAIN = parse_domain(
    {
        "name": "reef",
        "namespace": "9f0c2b1e-51c3-5a64-8d6a-0e7c7d3f4b52",
        "entities": {
            "Reef": {**entity(None, ["ID"], {"Name": TEXT, "Depth": {"type": "number", "nullable": True}}), "composition": {"collections": [{"entity": "Coral", "foreignKey": "ReefID"}], "isA": [{"entity": "Atoll"}, {"entity": "Barrier"}]}},
            "Coral": {**entity(None, ["ID"], {"Kind": TEXT}, {"ReefID": "Reef"}), "composition": {"collections": [{"entity": "Polyp", "foreignKey": "CoralID"}]}},
            "Polyp": entity(None, ["ID"], {"Colour": TEXT}, {"CoralID": "Coral"}),
            "Atoll": entity(None, ["ID"], {"Islands": {"type": "number"}}),
            "Barrier": entity(None, ["ID"], {"Length": {"type": "number"}}),
            "Diver": entity(None, ["ID"], {"Email": TEXT}),
        },
    }
)
for e in DOMAIN.entities.values():
    object.__setattr__(e, "pack", None)
KINDS = {n: e.schema() for n, e in DOMAIN.entities.items()}
assert FIELD


def frame(spark, name, rows):
    return spark.createDataFrame([{**dict.fromkeys(KINDS[name].names), **r} for r in rows], KINDS[name])


def digests(folder):
    return {str(f.relative_to(folder)): hashlib.sha256(f.read_bytes()).hexdigest() for f in sorted(Path(folder).rglob("*.txt")) if f.is_file() and "_append" not in str(f)}


def rows(df):
    return sorted(map(str, (sorted(r.asDict().items()) for r in df.collect())))


@pytest.fixture
def reef(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "PART_ROWS", 4)
    data = {
        "Reef": frame(spark, "Reef", [{"ID": f"r{i:02}", "Name": f"reef {i}", "Depth": float(i)} for i in range(10)]),
        "Coral": frame(spark, "Coral", [{"ID": f"c{i}", "Kind": "brain", "ReefID": f"r{i % 10:02}"} for i in range(15)]),
        "Polyp": frame(spark, "Polyp", [{"ID": f"p{i}", "Colour": "red", "CoralID": f"c{i}"} for i in range(6)]),
        "Atoll": frame(spark, "Atoll", [{"ID": "r01", "Islands": 3.0}]),
        "Barrier": frame(spark, "Barrier", [{"ID": "r02", "Length": 9.0}]),
    }
    folder = str(tmp_path / "tree")
    records.write(DOMAIN, data, folder, json=True)
    return folder, data


def test_only_what_is_touched_is_written_again(spark, reef):
    folder, data = reef
    before = digests(folder)
    assert len(before) == 3
    new = {
        "Reef": frame(spark, "Reef", [{"ID": f"s{i:02}", "Name": "new"} for i in range(5)]),
        "Coral": frame(spark, "Coral", [{"ID": "n1", "Kind": "fan", "ReefID": "R01"}, {"ID": "n2", "Kind": "fan", "ReefID": "s03"}]),
        "Polyp": frame(spark, "Polyp", [{"ID": "q1", "Colour": "blue", "CoralID": "n2"}, {"ID": "q2", "Colour": "blue", "CoralID": "c1"}]),
        "Diver": frame(spark, "Diver", [{"ID": "d1", "Email": "a@x"}]),
    }
    changed = {"Coral": frame(spark, "Coral", [{"ID": "c0", "Kind": "horn", "ReefID": "r00"}])}
    written = appending.append(spark, DOMAIN, folder, new, changed, part_rows=4)
    after = digests(folder)
    # r00 to r03 hold all that is touched; the part of two records is filled with two, the other three new reefs make a new one.
    same = [f for f in before if after.get(f) == before[f]]
    assert len(same) == 1 and "r04" in (Path(folder) / same[0]).read_text() and len(after) == 5 and len(written) == 4
    sizes = sorted(len(json.loads((Path(folder) / f).read_text())) for f in after if f.startswith("Reef/"))
    assert sizes == [3, 4, 4, 4]
    got = appending.read(spark, DOMAIN, folder, KINDS)
    for n in DOMAIN.entities:
        old = data.get(n, spark.createDataFrame([], KINDS[n]))
        want = old.where("ID <> 'c0'").unionByName(changed[n]) if n in changed else old
        want = want.unionByName(new[n]) if n in new else want
        # A key comes back as its parent's, so in the parent's own letters.
        want = want.withColumn("ReefID", F.lower("ReefID")) if "ReefID" in want.columns else want
        assert rows(got[n].select(*KINDS[n].names)) == rows(want.select(*KINDS[n].names)), n
    order = json.loads((Path(folder) / records.ORDER).read_text())["directoryOrder"]
    assert set(order) == {"Reef", "Diver"} and json.loads((Path(folder) / "Diver" / records.SIDECAR).read_text())["entity"] == "Diver"
    # A record keeps its place in its file.
    first = next(f for f in after if '"r00"' in (Path(folder) / f).read_text())
    assert [r["primaryKey"]["ID"] for r in json.loads((Path(folder) / first).read_text())] == ["r00", "r01", "r02", "r03"]


def test_what_is_wrong_stops_it_before_a_byte(spark, reef):
    folder, _ = reef
    before = digests(folder)
    with pytest.raises(ValueError) as e:
        appending.append(spark, DOMAIN, folder, {"Coral": frame(spark, "Coral", [{"ID": "x", "Kind": "k", "ReefID": "gone"}, {"ID": "c1", "Kind": "k", "ReefID": "r01"}])}, {"Reef": frame(spark, "Reef", [{"ID": "zz", "Name": "n"}])})
    assert set(str(e.value).split("; ")) == {"Coral: 1 new rows have keys that exist", "Reef: 1 changed rows aren't there", "Coral: 1 rows without a parent"}
    assert digests(folder) == before and not files.exists(spark, f"{folder}/{journal.JOURNAL}")
    assert appending.append(spark, DOMAIN, folder, {}) == []


def test_a_lost_driver_is_made_good(spark, reef, monkeypatch):
    folder, _ = reef
    before, calls = digests(folder), []
    real = files.replace

    def lost(spark_, source, to):
        if len(calls) == 1:
            raise KeyboardInterrupt
        calls.append(to)
        real(spark_, source, to)

    new = {"Reef": frame(spark, "Reef", [{"ID": f"s{i}", "Name": "new"} for i in range(7)]), "Coral": frame(spark, "Coral", [{"ID": "n1", "Kind": "fan", "ReefID": "r00"}])}
    monkeypatch.setattr(files, "replace", lost)
    with pytest.raises(KeyboardInterrupt):
        appending.append(spark, DOMAIN, folder, new, part_rows=4)
    monkeypatch.setattr(files, "replace", real)
    assert files.exists(spark, f"{folder}/{journal.JOURNAL}") and digests(folder) != before
    got = appending.read(spark, DOMAIN, folder, KINDS)
    assert got["Reef"].count() == 17 and got["Coral"].count() == 16
    assert not files.exists(spark, f"{folder}/{journal.JOURNAL}") and not list(Path(folder).glob("_append*"))


def test_rows_of_two_kinds_stop_a_write(spark, reef, tmp_path):
    _, data = reef
    with pytest.raises(ValueError, match="Reef: 1 rows are of two kinds"):
        records.write(DOMAIN, {**data, "Barrier": frame(spark, "Barrier", [{"ID": "R01", "Length": 1.0}])}, str(tmp_path / "other"), json=True)


def test_records_are_parsed_once_for_all_that_they_hold(spark, reef):
    folder, data = reef
    got = appending.read(spark, DOMAIN, folder, KINDS)
    for n, df in data.items():
        plan = got[n]._jdf.queryExecution().executedPlan().toString()
        assert "FileScan parquet" in plan and "FileScan text" not in plan, n
        assert got[n].count() == df.count(), n


def test_a_child_that_moves_stands_once(spark, reef):
    folder, data = reef
    changed = {"Coral": frame(spark, "Coral", [{"ID": "c0", "Kind": "horn", "ReefID": "r09"}])}
    appending.append(spark, DOMAIN, folder, {}, changed, part_rows=4)
    held = [(r["primaryKey"]["ID"], c["ID"], c["Kind"], [p["ID"] for p in c["Polyp"]]) for f in (Path(folder) / "Reef").glob("*.txt") for r in json.loads(f.read_text()) for c in r["fields"]["Coral"]]
    assert [h for h in held if h[1] == "c0"] == [("r09", "c0", "horn", ["p0"])] and len(held) == 15
    got = appending.read(spark, DOMAIN, folder, KINDS)
    assert rows(got["Coral"].select(*KINDS["Coral"].names)) == rows(data["Coral"].where("ID <> 'c0'").unionByName(changed["Coral"]))
    assert got["Polyp"].count() == 6


def test_embedded_rows_find_their_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "PART_ROWS", 2)
    keys = {"PortID": {"fieldName": "PortID", "targetEntity": "Port", "targetField": "ID"}}
    d = parse_domain({"name": "sea", "namespace": DOMAIN.namespace, "entities": {"Ship": {"fields": {"ID": {"type": "uuid", "isPrimaryKey": True}, "PortID": TEXT, "Name": TEXT}, "foreignKeys": keys, "composition": {"embeds": [{"entity": "Port", "field": "PortID"}]}}, "Port": {"fields": {"ID": {"type": "uuid", "isPrimaryKey": True}, "Town": TEXT}}}})
    ship = lambda *r: spark.createDataFrame(list(r), "ID string, PortID string, Name string")
    port = lambda *r: spark.createDataFrame(list(r), "ID string, Town string")
    folder, kinds = str(tmp_path / "sea"), {"Ship": ship(("0", "0", "")).schema, "Port": port(("0", "")).schema}
    records.write(d, {"Ship": ship(*[(f"{i}", f"{i % 2}", f"s{i}") for i in range(4)], ("4", None, "none"), ("5", "1", "s5")), "Port": port(("0", "a"), ("1", "b"))}, folder, json=True)
    before = digests(folder)
    # A new ship in a committed port, a committed ship sent to a new port, a committed port renamed.
    appending.append(spark, d, folder, {"Ship": ship(("90", "0", "t")), "Port": port(("7", "new"))}, {"Ship": ship(("4", "7", "s4")), "Port": port(("0", "A"))}, part_rows=2)
    held = {r["primaryKey"]["ID"]: (r["fields"].get("Port") or {}).get("Town") for f in (tmp_path / "sea" / "Ship").glob("*.txt") for r in json.loads(f.read_text())}
    assert held == {"0": "A", "1": "b", "2": "A", "3": "b", "4": "new", "5": "b", "90": "A"} and len(digests(folder)) == len(before) + 1
    got = appending.read(spark, d, folder, kinds)
    assert rows(got["Port"]) == rows(port(("0", "A"), ("1", "b"), ("7", "new"))) and got["Ship"].count() == 7
    with pytest.raises(ValueError, match="^Port: 1 rows without a parent$"):
        appending.append(spark, d, folder, {"Port": port(("8", "nobody's"))})


def test_partitions_are_found_by_their_values(spark, tmp_path):
    at = str(tmp_path / "by [one] {column}")
    spark.createDataFrame([("x", "a:b%2F c.txt"), ("y", "é=z")], "value string, n string").repartition(1).write.partitionBy("n").text(at)
    found = files.partitions(spark, at, "n")
    assert [v for v, _ in found] == ["a:b%2F c.txt", "é=z"] and [files.read_text(spark, f) for _, f in found] == ["x\n", "y\n"]
