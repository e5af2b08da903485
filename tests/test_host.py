"""Domains from a host's metadata, their comparison with it, and metadata from data."""

import json

import pytest
from pyspark.sql import functions as F

from causaria.model import ModelError, parse_domain
from causaria.plans.graph import held_loops
from causaria.sources import host

NAMESPACE = "3d1b6a52-7a0e-5f5c-8b6e-2f1f0b8f9d31"


def tables(spark, entities, fields, relations=()):
    e = spark.createDataFrame(entities, host.ENTITIES)
    f = spark.createDataFrame(fields, host.FIELDS)
    return e, f, spark.createDataFrame(list(relations), host.RELATIONS)


def field(entity, place, name, kind="nvarchar", nullable=True, primary=False, default=None, to=None, key=None, embedded=None):
    return (entity, place, name, kind, nullable, primary, default, to, key, embedded)


VESSELS = [("1", "Vessel", None, json.dumps({"Path": "Rig"})), ("2", "Ketch", "1", None), ("3", "Voyage", None, None), ("4", "Berth", None, json.dumps({"Map": {"Field": "Kind"}})), ("5", "Dry Berth", "4", None)]
PARTS = [
    field("1", 0, "ID", "uniqueidentifier", False, True), field("1", 1, "HullCode"), field("1", 2, "Name"), field("1", 3, "Rig"), field("1", 4, "Length", "decimal(8,2)", False), field("1", 5, "HomeID", "uniqueidentifier", True, to="Berth", key="ID", embedded="{}"),
    field("2", 0, "ID", "uniqueidentifier", False, True), field("2", 1, "SailNumber"), field("2", 2, "Masts", "smallint"),
    field("3", 0, "ID", "uniqueidentifier", False, True), field("3", 1, "Log"), field("3", 2, "VesselID", "uniqueidentifier", False, to="Vessel", key="ID"), field("3", 3, "Left", "datetimeoffset"), field("3", 4, "Safe", "bit"), field("3", 5, "PortID", "uniqueidentifier", to="Port", key="ID"),
    field("4", 0, "ID", "uniqueidentifier", False, True), field("4", 1, "Name"), field("4", 2, "Kind", default="wet", nullable=False),
    field("5", 0, "ID", "uniqueidentifier", False, True), field("5", 1, "DockKey"),
]
HELD = [("1", "Voyage", "VesselID", json.dumps({"Name": "Voyages", "Mode": "authoritative"})), ("1", "Voyage", "PortID", "{broken"), ("4", "Vessel", None, "{}")]


def test_a_domain_from_metadata(spark):
    e, f, r = tables(spark, VESSELS, PARTS, HELD)
    with pytest.raises(ModelError) as bad:
        host.imported("sea", NAMESPACE, e, f, r)
    assert bad.value.problems == ["Voyage: no business key, and no field is called like one"]
    d, warnings = host.imported("sea", NAMESPACE, e, f, r, {"Voyage": ["VesselID", "Left"], "Unknown": ["x"]})
    assert warnings == ["Vessel: the collection of Voyage can't be read"]
    v = d.entity("Vessel")
    assert [(x.name, x.type, x.nullable, x.primary) for x in v.fields] == [("ID", "uuid", False, True), ("HullCode", "string", True, False), ("Name", "string", True, False), ("Rig", "string", True, False), ("Length", "number", False, False), ("HomeID", "uuid", True, False)]
    assert [d.entity(n).business_key for n in ("Vessel", "Ketch", "Voyage", "Berth", "Dry Berth")] == [("HullCode",), ("SailNumber",), ("VesselID", "Left"), ("Name",), ("DockKey",)]
    assert [(c.kind, c.entity, c.field, c.when) for c in v.compositions] == [("isA", "Ketch", "ID", "Rig"), ("collection", "Voyage", "VesselID", None), ("embed", "Berth", "HomeID", None)]
    assert [(c.kind, c.entity, c.when) for c in d.entity("Berth").compositions] == [("isA", "Dry Berth", "Kind")]
    assert [(k.field, k.entity, k.target) for k in d.entity("Voyage").foreign_keys] == [("VesselID", "Vessel", "ID"), ("PortID", "Port", "ID")]
    assert [x.type for x in d.entity("Voyage").fields] == ["uuid", "string", "uuid", "date", "boolean", "uuid"] and d.entity("Ketch").fields[2].type == "number"


def test_selectors_that_only_the_host_knows_are_told(spark):
    for selector in (None, "{}", "not json", json.dumps({"Map": {"Other": 1}})):
        e, f, r = tables(spark, [("1", "A", None, selector), ("2", "B", "1", None), ("3", "C", "lost", None)], [field(i, 0, "Name") for i in "123"])
        d, warnings = host.imported("x", NAMESPACE, e, f, r)
        assert warnings == ["B: which rows of A are of this kind is known at run time only"] and d.entity("A").compositions[0].when is None
        assert not d.entity("C").compositions


def test_everything_wrong_is_told_at_once(spark):
    names = [("1", "A", "3", None), ("2", "B", "1", None), ("3", "C", "2", None), ("4", "D", None, None), ("5", "D", None, None), ("6", "T", None, None)]
    e, f, r = tables(spark, names, [field(str(i), 0, "Name") for i in range(1, 7)], [("4", "Gone", "DID", "{}"), ("6", "T", "ParentID", "{}")])
    with pytest.raises(ModelError) as bad:
        host.imported("x", NAMESPACE, e, f, r)
    assert bad.value.problems == ["D: declared 2 times", "D: holds unknown entity 'Gone'", "held in a loop: A > B > C > A"]
    empty = tables(spark, [], [])
    assert host.imported("x", NAMESPACE, *empty) == (parse_domain({"name": "x", "namespace": NAMESPACE}), [])


def test_loops_of_what_holds_what():
    of = lambda **held: parse_domain({"name": "x", "namespace": NAMESPACE, "entities": {n: {"composition": {"collections": [{"entity": m, "field": "ID"} for m in ms]}} for n, ms in held.items()}})
    assert held_loops(of(A="BC", B="D", C="D", D="")) == []
    assert held_loops(of(C="A", A="B", B="C", D="A")) == [["A", "B", "C", "A"]]
    assert sorted(held_loops(of(A="B", B="A", C="D", D="C", E="E"))) == [["A", "B", "A"], ["C", "D", "C"]]
    deep = {f"n{i:04}": [f"n{j:04}" for j in (i + 1, i + 2) if j < 2000] for i in range(2000)}
    assert held_loops(parse_domain({"name": "x", "namespace": NAMESPACE, "entities": {n: {"composition": {"collections": [{"entity": m, "field": "ID"} for m in ms]}} for n, ms in deep.items()}})) == []


def test_a_domain_against_its_host(spark):
    e, f, r = tables(spark, VESSELS, PARTS, HELD)
    d, _ = host.imported("sea", NAMESPACE, e, f, r, {"Voyage": ["Log"]})
    assert host.checked(d, e, f) == []
    text, uuid = {"type": "string"}, {"type": "uuid"}
    own = parse_domain({"name": "sea", "namespace": NAMESPACE, "entities": {
        "vessel": {"fields": {"id": uuid, "HullCode": {"type": "number"}, "Mast": text, "Rig": {"type": "json"}}},
        "Ketch": {"fields": {"SailNumber": text}},
        "Berth": {"fields": {"ID": uuid}, "composition": {"isA": {"parentEntity": "vessel"}}},
        "Dry Berth": {"fields": {"ID": uuid}, "composition": {"isA": {"parentEntity": "Voyage"}}},
        "Voyage": {"fields": {"VesselID": uuid, "PortID": uuid}, "foreignKeys": {"VesselID": {"targetEntity": "VESSEL"}, "PortID": {"targetEntity": "Berth"}}},
        "Buoy": {},
    }})
    found = sorted((x["severity"], x["entity"], x["part"], x["problem"]) for x in host.compared(own, e, f).select("severity", "entity", F.coalesce("part", F.lit("")).alias("part"), "problem").collect())
    assert found == sorted([
        ("error", "Berth", "", "Berth is declared a kind of vessel and has no parent in the host"),
        ("error", "Dry Berth", "", "Dry Berth is declared a kind of Voyage and is one of Berth in the host"),
        ("error", "Voyage", "PortID", "PortID leads to Berth and in the host to Port"),
        ("error", "vessel", "HullCode", "HullCode is a number and in the host a string"),
        ("error", "vessel", "Mast", "vessel has no field Mast in the host"),
        ("warning", "Buoy", "", "Buoy isn't in the host"),
        ("warning", "Ketch", "", "Ketch has a parent in the host and none is declared: its kind can't be checked"),
        ("warning", "vessel", "Length", "Length is demanded by the host and not declared"),
    ])
    with pytest.raises(ModelError) as bad:
        host.checked(own, e, f)
    assert len(bad.value.problems) == 5


def test_metadata_from_data(spark):
    port = spark.createDataFrame([(1, "Ayr"), (2, None)], "p_portkey long, p_name string")
    call = spark.createDataFrame([(10, 1, 7), (11, 2, 7), (12, None, 9)], "c_callkey long, c_portkey long, c_other long")
    stray = spark.createDataFrame([(1, 5)], "s_id long, x_portkey long")
    frames, keys = {"port": port, "call": call, "stray": stray}, {"port": "p_portkey", "call": "c_callkey"}
    found = {tuple(r) for r in host.links(frames, keys).collect()}
    assert found == {("call", "c_portkey", "port", "p_portkey", 3, 0), ("stray", "x_portkey", "port", "p_portkey", 1, 1)}
    prof = {(r["entity"], r["name"]): (r["rows"], r["nulls"], r["longest"]) for r in host.profile({**frames, "none": port.limit(0)}).collect()}
    assert prof["port", "p_name"] == (2, 1, 3) and prof["call", "c_portkey"] == (3, 1, None) and prof["none", "p_name"] == (0, 0, None)
    e, f = host.metadata(frames, keys)
    d, _ = host.imported("quay", NAMESPACE, e, f, None, {n: [k] for n, k in {**keys, "stray": "s_id"}.items()})
    assert [(k.field, k.entity, k.target) for k in d.entity("call").foreign_keys] == [("c_portkey", "port", "p_portkey")] and not d.entity("stray").foreign_keys
    assert [(x.name, x.type, x.nullable, x.primary) for x in d.entity("port").fields] == [("p_portkey", "number", False, True), ("p_name", "string", True, False)]
    assert host.checked(d, e, f) == []
