"""Cycles of a stream, each once, whatever is lost on the way."""

import json
import os
import shutil
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException

from causaria.__main__ import main
from causaria.plans import build as runs
from causaria.sources import files, journal, project, records, state, versions
from tests.test_runs import root  # noqa: F401


@pytest.fixture()
def project_with_plans(spark, root, tmp_path_factory):  # noqa: F811
    rules = json.loads((root / "ruleset" / "common.json").read_text())
    rules["ladders"] = [{"id": "life", "entity": "Keeper", "share": 1.0, "binding": {"field": "Stage"}, "states": [{"name": "Trial", "duration": 3}, {"name": "Active", "duration": 1, "capacity": 4}, {"name": "Gone", "duration": 9}]}]
    (root / "ruleset" / "common.json").write_text(json.dumps(rules))
    domain = json.loads((root / "domain.json").read_text())
    domain["entities"]["Keeper"]["fields"]["Stage"] = {"nullable": True}
    (root / "domain.json").write_text(json.dumps(domain))
    p = project.load(root)
    runs.write(p, runs.build(spark, p))
    plans = tmp_path_factory.mktemp("plans")
    for k, day in enumerate(("2026-01-08", "2026-01-15")):
        at = plans / f"{k}.json"
        at.write_text(json.dumps({"asOf": day, "summary": f"week {k}", "intake": {"Keeper": 1}, "records": [{"entity": "Keeper", "fields": {"Name": f"Tor {k}", "Status": "OnDuty", "CreatedAt": "2026-01-05"}}]}))
        os.utime(at, (1_700_000_000 + k, 1_700_000_000 + k))
    return p, str(plans)


def what(spark, p):
    data = records.read(spark, p.domain, str(p.output))
    c = state.load_checkpoint(Path(p.output) / runs.CHECKPOINT)
    states = spark.read.parquet(runs._states(p, c.cycle)).drop("dials")
    return {n: sorted(map(str, df.collect())) for n, df in {**data, "states": states}.items()}, c


def test_a_lost_stream_ends_where_an_unbroken_one_does(spark, project_with_plans, monkeypatch, tmp_path):
    p, plans = project_with_plans
    fresh = str(tmp_path / "copy")
    shutil.copytree(p.output, fresh)
    runs.stream_plans(spark, p, plans, str(tmp_path / "a")).awaitTermination()
    want, checkpoint = what(spark, p)
    assert checkpoint.batch == 1 and str(checkpoint.as_of) == "2026-01-15" and len(want["Keeper"]) == 14
    history = [versions.load(spark, str(p.output), v).note for v in versions.ids(spark, str(p.output))]
    assert [h.split(" as of")[0] for h in history] == ["built", "cycle 2027", "cycle 2028"]
    # The same, with the driver lost in the midst of the first batch's moves, and once more after the second's, before Spark notes it.
    real, calls = files.replace, []

    def lost(spark_, source, to):
        calls.append(to)
        if len(calls) == 3:
            raise RuntimeError("lost")
        real(spark_, source, to)

    shutil.rmtree(p.output)
    shutil.copytree(fresh, p.output)
    monkeypatch.setattr(files, "replace", lost)
    with pytest.raises(StreamingQueryException):
        runs.stream_plans(spark, p, plans, str(tmp_path / "b")).awaitTermination()
    assert files.exists(spark, f"{p.output}/{journal.JOURNAL}")
    begun = runs.cycle_of_batch(p)

    def unnoted(df, batch):
        begun(df, batch)
        if batch == 1 and not (tmp_path / "once").exists():
            (tmp_path / "once").write_text("")
            raise RuntimeError("lost before it is noted")

    monkeypatch.setattr(runs, "cycle_of_batch", lambda _: unnoted)
    with pytest.raises(StreamingQueryException):
        runs.stream_plans(spark, p, plans, str(tmp_path / "b")).awaitTermination()
    runs.stream_plans(spark, p, plans, str(tmp_path / "b")).awaitTermination()
    got, again = what(spark, p)
    assert got == want and again == checkpoint
    assert not files.exists(spark, f"{p.output}/{journal.JOURNAL}") and not files.exists(spark, f"{p.output}/_pending")
    assert len(versions.ids(spark, str(p.output))) == 3


def test_what_was_kept_aside_is_not_overwritten(spark, tmp_path):
    folder = str(tmp_path)
    for name, text in (("live", "old"), ("pending/live", "new")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    moves = [(journal.KEEP, f"{folder}/live", f"{folder}/kept"), (journal.MOVE, f"{folder}/pending/live", f"{folder}/live")]
    journal.begin(spark, folder, moves, f"{folder}/pending", {"k": 1})
    seen = []
    with pytest.raises(KeyboardInterrupt):
        journal.play(spark, folder, lambda then: (seen.append(then), (_ for _ in ()).throw(KeyboardInterrupt))[1].__next__())
    assert journal.play(spark, folder, seen.append) and seen == [{"k": 1}] * 2
    assert (tmp_path / "kept").read_text() == "old" and (tmp_path / "live").read_text() == "new" and not journal.play(spark, folder)


def test_follow_and_validate_against_a_version(spark, project_with_plans, capsys):
    p, plans = project_with_plans
    assert main(["follow", str(p.root), "--plans", plans]) == 0 and "2026-01-15" in capsys.readouterr().out
    assert main(["validate", str(p.root), "--base", "main~2"]) == 0
    assert "Keeper: kept" in capsys.readouterr().out
    assert main(["validate", str(p.root), "--base", "elsewhere"]) == 1
