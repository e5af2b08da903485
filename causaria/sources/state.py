"""Checkpoints and base snapshots."""

from __future__ import annotations

import json
import os
from dataclasses import asdict
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..streaming.accumulate import Checkpoint


class CheckpointError(ValueError):
    pass


def load_checkpoint(path: str | Path) -> Checkpoint | None:
    """None where there is none; one that doesn't parse or lacks a field raises, with its path."""
    p = Path(path)
    if not p.exists():
        return None
    try:
        d = json.loads(p.read_text())
        return Checkpoint(d["domain"], int(d["seed"]), int(d["cycle"]), date.fromisoformat(d["as_of"]), d["namespace"], {k: int(v) for k, v in d["counts"].items()}, {k: int(v) for k, v in d.get("numbered", {}).items()}, d.get("batch"))
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise CheckpointError(f"{p}: {type(e).__name__}: {e}") from e


def dumped(c: Checkpoint) -> str:
    return json.dumps({**asdict(c), "as_of": c.as_of.isoformat()}, sort_keys=True)


def save_checkpoint(path: str | Path, c: Checkpoint) -> None:
    """In one step: a reader sees the old one or the new one."""
    p = Path(path)
    tmp = p.with_suffix(".tmp")
    tmp.write_text(dumped(c))
    os.replace(tmp, p)


def base(spark: SparkSession, folder: str | None, entity: str) -> tuple[DataFrame | None, str | None]:
    """(rows, error) of the version to compare with: (None, None) without one, an error's text where it can't be read."""
    if folder is None:
        return None, None
    try:
        return spark.read.parquet(f"{folder}/{entity}"), None
    except Exception as e:  # whatever the store raises becomes a failed gate
        return None, str(e).splitlines()[0]
