"""A journal of renames: all of them are made or none, whoever is lost on the way.

What is to be put in place is written beside first; the journal, written in one
step, then names every move. From there on the state is the new one: play()
makes the moves, and makes those that are left when it is called again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession

from . import files

JOURNAL = "_journal.json"

#: Kinds of moves: in place of what is there, or only where nothing is.
MOVE, KEEP = "move", "keep"


def begin(spark: SparkSession, folder: str, moves: list[tuple[str, str, str]], beside: str, then: dict | None = None) -> None:
    """Writes the journal. beside: the folder that holds what is moved, deleted in the end; then: what play() hands to its caller."""
    files.write_text(spark, f"{folder}/{JOURNAL}", json.dumps({"moves": moves, "beside": beside, "then": then or {}}))


def play(spark: SparkSession, folder: str, finish: Callable[[dict], None] | None = None) -> bool:
    """Makes the moves of the journal that is there, if any; finish is called with its `then` before the journal goes, so more than once if lost in between."""
    at = f"{folder}/{JOURNAL}"
    if not files.exists(spark, at):
        return False
    journal = json.loads(files.read_text(spark, at))
    for kind, source, to in journal["moves"]:
        if kind == KEEP and files.exists(spark, to):
            continue  # made before; what stands at source now is new
        files.replace(spark, source, to)
    if finish is not None:
        finish(journal["then"])
    files.delete(spark, at)
    files.delete(spark, journal["beside"])
    return True
