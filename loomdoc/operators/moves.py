"""Carrying out move and undo plans: on the driver, after the plan; never inside a task, which may be tried again."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def carry_out(steps: Iterable[tuple[str, str]], apply: bool = False) -> list[tuple[str, str, str | None]]:
    """(source, target, error) of each step, in order; null error: moved, or would be. A dry run unless apply.

    Each step is checked again just before it; what exists is never overwritten. A failed step doesn't stop the others.
    """
    out: list[tuple[str, str, str | None]] = []
    gone, made = set(), set()  # of a dry run
    for source, target in steps:
        error = None
        try:
            if source in gone or (source not in made and not os.path.lexists(source)):
                error = "source is missing"
            elif target in made or (target not in gone and os.path.lexists(target)):
                error = "target is taken"
            elif apply:
                os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
                shutil.move(source, target)
            else:
                gone.add(source)
                made.discard(source)
                made.add(target)
                gone.discard(target)
        except OSError as e:
            error = str(e)
        out.append((source, target, error))
    return out


def apply_moves(moves: DataFrame, apply: bool = False) -> list[tuple[str, str, str | None]]:
    """The moves of redundancy_passes (pass, path, target), by pass and path."""
    return carry_out(((r["path"], r["target"]) for r in moves.orderBy("pass", "path").toLocalIterator()), apply)


def apply_undo(plan: DataFrame, apply: bool = False) -> list[tuple[str, str, str | None]]:
    """The steps of undo_plan that are ready, from neu back to alt, the last seq first."""
    ready = plan.where("status = 'bereit'").orderBy(F.desc("seq"))
    return carry_out(((r["neu"], r["alt"]) for r in ready.toLocalIterator()), apply)
