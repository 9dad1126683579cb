"""Jobs as a state machine over a stream of commands: measured, decided on, archived, and refused where a command doesn't fit.

Commands are (job, seq, kind, area, base) with seq counting a job's commands from 1.
They may come in any order and more than once: what is early waits in state, what was
applied before is left out, so a stream's rows are those of a fold over each job's
commands in order. A decision may name the version that it was made on, and is
refused if another has come between. A job that isn't measured within its deadline is
reported unmeasured by a timer; a measurement that comes later still counts.

Defined results: every command has exactly one row, when it is applied or refused;
unknown kinds are refused; commands without a job or seq are ignored; one whose
predecessors never come waits for good.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DEADLINE_S = 120
NOW = "status string, decision string, version int, area double, next long, early string"
ROWS = "job long, seq long, status string, decision string, version int, area double, outcome string"
NONE = ("none", None, 0, None, 1)
DECISIONS = ("approve", "reject", "adjust", "archive")


def _plain(v):
    return None if v is None or v is pd.NA or v != v else v


def refusal(state: tuple, kind: str, base: int | None) -> str | None:
    """Why a command isn't applied to a job in that state, if it isn't."""
    status, decision, version, area, _ = state
    if kind == "start":
        return None if status == "none" else "already started"
    if status == "none" or (status == "deleted" and kind != "restore"):
        return "not found"
    if kind == "restore":
        return None if status == "deleted" else "not archived"
    if kind in ("measured", "lost"):
        return None if status == "processing" or (kind == "measured" and status == "unmeasured") else "not processing"
    if kind not in DECISIONS:
        return "unknown command"
    if status == "processing":
        return "job is still processing"
    if base is not None and base != version:
        return "stale version"
    if kind == "approve" and area is None:
        return "approve blocked: no measurement"
    return "already approved" if kind == "archive" and decision == "approved" else None


def applied(state: tuple, kind: str, value: float | None, base: int | None) -> tuple[tuple, str]:
    """The state after a command, and what became of the command."""
    status, decision, version, area, turn = state
    if why := refusal(state, kind, base):
        return (status, decision, version, area, turn + 1), f"refused: {why}"
    if kind in ("approve", "reject"):
        decision = {"approve": "approved", "reject": "rejected"}[kind]
    if kind in ("measured", "adjust"):
        area = value
    after = {"start": "processing", "measured": "pending", "lost": "unmeasured", "archive": "deleted", "restore": decision or "pending"}
    if kind in ("approve", "reject"):
        status = decision
    elif kind != "adjust":
        status = after[kind]
    elif status != "approved":
        status = "pending"
    return (status, decision, version + 1, area, turn + 1), "applied"


def advanced(state: tuple, early: dict, fresh: dict) -> tuple[tuple, dict, list]:
    """The state after all commands that are now in turn, those that still wait, and (seq, state, outcome) of each in order."""
    waiting, found = {**early, **{s: c for s, c in fresh.items() if s >= state[4]}}, []
    while (turn := state[4]) in waiting:
        state, outcome = applied(state, *waiting.pop(turn))
        found.append((turn, state, outcome))
    return state, waiting, found


def _machine(deadline_s: int | None):
    names = [c.split()[0] for c in ROWS.split(", ")]

    kinds = dict(zip(names, ("int64", "int64", object, object, "int32", "float64", object)))

    def frame(job, found: list) -> pd.DataFrame:
        columns = zip(*((job, seq, *state[:4], outcome) for seq, state, outcome in found))
        return pd.DataFrame({c: np.array(values, kinds[c]) for c, values in zip(names, columns)}, copy=False)

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        *now, kept = held.get if held.exists else (*NONE, "{}")
        state = tuple(map(_plain, now))
        if held.hasTimedOut:
            if state[0] == "processing":
                state = ("unmeasured", *state[1:])
                held.update((*state, kept))
                yield frame(key[0], [(0, state, "deadline passed")])
            return
        # groups are a few rows each, so they are read as lists: what pandas does for a row costs more than the command
        fresh = {}
        for b in batches:
            kind, area, base = (b[c].tolist() for c in ("kind", "area", "base"))
            fresh.update(zip(map(int, b["seq"].tolist()), zip(kind, map(_plain, area), map(_plain, base))))
        early = {int(k): tuple(v) for k, v in json.loads(kept).items()}
        state, waiting, found = advanced(state, early, fresh)
        held.update((*state, json.dumps(waiting)))
        if state[0] == "processing" and deadline_s is not None:
            held.setTimeoutDuration(deadline_s * 1000)
        if found:
            yield frame(key[0], found)

    return run


def decided(commands: DataFrame, deadline_s: int | None = DEADLINE_S) -> DataFrame:
    """A row for every command of the stream commands(job, seq, kind, area, base) once it has been applied or refused; None sets no timers."""
    timers = GroupStateTimeout.NoTimeout if deadline_s is None else GroupStateTimeout.ProcessingTimeTimeout
    known = commands.where("job IS NOT NULL AND seq IS NOT NULL").select("job", "seq", "kind", "area", "base")
    return known.groupBy("job").applyInPandasWithState(_machine(deadline_s), ROWS, NOW, "update", timers)
