"""The state machine of jobs: any order of commands, replays, and deadlines."""

import random

import pandas as pd
import pytest

from mensura.streaming import decisions


def fold(commands):
    state, out = decisions.NONE, []
    for seq, c in enumerate(commands, 1):
        state, outcome = decisions.applied(state, *c)
        out.append((seq, *state[:4], outcome))
    return out


COMMANDS = [
    ("approve", None, None), ("start", None, None), ("approve", None, None), ("lost", None, None), ("measured", 5.0, None), ("measured", 6.0, None), ("adjust", None, None),
    ("approve", None, None), ("adjust", 7.0, 3), ("adjust", 7.5, 4), ("approve", None, 5), ("archive", None, None), ("adjust", 9.0, None), ("reject", None, None), ("archive", None, None),
    ("adjust", 1.0, None), ("restore", None, None), ("restore", None, None), ("odd", None, None),
]


def test_known_decisions():
    got = [(status, outcome) for _, status, _, _, _, outcome in fold(COMMANDS)]
    assert got == [
        ("none", "refused: not found"), ("processing", "applied"), ("processing", "refused: job is still processing"), ("unmeasured", "applied"), ("pending", "applied"),
        ("pending", "refused: not processing"), ("pending", "applied"), ("pending", "refused: approve blocked: no measurement"), ("pending", "refused: stale version"), ("pending", "applied"),
        ("approved", "applied"), ("approved", "refused: already approved"), ("approved", "applied"), ("rejected", "applied"), ("deleted", "applied"), ("deleted", "refused: not found"),
        ("rejected", "applied"), ("rejected", "refused: not archived"), ("rejected", "refused: unknown command"),
    ]


class Held:
    """What a stream keeps of one key."""

    def __init__(self):
        self.exists, self.get, self.hasTimedOut, self.timeout = False, None, False, None

    def update(self, state):
        self.exists, self.get = True, state

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def batch(rows):
    return pd.DataFrame([(1, s, *c) for s, c in rows], columns=["job", "seq", "kind", "area", "base"])


@pytest.mark.parametrize("seed", range(20))
def test_any_order_of_batches_is_the_fold(seed):
    r = random.Random(seed)
    rows = list(enumerate(COMMANDS, 1))
    rows += r.sample(rows, 6)  # replays
    r.shuffle(rows)
    held, run, found = Held(), decisions._machine(None), []
    while rows:
        n = r.randint(1, 5)
        found += [tuple(x) for b in run((1,), iter([batch(rows[:n])]), held) for x in b.itertuples(index=False)]
        rows = rows[n:]
    plain = [tuple(None if pd.isna(v) else v for v in x[1:]) for x in found]
    assert plain == fold(COMMANDS) and held.get[-1] == "{}" and held.timeout is None


def test_commands_are_read_and_written_as_columns(monkeypatch):
    def slow(*_, **__):
        raise AssertionError("a step of pandas for each row or group")

    rows, run = list(enumerate(COMMANDS, 1)), decisions._machine(None)
    commands = batch(rows)
    with monkeypatch.context() as m:
        for name in ("itertuples", "iterrows", "astype"):
            m.setattr(pd.DataFrame, name, slow)
        found = list(run((1,), iter([commands]), Held()))
    assert [len(b) for b in found] == [len(rows)]
    assert found[0].dtypes[["job", "seq", "version", "area"]].astype(str).tolist() == ["int64", "int64", "int32", "float64"]


def test_a_late_measurement_follows_a_deadline():
    held, run = Held(), decisions._machine(3)
    list(run((1,), iter([batch([(1, COMMANDS[1])])]), held))
    assert held.timeout == 3000
    held.hasTimedOut = True
    late = [x for b in run((1,), iter([]), held) for x in b.itertuples(index=False)]
    assert [(x.status, x.outcome) for x in late] == [("unmeasured", "deadline passed")]
    held.hasTimedOut = False
    after = [x for b in run((1,), iter([batch([(2, ("measured", 8.0, None))])]), held) for x in b.itertuples(index=False)]
    assert [(x.status, x.area_m2 if hasattr(x, "area_m2") else x.area, x.outcome) for x in after] == [("pending", 8.0, "applied")]
    held.hasTimedOut = True
    assert list(run((1,), iter([]), held)) == []
