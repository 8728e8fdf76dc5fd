"""The monitor takes a batch's ticks column by column, with what a walk over them row by row gives."""

import random
import time
from types import SimpleNamespace

import pandas as pd
import pytest

from reelproof.operators.telemetry import RATE_MS
from reelproof.streaming import monitor


class State:
    """A value, map or list of state, kept in memory."""

    def __init__(self, kind):
        self.kind, self.v = kind, None if kind == "value" else {} if kind == "map" else []

    exists = lambda self: self.v is not None
    get = lambda self: self.v
    iterator = lambda self: iter(self.v.items())

    def update(self, v):
        self.v = v

    put = update

    def updateValue(self, k, v):
        self.v[k] = v

    def clear(self):
        self.__init__(self.kind)


def started():
    handle = SimpleNamespace(getValueState=lambda *_: State("value"), getMapState=lambda *_: State("map"), getListState=lambda *_: State("list"), registerTimer=lambda at: None)
    own = monitor.Monitor()
    own.init(handle)
    return own


def walked(ticks, state):
    """The state after each tick in its turn."""
    phase, phase_no, done, began, planned, now, devices, points = state
    for r in sorted(ticks, key=lambda r: (r["ms"], monitor.ORDER.index(r["dev"]))):
        if r["phase"] is not None and r["phase"] != phase:
            phase, phase_no, done, began, points = r["phase"], phase_no + 1, 0, None, []
            devices = {k: [0, *v[1:]] for k, v in devices.items()}
        d = devices.setdefault(r["dev"], [0, 0, None, None, None])
        d[0], d[1] = d[0] + r["bytes"], d[1] + r["events"]
        if r["depth"] is not None:
            d[2], d[3] = r["depth"], r["cap"]
        if r["sampled"] is not None:
            d[4] = max(d[4] or 0, r["sampled"])
        if r["moves"]:
            done, began = done + r["bytes"], r["ms"] if began is None else began
            points = [p for p in points if p[0] >= r["ms"] - RATE_MS] + [(r["ms"], done)]
        planned, now = r["planned"], max(now, r["ms"])
    return phase, phase_no, done, began, planned, now, devices, points


def tick(rng, ms, chatty):
    moves = rng.randrange(3) if chatty else 0
    depth = rng.choice((None, None, 1, 4))
    return {
        "dev": rng.choice(monitor.ORDER), "ms": ms, "bytes": 100 * moves, "events": 1 + moves, "depth": depth, "cap": None if depth is None else 4, "sampled": rng.choice((None, ms + 3)),
        "phase": rng.choice(("COPY", "VERIFY")) if rng.random() < 0.1 else None, "moves": moves, "planned": 5000,
    }


@pytest.mark.parametrize("seed", range(30))
def test_columns_and_rows_give_one_state(seed):
    rng = random.Random(seed)
    own, want, at = started(), (None, 0, 0, None, None, 0, {}, []), 0
    for _ in range(4):
        ticks = []
        for _ in range(rng.randrange(1, 60)):
            at += rng.choice((0, 100, 1000, 5000))
            ticks.append(tick(rng, at, seed % 5))
        ticks = list({(t["ms"], t["dev"]): t for t in ticks}.values())
        rng.shuffle(ticks)
        if seed % 4 == 1:
            ticks = [t | {"planned": None} for t in ticks]
        want = walked(ticks, want)
        at += 100
        frames = [pd.DataFrame(ticks[lo : lo + 20]) for lo in range(0, len(ticks), 20)]
        shown = pd.concat(own.handleInputRows((1,), iter(frames), None))
        assert own.session.v == want[:6]
        assert {k[0]: list(v) for k, v in own.devices.v.items()} == want[6] and own.points.v == want[7]
        assert shown["done"].tolist() == [want[6][d][0] for d in monitor.ORDER if d in want[6]]


def test_a_long_batch_of_one_session_is_fast():
    rng, n = random.Random(3), 400_000
    one = pd.DataFrame([tick(rng, 100 * k, True) for k in range(2000)])
    frame = pd.concat([one.assign(ms=one["ms"] + 200_000 * k) for k in range(n // 2000)], ignore_index=True)
    began = time.time()
    assert len(pd.concat(started().handleInputRows((1,), iter([frame[lo : lo + 10_000] for lo in range(0, n, 10_000)]), None))) == 5
    assert time.time() - began < 5
