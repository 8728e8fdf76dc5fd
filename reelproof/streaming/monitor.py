"""Q5: a session watched live, in one query of several stateful steps: windows of 100 ms, then the session's own state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.telemetry import MIN_MS, RATE_MS, STALE_MS
from .live import FORGET_MS, LATE, with_rocks

ORDER = ("C1", "C2", "A", "B", "C")
TICK = ["dev", "ms", "bytes", "events", "depth", "cap", "sampled", "phase", "moves", "planned"]
VIEW = (
    "session_id long, dev string, now long, phase string, phase_no long, done long, device_events long, full boolean, session_done long, rate double, eta double, blocked string, idle string"
)


def ticks(events: DataFrame, late: str = LATE) -> DataFrame:
    """What each device has told in each 100 ms, once no event of them is awaited any more; so ticks come in their order.

    (session_id, dev, at, ms, bytes, events, depth, cap, sampled, phase): the newest queue, the newest rate's time, the
    newest phase said, if any; ms is the beginning. Events later than `late` are left out.
    """
    kind = lambda k: F.col("event") == k
    newest = lambda c, k: F.max_by(F.when(kind(k), F.col(c)), F.when(kind(k), F.struct("at", "event_id")))
    rows = events.withWatermark("at", late).groupBy("session_id", "dev", F.window("at", "100 milliseconds").alias("w")).agg(
        F.coalesce(F.sum(F.when(kind("bytes"), F.col("delta"))), F.lit(0)).alias("bytes"), F.count("*").alias("events"), newest("depth", "queue").alias("depth"), newest("cap", "queue").alias("cap"),
        F.max(F.when(kind("throughput"), F.unix_millis("at"))).alias("sampled"), newest("phase", "phase").alias("phase"), F.count_if(kind("bytes")).alias("moves"),
    )
    return rows.select("session_id", "dev", F.window_time("w").alias("at"), F.unix_millis("w.start").alias("ms"), "bytes", "events", "depth", "cap", "sampled", "phase", "moves")


class Monitor(StatefulProcessor):
    """A session's phase, its devices, and its last twelve seconds of bytes.

    Bytes done restart only when the phase changes, not when it is said again. A batch's ticks are taken column by column. A timer wakes the session when a device
    has been silent for STALE_MS, and another ends its state when nothing is heard of it for FORGET_MS.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "phase string, phase_no long, done long, began long, planned long, now long")
        self.devices = handle.getMapState("devices", "dev string", "done long, events long, depth int, cap int, sampled long")
        self.points = handle.getListState("points", "ms long, done long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        phase, phase_no, done, began, planned, now = self.session.get() if self.session.exists() else (None, 0, 0, None, None, 0)
        devices = {k[0]: list(v) for k, v in self.devices.iterator()}
        points = [tuple(p) for p in self.points.get()]
        new = pd.concat([x[TICK].astype({"dev": "category", "phase": "category"}) for x in rows], ignore_index=True)
        new["rank"] = new["dev"].astype(str).map({dev: ORDER.index(dev) for dev in new["dev"].unique()})
        new = new.sort_values(["ms", "rank"], kind="stable", ignore_index=True)
        said = new["phase"].dropna().astype(str)
        changed = said[said != said.shift(fill_value=phase or "")] if phase is not None else said[said != said.shift()]
        if len(changed):  # what was done before the last change counts no more
            phase, phase_no, done, began, points = changed.iloc[-1], phase_no + len(changed), 0, None, []
            for d in devices.values():
                d[0] = 0
        own = new.iloc[changed.index[-1] :] if len(changed) else new
        moved = own.groupby("rank")["bytes"].sum()
        for rank, x in new.groupby("rank").agg({"events": "sum", "sampled": "max"}).iterrows():
            d = devices.setdefault(ORDER[int(rank)], [0, 0, None, None, None])
            d[0], d[1] = d[0] + int(moved.get(rank, 0)), d[1] + int(x["events"])
            if pd.notna(x["sampled"]):
                d[4] = max(d[4] or 0, int(x["sampled"]))
        for r in new[new["depth"].notna()].groupby("rank").tail(1).itertuples():
            devices[ORDER[int(r.rank)]][2:4] = int(r.depth), None if pd.isna(r.cap) else int(r.cap)
        moves = own[own["moves"] > 0]
        if len(moves):
            last, upto = int(moves["ms"].iloc[-1]), done + moves["bytes"].cumsum()
            began = int(moves["ms"].iloc[0]) if began is None else began
            recent = moves["ms"] >= last - RATE_MS
            points = [p for p in points if p[0] >= last - RATE_MS] + [(int(m), int(n)) for m, n in zip(moves["ms"][recent], upto[recent], strict=True)]
            done = int(upto.iloc[-1])
        planned, now = None if pd.isna(new["planned"].iloc[-1]) else int(new["planned"].iloc[-1]), max(now, int(new["ms"].iloc[-1]))
        self.session.update((phase, phase_no, done, began, planned, now))
        for dev, d in devices.items():
            self.devices.updateValue((dev,), tuple(d))
            if d[4] is not None and d[4] + STALE_MS > now:
                self.handle.registerTimer(d[4] + STALE_MS)
        if points:  # an empty list is no state
            self.points.put(points)
        else:
            self.points.clear()
        self.handle.registerTimer(now + FORGET_MS)
        yield self.told(key)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.session.exists():
            return
        *rest, now = self.session.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at >= now + FORGET_MS:
            for state in (self.session, self.devices, self.points):
                state.clear()
            return
        self.session.update((*rest, max(now, at)))
        yield self.told(key)

    def told(self, key) -> pd.DataFrame:
        phase, phase_no, done, began, planned, now = self.session.get()
        devices = {k[0]: v for k, v in self.devices.iterator()}
        points = [tuple(p) for p in self.points.get()]
        full = {dev: d[2] is not None and d[3] > 0 and d[2] >= d[3] for dev, d in devices.items()}
        idle = [dev for dev in ORDER if dev in devices and devices[dev][4] is not None and devices[dev][4] + STALE_MS <= now]
        rate = eta = None
        if points:
            dt, db = points[-1][0] - points[0][0], points[-1][1] - points[0][1]
            rate = db * 1000 / dt if dt >= MIN_MS and db > 0 else None
        if planned is not None and points:
            left, elapsed = max(planned - done, 0), points[-1][0] - began
            eta = 0.0 if left == 0 else left / (rate or done * 1000 / elapsed) if done > 0 and elapsed >= MIN_MS else None
        blocked = next((dev for dev in ORDER if full.get(dev)), None)
        rate, eta = rate and round(rate, 3), eta if eta is None else round(eta, 3)
        rows = [(key[0], dev, now, phase, phase_no, devices[dev][0], devices[dev][1], full[dev], done, rate, eta, blocked, ",".join(idle)) for dev in ORDER if dev in devices]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in VIEW.split(", ")]).astype({"phase": object, "rate": object, "eta": object, "blocked": object})


def watched(events: DataFrame, plans: DataFrame, late: str = LATE) -> DataFrame:
    """Q5: a row for each of a session's devices, VIEW, whenever anything of the session changes or a device falls silent.

    events (session_id, event_id, dev, event, at, delta, depth, cap, phase); plans (session_id, planned), which may lack
    sessions. Of a session's rows, those of the greatest `now` hold.
    """
    with_rocks(events.sparkSession)
    rows = ticks(events, late).join(plans.select("session_id", "planned"), "session_id", "left")
    return rows.groupBy("session_id").transformWithStateInPandas(Monitor(), VIEW, "Append", "EventTime")


def newest(told: DataFrame) -> DataFrame:
    """The rows that hold, of those that watched() has told in batches: a row a session and device."""
    last = told.groupBy("session_id", "dev").agg(F.max_by(F.struct(*[c for c in told.columns if c not in ("session_id", "dev")]), F.struct("batch", "now")).alias("r"))
    return last.select("session_id", "dev", "r.*").drop("batch")
