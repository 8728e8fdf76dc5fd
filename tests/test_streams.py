"""Streams over several batches: what a single batch of the catalog does not show."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from reelproof.operators import history, plan
from reelproof.sources import files
from reelproof.streaming import live, monitor

EVENT = "session_id long, event_id long, at timestamp, event string, dev string, delta long, mbps double, depth int, cap int, phase string"
START = datetime.datetime(2026, 1, 1, 10)
START_MS = int(START.replace(tzinfo=datetime.UTC).timestamp() * 1000)


def at(ms):
    return START + datetime.timedelta(milliseconds=ms)


def fed(spark, folder, schema, batches):
    """Batches as files that arrive one by one, in their order."""
    import os

    for i, rows in enumerate(batches):
        path = folder / f"in{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
        for f in path.glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in*")


def event(i, ms, kind, dev, delta=0, depth=None, phase=None, session=1):
    return (session, i, at(ms), kind, dev, delta, None, depth, 4 if depth is not None else None, phase)


def test_monitor_over_batches(spark, tmp_path):
    """Phases restart what is done only when they change, rates and the time to go are of the phase, queues and silence show."""
    batches = [
        [event(1, 0, "phase", "C1", phase="COPY"), event(2, 1000, "bytes", "A", 500), event(3, 2000, "bytes", "A", 500), event(4, 2050, "phase", "C2", phase="COPY")],
        [event(5, 5000, "bytes", "B", 2000), event(6, 5200, "queue", "B", depth=4), event(7, 5200, "throughput", "B"), event(8, 5300, "phase", "C1", phase="COPY")],
        [event(9, 9000, "phase", "C1", phase="VERIFY"), event(10, 10_000, "bytes", "A", 100), event(11, 14_000, "bytes", "B", 300), event(12, 14_000, "throughput", "A"), event(13, 14_100, "bytes", "A", 50)],
        [event(14, 14_900, "throughput", "A"), event(15, 14_950, "log", "C1")],
        [event(99, 16_000, "log", "C1", session=2)],
    ]
    plans = spark.createDataFrame([(1, 1000)], "session_id long, planned long")
    stream = monitor.watched(fed(spark, tmp_path, EVENT, batches), plans, "1 second")
    told = live.drained(stream, f"{tmp_path}/run")
    now = {r.dev: r for r in monitor.newest(told).filter("session_id = 1").collect()}
    assert {d: (r.done, r.full) for d, r in now.items()} == {"C1": (0, False), "C2": (0, False), "A": (150, False), "B": (300, True)}
    one = now["A"]
    assert (one.phase, one.phase_no, one.session_done, one.blocked) == ("VERIFY", 2, 450, "B")
    assert one.rate == round(350 * 1000 / 4100, 3) and one.eta == round(550 / (350 * 1000 / 4100), 3)
    assert one.idle == "B"  # B fell silent at 5,950 and woke no more; A was heard at 14,900, and the stream is at 15,000
    before = [r for r in told.filter("session_id = 1 AND dev = 'A'").collect() if r.phase_no == 1]
    assert max(r.done for r in before) == 1000
    assert any(r.idle == "B" and r.now == START_MS + 10_000 for r in told.collect())  # told when it was found out


def test_completion_by_expectation(spark, tmp_path):
    """Files of two, three and five devices are complete at their own number; others are told of as incomplete, in time."""
    schema = "session_id long, rel string, slot string, hash string, at timestamp"
    m = lambda rel, slot, ms, h="x": (1, rel, slot, h, at(ms))
    items = spark.createDataFrame([(1, "two", "OnlyOnC1"), (1, "five", "Twinned"), (1, "late", "Twinned"), (1, "never", "Twinned")], "session_id long, rel string, pairing string").withColumn("size", F.lit(1).cast("long"))
    volumes = spark.createDataFrame([(1, s) for s in ("C1", "C2", "A", "B", "C")], "session_id long, slot string")
    expected = plan.expected(items, volumes).filter("rel <> 'two' OR slot IN ('C1', 'A')")
    batches = [
        [m("two", "C1", 0), m("five", "C1", 10), m("five", "C2", 20), m("late", "A", 30)],
        [m("two", "A", 1000), m("five", "A", 1010), m("five", "B", 1020), m("late", "B", 1030), m("late", "B", 1040), m("two", "B", 1050), m("unknown", "A", 1060)],
        [m("five", "C", 2000, "y"), m("two", "A", 2010)],
        [m("other", "A", 5_400_000)],
    ]
    got = live.drained(live.completed(fed(spark, tmp_path, schema, batches), expected, "10 minutes"), f"{tmp_path}/run").orderBy("rel").collect()
    assert [(r.rel, r.wanted, r.complete, r.c1, r.c2, r.a, r.b, r.c) for r in got] == [("five", 5, True, "x", "x", "x", "x", "y"), ("late", 5, False, None, None, "x", "x", None), ("two", 2, True, "x", None, "x", None, None)]
    assert [r.batch for r in got if r.rel == "two"] == [1]


def test_drops_are_observed(spark, tmp_path):
    """A view that takes two events in 100 ms of a device gets the first two, over batches too, and the rest is counted."""
    batches = [[event(i, 10 * i, "bytes", "A", 1) for i in range(5)], [event(10 + i, 60 + 10 * i, "bytes", "A", 1) for i in range(6)] + [event(30, 65, "queue", "A", depth=1)], [event(40, 300, "bytes", "B", 1)]]
    shown, counts = live.view(fed(spark, tmp_path, EVENT, batches), f"{tmp_path}/run", 2, 100)
    assert sorted(r.event_id for r in shown.collect()) == [0, 1, 14, 15, 30, 40]
    assert {r.event: (r.seen, r.dropped) for r in counts.collect()} == {"bytes": (12, 7), "queue": (1, 0)}


@pytest.mark.parametrize("kind", ["drained", "view"])
def test_empty_streams(spark, tmp_path, kind):
    (tmp_path / "in0").mkdir()
    stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in0")
    out = live.drained(stream, f"{tmp_path}/run") if kind == "drained" else live.view(stream, f"{tmp_path}/run")[1]
    assert out.count() == 0 and set(out.columns) >= ({"session_id", "batch"} if kind == "drained" else {"event", "seen", "dropped"})


def test_history_is_read_once(spark, tmp_path):
    """Three batches: each entry is read in its own, and the merged sums are those of all entries together."""
    (tmp_path / "in").mkdir()
    dev = lambda slot, serial, label: {"slot": slot, "serial": serial, "label": label}
    entries = [
        {"kind": "session", "seq": 1, "at": "2026-01-01T10:00:00Z", "devices": [dev("C1", 7, "OLD"), dev("C2", 7, "")], "retries": {"C1": 2, "C2": 1}, "suspect_cards": [9]},
        {"kind": "format", "seq": 2, "at": "2026-03-01T10:00:00Z", "devices": [dev("C1", 7, "NEW")]},
        {"kind": "session", "seq": 3, "at": "2026-02-01T10:00:00Z", "devices": [dev("C1", 7, ""), dev("A", 8, "DISK")], "retries": {"A": 6}, "suspect_cards": [7]},
        {"kind": "session", "seq": 4, "at": "2026-01-15T10:00:00Z", "devices": [dev("A", 8, "")]},
    ]
    for name, own in (("a", entries[:2]), ("b", entries[2:3]), ("c", entries[3:])):
        (tmp_path / "in" / f"{name}.jsonl").write_text("".join(json.dumps(x) + "\n" for x in own) + ('{"kind":"sess' if name == "b" else ""))
    schema = f"{files.HISTORY}, seq bigint"
    with live.Counts(spark) as counts:
        summary, read = live.rolling_history(live.json_lines(spark, f"{tmp_path}/in", schema, 1), f"{tmp_path}/run")
    assert sorted(r.entries for r in read.collect()) == [1, 1, 2] and counts.found["lines"] == {"all": 5, "bad": 1}
    whole = history.summarise(history.exploded(files.json_rows(spark, f"{tmp_path}/in", schema)))
    both = [{r.serial: r.asDict() for r in x.collect()} for x in (summary, whole)]
    assert both[0] == both[1]
    got = {k: (r["sessions"], r["retries"], r["twin_mismatches"], r["formats"], r["label"], r["suspect"], r["last_seen"] and r["last_seen"].month) for k, r in both[0].items()}
    assert got == {7: (2, 3, 1, 1, "NEW", True, 2), 8: (2, 6, 0, 0, "DISK", True, 2), 9: (1, 0, 1, 0, None, True, None)}
    (tmp_path / "in" / "d.jsonl").write_text(json.dumps({"kind": "format", "seq": 5, "at": "2026-04-01T10:00:00Z", "devices": [dev("C1", 8, "")]}) + "\n")
    summary, read = live.rolling_history(live.json_lines(spark, f"{tmp_path}/in", schema, 1), f"{tmp_path}/run")  # a later run goes on
    assert [r.entries for r in read.collect()] == [1] and {r.serial: (r.sessions, r.formats) for r in summary.collect()} == {7: (2, 1), 8: (2, 1), 9: (1, 0)}


def test_manifests_arriving(spark, tmp_path):
    """Each batch of manifests is checked against what the device holds by then; one bad entry spoils its manifest alone."""
    (tmp_path / "in").mkdir()
    entry = lambda rel, h, size="<size>1</size>": f"<hash><file>{rel}</file>{size}<xxhash64be>{h}</xxhash64be></hash>"
    texts = {"m1": entry("a", "01") + entry("b", "02"), "m2": entry("a", "09"), "m3": entry("c", "03"), "m4": entry("a", "01") + entry("b", "02", "")}
    for k, (name, text) in enumerate(texts.items()):
        (tmp_path / "in" / f"{name}.mhl").write_text(f"<hashlist>{text}</hashlist>")
        import os

        os.utime(tmp_path / "in" / f"{name}.mhl", (1_700_000_000 + k, 1_700_000_000 + k))
    calls = []

    def device():
        calls.append(1)
        rows = [("s", "f", "a", f"{1:016x}"), ("s", "f", "b", f"{2:016x}")] + ([("s", "f", "c", f"{3:016x}")] if len(calls) >= 3 else [])
        return spark.createDataFrame(rows, "session_id string, folder string, rel string, hash string")

    where = (F.lit("s"), F.lit("f"), F.regexp_extract("manifest", r"([^/]+)\.mhl$", 1))
    outcomes, status = live.arriving_manifests(spark, f"{tmp_path}/in", where, device, f"{tmp_path}/run", 1)
    assert sorted((r.manifest_id, r.rel, r.outcome) for r in outcomes.collect()) == [("m1", "a", "Matched"), ("m1", "b", "Matched"), ("m2", "a", "Changed"), ("m3", "c", "Matched")]
    assert {r.manifest_id: (r.entries, r.readable) for r in status.collect()} == {"m1": (2, True), "m2": (1, True), "m3": (1, True), "m4": (2, False)}


def test_completion_keeps_state_by_part(spark, tmp_path):
    """Files of one part, over batches and sessions: each is told of once, complete or in time, and a later one of its name counts anew."""
    schema = "session_id long, rel string, slot string, hash string, at timestamp"
    m = lambda session, rel, slot, ms: (session, rel, slot, f"{slot}{ms}", at(ms))
    expected = spark.createDataFrame([(s, r, d) for s in (1, 2) for r in ("a", "b") for d in ("C1", "A")], "session_id long, rel string, slot string")
    batches = [
        [m(1, "a", "C1", 0), m(2, "a", "C1", 0), m(1, "b", "A", 5)],
        [m(1, "a", "A", 1000), m(2, "b", "C1", 900_000)],
        [m(2, "b", "A", 1_000_000), m(1, "a", "A", 1_000_000)],
        [m(1, "a", "A", 9_000_000)],
        [m(2, "z", "A", 9_000_001)],
        [m(1, "b", "C1", 9_000_001), m(1, "b", "A", 9_000_002), m(2, "z", "A", 9_000_003)],
    ]
    stream = live.completed(fed(spark, tmp_path, schema, batches), expected, "10 minutes", parts=1)
    got = sorted((r.session_id, r.rel, r.complete, r.c1, r.a) for r in live.drained(stream, f"{tmp_path}/run").collect())
    assert got == [(1, "a", True, "C10", "A1000"), (1, "b", False, None, "A5"), (1, "b", True, "C19000001", "A9000002"), (2, "a", False, "C10", None), (2, "b", True, "C1900000", "A1000000")]
