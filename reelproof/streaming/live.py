"""Live telemetry: the batch operators' counterparts over streams."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import formats
from ..operators import history, recheck
from ..sources import files

LATE = "10 minutes"
FORGET_MS = 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocks(spark: SparkSession) -> None:
    """State of several variables needs the RocksDB store; a session's own choice of it stays."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def split_sinks(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What must be kept, and what may be dropped when the view is behind."""
    lossy = formats.is_droppable(F.col("event"))
    return events.filter(~lossy), events.filter(lossy)


def coalesced(events: DataFrame) -> DataFrame:
    """Bytes of each device in each 100 ms; events over ten minutes late are left out."""
    rows = events.filter("event = 'bytes'").withWatermark("at", LATE)
    out = rows.groupBy("session_id", "dev", F.window("at", "100 milliseconds").alias("w")).agg(F.sum("delta").alias("bytes"))
    return out.select("session_id", "dev", F.col("w.start").alias("at"), "bytes", F.round(F.col("bytes") / 1e6 / 0.1, 6).alias("mbps"))


def idle_gaps(events: DataFrame, gap_ms: int = 750) -> DataFrame:
    """T5: a device's spells of activity, each told again when it changes; the end of one is when the device falls idle.

    The newest row of each (session_id, dev, active_from) holds; one of no samples has become part of an earlier spell.
    State holds the spells that late events may still change, and ends with them.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        spells = [list(x) for x in zip(*state.get, strict=True)] if state.exists else []
        before = {s[0]: s for s in spells}
        spells += [[ms, ms + gap_ms * 1000, 1] for b in batches for ms in b["us"].tolist()]
        merged: list[list[int]] = []
        for start, stop, n in sorted(spells):
            if merged and start <= merged[-1][1]:
                merged[-1][1], merged[-1][2] = max(stop, merged[-1][1]), merged[-1][2] + n
            else:
                merged.append([start, stop, n])
        now = {s[0]: s for s in merged}
        told = [s for s in merged if before.get(s[0]) != s] + [[x, before[x][1], 0] for x in before if x not in now]
        open_ = [s for s in merged if s[1] > state.getCurrentWatermarkMs() * 1000] or merged[-1:]
        state.update(tuple(map(list, zip(*open_, strict=True))))
        state.setTimeoutTimestamp(max(open_[-1][1] // 1000, state.getCurrentWatermarkMs()) + 1)
        at = lambda k: pd.to_datetime([s[k] for s in told], unit="us")
        yield pd.DataFrame({"session_id": [key[0]] * len(told), "dev": [key[1]] * len(told), "active_from": at(0), "idle_from": at(1), "samples": [s[2] for s in told]})

    rows = events.filter("event = 'throughput'").withWatermark("at", LATE).select("session_id", "dev", "at", F.unix_micros("at").alias("us"))
    return rows.groupBy("session_id", "dev").applyInPandasWithState(
        fold, "session_id long, dev string, active_from timestamp, idle_from timestamp, samples long", "start array<long>, stop array<long>, n array<long>", "update", GroupStateTimeout.EventTimeTimeout
    )


SLOTS = ("SC", "C1", "C2", "A", "B", "C")
COMPLETED = "session_id long, rel string, at timestamp, wanted int, complete boolean, sc string, c1 string, c2 string, a string, b string, c string"


OPEN = pa.schema([("session_id", pa.int64()), ("rel", pa.string()), ("last", pa.int64()), ("due", pa.int64()), ("wanted", pa.int32()), ("told", pa.bool_()), ("slots", pa.list_(pa.string())), ("hashes", pa.list_(pa.string()))])


class Barrier(StatefulProcessor):
    """Measurements of a part of all files, each file's until all that are wanted have come, or the newest is `wait` ms old.

    A part's open files are one value of its state, an Arrow batch, so that the store is asked a few times for each part
    of a batch, not for each file. A part has one timer, that of the file due first.
    """

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "files binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        files, now, changed = self.held(), timerValues.getCurrentWatermarkInMs(), {}
        for batch in rows:
            for session, rel, slot, hash_, us, wanted in zip(*(batch[c].tolist() for c in ("session_id", "rel", "slot", "hash", "us", "wanted")), strict=True):
                last, due, _, told, seen = files.get((session, rel), (0, 0, 0, False, {}))
                if not told:
                    seen[slot] = hash_
                files[session, rel], changed[session, rel] = (max(last, us), due, wanted, told, seen), True
        complete = {}
        for name in changed:
            last, due, wanted, told, seen = files[name]
            if due < last // 1000 + self.wait:
                due = max(last // 1000, now) + self.wait
            if not told and len(seen) >= wanted:
                complete[name] = files[name]
                told, seen = True, {}
            files[name] = (last, due, wanted, told, seen)
        self.hold(files)
        yield self.rows(complete, True)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        files, now = self.held(), timerValues.getCurrentWatermarkInMs()
        over = {name: f for name, f in files.items() if f[1] < now}
        if over:
            self.hold({name: f for name, f in files.items() if name not in over})
        yield self.rows({name: f for name, f in over.items() if not f[3]}, False)

    def held(self) -> dict[tuple, tuple]:
        found = self.open.get()
        if not found:
            return {}
        session, rel, last, due, wanted, told, slots, hashes = (c.to_pylist() for c in pa.ipc.open_stream(pa.py_buffer(bytes(found[0]))).read_all().columns)
        return {name: (*f, dict(zip(s, h, strict=True))) for name, f, s, h in zip(zip(session, rel, strict=True), zip(last, due, wanted, told, strict=True), slots, hashes, strict=True)}

    def hold(self, files: dict[tuple, tuple]) -> None:
        if not files:
            self.open.clear()
            return
        rows = [(*name, *f[:4], list(f[4]), list(f[4].values())) for name, f in files.items()]
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, OPEN) as stream:
            stream.write(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), OPEN.types, strict=True)], schema=OPEN))
        self.open.update((out.getvalue().to_pybytes(),))
        self.handle.registerTimer(min(f[1] for f in files.values()))

    def rows(self, files: dict[tuple, tuple], complete: bool) -> pd.DataFrame:
        of = list(files.values())
        told = {"session_id": [n[0] for n in files], "rel": pd.Series([n[1] for n in files], dtype=object), "at": pd.to_datetime([f[0] for f in of], unit="us", utc=True), "wanted": [f[2] for f in of], "complete": [complete] * len(of)}
        return pd.DataFrame(told | {s.lower(): pd.Series([f[4].get(s) for f in of], dtype=object) for s in SLOTS})


def completed(measured: DataFrame, expected: DataFrame, wait: str = "1 hour", parts: int = 512) -> DataFrame:
    """Each file once: when all measurements that J9 expects of it have come, or as incomplete, `wait` after the newest.

    measured (session_id, rel, slot, hash, at); expected (session_id, rel, slot), a table: a file waits for as many as it
    has rows there, and others' measurements are left out. COMPLETED: hashes by slot, as diagnose() reads them, and
    whether they are all; an incomplete file is one of missing copies (J10). Files of which nothing ever comes are not
    told of here. State ends `wait` after a file's newest measurement; what comes later counts as a file of its own. Files
    are dealt to so many parts, whose state is theirs; of a part that a batch has rows of, all open files are written anew.
    """
    with_rocks(measured.sparkSession)
    counts = expected.groupBy("session_id", "rel").agg(F.countDistinct("slot").cast("int").alias("wanted"))
    rows = measured.withWatermark("at", LATE).select("session_id", "rel", "slot", "hash", "at", F.unix_micros("at").alias("us"))
    rows = rows.join(expected.select("session_id", "rel", "slot").distinct(), ["session_id", "rel", "slot"]).join(counts, ["session_id", "rel"])
    ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    return rows.withColumn("part", F.pmod(F.xxhash64("session_id", "rel"), F.lit(parts))).groupBy("part").transformWithStateInPandas(Barrier(ms), COMPLETED, "Append", "EventTime")


def aborts(diagnosed: DataFrame) -> DataFrame:
    """Each session's signal to stop, once: the first file (session_id, rel, kind, at) with a systematic fault."""

    def first(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        found = pd.concat(list(batches)).sort_values(["at", "rel"])
        told = state.exists
        state.update((True,))
        state.setTimeoutTimestamp(max(int(found["ms"].max()), state.getCurrentWatermarkMs()) + FORGET_MS)
        if not told:
            yield found[["session_id", "rel", "at"]].head(1)

    rows = diagnosed.filter("kind = 'Systematic'").withWatermark("at", LATE).select("session_id", "rel", "at", F.unix_millis("at").alias("ms"))
    return rows.groupBy("session_id").applyInPandasWithState(first, "session_id long, rel string, at timestamp", "told boolean", "append", GroupStateTimeout.EventTimeTimeout)


class Limit(StatefulProcessor):
    """Lets so many events of a key through in each `every` ms of event time, in the order in which they come."""

    def __init__(self, most: int, every: int, late: int):
        self.most, self.every, self.late = most, every, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "at array<long>, n array<long>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        used = dict(zip(*self.used.get(), strict=True)) if self.used.exists() else {}
        for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
            slot = r["ms"] // self.every
            used[slot] = used.get(slot, 0) + 1
            if used[slot] <= self.most:
                yield Row(**{c: r[c] for c in r.__fields__ if c != "ms"})
        open_ = {k: v for k, v in used.items() if (k + 1) * self.every > timerValues.getCurrentWatermarkInMs()}
        self.used.update((list(open_), list(open_.values())))
        self.handle.registerTimer((max(used) + 1) * self.every + self.late)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.used.exists() and all((k + 1) * self.every <= timerValues.getCurrentWatermarkInMs() for k in self.used.get()[0]):
            self.used.clear()
        return iter(())


def limited(lossy: DataFrame, most: int = 1, every_ms: int = 100) -> DataFrame:
    """What a view that takes `most` events of each session, device and kind in every_ms gets of a lossy stream."""
    with_rocks(lossy.sparkSession)
    rows = lossy.withWatermark("at", LATE)
    return rows.withColumn("ms", F.unix_millis("at")).groupBy("session_id", "dev", "event").transformWithState(Limit(most, every_ms, 1000), rows.schema, "Append", "EventTime")


class Counts(StreamingQueryListener):
    """Adds up what observe() has seen under each name, over all batches of one query. Use as a context around its run."""

    def __init__(self, spark: SparkSession):
        self.spark, self.found, self.ended = spark, {}, threading.Event()

    def __enter__(self) -> Counts:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.ended.wait(60)
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            own = self.found.setdefault(name, {})
            for k, v in row.asDict().items():
                own[k] = own.get(k, 0) + (v or 0)

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def tallied(stream: DataFrame, name: str, kinds: tuple[str, ...]) -> DataFrame:
    """stream, its rows of each kind of event counted under a name as they pass."""
    return stream.observe(name, F.count("*").alias("all"), *[F.count_if(F.col("event") == k).alias(k) for k in kinds])


def view(stream: DataFrame, path: str, most: int = 1, every_ms: int = 100, kinds: tuple[str, ...] = ("bytes", "queue", "throughput")) -> tuple[DataFrame, DataFrame]:
    """Feeds a view as fast as it may take, and counts what it does not get: the view's rows, and (event, seen, dropped).

    Both counts are observed while the query runs: before the limit, and after it.
    """
    spark = stream.sparkSession
    with Counts(spark) as counts:
        fed = tallied(limited(tallied(stream, "seen", kinds), most, every_ms), "shown", kinds)
        shown = drained(fed, path)
    seen, got = (counts.found.get(k, {}) for k in ("seen", "shown"))
    rows = [(k, seen[k], seen[k] - got.get(k, 0)) for k in kinds if seen.get(k)]
    return shown, spark.createDataFrame(rows, "event string, seen long, dropped long")


def drained(stream: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """What a stream has to give of the input that is there, through a table at path: a folder for each batch.

    A batch that is tried again writes its folder again, so its rows are there once. each makes of a batch and its number
    what is written, if not the batch itself. A stream that gives nothing has an empty table.
    """
    spark = stream.sparkSession
    made: list[DataFrame] = []

    def put(batch: DataFrame, n: int) -> None:
        rows = each(batch, n) if each else batch
        made[:] = [rows]
        rows.write.mode("overwrite").parquet(f"{path}/out/batch={n}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    schema = made[0].schema if made else each(spark.createDataFrame([], stream.schema), -1).schema if each else stream.schema
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/out")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).parquet(f"{path}/out")


def stored(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that have a folder of their own at path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(x.getPath().getName().removeprefix("batch=")) for x in store.listStatus(folder) if x.getPath().getName().startswith("batch=")) if store.exists(folder) else []


def rolling_history(entries: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The device summary kept up with a stream of history entries (kind, seq, at, devices, retries, suspect_cards).

    Each batch is summed by itself and merged into the sums so far, one version of them for each batch, so an entry is
    read once and only sums are read again. A batch that is tried again merges into the version before it. Returns the
    summary, and how many entries each batch has read (batch, entries, serials).
    """
    spark = entries.sparkSession
    read: list[tuple[int, int, int]] = []

    def put(batch: DataFrame, n: int) -> None:
        seen = Observation()
        history.partial(history.exploded(batch.observe(seen, F.count("*").alias("n")))).write.mode("overwrite").parquet(f"{path}/parts/batch={n}")  # all that is read of the batch
        own = spark.read.parquet(f"{path}/parts/batch={n}")
        before = [v for v in stored(spark, f"{path}/sums") if v < n]  # of runs before this one, too
        sums = history.merged(spark.read.parquet(f"{path}/sums/batch={before[-1]}"), own) if before else own
        sums.write.mode("overwrite").parquet(f"{path}/sums/batch={n}")
        read.append((n, seen.get["n"], spark.read.parquet(f"{path}/sums/batch={n}").count()))

    query = entries.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    versions = stored(spark, f"{path}/sums")
    sums = spark.read.parquet(f"{path}/sums/batch={versions[-1]}") if versions else history.partial(history.exploded(spark.createDataFrame([], entries.schema)))
    return history.finished(sums), spark.createDataFrame(read, "batch int, entries long, serials long")


def json_lines(spark: SparkSession, path: str, schema: str, files_at_once: int | None = None) -> DataFrame:
    """JSON lines as a stream of files; those that are no JSON are counted, as `bad` of all, under the name lines."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    rows = (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).text(path).select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    rows = rows.select("r.*").observe("lines", F.count("*").alias("all"), F.count_if(F.col("_bad").isNotNull()).alias("bad"))
    return rows.filter("_bad IS NULL").drop("_bad")


def arriving_manifests(spark: SparkSession, path: str, where: tuple[Column, Column, Column], device: Callable[[], DataFrame], out: str, files_at_once: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Manifests checked as their files arrive: outcomes of their entries, and the state of each manifest.

    where says, of a file's path, its session, folder and manifest. A manifest arrives whole, so one bad entry makes it
    unreadable (S7) when it is read. device gives what the device holds by then; each batch asks for it anew.
    """
    reader = spark.readStream.format("xml").option("rowTag", "hash").option("ignoreNamespace", "true").option("recursiveFileLookup", "true").schema(files.ENTRY)
    said = files.entries_of((reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).load(path), F.col("_metadata.file_modification_time").alias("arrived"))
    said = said.withWatermark("arrived", LATE).withColumn("manifest", files.plain_path(F.col("manifest")))
    names = [c.alias(n) for c, n in zip(where, ("session_id", "folder", "manifest_id"), strict=True)]

    def checked(batch: DataFrame) -> DataFrame:
        return recheck.validated(batch.select(*names, "rel", "size", "hash", "other_hash"))

    def put(batch: DataFrame, n: int) -> DataFrame:
        if n >= 0:
            recheck.manifest_status(checked(batch)).write.mode("overwrite").parquet(f"{out}/status/batch={n}")
        return recheck.recheck(recheck.readable(checked(batch)), device())

    outcomes = drained(said, out, each=put)
    return outcomes, spark.read.schema("session_id string, folder string, manifest_id string, error string, entries long, readable boolean, batch int").parquet(f"{out}/status")
