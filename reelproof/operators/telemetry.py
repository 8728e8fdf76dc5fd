"""Telemetry over time: phases, rates, progress, the state of each device."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .plan import rank

RATE_MS, MIN_MS, SMOOTH, STALE_MS, HISTORY = 12_000, 2_000, 10, 750, 120


def placed(rows: DataFrame, key: str) -> DataFrame:
    """K6: rows with their place in the order of a key, from 1, over all rows: numbered range by range, not in one task."""
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    dealt = kept(rows.repartitionByRange(parts, key).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("_range").alias("_above"), F.col("n"))
    starts = sizes.select("_range").join(F.broadcast(before), F.col("_above") < F.col("_range"), "left").groupBy("_range").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return dealt.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn("place", F.col("_start") + F.col("_own")).drop("_range", "_own", "_start")


def phased(events: DataFrame) -> DataFrame:
    """Events with the number of their phase: it goes up only where the phase changes, not where it is said again."""
    session = Window.partitionBy("session_id").orderBy("at", "event_id")
    rows = events.withColumn("said", F.when(F.col("event") == "phase", F.col("phase")))
    rows = rows.withColumn("now", F.last("said", ignorenulls=True).over(session.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("now").over(session)
    new = F.when(F.col("now").isNotNull() & ~F.col("now").eqNullSafe(before), 1).otherwise(0)
    rows = rows.withColumn("new", new).withColumn("phase_no", F.sum("new").over(session.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.drop("said", "new").withColumn("ms", F.unix_millis("at"))


def phase_times(rows: DataFrame) -> DataFrame:
    """Each phase's start and length; the last ends with the last event."""
    spans = rows.filter("phase_no > 0").groupBy("session_id", "phase_no").agg(F.first("now", ignorenulls=True).alias("phase"), F.min("ms").alias("from_ms"), F.max("ms").alias("last_ms"))
    nxt = F.lead("from_ms").over(Window.partitionBy("session_id").orderBy("phase_no"))
    return spans.select("session_id", "phase_no", "phase", "from_ms", (F.coalesce(nxt, F.col("last_ms")) - F.col("from_ms")).alias("length_ms"))


def phase_totals(times: DataFrame) -> DataFrame:
    """Time in each phase, over all its intervals."""
    return times.groupBy("session_id", "phase").agg(F.sum("length_ms").alias("ms"), F.count("*").alias("intervals"))


def cumulative(rows: DataFrame) -> DataFrame:
    """Bytes of each device so far in its phase."""
    w = Window.partitionBy("session_id", "phase_no", "dev").orderBy("ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.filter("event = 'bytes'").select("session_id", "phase_no", "dev", "event_id", "ms", F.sum("delta").over(w).alias("done"))


def rates(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Bytes a second over the last 12 s, and seconds to go of each session's plan (session_id, bytes), if it has one."""
    plans = plans.select("session_id", F.col("bytes").alias("planned"))
    phase = Window.partitionBy("session_id", "phase_no").orderBy("ms", "event_id")
    run = rows.filter("event = 'bytes'").withColumn("done", F.sum("delta").over(phase.rowsBetween(Window.unboundedPreceding, 0)))
    recent = Window.partitionBy("session_id", "phase_no").orderBy("ms").rangeBetween(-RATE_MS, 0)
    run = run.withColumns({"ms0": F.min("ms").over(recent), "done0": F.min("done").over(recent), "start": F.min("ms").over(phase.rowsBetween(Window.unboundedPreceding, 0))})
    dt, db = F.col("ms") - F.col("ms0"), F.col("done") - F.col("done0")
    rate = F.when((dt >= MIN_MS) & (db > 0), db * 1000.0 / dt)
    elapsed = F.col("ms") - F.col("start")
    run = run.join(plans, "session_id", "left")
    left = F.greatest(F.col("planned") - F.col("done"), F.col("planned") * 0)  # null where there is no plan
    mean = F.try_divide(F.col("done") * 1000.0, elapsed)
    eta = F.when(left == 0, 0.0).when((F.col("done") > 0) & (elapsed >= MIN_MS), F.try_divide(left, F.coalesce(rate, mean)))
    return run.select("session_id", "phase_no", "event_id", F.round(rate, 3).alias("rate"), F.round(eta, 3).alias("eta"))


def smoothed(rows: DataFrame) -> DataFrame:
    """Mean of a device's last ten rates, the highest so far, and whether it then falls idle."""
    w = Window.partitionBy("session_id", "dev").orderBy("ms", "event_id")
    run = rows.filter("event = 'throughput'")
    mean = F.avg("mbps").over(w.rowsBetween(1 - SMOOTH, 0))
    gap = F.lead("ms").over(w) - F.col("ms")
    run = run.withColumns({"mean": mean, "idle": F.coalesce(gap > STALE_MS, F.lit(True))})
    return run.select("session_id", "dev", "event_id", F.round("mean", 6).alias("smoothed"), F.round(F.max("mbps").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("peak"), "idle")


def recent_samples(rows: DataFrame, n: int = HISTORY) -> DataFrame:
    """A device's last n rates, oldest first."""
    back = F.row_number().over(Window.partitionBy("session_id", "dev").orderBy(F.desc("ms"), F.desc("event_id")))
    last = rows.filter("event = 'throughput'").withColumn("k", back).filter(F.col("k") <= n)
    return last.select("session_id", "dev", (F.count("*").over(Window.partitionBy("session_id", "dev")) - F.col("k")).alias("pos"), "mbps")


def latest(rows: DataFrame) -> DataFrame:
    """Each device's newest queue depth and rate."""
    when = F.struct("ms", "event_id")
    of = lambda e, c: F.max_by(F.when(F.col("event") == e, F.col(c)), F.when(F.col("event") == e, when))
    return rows.groupBy("session_id", "dev").agg(of("queue", "depth").alias("depth"), of("queue", "cap").alias("cap"), of("throughput", "mbps").alias("mbps"))


def blocked(state: DataFrame) -> DataFrame:
    """T4 in batch: the first device of a session, in their order, whose queue is full."""
    full = state.filter("cap > 0 AND depth >= cap")
    return full.groupBy("session_id").agg(F.min_by("dev", rank(F.col("dev"))).alias("dev"))


def current(rows: DataFrame) -> DataFrame:
    """What each event's device last said in a log line, up to then."""
    w = Window.partitionBy("session_id", "dev").orderBy("ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("session_id", "dev", "event_id", F.last(F.when(F.col("event") == "log", F.col("msg")), ignorenulls=True).over(w).alias("current"))


def moved(rows: DataFrame) -> DataFrame:
    """Bytes moved in a phase: of all devices where they are verified, else of the destination that has most."""
    per = rows.filter("event = 'bytes' AND phase_no > 0").groupBy("session_id", "phase_no", F.col("now").alias("phase"), "dev").agg(F.sum("delta").alias("n"))
    most = F.coalesce(F.max(F.when(F.col("dev").isin("A", "B", "C"), F.col("n"))), F.lit(0))
    return per.groupBy("session_id", "phase_no", "phase").agg(F.when(F.col("phase") == "VERIFY", F.sum("n")).otherwise(most).alias("moved"))


def progress(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The share of its plan (session_id, dev, bytes) that each device has done in a phase, from 0 to 1; 0 of none, 1 of an empty one."""
    done = rows.filter("event = 'bytes'").groupBy("session_id", "phase_no", "dev").agg(F.sum("delta").alias("done"))
    done = done.join(plans.select("session_id", "dev", "bytes"), ["session_id", "dev"], "left")
    part = F.least(F.greatest(F.try_divide(F.col("done"), F.col("bytes")), F.lit(0.0)), F.lit(1.0))
    share = F.when(F.col("bytes").isNull(), 0.0).when(F.col("bytes") == 0, 1.0).otherwise(part)
    return done.select("session_id", "phase_no", "dev", F.round(share, 6).alias("share"))


def level_counts(rows: DataFrame) -> DataFrame:
    """Log lines of each level, and of all (null)."""
    return rows.filter("event = 'log'").rollup("level").agg(F.count("*").alias("n"))


def tail(rows: DataFrame, n: int = 50_000) -> DataFrame:
    """Each session's newest log lines."""
    k = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ms"), F.desc("event_id")))
    return rows.filter("event = 'log'").withColumn("k", k).filter(F.col("k") <= n).select("session_id", "event_id", "k")


def coalesced(events: DataFrame) -> DataFrame:
    """Bytes and MB/s of each device in each 100 ms."""
    w = F.window("at", "100 milliseconds")
    return events.filter("event = 'bytes'").groupBy("session_id", "dev", w.alias("w")).agg(F.sum("delta").alias("bytes")).select("session_id", "dev", F.col("w.start").alias("at"), "bytes", F.round(F.col("bytes") / 1e6 / 0.1, 6).alias("mbps"))
