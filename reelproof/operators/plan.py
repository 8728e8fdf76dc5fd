"""Copy and verify plans: what a destination has, what it lacks, what must never be overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

DEVICES = ("C1", "C2", "A", "B", "C")
AT = ["session_id", "device", "rel"]


def rank(device: Column) -> Column:
    """The devices' fixed order."""
    return F.array_position(F.array(*[F.lit(d) for d in DEVICES]), device)


def present(items: DataFrame, volumes: DataFrame, dest_files: DataFrame) -> DataFrame:
    """Each item on each destination of its session, with what the destination has of it; done if it is the same file.

    What all destinations have of a path comes to the item together, and sessions have few slots, so rows are multiplied,
    by at most three, only after they have met.
    """
    slots = volumes.filter(~F.col("slot").isin("C1", "C2")).select("session_id", F.col("slot").alias("device"))
    there = dest_files.groupBy("session_id", "rel").agg(F.collect_list(F.struct("device", F.col("size").alias("dest_size"), F.col("mtime").alias("dest_mtime"), F.col("attrs").alias("dest_attrs"))).alias("there"))
    rows = items.select("session_id", "rel", "size", "mtime", "pairing").join(there, ["session_id", "rel"], "left").join(slots, "session_id")
    rows = rows.withColumn("x", F.explode_outer(F.filter("there", lambda x: x["device"] == F.col("device")))).select(*AT, "size", "mtime", "pairing", "x.dest_size", "x.dest_mtime", "x.dest_attrs")
    same = ~paths.is_cloud_placeholder(F.col("dest_attrs")) & (F.col("dest_size") == F.col("size")) & paths.mtimes_match(F.col("mtime"), F.col("dest_mtime"))
    return rows.withColumn("done", F.coalesce(same, F.lit(False)) & F.col("dest_size").isNotNull())


def clashes(checked: DataFrame) -> DataFrame:
    """Files in the way of a copy, and why they are not the file itself."""
    reason = F.when(paths.is_cloud_placeholder(F.col("dest_attrs")), "Placeholder").when(F.col("size") == F.col("dest_size"), "Modified").otherwise("Size")
    return checked.filter("dest_size IS NOT NULL AND NOT done").select(*AT, reason.alias("reason"))


def clash_advice(found: DataFrame) -> DataFrame:
    """What a session's clashes amount to."""
    n, modified, held = F.count("*"), F.count_if(F.col("reason") == "Modified"), F.count_if(F.col("reason") == "Placeholder")
    advice = F.when(n == modified, "edited since").when(held > 0, "not downloaded").otherwise("another session's work")
    return found.groupBy("session_id").agg(n.alias("clashes"), advice.alias("advice"))


def needed(checked: DataFrame) -> DataFrame:
    """What is still to copy."""
    return checked.filter("NOT done").select(*AT, "size", "pairing")


def skipped(checked: DataFrame) -> DataFrame:
    """Items that every destination has."""
    return checked.groupBy("session_id", "rel").agg(F.bool_and("done").alias("all_done")).filter("all_done").select("session_id", "rel")


def bytes_needed(checked: DataFrame, volumes: DataFrame) -> DataFrame:
    """Bytes to come to each destination, against its free space."""
    sums = needed(checked).groupBy("session_id", "device").agg(F.sum("size").alias("need"))
    rows = volumes.filter(~F.col("slot").isin("C1", "C2")).select("session_id", F.col("slot").alias("device"), "free_bytes").join(sums, ["session_id", "device"], "left")
    need = F.coalesce("need", F.lit(0))
    return rows.select("session_id", "device", need.alias("need"), "free_bytes", (need > F.col("free_bytes")).alias("refused"))


def copy_plan(checked: DataFrame) -> DataFrame:
    """Files and bytes to write to each destination, and to read from each card (once, however many need them)."""
    todo = needed(checked).withColumn("card", F.when(F.col("pairing") == "OnlyOnC2", "C2").otherwise("C1"))
    out = todo.groupBy("session_id", "device").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    read = todo.select("session_id", "card", "rel", "size").distinct().groupBy("session_id", F.col("card").alias("device")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return out.unionByName(read)


def expected(items: DataFrame, volumes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The measurements that a session's files call for; keep names further columns of items."""
    rows = items.select("session_id", "rel", "size", "pairing", *keep).join(volumes.select("session_id", "slot"), "session_id")
    return rows.filter(paths.expected_on(F.col("slot"), F.col("pairing")))


def verify_plan(expected_: DataFrame) -> DataFrame:
    """Bytes to read of each device, and of each session (device null)."""
    return expected_.rollup("session_id", "slot").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).filter("session_id IS NOT NULL")
