"""Rechecks: what a device holds against what its manifests say. A folder is one of its session's drive: drives may share names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths


def validated(entries: DataFrame) -> DataFrame:
    """Entries with their path made plain and what is wrong with each, if anything."""
    rel = paths.normalise(F.col("rel"))
    lacks = F.col("hash").isNull()
    error = (
        F.when(rel.isNull() | (rel == ""), "no file").when(F.col("size").isNull(), "no size").when(lacks & F.col("other_hash").isNotNull(), "hashed by another algorithm")
        .when(lacks, "no hash").when(~paths.is_contained(rel), "path leaves the folder")
    )
    return entries.withColumn("rel", rel).withColumn("error", error)


def manifest_status(checked: DataFrame) -> DataFrame:
    """One bad entry makes its whole manifest unreadable."""
    return checked.groupBy("session_id", "folder", "manifest_id").agg(F.min("error").alias("error"), F.count("*").alias("entries")).withColumn("readable", F.col("error").isNull())


def readable(checked: DataFrame) -> DataFrame:
    bad = manifest_status(checked).filter("NOT readable").select("session_id", "manifest_id")
    return checked.join(bad, ["session_id", "manifest_id"], "left_anti")


def recheck(entries: DataFrame, device: DataFrame) -> DataFrame:
    """Each entry against the device, by digest alone."""
    there = device.select("session_id", "folder", "rel", F.col("hash").alias("found"), F.lit(True).alias("there"))
    rows = entries.join(there, ["session_id", "folder", "rel"], "left")
    outcome = F.when(F.col("there").isNull(), "Missing").when(F.col("found").isNull(), "Unreadable").when(F.col("found") == F.col("hash"), "Matched").otherwise("Changed")
    return rows.select("session_id", "folder", "manifest_id", "rel", "size", outcome.alias("outcome"))


def extras(entries: DataFrame, device: DataFrame) -> DataFrame:
    """Files of the device that a manifest of the folder does not list, litter and sidecars apart."""
    files = device.filter(~paths.in_litter_dir(F.col("rel")) & ~paths.is_litter_file(F.col("rel")) & ~paths.is_sidecar(F.col("rel"))).select("session_id", "folder", "rel")
    manifests = entries.select("session_id", "folder", "manifest_id").distinct()
    return files.join(manifests, ["session_id", "folder"]).join(entries.select("session_id", "manifest_id", "rel"), ["session_id", "manifest_id", "rel"], "left_anti").select("session_id", "folder", "manifest_id", "rel")


def residual(entries: DataFrame, device: DataFrame) -> DataFrame:
    """Files that no manifest of the folder lists."""
    files = device.filter(~paths.in_litter_dir(F.col("rel")) & ~paths.is_litter_file(F.col("rel")) & ~paths.is_sidecar(F.col("rel"))).select("session_id", "folder", "rel")
    return files.join(entries.select("session_id", "folder", "rel").distinct(), ["session_id", "folder", "rel"], "left_anti").select("session_id", "folder", "rel")


def unvouched(device: DataFrame, entries: DataFrame) -> DataFrame:
    """Folders without a manifest."""
    return device.select("session_id", "folder").distinct().join(entries.select("session_id", "folder").distinct(), ["session_id", "folder"], "left_anti").select("session_id", "folder")


def headline(outcomes: DataFrame) -> DataFrame:
    """A manifest's counts."""
    ok = F.col("outcome") == "Matched"
    read = F.sum(F.when(F.col("outcome").isin("Matched", "Changed"), F.col("size")).otherwise(0))
    return outcomes.groupBy("session_id", "folder", "manifest_id").agg(F.count_if(ok).alias("matched"), F.count_if(~ok).alias("failures"), F.bool_and(ok).alias("intact"), read.alias("bytes_hashed"))


def sweep(device: DataFrame, checked: DataFrame, good: DataFrame | None = None) -> DataFrame:
    """The state of each folder, the first that fits, and whether it is vouched for. good: what readable(checked) gives."""
    status = manifest_status(checked).groupBy("session_id", "folder").agg(F.bool_and("readable").alias("readable"), F.count("*").alias("manifests"))
    good = readable(checked) if good is None else good
    counts = recheck(good, device).groupBy("session_id", "folder").agg(F.count_if(F.col("outcome") != "Matched").alias("bad"), F.count_if(F.col("outcome") == "Matched").alias("matched"))
    rest = residual(good, device).groupBy("session_id", "folder").agg(F.count("*").alias("residual"))
    rows = device.select("session_id", "folder").unionByName(checked.select("session_id", "folder")).distinct()
    for x in (status, counts, rest):
        rows = rows.join(x, ["session_id", "folder"], "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("bad", "matched", "residual")}
    state = F.when(F.col("manifests").isNull(), "NO MANIFEST").when(~F.col("readable"), "UNREADABLE").when(n["bad"] > 0, "DAMAGED").when(n["residual"] > 0, "INTACT").when(n["matched"] == 0, "EMPTY MANIFEST").otherwise("INTACT")
    vouched = F.col("manifests").isNotNull() & F.coalesce("readable", F.lit(False)) & (n["bad"] == 0) & (n["residual"] == 0) & (n["matched"] > 0)
    return rows.select("session_id", "folder", state.alias("state"), vouched.alias("clean"), n["matched"].alias("matched"), n["bad"].alias("bad"), n["residual"].alias("residual"))


def drive(swept: DataFrame) -> DataFrame:
    """Folders of each state on the drive; it is clean if all are."""
    return swept.groupBy("state", "clean").agg(F.count("*").alias("folders"), F.sum("matched").alias("matched"))


def first_lines(outcomes: DataFrame, n: int = 5) -> DataFrame:
    """K5: the first lines of each folder that are not matched."""
    order = Window.partitionBy("session_id", "folder").orderBy("rel", "manifest_id")
    return outcomes.filter("outcome <> 'Matched'").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= n).select("session_id", "folder", "k", "rel", "outcome")
