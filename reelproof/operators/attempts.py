"""Copy attempts: what a second pass mended, and reads that did not repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AT = ["session_id", "device", "rel"]


def by_pass(attempts: DataFrame, n: int) -> DataFrame:
    return attempts.filter(F.col("pass") == n).groupBy(*AT).agg(F.min("error").alias("error"))


def resolved(attempts: DataFrame) -> DataFrame:
    """Each file and device that failed first, and whether the one retry mended it."""
    again = by_pass(attempts, 2).select(*AT, F.lit(True).alias("again"))
    return by_pass(attempts, 1).join(again, AT, "left").select(*AT, "error", F.when(F.col("again"), "failed again").otherwise("recovered").alias("outcome"))


def retries(attempts: DataFrame) -> DataFrame:
    """Retries that mended a file, of each session and device."""
    return resolved(attempts).filter("outcome = 'recovered'").groupBy("session_id", "device").agg(F.count("*").alias("retries"))


def failed_paths(attempts: DataFrame) -> DataFrame:
    """Paths that stay failed, each once."""
    return by_pass(attempts, 2).select("session_id", "rel").distinct()


def unrepeatable(reads: DataFrame) -> DataFrame:
    """Files whose bytes, read twice while copying, were not the same."""
    digest = lambda n: F.max(F.when(F.col("pass") == n, F.col("hash")))
    rows = reads.filter("slot = 'SC'").groupBy("session_id", "rel").agg(digest(1).alias("h1"), digest(2).alias("h2"))
    return rows.filter("h1 <> h2").select("session_id", "rel")


def all_errors(attempts: DataFrame, scan_errors: DataFrame, failures: DataFrame) -> DataFrame:
    """A session's errors of every stage, each labelled."""
    copy = by_pass(attempts, 2).select("session_id", F.format_string("copy %s %s: %s", "device", "rel", "error").alias("line"))
    scan = scan_errors.select("session_id", F.format_string("scan %s: %s", "device", "msg").alias("line"))
    bad = failures.select("session_id", F.format_string("verify %s: %s", "rel", "kind").alias("line"))
    return copy.unionByName(scan).unionByName(bad)
