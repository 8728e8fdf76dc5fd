"""Verdicts: whether a session's originals may be erased, always failing towards no."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

RETRY_CEILING = 5
# Each verdict's headline, exit code, and whether it authorises erasing, calls the copy good, says that something is wrong.
VERDICTS = (
    ("SAFE_TO_FORMAT", "SAFE TO FORMAT", 0, True, True, False),
    ("VERIFIED_ONE_SOURCE", "VERIFIED — ONE SOURCE", 10, False, True, False),
    ("VERIFIED_ONE_COPY", "VERIFIED — ONE COPY", 11, False, True, False),
    ("VERIFIED_DO_NOT_FORMAT", "VERIFIED — DO NOT FORMAT", 12, False, True, True),
    ("FAILED", "FAILED", 20, False, False, True),
)


def dimension(spark: SparkSession) -> DataFrame:
    """What each verdict means."""
    return spark.createDataFrame(VERDICTS, "verdict string, headline string, exit_code int, authorises_erase boolean, copy_is_good boolean, something_is_wrong boolean")


def assessment(sessions: DataFrame, summary: DataFrame, volumes: DataFrame, states: DataFrame, retries: DataFrame, scan_errors: DataFrame, failures: DataFrame, evidence: DataFrame) -> DataFrame:
    """Everything that a verdict looks at, a row a session, sessions without files included.

    evidence (session_id, slot, from_device): a destination of which anything was not read from its device is no surer
    than one on a network, nor is one that nothing was read of.
    """
    failed = failures.groupBy("session_id").agg(F.count("*").alias("failures"))
    over = retries.groupBy("session_id").agg(F.max("retries").alias("most_retries"))
    dest = ~F.col("slot").isin("C1", "C2")
    local, read = paths.is_verifiable(F.col("drive_type")), F.coalesce("from_device", F.lit(False))
    volumes = volumes.join(evidence, ["session_id", "slot"], "left")
    disks = volumes.groupBy("session_id").agg(F.count_if(dest).alias("dest_count"), F.count_if(dest & local & read).alias("sure_dests"), F.count_if(dest & local & ~read).alias("cached_dests"), F.count_if(dest & ~local).alias("network_dests"))
    rows = sessions.join(summary.drop("had_card2"), "session_id", "left")
    for x in (failed, over, disks, states, scan_errors):
        rows = rows.join(x, "session_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("failures", "most_retries", "dest_count", "sure_dests", "cached_dests", "network_dests", "scan_errors", "conflicts", "untwinned", "twinned")}
    rows = rows.withColumns(zero).withColumns({"dests": F.coalesce("dests", F.lit("Unproven")), "dest_on_card": F.coalesce("dest_on_card", F.lit(False))})
    return rows.withColumns({"files": F.col("twinned") + F.col("untwinned"), "twin_matched": F.col("had_card2") & (F.col("untwinned") == 0) & (F.col("conflicts") == 0)})


def ladder(rows: DataFrame) -> DataFrame:
    """The verdict and its reasons in their order, one code each."""
    c = F.col
    say = lambda test, text: F.when(test, F.lit(text))
    listed = lambda *xs: F.array_compact(F.array(*xs))
    broken = listed(say(c("aborted").isNotNull(), "aborted"), say(c("failures") > 0, "failures"), say(c("conflicts") > 0, "conflicts"))
    two = c("dest_count") >= 2
    network, cached = c("network_dests") > 0, c("cached_dests") > 0
    leaning = ~((c("sure_dests") >= 2) & (c("dests") == "Distinct"))  # on destinations that prove less
    faults = listed(
        say(c("files") == 0, "no files"), say(c("dest_on_card"), "destination on a card"), say(c("scan_errors") > 0, "scan errors"), say(c("most_retries") > RETRY_CEILING, "too many retries"),
        say(F.coalesce(c("cards") == "SameDevice", F.lit(False)), "cards are one device"), say(leaning & network, "network destination"), say(leaning & cached, "destination not read from its device"),
        say(two & (c("dests") == "SameDevice"), "destinations are one device"), say(two & (c("dests") == "Unproven"), "destinations not proven distinct"),
    )
    notes = listed(say(network & ~leaning, "network note"), say(cached & ~leaning, "cached read note"))
    gaps = F.concat(notes, listed(
        say(~two, "one destination"), F.when(~c("twin_matched"), F.when(~c("had_card2"), "no second card").otherwise("not all twinned")), say(~c("twin_matched") & c("card_mode").isNotNull() & (c("card_mode") != "Backup"), "card mode"),
    ))
    only_notes = c("twin_matched") & two & (c("files") > 0) & (F.size(gaps) == F.size(notes))
    unwritten = ~c("manifests_written")
    verdict = (
        F.when(F.size(broken) > 0, "FAILED").when(unwritten, "FAILED").when(F.size(faults) > 0, "VERIFIED_DO_NOT_FORMAT")
        .when((F.size(gaps) == 0) | only_notes, "SAFE_TO_FORMAT").when(~two, "VERIFIED_ONE_COPY").otherwise("VERIFIED_ONE_SOURCE")
    )
    reasons = F.when(F.size(broken) > 0, broken).when(unwritten, F.array(F.lit("manifests not written"))).when(F.size(faults) > 0, F.concat(faults, gaps)).otherwise(gaps)
    failed = F.when(F.size(broken) > 0, c("failures") + c("conflicts")).otherwise(0)
    return rows.select("session_id", verdict.alias("verdict"), reasons.alias("reasons"), failed.alias("files_failed"), "files", "twin_matched")


def refused(refusals: DataFrame) -> DataFrame:
    """The verdict of sessions that never started."""
    rows = refusals.groupBy("session_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return rows.select("session_id", F.lit("FAILED").alias("verdict"), "reasons", F.lit(0).cast("long").alias("files_failed"), F.lit(0).cast("long").alias("files"), F.lit(False).alias("twin_matched"))


def reason_rows(verdicts: DataFrame) -> DataFrame:
    """A row for each reason, in order."""
    return verdicts.select("session_id", "verdict", F.posexplode("reasons").alias("ord", "reason"))


def preview(names: Column, n: int = 3) -> Column:
    """K4: the first names, and how many more there are."""
    return F.concat(F.array_join(F.slice(names, 1, n), ", "), F.when(F.size(names) > n, F.format_string(" and %d more", F.size(names) - n)).otherwise(""))
