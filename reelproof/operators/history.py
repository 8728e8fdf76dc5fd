"""Device histories: what a card has been through, over all sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RETRY_CEILING = 5


def suspects(diagnoses: DataFrame, volumes: DataFrame, excused: DataFrame | None = None) -> DataFrame:
    """Serials of cards that twin mismatches speak against, each once a session; excused files left out if given."""
    bad = diagnoses.filter("kind = 'TwinMismatch' AND suspect IS NOT NULL")
    if excused is not None:
        bad = bad.join(excused.select("session_id", "rel"), ["session_id", "rel"], "left_anti")
    return bad.select("session_id", F.col("suspect").alias("slot")).join(volumes.select("session_id", "slot", "serial"), ["session_id", "slot"]).select("session_id", "serial").distinct()


def exploded(entries: DataFrame) -> DataFrame:
    """A row a device of each entry (kind, seq, at, devices, retries, suspect_cards), as summarise() takes them.

    Suspect cards that are none of the entry's devices have a row of their own, without a slot or a label.
    """
    none = F.array().cast("array<bigint>")
    suspects_ = F.coalesce("suspect_cards", none)
    card = lambda serial, slot, label, retries, suspect: F.struct(serial.alias("serial"), slot.alias("slot"), label.alias("label"), retries.cast("long").alias("retries"), suspect.alias("suspect"))
    own = F.transform("devices", lambda d: card(d["serial"], d["slot"], d["label"], F.coalesce(F.try_element_at("retries", d["slot"]), F.lit(0)), F.array_contains(suspects_, d["serial"])))
    others = F.array_except(suspects_, F.coalesce(F.transform("devices", lambda d: d["serial"]), none))
    more = F.transform(others, lambda s: card(s, F.lit(None).cast("string"), F.lit(""), F.lit(0), F.lit(True)))
    rows = entries.select("kind", "seq", "at", F.explode(F.concat(F.coalesce(own, F.slice(more, 1, 0)), more)).alias("d"))  # one pass
    return rows.select("kind", "seq", "at", "d.*")


def partial(rows: DataFrame) -> DataFrame:
    """Sums of a row a serial that merged() adds up. An entry's rows must all be among them."""
    session = F.col("kind") == "session"
    named = F.col("label") != ""
    return rows.groupBy("serial").agg(
        F.countDistinct(F.when(session, F.col("seq"))).alias("sessions"), F.sum(F.when(session, F.col("retries")).otherwise(0)).alias("retries"),
        F.countDistinct(F.when(session & F.col("suspect"), F.col("seq"))).alias("twin_mismatches"), F.countDistinct(F.when(~session, F.col("seq"))).alias("formats"),
        F.max(F.when(session & F.col("slot").isNotNull(), F.col("at"))).alias("last_seen"), F.max(F.when(named, F.struct("seq", "slot", "label"))).alias("newest"),
    )


def merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two partial() sums as one; what either has is added, or the greater taken."""
    add = [F.sum(c).alias(c) for c in ("sessions", "retries", "twin_mismatches", "formats")]
    return one.unionByName(other).groupBy("serial").agg(*add, F.max("last_seen").alias("last_seen"), F.max("newest").alias("newest"))


def finished(sums: DataFrame) -> DataFrame:
    """The summary of partial() sums."""
    rows = sums.withColumn("label", F.col("newest.label")).drop("newest")
    suspect = (F.col("twin_mismatches") > 0) | (F.col("retries") > RETRY_CEILING)
    warning = F.when(F.col("twin_mismatches") > 0, F.format_string("%d twin mismatch(es)", "twin_mismatches")).when(F.col("retries") > RETRY_CEILING, F.format_string("%d retries", "retries"))
    return rows.withColumns({"suspect": suspect, "warning": warning})


def summarise(history: DataFrame) -> DataFrame:
    """A row a serial. history: an entry and slot a row (kind, seq, at, serial, slot, label, retries, suspect).

    A session counts once for a serial, whatever slots it fills; the label is the last that is not empty, in the order
    of entry, formats included; formats do not touch last_seen; what makes a card suspect is never taken back.
    """
    return finished(partial(history))


def warnings(volumes: DataFrame, summary: DataFrame) -> DataFrame:
    """today's devices with a bad history."""
    bad = summary.filter("suspect").select("serial", "warning")
    return volumes.select("session_id", "slot", "serial").join(bad, "serial").select("session_id", "slot", "serial", "warning")


def trail(history: DataFrame) -> DataFrame:
    """Each session with the formats that came after it on the same serial: the first, and how many."""
    later = Window.partitionBy("serial").orderBy(F.desc("seq")).rangeBetween(Window.unboundedPreceding, -1)  # a frame that only grows
    own = F.when(F.col("kind") == "format", F.col("seq"))
    rows = history.withColumns({"formatted_after": F.min(own).over(later), "formats_after": F.count(own).over(later)})
    return rows.filter("kind = 'session'").groupBy("seq", "serial").agg(F.min("formatted_after").alias("formatted_after"), F.max("formats_after").alias("formats_after"))


def timeline(history: DataFrame) -> DataFrame:
    """A line an entry: its cards and how many files failed."""
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "label", "serial"))), lambda d: F.concat(d["slot"], F.lit(" "), F.when(d["label"] == "", d["serial"].cast("string")).otherwise(d["label"]))), ", ")
    cards = history.filter(F.col("slot").isin("C1", "C2"))
    return cards.groupBy("seq", "kind").agg(named.alias("cards"), F.max("failures").alias("failures"))
