"""Diagnoses: what the digests of all copies of a file say together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = ("SC", "C1", "C2", "A", "B", "C")
FAILURES = ("MissingCopy", "TwinMismatch", "BadDestination", "Systematic", "SourceReadCorrupt", "UnrepeatableSourceRead", "Unclassified")


def tuples(measurements: DataFrame, apart: tuple[str, ...] = ()) -> DataFrame:
    """A10: a file's digests side by side; null is not measured. apart names columns that tell files of one path apart, if there are such."""
    digests = [F.max(F.when(F.col("slot") == s, F.col("hash"))).alias(s.lower()) for s in SLOTS]
    return measurements.groupBy("session_id", "rel", *apart).agg(*digests).drop(*apart)


def evidence(measurements: DataFrame) -> DataFrame:
    """(session_id, slot, from_device, cached): whether all that was measured of a slot was read from the device, and how many files were not."""
    device = F.coalesce(F.col("read_mode") == "device", F.lit(False))
    return measurements.groupBy("session_id", "slot").agg(F.bool_and(device).alias("from_device"), F.count_if(~device).alias("cached"))


def missing(expected: DataFrame, measurements: DataFrame) -> DataFrame:
    """Per file the devices that were expected and not measured, in their order."""
    return lost(expected.join(measurements.select("session_id", "rel", "slot"), ["session_id", "rel", "slot"], "left_anti"))


def unmeasured(items: DataFrame, volumes: DataFrame, wide: DataFrame) -> DataFrame:
    """J10 of plan.expected(items, volumes) and the digests side by side: nothing is shuffled for each measurement, be it expected or there."""
    from .plan import DEVICES, expected

    seen = wide.groupBy("session_id", "rel").agg(*[F.bool_or(F.col(d.lower()).isNotNull()).alias(d) for d in DEVICES])
    there = F.coalesce(*[F.when(F.col("slot") == d, F.col(d)) for d in DEVICES], F.lit(False))
    return lost(expected(items.join(seen, ["session_id", "rel"], "left"), volumes, keep=DEVICES).filter(~there))


def lost(rows: DataFrame) -> DataFrame:
    """(session_id, rel, devs) of rows (session_id, rel, slot)."""
    from .plan import rank

    named = F.array_sort(F.collect_list(F.struct(rank(F.col("slot")).alias("k"), "slot")))
    return rows.groupBy("session_id", "rel").agg(F.array_join(F.transform(named, lambda x: x["slot"]), ",").alias("devs"))


def witnesses() -> Column:
    """The digests that bear witness to a card: of the copies, and of the bytes read while copying."""
    return F.array_compact(F.array("a", "b", "c", "sc"))


def votes(card: Column) -> Column:
    """Witnesses that agree with a card; none do with a card that was not measured."""
    return F.size(F.filter(witnesses(), lambda w: w == card))


def suspect() -> Column:
    """The card that has fewer witnesses; null if they are as many."""
    return F.when(votes(F.col("c1")) > votes(F.col("c2")), "C2").when(votes(F.col("c2")) > votes(F.col("c1")), "C1")


def diagnose(wide: DataFrame, missing_: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The first diagnosis that fits: (session_id, rel, kind, suspect, dests, devs).

    Every test asks for values that were measured: a null is never equal to anything, nor different.
    """
    card = F.coalesce("c1", "c2")
    dests = ("a", "b", "c")
    off = F.array_compact(F.array(*[F.when(F.col(d).isNotNull() & (F.col(d) != card), F.lit(d.upper())) for d in dests]))
    values = F.array_compact(F.array(*dests))
    n = F.size(values)
    agreed = F.coalesce(F.col("sc") == card, F.lit(True))
    alike = F.size(F.array_distinct(values)) == 1
    all_sc = F.forall(values, lambda v: F.coalesce(v == F.col("sc"), F.lit(False)))
    kind = (
        F.when(F.col("c1").isNotNull() & F.col("c2").isNotNull() & (F.col("c1") != F.col("c2")), "TwinMismatch")
        .when(card.isNull() | (n == 0), "Unclassified")
        .when(agreed & (F.size(off) == 0), "Clean")
        .when(agreed & (n >= 2) & (F.size(off) == n) & alike, "Systematic")
        .when(agreed, "BadDestination")
        .when(F.size(off) == 0, "UnrepeatableSourceRead")
        .when(all_sc, "SourceReadCorrupt")
        .otherwise("Unclassified")
    )
    rows = wide.withColumns({"kind": kind, "suspect": suspect(), "off": F.array_join(off, ","), "all": F.array_join(F.array_compact(F.array(*[F.when(F.col(d).isNotNull(), F.lit(d.upper())) for d in dests])), ",")})
    if missing_ is not None:
        rows = rows.join(missing_, ["session_id", "rel"], "full").withColumn("kind", F.when(F.col("devs").isNotNull(), "MissingCopy").otherwise(F.col("kind")))
    else:
        rows = rows.withColumn("devs", F.lit(None).cast("string"))
    told = F.when(F.col("kind") == "BadDestination", F.col("off")).when(F.col("kind").isin("SourceReadCorrupt", "Systematic"), F.col("all"))
    return rows.select("session_id", "rel", "kind", F.when(F.col("kind") == "TwinMismatch", F.col("suspect")).alias("suspect"), told.alias("dests"), "devs", *keep)


def diagnosed_rows(wide: DataFrame) -> DataFrame:
    """A11 of files as they complete: (session_id, rel, at, kind); row by row, so it works on streams too."""
    return diagnose(wide, keep=("at",)).select("session_id", "rel", "at", "kind")


def unexcused(diagnoses: DataFrame, *excuses: DataFrame) -> DataFrame:
    """Failures that no table of (session_id, rel) excuses."""
    rows = diagnoses.filter("kind <> 'Clean'")
    for x in excuses:
        rows = rows.join(x.select("session_id", "rel"), ["session_id", "rel"], "left_anti")
    return rows


def result_lines(measurements: DataFrame) -> DataFrame:
    """A file's slots grouped by digest: those that agree are joined by =, groups by a bar. All measurements of a path are told of."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SLOTS]), F.col("slot"))
    found = measurements.filter("hash IS NOT NULL").groupBy("session_id", "rel").agg(F.array_sort(F.collect_list(F.struct(rank.alias("k"), "slot", "hash"))).alias("found"))
    groups = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["hash"])))
    line = F.transform(groups, lambda h: F.concat(F.array_join(F.transform(F.filter("found", lambda x: x["hash"] == h), lambda x: x["slot"]), " = "), F.lit(" "), F.substring(h, 1, 8)))
    return found.select("session_id", "rel", F.array_join(line, " | ").alias("line"))
