"""Twin cards: which files both hold, where each is copied from, how the cards were used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

KEYS = ["session_id", "rel"]


def reconcile(c1: DataFrame, c2: DataFrame) -> DataFrame:
    """Each path of either card with its pairing, and the source it is copied from (card 1 if it has it)."""
    a = c1.select(*KEYS, F.col("size").alias("size1"), F.col("mtime").alias("mtime1"))
    b = c2.select(*KEYS, F.col("size").alias("size2"), F.col("mtime").alias("mtime2"))
    return paired(a.join(b, KEYS, "full"))


def reconcile_dealt(cards: DataFrame) -> DataFrame:
    """reconcile() of rows that hold what each card has of a file (c1, c2: structs of size and mtime, or null), paths not null: they meet once, where a join shuffles either card."""
    held = cards.groupBy(*KEYS).agg(F.collect_list("c1").alias("a"), F.collect_list("c2").alias("b"))
    both = held.select(*KEYS, F.explode_outer("a").alias("a"), "b").select(*KEYS, "a", F.explode_outer("b").alias("b")).filter("a IS NOT NULL OR b IS NOT NULL")
    return paired(both.select(*KEYS, F.col("a.size").alias("size1"), F.col("a.mtime").alias("mtime1"), F.col("b.size").alias("size2"), F.col("b.mtime").alias("mtime2")))


def paired(both: DataFrame) -> DataFrame:
    """The pairing and source of paths with what the two cards have of each, side by side."""
    pairing = F.when(F.col("size2").isNull(), "OnlyOnC1").when(F.col("size1").isNull(), "OnlyOnC2").when(F.col("size1") == F.col("size2"), "Twinned").otherwise("SizeConflict")
    source = F.when(F.col("size1").isNotNull(), "C1").otherwise("C2")
    rows = both.select(*KEYS, pairing.alias("pairing"), source.alias("source"), F.coalesce("size1", "size2").alias("size"), F.coalesce("mtime1", "mtime2").alias("mtime"))
    return rows.withColumn("source", F.when(F.col("pairing") != "SizeConflict", F.col("source")))


def items(reconciled: DataFrame) -> DataFrame:
    """What is copied: everything but conflicts."""
    return reconciled.filter("pairing <> 'SizeConflict'")


def summary(sessions: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Counts of each session's pairings, and how its two cards were used (null without a second card)."""
    of = lambda p: F.count_if(F.col("pairing") == p)
    kinds = lambda p: F.collect_set(F.when(F.col("pairing") == p, paths.extension(F.col("rel"))))
    size = F.sum(F.when(F.col("pairing") != "SizeConflict", F.col("size")))
    groups = reconciled.groupBy("session_id").agg(
        of("Twinned").alias("twinned"), of("OnlyOnC1").alias("only_c1"), of("OnlyOnC2").alias("only_c2"), of("SizeConflict").alias("conflicts"), size.alias("total_bytes"), kinds("OnlyOnC1").alias("x1"), kinds("OnlyOnC2").alias("x2")
    )
    rows = sessions.select("session_id", "had_card2").join(groups, "session_id", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("twinned", "only_c1", "only_c2", "conflicts", "total_bytes")}
    total = n["twinned"] + n["only_c1"] + n["only_c2"] + n["conflicts"]
    mode = (
        F.when(~F.col("had_card2"), None).when((total == 0) | (n["twinned"] * 50 >= total * 49), "Backup").when(n["twinned"] > 0, "Mixed")
        .when((n["only_c1"] == 0) | (n["only_c2"] == 0), "Mixed").when(~F.arrays_overlap("x1", "x2"), "SplitByType").otherwise("Relay")
    )
    untwinned = n["only_c1"] + n["only_c2"]
    complete = F.col("had_card2") & (untwinned == 0) & (n["conflicts"] == 0)
    line = F.format_string("%d twinned, %d only on C1, %d only on C2, %d conflicts", n["twinned"], n["only_c1"], n["only_c2"], n["conflicts"])
    return rows.select("session_id", "had_card2", *[v.alias(k) for k, v in n.items()], untwinned.alias("untwinned"), complete.alias("twins_complete"), mode.alias("card_mode"), line.alias("line"))
