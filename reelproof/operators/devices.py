"""Devices: whether two are two, which slots share a disk, where remembered ones are today."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .plan import rank


def distinct_state(a: str, b: str) -> Column:
    """What is known of two volumes, columns prefixed a and b: same disk or not, else the same identity, else unproven."""
    col = lambda side, c: F.col(f"{side}_{c}")
    same = lambda c: F.coalesce(col(a, c) == col(b, c), F.lit(False))
    known = col(a, "device_number").isNotNull() & col(b, "device_number").isNotNull()
    return F.when(known, F.when(same("device_number"), "SameDevice").otherwise("Distinct")).when(same("guid") | same("serial"), "SameDevice").otherwise("Unproven")


def sided(volumes: DataFrame, side: str) -> DataFrame:
    cols = ("slot", "device_number", "guid", "serial", "label", "root")
    return volumes.select("session_id", *[F.col(c).alias(f"{side}_{c}") for c in cols])


def pairs(volumes: DataFrame) -> DataFrame:
    """All pairs of a session's few slots: their distinctness, and whether labels or places are the same."""
    rows = sided(volumes, "a").join(sided(volumes, "b"), "session_id").filter(rank(F.col("a_slot")) < rank(F.col("b_slot")))
    card = lambda c: c.isin("C1", "C2")
    role = F.when(card(F.col("a_slot")) & card(F.col("b_slot")), "cards").when(card(F.col("a_slot")), "card and destination").otherwise("destinations")
    return rows.select("session_id", "a_slot", "b_slot", role.alias("role"), distinct_state("a", "b").alias("state"), F.coalesce(F.col("a_label") == F.col("b_label"), F.lit(False)).alias("same_label"), paths.same_location(F.col("a_root"), F.col("b_root")).alias("same_place"))


def collisions(volumes: DataFrame) -> DataFrame:
    """Slots that share a physical disk with another, and the first such."""
    other = volumes.select("session_id", "device_number", F.col("slot").alias("other"))
    rows = volumes.join(other, ["session_id", "device_number"]).filter("slot <> other")
    return rows.groupBy("session_id", "slot").agg(F.min_by("other", rank(F.col("other"))).alias("collides_with"))


def session_state(volumes: DataFrame) -> DataFrame:
    """J11 for the verdict: the first two destinations, the two cards, and cards against destinations."""
    p = pairs(volumes)
    first = F.min_by("state", F.struct(rank(F.col("a_slot")), rank(F.col("b_slot"))))
    dests = p.filter("role = 'destinations'").groupBy("session_id").agg(first.alias("dests"))
    cards = p.filter("role = 'cards'").groupBy("session_id").agg(F.max("state").alias("cards"))
    mixed = p.filter("role = 'card and destination'").groupBy("session_id").agg(F.bool_or(F.col("state") == "SameDevice").alias("dest_on_card"))
    ids = volumes.select("session_id").distinct()
    rows = ids.join(dests, "session_id", "left").join(cards, "session_id", "left").join(mixed, "session_id", "left")
    return rows.select("session_id", F.coalesce("dests", F.lit("Unproven")).alias("dests"), "cards", F.coalesce("dest_on_card", F.lit(False)).alias("dest_on_card"))


def resolve_slots(memory: DataFrame, mounted: DataFrame) -> DataFrame:
    """Remembered slots by serial where they are mounted, with the rebuilt path; absent where they are not."""
    now = mounted.select("session_id", "serial", "root").distinct().groupBy("session_id", "serial").agg(F.min("root").alias("root"))
    rows = memory.join(now, ["session_id", "serial"], "left")
    path = F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/"), F.col("subpath"))
    return rows.select("session_id", "profile", "slot", "serial", path.alias("path"), F.col("root").isNull().alias("absent"))


def capability(volumes: DataFrame) -> DataFrame:
    """What a station's disks can prove."""
    removable = F.count_if(paths.is_card_like(F.col("drive_type")))
    return volumes.groupBy("session_id").agg(F.countDistinct("device_number").alias("disks"), F.count_if(F.col("device_number").isNull()).alias("unnumbered"), removable.alias("removable"))


def picker(volumes: DataFrame, cards: bool) -> DataFrame:
    """K7: volumes in the order to offer them: removable ones first for a card, fixed ones for a destination."""
    from pyspark.sql import Window

    kind = paths.drive_kind(F.col("drive_type"))
    order = F.when(kind == ("removable" if cards else "fixed"), 0).otherwise(1)
    return volumes.select("session_id", "slot", kind.alias("kind"), F.row_number().over(Window.partitionBy("session_id").orderBy(order, "serial", "slot")).alias("place"))


def refusals(volumes: DataFrame) -> DataFrame:
    """Sessions that cannot start: both cards in one place, or a card slot at the root of a fixed volume."""
    twice = pairs(volumes).filter("role = 'cards' AND same_place").select("session_id", F.lit("C2").alias("slot"), F.lit("same place as C1").alias("reason"))
    fixed = volumes.filter(F.col("slot").isin("C1", "C2") & paths.is_volume_root(F.col("root")) & ~paths.is_card_like(F.col("drive_type")))
    return twice.unionByName(fixed.select("session_id", "slot", F.lit("root of a fixed volume").alias("reason")))
