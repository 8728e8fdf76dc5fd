"""Shards by jump consistent hashing, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Rows of a shard that are numbered by one task, on average, and the most parts that a shard is numbered in.
PART_ROWS, PARTS = 20_000, 4096


def jump(key: Column, shards: int) -> Column:
    """The shard of a long key, 0 to shards - 1, without a table of the ring.

    The key's own stream of uniform numbers, one for each shard landed on, says how far the key jumps next: from
    shard b to floor((b + 1) / u). Its shard is the last before it jumps past the end, so one more shard takes only
    the keys whose next jump lands on it. A key lands on fewer than ln(shards) + 1 shards on average; the fold below
    has as many steps as shards, and stays where it is once it has passed the end. A null key counts as a key.
    """
    state = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("to"))

    def step(s: Column, _: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, s["to"]), 33) + 1).cast("double") / F.lit(2.0**31)
        nxt = F.struct(s["to"].alias("at"), F.floor((s["to"] + 1).cast("double") / u).cast("long").alias("to"))
        return F.when(s["to"] < shards, nxt).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, step, lambda s: s["at"].cast("int"))


def shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Each row of docs with its shard, its slot there, and its shard if there were one more.

    The law is `key`: doc_id and the number of shards decide alone, so copies of a text may lie in different shards,
    rows of equal doc_id lie together, and one more shard takes rows only into itself. Slots count from 0 without gaps.
    A null text has size 1 and the crc32 of no bytes; a null doc_id is a key like any other; repeated rows get a slot
    each; an empty table gives no rows; very long texts are only measured and digested, whole; further columns, whatever
    their names, are left out.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    parts = min(PARTS, 1 + docs.count() // (shards * PART_ROWS))
    key = F.col("doc_id")
    rows = rows.select("*", jump(key, shards).alias("shard"), jump(key, shards + 1).alias("grown_shard"), F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts)).alias("part"))
    # At most shards * parts rows, so small enough to send to every task.
    sizes = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("shard", "part", before.alias("start")))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("n", F.row_number().over(order)).join(starts, ["shard", "part"])
    slot = (F.col("start") + F.col("n") - 1).cast("long")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")
