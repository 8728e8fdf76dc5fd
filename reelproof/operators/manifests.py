"""Manifests: what goes into them, their names and numbers, and their two dialects as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats


def contents(items: DataFrame, wide: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Each item with the digest of its first destination; sessions with an unverified item write nothing."""
    rows = items.select("session_id", "rel", "size", "mtime").join(wide.select("session_id", "rel", F.coalesce("a", "b", "c").alias("hash")), ["session_id", "rel"], "left")
    if kept is not None:
        rows = rows.unionByName(kept.select(*rows.columns))
    bad = rows.filter("hash IS NULL").select("session_id").distinct()
    return rows.join(bad, "session_id", "left_anti")


def next_generations(asked: DataFrame, taken: DataFrame) -> DataFrame:
    """Numbers for new manifests (folder, name) after those that a folder has (folder, sequence): four digits."""
    top = taken.groupBy("folder").agg(F.max("sequence").alias("top"))
    n = F.coalesce("top", F.lit(0)) + F.row_number().over(Window.partitionBy("folder").orderBy("name"))
    return asked.join(top, "folder", "left").withColumn("sequence", n.cast("int")).select("folder", "name", "sequence", F.lpad(F.col("sequence").cast("string"), 4, "0").alias("digits"))


def free_names(asked: DataFrame, taken: DataFrame) -> DataFrame:
    """Names for new files (folder, id, ord), each the first free of id, id-2, id-3 and so on, taken names being (folder, name).

    An id's candidates are as many as it is asked for and has names that may be taken, so the free ones suffice. A name
    that is itself asked for as an id is left to that id.
    """
    used = taken.select("folder", "name").distinct()
    ids = asked.select("folder", F.col("id").alias("name")).distinct()
    mine = F.array_distinct(F.array(F.col("name"), F.regexp_replace("name", r"-\d+$", "")))
    tries = used.unionByName(ids).select("folder", F.explode(mine).alias("id")).unionByName(asked.select("folder", "id")).groupBy("folder", "id").agg(F.count("*").alias("n"))
    named = F.when(F.col("k") == 1, F.col("id")).otherwise(F.concat("id", F.lit("-"), F.col("k").cast("string")))
    tries = tries.join(asked.select("folder", "id").distinct(), ["folder", "id"], "left_semi").select("folder", "id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k")).withColumn("name", named)
    own = Window.partitionBy("folder", "id")
    free = tries.join(used, ["folder", "name"], "left_anti").join(ids.withColumn("asked", F.lit(True)), ["folder", "name"], "left").filter("k = 1 OR asked IS NULL").withColumn("nth", F.row_number().over(own.orderBy("k")))
    rows = asked.withColumn("nth", F.row_number().over(own.orderBy("ord")))
    return rows.join(free, ["folder", "id", "nth"]).select("folder", "id", "ord", "name")


def mhl_line(entry: str = "") -> Column:
    """An entry as a line of MHL 1.1; entry names the struct that it is in, if it is, with a point behind."""
    mtime = formats.rfc3339(F.coalesce(f"{entry}mtime", F.lit("1970-01-01").cast("timestamp")))
    return F.to_xml(F.struct(F.col(f"{entry}rel").alias("file"), F.col(f"{entry}size").alias("size"), mtime.alias("lastmodificationdate"), F.col(f"{entry}hash").alias("xxhash64be"), mtime.alias("hashdate")), {"rowTag": "hash"})


def asc_mhl_line() -> Column:
    """The same in ASC MHL 2: the path's size and date, and the digest's date, are attributes."""
    mtime = formats.rfc3339(F.coalesce("mtime", F.lit("1970-01-01").cast("timestamp")))
    path = F.struct(F.col("size").alias("_size"), mtime.alias("_lastmodificationdate"), F.col("rel").alias("_VALUE"))
    digest = F.struct(F.lit("original").alias("_action"), mtime.alias("_hashdate"), F.col("hash").alias("_VALUE"))
    return F.to_xml(F.struct(path.alias("path"), digest.alias("xxh64")), {"rowTag": "hash"})


def mhl(entries: DataFrame) -> DataFrame:
    """The lines of MHL 1.1 manifests: (manifest_id, rel, value)."""
    return entries.select("manifest_id", "rel", mhl_line().alias("value"))


def asc_mhl(entries: DataFrame) -> DataFrame:
    """The same in ASC MHL 2."""
    return entries.select("manifest_id", "rel", asc_mhl_line().alias("value"))


def dealt(entries: DataFrame, line: Column, root: str, version: str) -> DataFrame:
    """(manifest_id, value), the lines of documents() in their order; entries are dealt and sorted as they are, and become text after that."""
    cols = ("rel", "size", "mtime", "hash")
    ends = entries.select("manifest_id").distinct().select("manifest_id", F.explode(F.array(F.lit(0), F.lit(2))).alias("part"), *[F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in cols])
    rows = entries.select("manifest_id", F.lit(1).alias("part"), *cols).unionByName(ends).repartition("manifest_id").sortWithinPartitions("manifest_id", "part", "rel")
    value = F.when(F.col("part") == 1, line).when(F.col("part") == 0, F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<{root} version="{version}">')).otherwise(F.lit(f"</{root}>"))
    return rows.select("manifest_id", value.alias("value"))


def documents(lines: DataFrame, root: str, version: str) -> DataFrame:
    """A row a line of each manifest, with its head and tail; sorted within a manifest by path.

    A manifest's lines are never gathered into one value: they are rows, dealt and sorted by manifest.
    """
    head = lines.select("manifest_id").distinct().select("manifest_id", F.lit(0).alias("part"), F.lit("").alias("rel"), F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<{root} version="{version}">').alias("value"))
    tail = head.select("manifest_id", F.lit(2).alias("part"), "rel", F.lit(f"</{root}>").alias("value"))
    body = lines.select("manifest_id", F.lit(1).alias("part"), "rel", "value")
    return head.unionByName(body).unionByName(tail)


def chain(generations: DataFrame) -> DataFrame:
    """A chain's lines: (folder, sequence, value)."""
    digest = F.struct(F.lit("xxh64").alias("_type"), F.col("hash").alias("_VALUE"))
    one = F.to_xml(F.struct(F.col("sequence").alias("_sequencenr"), F.col("name").alias("path"), digest.alias("hash")), {"rowTag": "hashlist"})
    return generations.select("folder", "sequence", one.alias("value"))


def foreign(listing: DataFrame) -> DataFrame:
    """ASC directories that are not ours to add to: (folder, name, algorithm), with the first reason."""
    odd = F.when(F.col("algorithm") != "xxh64", F.concat(F.lit("chain uses "), F.col("algorithm"))).when(~F.col("name").rlike(r"^\d{4}_.+\.mhl$"), F.concat(F.lit("unknown file "), F.col("name")))
    return listing.groupBy("folder").agg(F.min(odd).alias("reason"), F.count("*").alias("files")).withColumn("foreign", F.col("reason").isNotNull())
