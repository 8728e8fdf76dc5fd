"""Readers and writers of inventories, manifests, histories, telemetry and session bundles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, paths
from ..operators import digest
from . import ranges
from .shared import kept

HISTORY = (
    "kind string, at timestamp, session string, verdict string, devices array<struct<slot:string,serial:bigint,label:string>>, retries map<string,bigint>, "
    "suspect_cards array<bigint>, failures bigint, cards array<struct<slot:string,serial:bigint,label:string>>, note string"
)
TELEMETRY = (
    "at timestamp, elapsed_ms bigint, event string, phase string, dev string, rel string, size bigint, delta bigint, depth int, cap int, mbps double, level string, stage string, msg string, "
    "info struct<volume:struct<root:string,label:string,serial:bigint,filesystem:string,sector_size:int,guid:string,device_number:int>,free_bytes:bigint,total_bytes:bigint>"
)
SESSION = (
    "tool string, session string, start timestamp, finish timestamp, phases array<struct<phase:string,ms:bigint>>, "
    "reconciliation struct<twinned:bigint,only_c1:array<string>,only_c2:array<string>,conflicts:array<string>,had_card2:boolean>, "
    "verdict struct<state:string,reasons:array<string>>, errors array<string>, formatted_after string"
)
#: What a bundle's list of its own contents is called.
CONTENTS = "contents.txt"
ENTRY = (
    "file string, size string, lastmodificationdate string, hashdate string, xxhash64be string, xxhash64 string, md5 string, sha1 string, sha256 string, "
    "path struct<_VALUE:string,_size:string,_lastmodificationdate:string>, xxh64 struct<_VALUE:string,_hashdate:string>, xxh3 struct<_VALUE:string>, xxh128 struct<_VALUE:string>, c4 struct<_VALUE:string>"
)


def inventory(spark: SparkSession, root: str, pattern: str | None = None, litter: bool = False) -> DataFrame:
    """(path, rel, size, mtime, skipped) of the files below a folder, empty and hidden ones too; contents are not read.

    Litter directories are not entered (P1); litter files are left out, unless asked for, and are then marked as skipped
    (P2). rel is what stands in a file's path after the root's own, whatever characters either has. A store that only
    Spark can open is listed by Spark, which leaves out empty files and names that begin with a dot or an underscore.
    """
    if ranges.reachable(root):
        found = ranges.walked(spark, root, paths.LITTER_DIRS)
        found = found.filter(F.element_at(F.split("rel", "/"), -1).rlike(glob(pattern))) if pattern else found
    else:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        named = literal(root)
        found = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(named).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
        found = found.select("path", F.substring("path", len(whole) + 2, 1 << 30).alias("rel"), "size", "mtime").filter(~paths.in_litter_dir(F.col("rel")))
    found = found.withColumn("skipped", paths.is_litter_file(F.col("rel")))
    return found if litter else found.filter(~F.col("skipped"))


def literal(path: str) -> str:
    """A path for Spark's readers that is no pattern, but a name."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def glob(pattern: str) -> str:
    return "^" + re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".") + "$"


def destination(spark: SparkSession, root: str) -> DataFrame:
    """Like inventory; a folder that is not there has no files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string, rel string, size bigint, mtime timestamp, skipped boolean")
    return inventory(spark, root)


def plain_path(path: Column) -> Column:
    """A path as inventory() has it, from that of a file's metadata, where special characters are escaped."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), r"\+", "%2B"))


def manifest_entries(spark: SparkSession, path: str | list[str], reader: DataFrameReader | None = None) -> DataFrame:
    """Entries of manifests of both dialects under one schema; other_hash is of an algorithm not used here."""
    return entries_of((reader or spark.read).format("xml").option("rowTag", "hash").option("ignoreNamespace", "true").schema(ENTRY).load(path))


def entries_of(rows: DataFrame, *more: Column) -> DataFrame:
    """Entries of both dialects, read under ENTRY from files or a stream of them, and more of the files' metadata."""
    other = F.coalesce("md5", "sha1", "sha256", "xxh3._VALUE", "xxh128._VALUE", "c4._VALUE")
    return rows.select(
        F.col("_metadata.file_path").alias("manifest"), paths.normalise(F.coalesce("file", "path._VALUE")).alias("rel"), F.coalesce("size", "path._size").cast("bigint").alias("size"),
        formats.parse_rfc3339(F.coalesce("lastmodificationdate", "path._lastmodificationdate")).alias("mtime"),
        formats.parse_hex(F.coalesce("xxhash64be", "xxhash64", "xxh64._VALUE")).alias("hash"), other.alias("other_hash"), *more,
    )


def manifest_headers(spark: SparkSession, path: str | list[str], reader: DataFrameReader | None = None) -> DataFrame:
    """Who wrote each manifest, and when."""
    rows = (reader or spark.read).format("xml").option("rowTag", "creatorinfo").option("ignoreNamespace", "true").schema("name string, hostname string, tool string, startdate string, finishdate string").load(path)
    return rows.select(F.col("_metadata.file_path").alias("manifest"), "name", "hostname", "tool", formats.parse_rfc3339(F.col("startdate")).alias("start"), formats.parse_rfc3339(F.col("finishdate")).alias("finish"))


def generations(spark: SparkSession, root: str, pattern: str = "*.mhl", folder: Column | None = None, name: Column | None = None) -> DataFrame:
    """Manifests of ASC directories by the number in their names, with the digest of their bytes.

    What lies in the directory counts, whatever its chain lists. folder and name say where in `path` these stand, if not
    as the file's own.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    name = F.element_at(F.split("path", "/"), -1) if name is None else name
    folder = F.regexp_replace("path", "/[^/]*$", "") if folder is None else folder
    return files.select(folder.alias("folder"), F.try_to_number(F.nullif(F.regexp_extract(name, r"^(\d+)_", 1), F.lit("")), F.lit("999999")).cast("int").alias("sequence"), name.alias("name"), digest.xxh64(F.col("content")).alias("hash"))


def write_manifests(lines: DataFrame, path: str) -> None:
    """A folder a manifest; its lines, dealt and in order, in one text file."""
    lines.write.partitionBy("manifest_id").text(path)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; those that are not JSON are left out, and can be counted by bad_lines."""
    rows = spark.read.text(path).select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.select("r.*").filter("_bad IS NULL").drop("_bad")


def bad_lines(spark: SparkSession, path: str, schema: str) -> int:
    rows = spark.read.text(path).select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.filter("r._bad IS NOT NULL").count()


def append_history(rows: DataFrame, path: str) -> None:
    """S15"""
    rows.write.mode("append").json(path)


def write_sessions(records: DataFrame, path: str) -> None:
    """A folder a session, with its record as one JSON document."""
    rows = records.withColumn("part", F.col("session"))
    rows.repartition("part").write.partitionBy("part").json(path)


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session records, one JSON document a file."""
    return spark.read.schema(SESSION).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)


def volumes_of(telemetry: DataFrame) -> DataFrame:
    """Devices as telemetry tells of them."""
    return telemetry.filter("event = 'device'").select("dev", "info.volume.*", "info.free_bytes")


def log_lines(rows: DataFrame) -> DataFrame:
    """A text line a log event."""
    return rows.filter("event = 'log'").select("session_id", "event_id", formats.log_line(F.col("at"), F.col("level"), F.col("stage"), F.col("msg")).alias("value"))


def bundle(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """A session's artifacts (session_id, artifact), gathered or not."""
    there = listing.select("session_id", "artifact", F.lit(True).alias("there")).distinct()
    return expected.join(there, ["session_id", "artifact"], "left").select("session_id", "artifact", F.coalesce("there", F.lit(False)).alias("gathered"))


def export_bundles(expected: DataFrame, lines: DataFrame, root: str, value: Column | None = None) -> DataFrame:
    """Writes each session's bundle, a folder with a file for each artifact gathered and one, contents.txt, that says what is and what is not.

    expected (session_id, artifact): what a session's bundle should hold; lines (session_id, artifact, part, value): what
    there is, line by line in the order of part. Other sessions' lines and other artifacts are left out. value: how a line
    is made of further columns of lines, if it is; that is done as it is written. Returns (session_id, artifact, gathered,
    bytes), bytes null of what is not gathered. No artifact's lines are gathered in memory; lines are gone through once, as
    what was gathered is seen from the files written.
    """
    wanted = kept(expected.select("session_id", "artifact").distinct())
    name = F.concat(F.col("session_id").cast("string"), F.lit("/"))
    own = lines.join(wanted, ["session_id", "artifact"], "left_semi").withColumn("_rel", F.concat(name, "artifact")).withColumn("_part", F.col("part").cast("long"))
    line = F.concat(F.col("value") if value is None else value, F.lit("\n"))
    more = [c for c in lines.columns if c not in ("session_id", "artifact", "part")]
    sizes = kept(ranges.written(own.select(F.col("_rel").alias("rel"), F.col("_part").alias("part"), *more), root, line))
    state = wanted.withColumn("rel", F.concat(name, "artifact")).join(sizes, "rel", "left").withColumn("gathered", F.col("size").isNotNull())
    said = F.concat(F.when(F.col("gathered"), "gathered: ").otherwise("not gathered: "), F.col("artifact"))
    told = state.select(F.concat(name, F.lit(CONTENTS)).alias("rel"), F.struct(F.lit(None).cast("long").alias("n"), said.alias("text")).alias("part"), F.concat(said, F.lit("\n")).alias("value"))
    if not wanted.filter(F.col("artifact") == CONTENTS).isEmpty():  # an artifact of this name stands below what is said
        told = told.unionByName(own.filter(F.col("artifact") == CONTENTS).select(F.col("_rel").alias("rel"), F.struct(F.col("_part").alias("n"), F.lit("").alias("text")).alias("part"), line.alias("value")))
    told = kept(ranges.written(told, root)).select("rel", F.col("size").alias("whole"))
    return state.join(told, "rel", "left").select("session_id", "artifact", "gathered", F.coalesce("whole", "size").alias("bytes"))


def session_folders(listing: DataFrame, drive: list[str] | None = None) -> DataFrame:
    """Direct children that hold a manifest, an ascmhl folder, or have a session's name, with their manifests.

    drive names columns of the listing that say which drive a file is on, if there are several.
    """
    drive = drive or []
    parts = F.split("rel", "/")
    rows = listing.filter(F.size(parts) > 1).withColumn("folder", F.get(parts, F.lit(0))).withColumn("below", F.slice(parts, F.lit(2), F.size(parts)))
    has_asc = F.exists("below", lambda c: F.lower(c) == "ascmhl")
    found = rows.groupBy(*drive, "folder").agg(F.array_join(F.array_sort(F.collect_set(F.when(is_manifest(F.col("below")), F.col("rel")))), ",").alias("manifests"), F.bool_or(has_asc).alias("asc"))
    return found.filter((F.col("manifests") != "") | F.col("asc") | paths.is_session_name(F.col("folder"))).select(*drive, "folder", "manifests")


def is_manifest(below: Column) -> Column:
    """Whether the path below a session's folder, as an array, is that of one of its manifests."""
    name = lambda k: F.lower(F.get(below, F.lit(k)))
    return (F.size(below) == 1) & name(0).endswith(".mhl") | (F.size(below) == 2) & (name(0) == "ascmhl") & name(1).endswith(".mhl")
