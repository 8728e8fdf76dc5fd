"""Q3: archive drives checked again from their files: manifests found and read, what they list digested, folders judged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import recheck
from ..sources import files, ranges


def listed(spark: SparkSession, root: str) -> DataFrame:
    """The files of the drives below root, a drive a direct child: (session_id, path, rel, size, folder), litter left out.

    session_id is the drive's name, rel the path below the drive, folder its first part.
    """
    found = files.inventory(spark, root).select("path", F.split("rel", "/").alias("parts"), "size").filter("size(parts) > 2")
    rel = F.array_join(F.slice("parts", F.lit(2), F.size("parts")), "/")
    return found.select(F.get("parts", F.lit(0)).alias("session_id"), "path", rel.alias("rel"), "size", F.get("parts", F.lit(1)).alias("folder"))


def entries(spark: SparkSession, root: str, listing: DataFrame) -> DataFrame:
    """What the folders' manifests say: (session_id, folder, manifest_id, rel, size, hash, other_hash, error).

    A manifest without entries has one row that says so, `bare`; without a header either, it is no manifest, and in error.
    """
    below = F.split("rel", "/")
    of = listing.filter(files.is_manifest(F.slice(below, F.lit(2), F.size(below)))).select("session_id", "folder", F.col("rel").alias("manifest_id"), "path")
    of = of.filter(paths.manifest_base(F.col("manifest_id")) == F.col("folder"))
    names = [files.literal(r.path) for r in of.select("path").distinct().collect()]  # the manifests alone: a reader of the root would list every file in the driver
    if names:
        said = files.manifest_entries(spark, names).withColumn("path", files.plain_path(F.col("manifest")))
        begun = files.manifest_headers(spark, names).filter("start IS NOT NULL").select(files.plain_path(F.col("manifest")).alias("path"), F.lit(True).alias("begun")).distinct()
    else:
        said = spark.createDataFrame([], "manifest string, rel string, size long, hash string, other_hash string, path string")
        begun = spark.createDataFrame([], "path string, begun boolean")
    rows = of.join(said, "path", "left").join(begun, "path", "left")
    bare = F.col("manifest").isNull() & F.coalesce("begun", F.lit(False))
    checked = recheck.validated(rows.select("session_id", "folder", "manifest_id", "rel", "size", "hash", "other_hash", bare.alias("bare")))
    return checked.withColumn("error", F.when(~F.col("bare"), F.col("error")))


def digested(listing: DataFrame, good: DataFrame, algorithm: str = "xxh64") -> DataFrame:
    """The drives' files as recheck takes them, (session_id, folder, rel, size, hash), rel below the folder.

    Only files that a readable manifest lists are read; the others' digest is null, as it is of those that can't be.
    """
    rows = listing.withColumn("rel", F.substr("rel", F.length("folder") + 2))
    wanted = rows.join(good.select("session_id", "folder", "rel").distinct(), ["session_id", "folder", "rel"], "left_semi")
    return rows.join(ranges.digests(wanted, algorithm).select("path", "hash"), "path", "left").select("session_id", "folder", "rel", "size", "hash")


def recheck_drives(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The state of each session folder of the drives below root, and what became of each file that a manifest lists."""
    listing = listed(spark, root)
    own = files.session_folders(listing, ["session_id"]).select("session_id", "folder")
    listing = listing.join(own, ["session_id", "folder"], "left_semi")
    checked = entries(spark, root, listing)
    good = recheck.readable(checked).filter("NOT bare")
    device = digested(listing, good)
    return recheck.sweep(device, checked, good), recheck.recheck(good, device)
