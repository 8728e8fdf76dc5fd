"""Inventories: totals, and names that another file system would not take."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths


def split_litter(files: DataFrame) -> DataFrame:
    """Files outside litter directories, with skipped saying which are litter themselves."""
    return files.filter(~paths.in_litter_dir(F.col("rel"))).withColumn("skipped", paths.is_litter_file(F.col("rel")))


def totals(files: DataFrame) -> DataFrame:
    """A1: files and bytes of each session and device."""
    return files.groupBy("session_id", "device").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def scan_error_counts(sessions: DataFrame, errors: DataFrame) -> DataFrame:
    """Errors of each session, none included."""
    counts = errors.groupBy("session_id").agg(F.count("*").alias("n"))
    return sessions.select("session_id").join(counts, "session_id", "left").select("session_id", F.coalesce("n", F.lit(0)).alias("scan_errors"))


def case_collisions(files: DataFrame) -> DataFrame:
    """A4: paths of a device that are one where case does not count."""
    groups = files.groupBy("session_id", "device", F.lower("rel").alias("folded")).agg(F.count("*").alias("n"), F.concat_ws(" | ", F.array_sort(F.collect_list("rel"))).alias("rels"))
    return groups.filter("n > 1")


def name_hazards(files: DataFrame) -> DataFrame:
    """A5: for each component of each path its hazards: reserved, illegal (the first such character), trailing."""
    rows = files.select("session_id", "device", "rel", F.posexplode(paths.parts(F.col("rel"))).alias("pos", "part"))
    stem = F.lower(F.substring_index("part", ".", 1))
    bad = F.regexp_extract("part", f"({paths.ILLEGAL})", 1)
    found = F.array_compact(
        F.array(
            F.when(stem.isin(*paths.RESERVED), F.struct(F.lit("reserved").alias("hazard"), F.col("part").alias("what"))),
            F.when(bad != "", F.struct(F.lit("illegal").alias("hazard"), bad.alias("what"))),
            F.when(F.col("part").rlike(r"[. ]$"), F.struct(F.lit("trailing").alias("hazard"), F.col("part").alias("what"))),
        )
    )
    return rows.select("session_id", "device", "rel", "pos", F.inline(found))


def hazard_summary(sessions: DataFrame, files: DataFrame, first: int = 10, hazards: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Hazards of each session over all its devices, the first ten told; any refuses the job.

    hazards: what name_hazards() and case_collisions() give of the files, if known.
    """
    named, cased = hazards or (name_hazards(files), case_collisions(files))
    told = named.select("session_id", F.concat_ws(": ", "hazard", "rel").alias("line"))
    told = told.unionByName(cased.select("session_id", F.concat(F.lit("case: "), F.col("rels")).alias("line")))
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("line"))
    shown = told.withColumn("k", order).filter(F.col("k") <= first)  # a limit of each group before the sort
    shown = shown.groupBy("session_id").agg(F.concat_ws(" ; ", F.array_sort(F.collect_list("line"))).alias("first"))
    groups = told.groupBy("session_id").agg(F.count("*").alias("n")).join(shown, "session_id")
    rows = sessions.select("session_id").join(groups, "session_id", "left")
    return rows.select("session_id", F.coalesce("n", F.lit(0)).alias("hazards"), F.coalesce("first", F.lit("")).alias("preview"), (F.coalesce("n", F.lit(0)) > 0).alias("refused"))
