"""Log retention: which logs of each folder go, and what that frees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def plan(logs: DataFrame, keep: int = 30) -> DataFrame:
    """A folder's logs, newest first (ties: the later path), those after the first `keep` to go."""
    k = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("modified"), F.desc("path")))
    return logs.withColumn("k", k).withColumn("gone", F.col("k") > keep)


def summary(planned: DataFrame) -> DataFrame:
    """Logs and bytes of each folder, and those freed."""
    gone = F.col("gone")
    return planned.groupBy("dir").agg(F.count("*").alias("logs"), F.sum("bytes").alias("bytes"), F.count_if(gone).alias("freed_logs"), F.sum(F.when(gone, F.col("bytes")).otherwise(0)).alias("freed_bytes"))
