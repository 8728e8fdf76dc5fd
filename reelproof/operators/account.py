"""H9: differences between twins known to be harmless, from the two files and the tables of their containers.

Cheap tests come first, and each leaves fewer files to the next: kinds and lengths, then structures and sample tables,
then the digests of byte ranges, and only ranges whose digests differ are read side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import ranges
from ..sources.shared import kept
from . import digest

# Kinds of container with rules, least number of metadata samples, and the largest share of bytes that may differ.
PINNED = ("mp4",)
MIN_SAMPLES, SHARE = 32, 0.02
#: Bytes of a cell in which runs meet spans: small, so that few of a file's spans lie in one.
CELL = 1 << 16


def compared(pairs: DataFrame, size: int = ranges.RANGE, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """H4 with a budget, of files of one length (rel, a, b, size): totals (rel, differing, too_much) and runs (rel, start, length).

    Ranges are digested first. A file of which more ranges differ than bytes may is out; of the others the ranges that
    differ are read, each until it alone is over the budget. Files over it have too_much, no count and no runs.
    """
    pairs = pairs.withColumn("budget", F.floor(F.col("size") * share))
    cut = ranges.cut(pairs, size)
    one, other = (ranges.range_digests(cut.withColumn("path", F.col(side)), ["rel"]) for side in ("a", "b"))
    unlike = one.join(other.select("rel", "no", F.col("hash").alias("twin")), ["rel", "no"]).filter("hash <> twin").select("rel", "no")
    unlike = kept(unlike)
    count = unlike.groupBy("rel").agg(F.count("*").alias("n"))
    left = pairs.join(count, "rel").filter("n <= budget").select("rel")
    todo = cut.join(unlike.join(left, "rel", "left_semi"), ["rel", "no"], "left_semi")
    runs = kept(ranges.diff_runs(todo, ["rel"]))
    found = runs.groupBy("rel").agg(F.sum("length").alias("bytes"), F.bool_or(F.col("start").isNull()).alias("stopped"))
    rows = pairs.join(count, "rel", "left").join(found, "rel", "left")
    much = (F.coalesce("n", F.lit(0)) > F.col("budget")) | F.coalesce("stopped", F.lit(False)) | (F.coalesce("bytes", F.lit(0)) > F.col("budget"))
    totals = rows.select("rel", much.alias("too_much"), F.when(~much, F.coalesce("bytes", F.lit(0))).alias("differing"))
    return totals, runs.join(totals.filter("NOT too_much"), "rel", "left_semi")


def facts(pairs: DataFrame, structures: DataFrame, kinds: DataFrame, chunks: DataFrame, spans: DataFrame, sizes: DataFrame, size: int = ranges.RANGE, algorithm: str = "xxh64") -> DataFrame:
    """What ladder() judges twins by, a row a pair.

    pairs (rel, a, b, size_a, size_b, ext): the two files. structures (rel, side, start, stop, hash): where each side's
    structure box lies, and its digest when it was parsed. kinds (rel, track, kind): 'essence' for picture and sound,
    'meta' for any other track. chunks, spans and sizes: a's sample tables, as chunk_spans (H7) takes them.
    """
    one = structures.filter("side = 'a'").select("rel", "start", "stop", "hash")
    other = structures.filter("side = 'b'").select("rel", F.struct("start", "stop", "hash").alias("twin"))
    base = pairs.select("rel", "a", "b", "size_a", "size_b", "ext").join(one, "rel", "left").join(other, "rel", "left")
    base = base.withColumns({"parsed": F.col("hash").isNotNull() & F.col("twin").isNotNull(), "structure_equal": F.coalesce(F.struct("start", "stop", "hash") == F.col("twin"), F.lit(False))})
    base = kept(base)
    fit = base.filter(F.col("ext").isin(*PINNED) & (F.col("size_a") == F.col("size_b")) & F.col("structure_equal"))

    track = kept(digest.chunk_spans(*(x.join(fit.select("rel"), "rel", "left_semi") for x in (chunks, spans, sizes))).join(kinds, ["rel", "track"]))
    samples = sizes.groupBy("rel", "track").agg(F.count("*").alias("n")).join(kinds, ["rel", "track"]).filter("kind <> 'essence'").groupBy("rel").agg(F.sum("n").alias("samples"))
    tracks = kinds.groupBy("rel").agg(F.count("*").alias("tracks"))
    essence = track.filter("kind = 'essence'").groupBy("rel").agg(F.count("*").alias("essence_spans"))
    crossed = digest.overlapping(track, "rel").withColumn("crossed", F.lit(True))
    rows = base
    for x in (tracks, samples, essence, crossed):
        rows = rows.join(x, "rel", "left")
    rows = rows.na.fill(0, ["tracks", "samples", "essence_spans"]).na.fill(False, ["crossed"])
    rows = kept(rows.withColumn("sound", (F.col("tracks") > 0) & ~F.col("crossed")))

    fit = fit.join(rows.filter(F.col("sound") & (F.col("essence_spans") > 0) & (F.col("samples") >= MIN_SAMPLES)).select("rel"), "rel", "left_semi")
    totals, runs = compared(fit.select("rel", "a", "b", F.col("size_a").alias("size")), size)
    again = fit.select("rel", F.col("a").alias("path"), F.lit(0).cast("long").alias("no"), F.col("start").alias("offset"), (F.col("stop") - F.col("start")).alias("length"))
    again = ranges.range_digests(again, ["rel"], algorithm).select("rel", F.col("hash").alias("verified"))
    inside = digest.overlaps(runs, track.filter("kind = 'essence'"), "rel", min(size, CELL)).withColumnRenamed("bytes", "inside")
    for x in (totals, again, inside):
        rows = rows.join(x, "rel", "left")
    rows = rows.withColumn("structure_stable", F.coalesce(F.col("verified") == F.col("hash"), F.lit(False)))
    return rows.withColumn("essence_overlap", F.when(F.col("differing").isNotNull(), F.coalesce("inside", F.lit(0))))


def ladder(facts: DataFrame) -> DataFrame:
    """H9: (rel, state, differing, essence_overlap, share): harmless, or the first refusal that fits."""
    c = F.col
    state = (
        F.when(~c("ext").isin(*PINNED), "NotPinnedContainer").when(c("size_a") != c("size_b"), "LengthMismatch").when(~c("parsed"), "Unparsable").when(~c("structure_equal"), "MoovDiffers")
        .when(~c("sound") | (c("essence_spans") == 0), "Unparsable").when(c("samples") < MIN_SAMPLES, "TooFewSamples").when(c("too_much"), "TooMuchDiffers")
        .when(~c("structure_stable"), "MoovNotStable").when(c("essence_overlap") > 0, "EssenceDiffers").otherwise("Accounted")
    )
    return facts.select("rel", state.alias("state"), "differing", "essence_overlap", F.round(F.try_divide("differing", "size_a"), 6).alias("share"))
