"""Digests of content, and byte differences between two copies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats

#: XXH64 of this number, seed 42, is 0; hashed before the content it gives XXH64 with seed 0.
SEED_ZERO = -365884300664092260
CHUNK, BLOCK = 4 << 20, 4096


def xxh64(content: Column) -> Column:
    """H1: XXH64 with seed 0 as 16 hex digits; null of null."""
    return F.when(content.isNotNull(), formats.hex64(F.xxhash64(F.lit(SEED_ZERO).cast("long"), content)))


def digests(files: DataFrame) -> DataFrame:
    """H1: (path, bytes, hash) of binaryFile rows."""
    return files.select("path", F.col("length").alias("bytes"), xxh64(F.col("content")).alias("hash"))


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """H1 beyond 2 GB: (path, bytes, hash) of (path, chunk_no, content); a file's chunks stream through one task in order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n, h = None, 0, xxhash.xxh64()
        row = lambda: pa.RecordBatch.from_pydict({"path": [path], "bytes": [n], "hash": [h.hexdigest()]})
        for b in batches:
            for p, content in zip(b.column(0), b.column(2), strict=True):
                if p.as_py() != path:
                    if path is not None:
                        yield row()
                    path, n, h = p.as_py(), 0, xxhash.xxh64()
                data = content.as_py() or b""
                h.update(data)
                n += len(data)
        if path is not None:
            yield row()

    rows = chunks.select("path", "chunk_no", "content").repartition("path").sortWithinPartitions("path", "chunk_no")
    return rows.mapInArrow(each, "path string, bytes long, hash string")


def chain_audit(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """H3: generations whose file is not what the chain says."""
    rows = recorded.join(found.select("folder", "sequence", F.col("hash").alias("now")), ["folder", "sequence"], "left")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("hash"), "edited").otherwise("intact")
    return rows.select("folder", "sequence", state.alias("state"))


def chunked(files: DataFrame, key: str, content: str, chunk: int = CHUNK) -> DataFrame:
    """(key, no, content): files cut into chunk rows; each row carries its own bytes alone. An empty file has chunk 0."""
    last = F.floor(F.greatest(F.octet_length(content) - 1, F.lit(0)) / chunk).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col(content), i * chunk + 1, F.lit(chunk)))
    return files.filter(F.col(content).isNotNull()).select(key, F.posexplode(cut).alias("no", "content"))


def diff_runs(one: DataFrame, other: DataFrame, key: str, chunk: int = CHUNK) -> DataFrame:
    """(key, start, length) of runs of differing bytes of twins of one length, given as chunk rows (see chunked).

    Chunks are joined by key and number and compared whole; of those that differ blocks are compared, and only blocks
    that differ are looked at byte by byte. Runs end at chunk edges.
    """
    both = one.select(key, "no", F.col("content").alias("a")).join(other.select(key, "no", F.col("content").alias("b")), [key, "no"]).filter("a <> b")
    block = lambda c, i: F.substring(F.col(c), i * BLOCK + 1, F.lit(BLOCK))
    blocks = F.sequence(F.lit(0), F.floor((F.octet_length("a") - 1) / BLOCK).cast("int"))
    unlike = both.select(key, "no", F.explode(F.filter(F.transform(blocks, lambda i: F.struct(i.alias("_block"), block("a", i).alias("a"), block("b", i).alias("b"))), lambda x: x["a"] != x["b"])).alias("x"))
    unlike = unlike.select(key, "no", "x.*")
    places = F.filter(F.sequence(F.lit(1), F.octet_length("a")), lambda k: F.substring(F.col("a"), k, F.lit(1)) != F.substring(F.col("b"), k, F.lit(1)))
    bytes_ = unlike.select(key, "no", "_block", F.explode(places).alias("_byte")).withColumn("pos", F.col("no").cast("long") * chunk + F.col("_block") * BLOCK + F.col("_byte") - 1)
    island = F.col("pos") - F.row_number().over(Window.partitionBy(key, "no").orderBy("pos"))
    return bytes_.withColumn("island", island).groupBy(key, "no", "island").agg(F.min("pos").alias("start"), F.count("*").alias("length")).select(key, "start", "length")


def overlaps(runs: DataFrame, spans: DataFrame, key: str, grid: int = CHUNK) -> DataFrame:
    """H5: bytes of runs that lie in protected spans [start, stop), for each key.

    Both sides are cut to a grid, so the range join is an equal join of cells first; a cell counts its own part only.
    """
    def cells(df: DataFrame, start: Column, stop: Column) -> DataFrame:
        df = df.select(key, start.alias("s"), stop.alias("e")).filter("e > s")
        df = df.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / grid), F.floor((F.col("e") - 1) / grid))))
        return df.select(key, "cell", F.greatest("s", F.col("cell") * grid).alias("s"), F.least("e", (F.col("cell") + 1) * grid).alias("e"))

    a = cells(runs, F.col("start"), F.col("start") + F.col("length"))
    b = cells(spans, F.col("start"), F.col("stop")).select(key, "cell", F.col("s").alias("s2"), F.col("e").alias("e2"))
    both = a.join(b, [key, "cell"]).filter("s < e2 AND s2 < e")
    return both.groupBy(key).agg(F.sum(F.least("e", "e2") - F.greatest("s", "s2")).alias("bytes"))


def masked(text: Column, attributes: tuple[str, ...]) -> Column:
    """H6: a text with the characters of these attributes' values masked, its length as it was."""
    return F.regexp_replace(text, rf'(?<=[\s</](?:{"|".join(attributes)})="[A-Za-z0-9]{{0,127}})[A-Za-z0-9]', "_")


def identifiers_only(twins: DataFrame, key: str, attributes: tuple[str, ...]) -> DataFrame:
    """H6: how two index texts differ: not, in length, in identifiers alone, elsewhere, or without any identifier."""
    spans = F.regexp_count("a", F.lit(rf'[\s</](?:{"|".join(attributes)})="[A-Za-z0-9]{{1,128}}"'))
    state = (
        F.when(F.col("a") == F.col("b"), "Equal").when(F.length("a") != F.length("b"), "LengthMismatch").when(spans == 0, "Unparsable")
        .when(masked(F.col("a"), attributes) == masked(F.col("b"), attributes), "IdentifiersOnly").otherwise("EssenceDiffers")
    )
    return twins.select(key, state.alias("state"))


def chunk_spans(chunks: DataFrame, ranges: DataFrame, sizes: DataFrame) -> DataFrame:
    """H7: the bytes [start, stop) of each chunk: as many samples as the last range that begins at or before it says, or one.

    Where the table of sizes ends, chunks end; those without any sample left are no spans.

    chunks (rel, track, chunk_no, offset), ranges (rel, track, first_chunk, samples_per_chunk), sizes (rel, track, sample_no, size).
    """
    track = ["rel", "track"]
    marks = ranges.select(*track, F.col("first_chunk").alias("at"), F.lit(0).alias("kind"), "samples_per_chunk", F.lit(None).cast("long").alias("offset"))
    marks = marks.unionByName(chunks.select(*track, F.col("chunk_no").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("samples_per_chunk"), "offset"))
    before = Window.partitionBy(*track).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    per = marks.withColumn("n", F.coalesce(F.last("samples_per_chunk", ignorenulls=True).over(before), F.lit(1))).filter("kind = 1")
    per = per.withColumn("upto", F.sum("n").over(Window.partitionBy(*track).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    # Sample numbers and the last samples of chunks stand in one row: what is summed up to a chunk's last, less what was at the chunk before, is its size.
    asked = per.select(*track, F.col("upto").alias("pos"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("size"), F.col("at").alias("chunk_no"), "offset")
    line = asked.unionByName(sizes.select(*track, F.col("sample_no").cast("long").alias("pos"), F.lit(0).alias("kind"), "size"), allowMissingColumns=True)
    order = Window.partitionBy(*track).orderBy("pos", "kind", "chunk_no")
    ends = line.withColumn("sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("kind = 1")
    rows = ends.withColumn("size", F.col("sum") - F.lag("sum", 1, 0).over(order))
    return rows.select(*track, "chunk_no", F.col("offset").alias("start"), (F.col("offset") + F.col("size")).alias("stop")).filter("stop > start")


def overlapping(spans: DataFrame, key: str) -> DataFrame:
    """H8: keys of which a metadata span overlaps one of essence.

    In the order of their starts, one does if it begins before the furthest end of the other kind so far; so a key's spans
    are passed over once, and never compared with each other.
    """
    before = Window.partitionBy(key).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    other = {kind: F.max(F.when(F.col("kind") == twin, F.col("stop"))).over(before) for kind, twin in (("meta", "essence"), ("essence", "meta"))}
    rows = spans.select(key, "kind", "start", "stop").filter("kind IN ('meta', 'essence')")
    return rows.withColumn("reach", F.when(F.col("kind") == "meta", other["meta"]).otherwise(other["essence"])).filter("reach > start").select(key).distinct()


def kept_proven(kept: DataFrame, measured: DataFrame) -> DataFrame:
    """Kept files whose digest on every destination is the other card's: kept (session_id, rel, want)."""
    rows = kept.join(measured.select("session_id", "rel", "slot", "hash"), ["session_id", "rel"], "left")
    ok = F.coalesce(F.bool_and(F.coalesce(F.col("hash") == F.col("want"), F.lit(False))), F.lit(False))
    return rows.groupBy("session_id", "rel").agg(ok.alias("proven"), F.count("hash").alias("destinations"))
