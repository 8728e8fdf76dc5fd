"""A Merkle manifest of a dataset: leaves of rows, a tree for each group, a tree over the groups, and proofs of leaves.

A tree's inner nodes are kept as content-addressed records from a digest to the digests HEIGHT levels below it, so that
a record stands for a segment of up to 2^HEIGHT paths. Proofs start at the root with a leaf's rank, whose digits in base
2^HEIGHT say which child to take in each record on the way down; the nodes not taken are the proof, segment by segment,
and are put into the order from leaf to root at the end. Leaves are numbered by ranges, never in one task, and
neither a record nor a bundle of requests holds more than 2^HEIGHT digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Levels of a tree in one record.
HEIGHT = 8
#: Rows of a range that is numbered by one task, on average.
RANGE_ROWS = 20_000
#: What is known of each tree, some 200 bytes, is sent to every task for up to this many trees, and joined by shuffle beyond.
BROADCAST_TREES = 100_000


def beside(trees: DataFrame) -> DataFrame:
    """A table of a row a tree (a saved one), to be joined to many rows of each: most rows may be of one tree."""
    return F.broadcast(trees) if trees.count() <= BROADCAST_TREES else trees


def netstring(column: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value."""
    value = column.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*columns: Column) -> Column:
    """The digest of a row: lowercase hex sha256 of its values' netstrings in turn."""
    return F.sha2(F.concat(*[netstring(c) for c in columns]), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows (saved ones), with `rank`, from 0 in each group by the order, nulls first; equal rows in any order.

    Rows are dealt out by ranges of group and order, with a number of their own at the end so that equal rows split too;
    the rows before a range come from the ranges' counts, of which there is one for each range and group in it.
    """
    parts = max(1, rows.count() // RANGE_ROWS)
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("_own")]
    dealt = rows.withColumn("_own", F.monotonically_increasing_id()).repartitionByRange(parts, *keys)
    dealt = saved(dealt.withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*keys[1:]))
    placed = dealt.withColumn("_place", place).join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return placed.withColumn("rank", F.col("_before") + F.col("_place") - 1).select(*rows.columns, "rank")


def doublings(n: Column) -> Column:
    """How often n nodes are paired until one is left."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1)))


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climbed(nodes: list[str], levels: int) -> list[list[str]]:
    """The levels from nodes upwards: every two consecutive ones become their digest, a last one alone its own."""
    out = [nodes]
    for _ in range(levels):
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def trees(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The trees over nodes (tree, rank, digest), ranks from 0 without gaps.

    Returns the records of each round from the lowest, (digest, levels, children), a row a digest; and the roots
    (tree, digest, rounds). A round takes the nodes HEIGHT levels up, or to a tree's root if fewer levels are left.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tops, children = [], []
            for levels, block in zip(b.column("levels").to_pylist(), b.column("block_nodes"), strict=True):
                nodes = block.values
                own = nodes.field("digest").take(pa.compute.sort_indices(nodes.field("rank"))).to_pylist()
                tops.append(climbed(own, levels)[-1][0])
                children.append(pa.array(own, pa.string()))
            sizes = np.cumsum([0, *map(len, children)])
            children = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.concat_arrays(children) if children else pa.array([], pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("block"), b.column("levels"), b.column("last"), pa.array(tops, pa.string()), children], ["tree", "rank", "levels", "last", "digest", "children"])

    records, roots, round_ = [], None, 1
    while True:
        sizes = nodes.groupBy("tree").agg(F.count("*").alias("size"))
        left = doublings(F.col("size"))
        sizes = sizes.select(F.col("tree").alias("_tree"), F.least(left, F.lit(HEIGHT)).alias("levels"), (left <= HEIGHT).alias("last"))
        blocks = nodes.groupBy("tree", F.shiftright("rank", HEIGHT).alias("block")).agg(F.collect_list(F.struct("rank", "digest")).alias("block_nodes"))
        blocks = blocks.join(sizes, F.col("tree").eqNullSafe(F.col("_tree"))).select("tree", "block", "levels", "last", "block_nodes")
        up = saved(blocks.mapInArrow(each, "tree long, rank long, levels int, last boolean, digest string, children array<string>"))
        records.append(up.select("digest", "levels", "children").dropDuplicates(["digest", "levels"]))
        done = up.filter("last").select("tree", "digest", F.lit(round_).alias("rounds"))
        roots = done if roots is None else roots.unionByName(done)
        nodes = up.filter("NOT last").select("tree", "rank", "digest")
        if nodes.isEmpty():
            return records, saved(roots)
        round_ += 1


def descended(frontier: DataFrame, records: DataFrame, wanted: DataFrame) -> DataFrame:
    """One record further down: frontier (tree, rank, digest, levels, path) to the children wanted (tree, child), each once.

    path gathers the siblings, a segment for each record
    passed, the uppermost segment first; within a segment, from the lower level to the upper.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"tree": [], "rank": [], "digest": [], "path": []}
            for tree, rank, levels, path, children, digits in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                up = climbed(children, levels)
                for digit in digits:
                    at, segment = digit, []
                    for level in up[:levels]:
                        if at ^ 1 < len(level):
                            segment.append(level[at ^ 1])
                        at >>= 1
                    out["tree"].append(tree)
                    out["rank"].append((rank << HEIGHT) + digit)
                    out["digest"].append(children[digit])
                    out["path"].append([*path, "".join(segment)])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("tree", pa.int64()), ("rank", pa.int64()), ("digest", pa.string()), ("path", pa.list_(pa.string()))]))

    asked = wanted.groupBy("tree", F.shiftright("child", HEIGHT).alias("rank"))
    asked = asked.agg(F.collect_list((F.col("child").bitwiseAND(F.lit((1 << HEIGHT) - 1))).cast("int")).alias("digits"))
    rows = frontier.join(asked, ["tree", "rank"]).join(records, ["digest", "levels"]).select("tree", "rank", "levels", "path", "children", "digits")
    return rows.mapInArrow(each, "tree long, rank long, digest string, path array<string>")


def proofs(records: list[DataFrame], sizes: DataFrame, roots: DataFrame, wanted: DataFrame, path: str | None = None) -> DataFrame:
    """For each node wanted (tree, rank), a row (tree, rank, digest, path): the siblings' segments from its tree's root down.

    roots (tree, digest, rounds) as trees() gives them, with `path` if they lie in a larger tree themselves; sizes (tree,
    size). Requests of one subtree travel as one row until they part; a digest met in several places is one record.
    """
    rounds = len(records)
    start = roots.join(sizes, "tree").select("tree", F.lit(0).cast("long").alias("rank"), "digest", "rounds", "size", (F.col(path) if path else F.array().cast("array<string>")).alias("path"))
    known, frontier = beside(roots.select("tree", "rounds")), None
    for r in range(rounds, 0, -1):
        levels = doublings(F.col("size")) - HEIGHT * (r - 1)
        fresh = start.filter(F.col("rounds") == r).select("tree", "rank", "digest", levels.alias("levels"), "path")
        below = fresh if frontier is None else fresh.unionByName(frontier.withColumn("levels", F.lit(HEIGHT)))
        children = wanted.select("tree", F.shiftright("rank", HEIGHT * (r - 1)).alias("child")).distinct()
        children = children if r == 1 else children.join(known, "tree").filter(F.col("rounds") >= r)
        frontier = descended(below, records[r - 1], children)
        frontier = saved(frontier) if r > 1 else frontier
    return frontier


def verified(docs: DataFrame) -> DataFrame:
    """docs' rows as a Merkle manifest, each with its leaf, subroot, root, proof, and whether it can be told from a tampered copy.

    Columns: doc_id, lang, leaf, subroot, root, proof (siblings from leaf to root, joined), proof_sha256, folded_root,
    verified. A leaf is the digest of doc_id, source, lang, n_chars and text; leaves stand in a tree for each lang by
    doc_id, the trees' roots, ordered by lang, in one more. folded_root is recomputed from the proof and a copy of the
    row of which, where 7 divides crc32(doc_id), n_chars has been raised by 1.

    Nulls are digested as such; a null lang is a group, the first; null doc_ids come first in theirs and are never
    tampered with. Rows of equal doc_id are ordered by their leaves, and equal rows are leaves each. Very long texts are
    digested whole. An empty table gives no rows. Further columns are left out, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), F.col("text").cast("string"))
    own = leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    altered = leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = saved(docs.select("doc_id", "lang", own.alias("leaf"), F.when(hit & F.col("n_chars").isNotNull(), altered).alias("altered")))
    rows = numbered(rows, "lang", ["doc_id", "leaf"])
    groups = saved(rows.groupBy("lang").agg(F.count("*").alias("size")).withColumn("one", F.lit(0)))
    groups = saved(numbered(groups, "one", ["lang"]).select(F.col("rank").alias("tree"), "lang", "size"))
    named = beside(groups.select("tree", F.col("lang").alias("_lang")))
    rows = saved(rows.join(named, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang"))

    records, subroots = trees(rows.select("tree", "rank", F.col("leaf").alias("digest")))
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), "digest")
    above, root = trees(tops)
    one = tops.groupBy("tree").agg(F.count("*").alias("size"))
    paths = proofs(above, one, root, tops.select("tree", "rank"))
    roots = subroots.join(paths.select(F.col("rank").alias("tree"), "path"), "tree")
    found = proofs(records, groups.select("tree", "size"), roots, rows.select("tree", "rank"), "path")
    tree = saved(groups.select("tree", "size").join(subroots.select("tree", F.col("digest").alias("subroot")), "tree"))
    joined = rows.join(found.select("tree", "rank", F.array_join(F.reverse("path"), "").alias("proof")), ["tree", "rank"]).join(beside(tree), "tree")
    top, groups_ = root.first(), one.first()  # a row each, none of an empty table
    joined = joined.withColumn("root", F.lit(top and top.digest).cast("string")).withColumn("trees", F.lit(groups_ and groups_.size).cast("long"))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for digest, proof, rank, size, tree, trees in zip(*(b.column(c).to_pylist() for c in ("copy", "proof", "rank", "size", "tree", "trees")), strict=True):
                for at, n in ((rank, size), (tree, trees)):
                    while n > 1:
                        if at ^ 1 < n:
                            sibling, proof = proof[:64], proof[64:]
                            digest = h(sibling, digest) if at & 1 else h(digest, sibling)
                        else:
                            digest = h(digest)
                        at, n = at >> 1, (n + 1) >> 1
                out.append(digest)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "lang", "leaf", "subroot", "root", "proof")], pa.array(out, pa.string())], ["doc_id", "lang", "leaf", "subroot", "root", "proof", "folded_root"])

    schema = "doc_id long, lang string, leaf string, subroot string, root string, proof string, folded_root string"
    out = joined.withColumn("copy", F.coalesce("altered", "leaf")).mapInArrow(folded, schema)
    return out.select("doc_id", "lang", "leaf", "subroot", "root", "proof", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
