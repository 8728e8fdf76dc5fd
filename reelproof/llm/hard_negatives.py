"""Hard negatives of anchors: rows of another label that score nearly as high as rows of the anchor's own.

Anchors of a group form a spanning tree by distance. A row's scores are taken down the tree: its score at an anchor is
its score at the parent, give or take the length of the edge times the row's norm. Only rows whose bounds reach into what
an anchor still looks for are scored exactly, and their bounds are points from there on. Scores are exact integers.

Rows lie in blocks, anchors in groups, and a task takes one block down one group's tree, so that neither grows with the
table; what a task finds for an anchor is at most what the anchor asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Anchors of a group, rows of a block, the least number of blocks, and rows taken down the tree at once.
ANCHORS, BLOCK, BLOCKS, LANES = 2048, 16_384, 24, 2048
#: Whole numbers up to this are exact in doubles; scores that a long can't hold become its ends.
EXACT, LEAST, MOST = 1 << 53, -(1 << 63), (1 << 63) - 1
#: Bounds are widened by this share, for the rounding of doubles.
SLACK = 1e-9


def prepared(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(uid, vec_id, label, vec) of the rows that take part, each component floor(scale * x); uid tells equal rows apart."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fit = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~odd)

    def whole(x: Column) -> Column:
        y = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) < F.lit(2.0**52), F.floor(y).cast("double")).otherwise(y)

    return fit.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform("embedding", whole).alias("vec"))


def spanning(vectors: np.ndarray) -> tuple[list[int], list[int], list[float]]:
    """A least spanning tree from the first vector on: the order in which vectors join it, their parents, and the edges' lengths."""
    n = len(vectors)
    order, parent, edge = [0] if n else [], [-1] * n, [0.0] * n
    best, link = np.full(n, np.inf), np.zeros(n, np.int64)
    left = np.arange(1, n)
    for _ in range(n - 1):
        d = np.sqrt(((vectors[left] - vectors[order[-1]]) ** 2).sum(axis=1))
        nearer = d < best[left]
        best[left[nearer]], link[left[nearer]] = d[nearer], order[-1]
        k = int(np.argmin(best[left]))
        at = int(left[k])
        order.append(at)
        parent[at], edge[at] = int(link[at]), float(best[at])
        left = np.delete(left, k)
    return order, parent, edge


def padded(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as the rows of a matrix; missing components are 0, those beyond the width left out."""
    size = np.diff(vectors.offsets.to_numpy())
    width = int(size.max(initial=0)) if width is None else width
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return values.reshape(len(size), width)
    out = np.zeros((len(size), width))
    row, col = np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    out[row[col < width], col[col < width]] = values[col < width]
    return out


def exact(rows: np.ndarray, anchor: np.ndarray, safe: bool) -> np.ndarray:
    """The integer scores of rows with an anchor; safe says that doubles hold them exactly."""
    if safe:
        return (rows @ anchor).astype(np.int64)
    own = [int(x) for x in anchor]
    return np.array([min(MOST, max(LEAST, sum(int(x) * y for x, y in zip(r, own, strict=True)))) for r in rows], np.int64)


class Best:
    """The `most` first rows by score, then vec_id (nulls last), among those put in."""

    def __init__(self, most: int):
        self.most, self.score, self.order, self.at = most, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def floor(self) -> int:
        """The least score that may still come in."""
        return int(self.score[-1]) if len(self.score) == self.most else LEAST

    def put(self, score: np.ndarray, order: np.ndarray, at: np.ndarray) -> None:
        if len(score) > self.most:  # those below the last place are out before any sort
            keep = score >= np.partition(score, len(score) - self.most)[len(score) - self.most]
            score, order, at = score[keep], order[keep], at[keep]
        score, order, at = np.concatenate((self.score, score)), np.concatenate((self.order, order)), np.concatenate((self.at, at))
        first = np.lexsort((order, score.view(np.uint64) ^ np.uint64((1 << 63) - 1)))[: self.most]  # descending, whatever the sign
        self.score, self.order, self.at = score[first], order[first], at[first]


def surely(low: np.ndarray, most: int) -> float:
    """What the `most` first of rows of these lower bounds reach at least."""
    return float(np.partition(low, len(low) - most)[len(low) - most]) if len(low) >= most else -np.inf


def reach(values: np.ndarray, up: bool) -> np.ndarray:
    return values + np.abs(values) * SLACK if up else values - np.abs(values) * SLACK


def walked(block: pa.StructScalar, group: pa.StructScalar, most: int, windows: list | None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """What a block has for each anchor of a group: (anchor's place, rows' places, scores).

    Without windows, the first rows of the anchor's label, other than itself. With them, a list of score ranges for each
    anchor, the first rows of another label within each range.
    """
    uid, label = (np.asarray(block[c].values) for c in ("uid", "label"))
    order = block["vec_id"].values.fill_null(MOST).to_numpy(zero_copy_only=False)
    vectors, anchors = block["vec"].values, group["vec"].values
    own_uid, own_label = (np.asarray(group[c].values) for c in ("uid", "label"))
    tree, parent, edge = (np.asarray(group[c].values) for c in ("tree", "parent", "edge"))
    found = [[Best(most)] for _ in own_uid] if windows is None else [[Best(most) for _ in w] for w in windows]
    by_size = np.argsort(np.diff(vectors.offsets.to_numpy()), kind="stable")
    for lane in range(0, len(uid), LANES):
        at = by_size[lane : lane + LANES]
        rows = padded(vectors.take(pa.array(at)))
        a = padded(anchors, rows.shape[1])
        safe = float(np.abs(rows).max(initial=0)) * float(np.abs(a).max(initial=0)) * max(1, rows.shape[1]) < EXACT
        norm, own, number, who = np.sqrt((rows * rows).sum(axis=1)) * (1 + SLACK), label[at], order[at], uid[at]
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for node in tree.tolist():
            if parent[node] < 0:
                score = exact(rows, a[node], safe)
                lo, hi = reach(score.astype(float), False), reach(score.astype(float), True)
            else:
                wide = float(edge[node]) * (1 + SLACK) * norm
                lo, hi = low[parent[node]] - wide, high[parent[node]] + wide
            if windows is None:
                wanted = (own == own_label[node]) & (who != own_uid[node])
                wanted &= hi >= max(found[node][0].floor(), surely(lo[wanted], most))
            else:
                other, wanted = own != own_label[node], np.zeros(len(at), bool)
                for (least, top), best in zip(windows[node], found[node], strict=True):
                    inside = other & (lo >= least) & (hi <= top)
                    wanted |= (hi >= max(least, best.floor(), surely(lo[inside], most))) & (lo <= top)
                wanted &= other
            hit = np.flatnonzero(wanted)
            if len(hit):
                score = exact(rows, a[node], safe)[hit] if safe and 2 * len(hit) > len(at) else exact(rows[hit], a[node], safe)
                lo[hit], hi[hit] = reach(score.astype(float), False), reach(score.astype(float), True)
                if windows is None:
                    found[node][0].put(score, number[hit], at[hit])
                else:
                    for (least, top), best in zip(windows[node], found[node], strict=True):
                        fits = (score >= max(least, best.floor())) & (score <= top)
                        if fits.any():
                            best.put(score[fits], number[hit][fits], at[hit][fits])
            low[node], high[node] = lo, hi
    out = []
    for node, bests in enumerate(found):
        if bests:
            at, k = np.unique(np.concatenate([b.at for b in bests]), return_index=True)
            out.append((node, at, np.concatenate([b.score for b in bests])[k]))
    return out


def blocks(rows: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Rows in blocks and anchors in groups, a row each, both saved, and their numbers. A group holds its spanning tree."""
    n, m = rows.count(), anchors.count()
    parts, groups = max(-(-n // BLOCK), min(BLOCKS, -(-n // 64)), 1), max(1, -(-m // ANCHORS))
    row = F.struct("uid", "vec_id", "label", "vec")
    packed = lambda df, of: df.groupBy(of).agg(F.collect_list(row).alias("r")).select(of, *[F.col(f"r.{c}").alias(c) for c in ("uid", "vec_id", "label", "vec")])
    block = packed(rows.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(parts))), "block")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spanning(padded(b.column("vec")[i].values)) for i in range(b.num_rows)]
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()))
            more = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "tree", "parent", "edge"])

    group = packed(anchors.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(groups))), "part")
    group = group.mapInArrow(trees, "part long, uid array<long>, vec_id array<long>, label array<long>, vec array<array<double>>, tree array<int>, parent array<int>, edge array<double>")
    return saved(block), saved(group), parts, groups


def met(block: DataFrame, group: DataFrame, parts: int, groups: int, most: int) -> DataFrame:
    """(anchor, row, vec_id, score): for each block and anchor the rows it has to offer, by windows if the groups have any."""
    ranged = "least" in group.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                own, other = b.column("b")[k], b.column("g")[k]
                windows = None
                if ranged:
                    at = {u: i for i, u in enumerate(other["uid"].as_py())}
                    windows = [[] for _ in at]
                    for u, least, top in zip(*(other[c].as_py() or [] for c in ("of", "least", "top")), strict=True):
                        windows[at[u]].append((least, top))
                for node, rows, score in walked(own, other, most, windows):
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), other["uid"].values[node].as_py())), own["uid"].values.take(take), own["vec_id"].values.take(take), pa.array(score)], ["anchor", "row", "vec_id", "score"])

    cells = lambda of, n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(of)
    tasks = min(10_000, parts * groups)
    left = block.select("block", F.struct(*[c for c in block.columns if c != "block"]).alias("b"), cells("part", groups)).repartition(tasks, "block", "part")
    right = group.select("part", F.struct(*[c for c in group.columns if c != "part"]).alias("g"), cells("block", parts)).repartition(tasks, "block", "part")
    return left.join(right, ["block", "part"]).select("b", "g").mapInArrow(each, "anchor long, row long, vec_id long, score long")


def mined(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, top: int = 90, scale: int = 256) -> DataFrame:
    """Hard negatives of rows (vec_id, label, embedding): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of floor(scale * x); higher ones come first, ties by smaller vec_id. anchor says which rows
    are anchors. An anchor's positives are the first other rows of its label; its negatives for a positive are the first
    rows of other labels whose score is between `least` and `top` hundredths of the positive's.

    Rows with a null label, a null vector, or any null or non-finite component take no part. A null vec_id comes after all
    others and is named null. Repeated rows are rows each, and each other's positives. Vectors may differ in length:
    missing components count as 0. Scores that a long can't hold are its ends. No rows or no anchors: no result. Further
    columns are left out, whatever their names.
    """
    own = saved(prepared(rows, scale))
    asked = saved(own.filter(anchor))
    block, group, parts, groups = blocks(own, asked)
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("row")]
    near = met(block, group, parts, groups, positives).withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*order)))
    near = saved(near.filter(F.col("place") <= positives).select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    share = lambda x, up: F.call_function("ceil" if up else "floor", F.col("positive_score").cast("decimal(30,0)") * F.lit(x) / F.lit(100)).cast("long")
    ranges = near.select("anchor", share(least, True).alias("least"), share(top, False).alias("top")).filter("least <= top").distinct()
    ranges = ranges.groupBy(F.pmod(F.xxhash64("anchor", F.lit(1)), F.lit(groups)).alias("part")).agg(F.collect_list(F.struct("anchor", "least", "top")).alias("w"))
    ranges = ranges.select("part", F.col("w.anchor").alias("of"), F.col("w.least").alias("least"), F.col("w.top").alias("top"))
    far = met(block, group.join(ranges, "part"), parts, groups, negatives)
    exact_ = lambda c, x: F.col(c).cast("decimal(30,0)") * x
    fits = (exact_("positive_score", least) <= exact_("score", 100)) & (exact_("score", 100) <= exact_("positive_score", top))
    both = far.join(near, "anchor").filter(fits).withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*order)))
    named = asked.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = both.filter(F.col("rank") <= negatives).join(named, "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
