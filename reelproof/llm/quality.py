"""Document quality: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: The most labelled rows that a model learns from. More labels than this are sampled by a hash of doc_id.
SAMPLE_ROWS = 20_000
BINS, TREES, DEPTH, RATE, RIDGE, LEAST = 64, 60, 4, 0.2, 1.0, 5.0
MARKS = b"!?.,;:|#$%&*/\\<>{}[]()=_-\"'@~^+"
STATISTICS = (
    "log_chars", "log_words", "log_lines", "upper", "digits", "white", "other_marks", "high_bytes", "byte_entropy",
    "word_length", "word_length_spread", "long_words", "one_letter_words", "distinct_words", "commonest_word",
    "capital_words", "marked_ends", "sentence_ends", "line_length", "short_lines", "repeated_lines", "letters_in_words",
    *(f"mark_{m:02x}" for m in MARKS),
)
LETTER = np.array([chr(b).isalpha() and b < 128 or b > 127 for b in range(256)])


def statistics(text: bytes) -> list[float]:
    """The STATISTICS of a whole text; all zero for an empty one."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    if not words:
        return [0.0] * len(STATISTICS)
    n, m, k = len(text), len(words), len(lines)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    p = c[c > 0] / n
    letters = max(1, int(c[LETTER].sum()))
    upper, white = int(c[65:91].sum()), int(c[32] + c[9:14].sum())
    high, digits = int(c[128:].sum()), int(c[48:58].sum())
    length = np.fromiter(map(len, words), np.int64, m)
    seen, ends = Counter(words), Counter(w[-1] for w in words)
    return [
        math.log1p(n), math.log1p(m), math.log1p(k), upper / letters, digits / n, white / n, (n - letters - white - digits) / n, high / n, float(-(p * np.log2(p)).sum()),
        float(length.mean()), float(length.std()), float((length > 20).mean()), float((length == 1).mean()), len(seen) / m, max(seen.values()) / m,
        sum(1 for w in words if w.isupper()) / m, sum(v for e, v in ends.items() if not LETTER[e]) / m, (ends[46] + ends[33] + ends[63]) / m, n / k, sum(1 for x in lines if len(x) < 30) / k, 1 - len(set(lines)) / k, letters / n,
        *(c[list(MARKS)] / n).tolist(),
    ]


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from: the crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    """Trees as arrays, a row a tree: node i's children are 2i + 1 and 2i + 2; the last row of nodes are leaves."""

    start: float
    edges: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row of x: all rows go down a tree together, a step at a time."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosted trees for the log loss; splits are found on histograms of at most BINS bins a statistic, level by level."""
    n, d = x.shape
    inner = 2**DEPTH - 1
    if n == 0 or y.min() == y.max():
        mean = 0.0 if n == 0 else math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
        return Model(mean, np.zeros((d, 0)), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = np.sort(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T, axis=1)
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # x > e[b - 1] for its bin b
    flat = bins + np.arange(d) * BINS
    mean = math.log(y.mean() / (1 - y.mean()))
    total, features, cuts, leaves = np.full(n, mean), [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        at, feature, cut = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * (d * BINS) + flat).ravel()
            sums = [np.cumsum(np.bincount(cell, np.repeat(v, d), width * d * BINS).reshape(width, d, BINS), axis=2) for v in (g, h)]
            gl, hl = (s[:, :, :-1] for s in sums)
            gt, ht = (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(hl < LEAST / 4) | (ht - hl < LEAST / 4)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k, b in enumerate(best):
                if gain[k].ravel()[b] > 1e-9:
                    feature[first + k], cut[first + k] = b // (BINS - 1), edges[b // (BINS - 1), b % (BINS - 1)]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        gs, hs = (np.bincount(at - inner, v, inner + 1) for v in (g, h))
        leaf = RATE * gs / (hs + RIDGE)
        total += leaf[at - inner]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Model(mean, edges, np.array(features), np.array(cuts), np.array(leaves))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for each row of docs, x its STATISTICS."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [v for t in b.column(1).cast(pa.binary()) for v in statistics(t.as_py() or b"")]
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(values, pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, x array<float>")


def fitted(found: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most `rows` labelled rows, none of them held out; a document with several labels has the mean's side."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    some = labels.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    known = found.join(F.broadcast(some), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).toPandas()  # `rows` rows at most
    x = np.array(known["x"].tolist(), np.float32).reshape(len(known), len(STATISTICS)).astype(np.float64)
    return train(x, known["y"].to_numpy(np.float64))


def scored(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs, learned from labels (doc_id, quality 0 or 1).

    Null and empty texts have the statistics zero and a score like any other; repeated rows have equal scores; a null
    doc_id is scored and never learned from. Without labels of both kinds all scores are the same: the share of label
    1, or 0.5 if there is none. No rows give none. Very long texts are measured whole. Of statistics that split equally
    well the first is taken, and of thresholds the lowest; a score of exactly 0.5 predicts 1. Other columns, whatever
    their names, are not looked at.
    """
    found = saved(measured(docs))
    model = fitted(found, labels, rows)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["x"].to_numpy()).astype(np.float64) if len(b) else np.zeros((0, len(STATISTICS)))
            s = model.score(x)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return found.withColumn("held_out", held_out(F.col("doc_id"))).mapInPandas(each, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, all columns as they are, that the model takes for label 1 (see scored): score 0.5 or more.

    Texts are measured and judged where they lie, so only the labelled sample's statistics move. Columns of any name
    are kept; a table without rows stays so.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    ids = ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # `rows` rows at most
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi")
    model = fitted(saved(measured(some)), labels, rows)
    at = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py() or b"") for t in b.column(at).cast(pa.binary())], np.float32).reshape(len(b), len(STATISTICS))
            yield b.filter(pa.array(model.score(x.astype(np.float64)) >= 0.5))

    return docs.mapInArrow(each, docs.schema)
