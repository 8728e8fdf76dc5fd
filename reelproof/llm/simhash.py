"""SimHash near-duplicates: fingerprints of word shingles, compared bit-sliced within band buckets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, saved

BITS = 64
#: Shingles whose bits are counted at once, so that a very long text needs no more memory than a short one.
CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit number: bit i is 1 if more than half the shingles' hashes have it."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n, ones = max(1, len(words) - shingle + 1), np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(n, at + CHUNK) + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        lo, hi = starts[: max(1, len(part) - shingle + 1)].tolist(), (ends[shingle - 1 :] if len(part) >= shingle else ends[-1:]).tolist()
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(lo, hi, strict=True)], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of docs; a null text counts as empty, and an empty text has fingerprint 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t or b"", shingle) for t in (x.as_py() for x in b.column(1).cast(pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes stored vertically: row i holds bit i of all fingerprints, 64 of them to a word."""
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u8")


def near(fps: np.ndarray, radius: int, lanes: int = 64, step: int = 4) -> Iterator[tuple[int, np.ndarray]]:
    """For each i, the j > i whose fingerprints differ from fps[i] in at most radius bits.

    Planes are taken one by one: the query's bit, spread over a word, is XORed with 64 fingerprints' bits at once, and
    the result added to saturating counters held bit-sliced themselves (carry-save). The counters start so high that
    the carry out of the top one says "over the radius"; a block of words is abandoned once all its lanes say so.
    """
    n, v, full = len(fps), planes(fps), np.uint64(0xFFFFFFFFFFFFFFFF)
    ask = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.uint64) * full
    depth = max(1, int(radius + 1).bit_length())
    start = (1 << depth) - 1 - radius
    for q in range(0, n, lanes):
        own, hits = ask[q : q + lanes], [[] for _ in range(min(lanes, n - q))]
        for w in range(q // 64, v.shape[1], lanes):
            block = v[:, w : w + lanes]
            at = np.arange(w * 64, (w + block.shape[1]) * 64)
            dead = np.ascontiguousarray(np.packbits((at[None, :] <= np.arange(q, q + len(own))[:, None]) | (at >= n)[None, :], axis=1, bitorder="little")).view("<u8")
            count = [np.full_like(dead, full if start >> k & 1 else 0) for k in range(depth)]
            for p in range(BITS):
                carry = block[p][None, :] ^ own[:, p][:, None]
                for k in range(depth):
                    carry, count[k] = count[k] & carry, count[k] ^ carry
                dead |= carry
                if p % step == step - 1 and (dead == full).all():
                    break
            for i in np.flatnonzero((dead != full).any(axis=1)):
                alive = np.unpackbits((~dead[i]).view(np.uint8), bitorder="little")
                hits[i].append(at[np.flatnonzero(alive)])
        for i, found in enumerate(hits):
            if found:
                yield q + i, np.concatenate(found)


def forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each of the sorted fps, the index of the first one of its component within this bucket."""
    label = np.arange(len(fps))
    for i, js in near(fps, radius):
        seen = np.unique(np.append(label[js], label[i]))
        if len(seen) > 1:
            label[np.isin(label, seen)] = seen[0]
    return label


def split(mask: int, parts: int) -> list[int]:
    """mask, widened by each of so many even parts of the bits that it leaves out."""
    rest = [1 << b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(rest[k * len(rest) // parts : (k + 1) * len(rest) // parts]) for k in range(parts)]


def masks(radius: int) -> list[int]:
    """Of radius + 2 even bands, all ways to leave out radius: one at least has all its bits equal in any two near ones."""
    n = radius + 2
    bands = [sum(1 << b for b in range(BITS * k // n, BITS * (k + 1) // n)) for k in range(n)]
    return [sum(kept) for kept in combinations(bands, 2)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def links(fps: DataFrame, radius: int = 2, most: int = 8192) -> DataFrame:
    """Links (a, b) between distinct fingerprints (one column fp), enough to join all that are near, directly or not.

    Two fingerprints within the radius agree on at least two of radius + 2 bands, so each goes to a bucket for each
    two bands. A bucket of over `most` is split exactly: its rest bits are cut in radius + 1 parts, one of which must
    agree too. After a few rounds too few bits are left for a bucket to be large. Within a bucket the comparison is
    bit-sliced, and what leaves it is a tree per component, never its pairs.
    """
    spark = fps.sparkSession
    level = masks(radius)
    rows = fps.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in level])).alias("mask"))
    key = F.col("fp").bitwiseAND(F.col("mask"))
    while BITS - level[0].bit_count() > most.bit_length():
        big = saved(rows.groupBy("mask", key.alias("key")).count().filter(F.col("count") > most).select("mask", "key"))
        if big.isEmpty():
            break
        finer = [(signed(m), signed(x)) for m in level for x in split(m, radius + 1)]
        level = [x for m in level for x in split(m, radius + 1)]
        rows = rows.withColumn("key", key)
        again = F.broadcast(spark.createDataFrame(finer, "mask long, finer long"))  # a few dozen constant rows
        wide = rows.join(big, ["mask", "key"], "left_semi").join(again, "mask").select("fp", F.col("finer").alias("mask"))
        rows = saved(rows.join(big, ["mask", "key"], "left_anti").select("fp", "mask").unionByName(wide))
    buckets = rows.groupBy("mask", key.alias("key")).agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1").select("fps")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = [], []
            for bucket in b.column(0):
                own = np.sort(bucket.values.to_numpy(zero_copy_only=False))
                label = forest(own.view(np.uint64), radius)
                moved = np.flatnonzero(label != np.arange(len(own)))
                a.append(own[moved])
                c.append(own[label[moved]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(c))], ["a", "b"])

    return buckets.mapInArrow(each, "a long, b long")


def near_groups(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """docs' (doc_id, fingerprint, component_id): 16 hex digits, and the smallest doc_id that links reach.

    Null and empty texts have fingerprint zero and link like any other; rows with the same text, or the same doc_id,
    each give a row; a null doc_id gives a row but is never a component's name unless it has no other; no rows: none.
    Very long texts are read whole, CHUNK shingles at a time. Further columns are left out, whatever their names.
    """
    own = saved(fingerprints(docs, shingle))
    first = saved(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = components(links(first.select("fp"), radius))
    named = first.join(comp, first.fp == comp.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = saved(named)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = named.join(least, "root").select("fp", "component_id")
    return own.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
