"""Line deduplication: a line goes if an earlier line is equal, or within one word (short lines: one character) of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, saved

#: Lines of WORDS words or more may differ in one word (changed, added or left out), so at least 0.8 of them is equal;
#: shorter ones, if they have CHARS characters or more, in one character.
WORDS, CHARS = 5, 10
#: Of two lines within one word, END words at one end are equal if both have LONG words or more, else FEW.
LONG, END, FEW = 10, 5, 2
LINE = ["doc_id", "tk", "line_no"]
BLANK = " \t\r\x0b\x0c"
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, line_no, line) of each line that is not blank, white space at its ends removed; tk tells texts of one doc_id apart."""
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("tk"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return rows.withColumn("line", F.btrim("line", F.lit(BLANK))).filter("line <> ''")


def first_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, tk, line_no, ends) of the first line of each text; lines within the bound of each other share one of their ends."""
    rows = lines.withColumn("words", F.split("line", GAP))
    n, c = F.size("words"), F.char_length("line")

    def end(which: Column, k: int, at: int, size: int) -> Column:
        return F.when(which, F.xxhash64(F.lit(k), F.slice("words", at, size)))

    some = (n >= WORDS) & (n <= LONG + 1)
    tiny = (n < WORDS) & (c >= CHARS)
    half = F.lit(CHARS // 2 - 1)
    ends = F.array_compact(F.array(
        end(n >= LONG, 0, 1, END), end(n >= LONG, 1, -END, END), end(some, 2, 1, FEW), end(some, 3, -FEW, FEW),
        F.when(tiny, F.xxhash64(F.lit(4), F.left("line", half))), F.when(tiny, F.xxhash64(F.lit(5), F.right("line", half))),
    ))
    rows = rows.select("doc_id", "tk", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), ends.alias("ends"))
    first = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "tk", "line_no")).alias("l"), F.max("ends").alias("ends"))
    return first.select("l.*", "ends")


def units(line: bytes) -> tuple[bool, list[bytes]]:
    """Whether edits of a line are counted in words, and its words, or else its characters (none if it may not differ at all)."""
    words = line.split()
    if len(words) >= WORDS:
        return True, words
    text = line.decode()
    return False, [c.encode() for c in text] if len(text) >= CHARS else []


def deletions(words: list[bytes], in_words: bool = True) -> tuple[list[int], np.ndarray]:
    """Places and keys of all variants within the bound: at -1 the whole line, at i the line without unit i.

    A key is a polynomial of the units' hashes by place, so each variant's follows from two prefix sums.
    """
    if not words:
        return [], np.zeros(0, np.int64)
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    power = np.cumprod(np.full(len(words), BASE))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power, dtype=np.uint64)))
    cut = sums[:-1] + (sums[-1] - sums[1:]) * UNBASE
    keys = np.concatenate((sums[-1:], cut))
    return [-1, *range(len(words))], (keys if in_words else ~keys).view(np.int64)


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether a and b are at most one changed, added or missing unit apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def near(a: bytes, b: bytes) -> bool:
    (one, x), (two, y) = units(a), units(b)
    return one == two and bool(x) and bool(y) and within_one(x, y)


def variants(lines: DataFrame) -> DataFrame:
    """(key, at, doc_id, tk, line_no) of every variant of every line."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3).cast(pa.binary())
            for lo in range(0, len(b), 256):
                found = [deletions(own, in_words) for in_words, own in (units(t.as_py()) for t in texts[lo : lo + 256])]
                times = pa.array(np.repeat(np.arange(lo, min(len(b), lo + 256)), [len(at) for at, _ in found]))
                keys, at = np.concatenate([k for _, k in found]), np.concatenate([np.array(at, np.int32) for at, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(at), *(b.column(i).take(times) for i in range(3))], ["key", "at", "doc_id", "tk", "line_no"])

    return lines.select("doc_id", "tk", "line_no", "line").mapInArrow(each, "key long, at int, doc_id long, tk long, line_no int")


def near_lines(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """(doc_id, tk, line_no) of the firsts (see first_lines) that have an earlier line within the bound.

    Only lines that share an end with a different line can be near one, so the rest emit nothing. Lines that share a
    variant cut at the same place, or of which one's variant is the other whole, are within the bound; so per variant
    the earliest of each kind is enough to find an earlier line for every other, and no group's pairs are formed. The
    words themselves are compared at the end.
    """
    ends = firsts.select(*LINE, F.explode("ends").alias("end"))
    shared = ends.groupBy("end").count().filter("count > 1").select("end")
    some = ends.join(shared, "end", "left_semi").select(*LINE).distinct()
    first = saved(lines.join(some, LINE, "left_semi"))
    cuts = variants(first).repartition("key")  # the one exchange of the variants: counted and joined where they lie
    me = F.struct(*LINE)
    group = cuts.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(F.col("at") < 0, me)).alias("whole"), F.min(F.when(F.col("at") >= 0, me)).alias("cut")).filter("n > 1")
    met = saved(cuts.join(group, "key"))
    same = met.filter("at >= 0").groupBy("key", "at").agg(F.min(me).alias("same"))
    seen = F.array(F.col("whole"), F.when(F.col("at") < 0, F.col("cut")).otherwise(F.col("same")))
    pairs = met.join(same, ["key", "at"], "left").select(me.alias("me"), F.explode(F.array_compact(seen)).alias("other")).filter("other < me").distinct()
    text = first.select(me.alias("k"), "line")
    pairs = pairs.join(text.select(F.col("k").alias("me"), F.col("line").alias("a")), "me").join(text.select(F.col("k").alias("other"), F.col("line").alias("b")), "other")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (b.column(i).cast(pa.binary()) for i in (3, 4))
            yield b.select([0, 1, 2]).filter(pa.array([near(x.as_py(), y.as_py()) for x, y in zip(a, c, strict=True)], pa.bool_()))

    return pairs.select("me.doc_id", "me.tk", "me.line_no", "a", "b").mapInArrow(each, "doc_id long, tk long, line_no int").distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with each line's later copies taken out of text, n_chars to match if there is one, and two counts more.

    Documents come in the order of doc_id, and a document's lines in theirs. A line that equals an earlier one, white
    space at its ends apart, goes; so does one that an earlier line is near, whether that one stays or not: within one
    word if both have WORDS words or more, within one character if both have fewer words and CHARS characters or more.
    Blank lines stay. Added: lines_before, lines_removed (int). A null or empty text stays as it is; a null doc_id has
    no place in the order, so its row stays as it is; rows of one doc_id and different texts come in the order of the
    texts' hashes (64 bits), rows equal in both count as one document and are treated alike; texts of any length are
    read whole; no rows give none. Other columns, whatever their names, are kept, but for lines_before and
    lines_removed, which are replaced.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = lines_of(ids)
    firsts = saved(first_lines(lines))
    stay = firsts.select(*LINE).join(near_lines(lines, firsts), LINE, "left_anti")
    stay = stay.groupBy(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk")).agg(F.collect_set("line_no").alias("_stay"))
    rows = docs.drop("lines_before", "lines_removed")
    rows = rows.join(stay, (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64("text") == F.col("_tk")), "left").drop("_id", "_tk")
    rows = rows.withColumn("_lines", F.split("text", "\n", -1))
    blank = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: F.btrim(F.get("_lines", i), F.lit(BLANK)) == "")
    rows = rows.withColumn("_kept", F.array_sort(F.array_union(blank, F.coalesce("_stay", F.array().cast("array<int>")))))
    keep = F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.size("_kept") < F.size("_lines"))
    text = F.when(keep, F.array_join(F.transform("_kept", lambda i: F.get("_lines", i)), "\n")).otherwise(F.col("text"))
    gone = F.when(keep, F.size("_lines") - F.size("_kept")).otherwise(F.lit(0))
    rows = rows.withColumns({"lines_before": F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")), "lines_removed": gone, "text": text}).drop("_kept", "_lines", "_stay")
    return rows.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in rows.columns else rows
