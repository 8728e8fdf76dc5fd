"""Document fingerprints by consistent weighted sampling, in DataFrame operations alone.

A document is a bag of words weighted by their counts. For sample k each word draws r and c from Gamma(2, 1) and b
from [0, 1), all fixed by the word and k; with t = floor(ln w / r + b) its key is ln c - r (t - b + 1), and the word
of the smallest key, with its t, is sample k. Two bags agree on a sample with the probability of their generalised
Jaccard similarity (sum of smaller weights over sum of larger ones), so the share of equal samples estimates it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GAP

SAMPLES = 64
#: Gamma(2, 1) is drawn by inverse transform from this many equally likely values.
GRID = 4096
#: Rows per range of documents, and the most ranges. Their bounds are found in two steps, of so many at a time.
RANGE_ROWS, RANGES, FINE = 500, 1 << 16, 256


def gamma2(p: float) -> float:
    """The p-quantile of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x)."""
    lo, hi = 0.0, 60.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - (1 + mid) * math.exp(-mid) < p else (lo, mid)
    return (lo + hi) / 2


def draws(spark: SparkSession) -> DataFrame:
    """One row: the values that r and ln c take. Its size is fixed: two arrays of GRID numbers."""
    values = [gamma2((i + 0.5) / GRID) for i in range(GRID)]
    return spark.createDataFrame([(0, values, [math.log(v) for v in values])], "one int, gamma array<double>, log_gamma array<double>")


def word_hashes(text: Column) -> Column:
    """The sorted hashes of a text's words, repeats included."""
    return F.sort_array(F.transform(F.array_remove(F.split(F.lower(text), GAP), ""), lambda w: F.xxhash64(w)))


def sample(k: int) -> Column:
    """Sample k's key and identity in one number, smaller for a smaller key; from columns h, lnw, gamma and log_gamma."""
    u = F.xxhash64("h", F.lit(k))
    r = F.get("gamma", u.bitwiseAND(F.lit(GRID - 1)).cast("int"))
    ln_c = F.get("log_gamma", F.shiftright(u, 12).bitwiseAND(F.lit(GRID - 1)).cast("int"))
    b = F.shiftrightunsigned(u, 24).cast("double") * F.lit(2.0**-40)
    t = F.floor(F.col("lnw") / r + b)
    key = F.floor((ln_c - r * (t.cast("double") - b + 1.0) + 128.0) * F.lit(2.0**25)).cast("long")
    own = u.bitwiseAND(F.lit((1 << 29) - 1)).bitwiseXOR(F.shiftleft(t.bitwiseAND(F.lit(4095)), 17))
    return F.shiftleft(key, 29).bitwiseOR(own)


def signatures(rows: DataFrame, keys: list[str], texts: list[str], samples: int = SAMPLES) -> DataFrame:
    """For each row and each text column: (keys, kind, signature), kind the column's place and signature 16-bit samples.

    keys must identify the row; if rows are dealt out by some of them, no further exchange takes place. A text without
    words has the signature of zeros.
    """
    lists = rows.select(*keys, F.posexplode(F.array(*[word_hashes(F.col(t)) for t in texts])).alias("kind", "s"))
    n = F.size("s")
    firsts = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))).otherwise(F.array().cast("array<int>"))
    firsts = lists.select(*keys, "kind", "s", firsts.alias("at"))
    terms = F.transform("at", lambda p, j: F.struct(F.get("s", p).alias("h"), F.log((F.coalesce(F.get("at", j + 1), F.size("s")) - p).cast("double")).alias("lnw")))
    words = firsts.select(*keys, "kind", F.inline_outer(terms)).withColumn("one", F.lit(0))
    least = words.join(F.broadcast(draws(rows.sparkSession)), "one").groupBy(*keys, "kind").agg(*[F.min(sample(k)).alias(f"x{k}") for k in range(samples)])
    small = [F.coalesce(F.shiftright(f"x{k}", 31).bitwiseXOR(F.col(f"x{k}")).bitwiseAND(F.lit(65535)).cast("int"), F.lit(0)) for k in range(samples)]
    return least.select(*keys, "kind", F.array(*small).alias("signature"))


def as_text(signature: Column) -> Column:
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def place(doc_id: Column, text: Column) -> Column:
    """What documents are ordered by, as one string: doc_id, none before all, then the text's hash."""
    digits = lambda n: F.lpad(F.hex(n.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.when(doc_id.isNull(), "0").otherwise("1"), digits(F.coalesce(doc_id, F.lit(0).cast("long"))), digits(F.xxhash64(text)))


def ranged(docs: DataFrame) -> DataFrame:
    """docs with (place, bucket, guest): ranges of documents, each with the first row of the next range below as a guest.

    Ordered by guest and then by descending place, a bucket then holds each of its own rows before the next document
    of the whole table; after the last document comes the first. So a window over a bucket does the work of one over
    the table. Bounds are the documents whose places' hashes are divisible by the wanted size of a range, so ranges are
    of that size on average, and rows of one doc_id (or none) with different texts are split as well. The driver gets
    the ranges' bounds and last places: RANGES of either, or a few more.
    """
    spark, docs = docs.sparkSession, docs.withColumn("place", place(F.col("doc_id"), F.col("text")))
    n = docs.count()
    size = max(RANGE_ROWS, n // RANGES)
    bounds = docs.select("place").filter(F.pmod(F.xxhash64("place"), F.lit(size)) == 0).distinct() if n > size else docs.select("place").limit(0)
    bounds = sorted(r[0] for r in bounds.collect())
    chunks = [bounds[i : i + FINE] for i in range(0, len(bounds), FINE)]
    if chunks:
        below = lambda bs, x: F.size(F.filter(bs, lambda b: b <= x))
        coarse = below(F.lit([c[0] for c in chunks]), F.col("place"))
        fine = F.get(F.array(*[F.lit(c) for c in chunks]), coarse - 1)
        bucket = F.coalesce(F.when(coarse > 0, (coarse - 1) * FINE + below(fine, F.col("place"))), F.lit(0))
    else:
        bucket = F.lit(0)
    docs = docs.withColumn("bucket", bucket)
    tops = sorted(tuple(r) for r in docs.groupBy("bucket").agg(F.max("place")).collect())
    guests = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    guests = F.broadcast(spark.createDataFrame(guests, "top string, for_bucket int"))
    both = docs.join(guests, F.col("place") == F.col("top"), "left")
    homes = F.array(F.struct("bucket", F.lit(False).alias("guest")), F.struct(F.col("for_bucket").alias("bucket"), F.lit(True).alias("guest")))
    return both.select("doc_id", "text", "place", F.inline(homes)).filter("bucket IS NOT NULL")


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are to each other and to the next text.

    The edited text has its last half replaced by as much of the start of the next document, in descending doc_id.
    A null text counts as empty; very long ones are read whole; a null doc_id comes last; rows of equal doc_id follow
    each other in the falling order of their texts' hashes; repeated rows give a row each; an empty table gives none;
    other columns, whatever their names, are not looked at.
    """
    rows = ranged(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("place"))
    rows = rows.select("bucket", "guest", "doc_id", "text", F.lead("text").over(order).alias("next"), F.row_number().over(order).alias("pos"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.when(~F.col("guest"), F.concat(F.left("text", n - half), F.left(F.col("next"), half)))
    rows = rows.select("bucket", "guest", "pos", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    keys = ["bucket", "guest", "pos", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.withColumn("edited_sha256", F.sha2(F.coalesce("edited", F.lit("")), 256))
    found = signatures(rows, keys, ["text", "edited"], samples)
    pair = found.groupBy(*keys).agg(*[F.first(F.when(F.col("kind") == k, F.col("signature")), ignorenulls=True).alias(c) for k, c in enumerate(("own", "changed"))])
    after = F.lead("own").over(Window.partitionBy("bucket").orderBy("pos"))
    pair = pair.withColumn("after", after).filter(~F.col("guest"))
    return pair.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
