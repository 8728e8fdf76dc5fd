"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, saved

LENGTHS = (512, 1024, 2048, 4096)
#: Cost of a sequence besides its length, in tokens; the length at which attention costs as much as all else (its cost
#: grows with the square of the length); and the pieces that one task packs together.
OVERHEAD, ATTENTION, GROUP = 32, 16384, 8192


def price(length: int, overhead: float = OVERHEAD, attention: float = ATTENTION) -> float:
    """What a sequence costs, however full: short ones pay the overhead more often, long ones more for attention."""
    return overhead + length + length * length / attention


def pack(sizes: np.ndarray, lengths: Sequence[int] = LENGTHS, overhead: float = OVERHEAD, attention: float = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and bin length for each of the sizes, which come in descending order, none over the longest length.

    Each piece goes to the open bin that it leaves least room in. If none has room, a bin opens in the length that
    costs least for each token it would come to hold, were it filled with the largest pieces still to come that fit. At
    the end each bin shrinks to the shortest length that holds its contents. Bins with the same room wait in one stack;
    the rooms that have any, and the sizes still to come, are bits of one number each, so a piece takes the same time
    however many bins are open.
    """
    lengths = sorted(lengths)
    rooms: dict[int, list[int]] = {}
    some, used, cost = 0, [], {c: price(c, overhead, attention) for c in lengths}
    still = np.bincount(sizes, minlength=1).tolist() if len(sizes) else [0]
    to_come = sum(1 << n for n, k in enumerate(still) if k)

    def filled(room: int) -> int:
        """The tokens that come to lie in a room, largest pieces first."""
        free = room
        fits = to_come & ((2 << free) - 1)
        while fits:
            n = fits.bit_length() - 1
            free -= n * min(still[n], free // n)
            fits = to_come & ((2 << min(free, n - 1)) - 1) if free else 0
        return room - free

    def dear(n: int, c: int) -> tuple[float, int]:
        held = n + filled(c - n)
        return min(cost[x] for x in lengths if x >= held) / held, c

    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, n in enumerate(sizes.tolist()):
        still[n] -= 1
        if not still[n]:
            to_come ^= 1 << n
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                some ^= 1 << room
        else:
            room = min((c for c in lengths if c >= n), key=lambda c: dear(n, c))  # noqa: B023
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if room > n:
            rooms.setdefault(room - n, []).append(b)
            some |= 1 << room - n
    fit = np.asarray(lengths)[np.searchsorted(lengths, used)]
    return bins, offsets, fit[bins] if len(sizes) else bins


def words_and_end(text: Column) -> Column:
    """Words, and one token more for the end of the text."""
    return (F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")) + 1).cast("long")


def packed(docs: DataFrame, lengths: Sequence[int] = LENGTHS, tokens: Column | None = None, group: int = GROUP) -> DataFrame:
    """Where each piece of each document lies: (doc_id, piece, start, n_tokens, bin_id, bin_length, bin_offset).

    A document of more tokens than the longest length is cut into pieces of that length and a rest; no token is lost,
    however long the text. tokens says how long a document is (words and an end if not given, so null and empty texts
    are one token); documents of no or unknown tokens have none to place and give no row. Pieces are dealt by a hash of
    doc_id, text and place into groups of about `group`, packed apart, so that a bin's pieces are in one group; ties in
    size go by doc_id and place. Repeated rows are placed each; a null doc_id is placed too; an empty table gives no
    rows; further columns, whatever their names, are not looked at.
    """
    lengths, longest = tuple(sorted(lengths)), max(lengths)
    n = (words_and_end(F.col("text")) if tokens is None else tokens.cast("long")).alias("n")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n, F.xxhash64("text").alias("h"))
    whole = saved(whole.filter("n > 0"))  # texts are read once
    pieces = whole.select("doc_id", "n", "h", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / longest).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * longest
    pieces = pieces.select("doc_id", "h", "piece", start.alias("start"), F.least(F.lit(longest), F.col("n") - start).cast("int").alias("n_tokens"))
    number = whole.select(((F.col("n") - 1) / longest).cast("long").alias("more")).agg(F.count("*") + F.coalesce(F.sum("more"), F.lit(0))).first()[0]
    groups = 1 + number // group
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "h", "piece"), F.lit(groups))).drop("h")

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, fit = pack(pdf["n_tokens"].to_numpy(), lengths)
        return pdf.assign(bin_id=pdf["part"] * (1 << 32) + bins, bin_length=fit.astype(np.int32), bin_offset=offsets.astype(np.int32)).drop(columns="part")

    schema = "doc_id long, piece int, start long, n_tokens int, bin_id long, bin_length int, bin_offset int"
    return pieces.groupBy("part").applyInPandas(each, schema)
