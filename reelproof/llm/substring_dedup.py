"""Substring dedup: every stretch of words that a document of a smaller doc_id also has is removed from later ones.

Runs of `width` words are the edges of a De Bruijn graph. Documents are packed in parts, which ask each other in two
rounds. In the first, each part sends the seeds of its texts, the least of all SEED-word hashes in each run of `width`
words, and learns which of them lie in different texts; a run that two texts share has the same seed in both, so only
runs with such a seed are edges that may repeat. In the second, it sends those edges, with the words before and after
them, and learns for each the earliest document that has it and whether the edge branches. Edges that follow each other
in a text and in their source, without branching, compact to one path. The words at each path's source coordinates are
then compared with its own before anything is removed. Copies of a whole text are one path from the start.

A part sends a hash once, however often it has it, so a passage that all documents share is as many rows as there are
parts. Parts hold a bounded number of bytes (or one text), buckets of hashes the hashes of a bounded number of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Words of a seed; bytes and rows of a part; bytes of text whose hashes go to a bucket on average, and the least number of buckets.
SEED, PART_BYTES, PART_ROWS, BUCKET_BYTES, BUCKETS = 7, 1 << 20, 1024, 64 << 20, 32
#: Bytes that are hashed at once.
CHUNK = 1 << 20

U = np.uint64
TOP = U(0xFFFFFFFFFFFFFFFF)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Odd multipliers that are 3 modulo 8, so that their powers differ in as many bits as they can.
ROLL, GRAM = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B), (0xD6E8FEB86659FD93, 0xA0761D6478BD642B)
CODEC = pa.Codec("zstd", 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads each number's bits over all others (the finaliser of MurmurHash3)."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def letters(k: int) -> np.ndarray:
    """A number for each byte, 0 for white space."""
    out = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(k))
    out[SPACE] = 0
    return out


LETTERS = (letters(1), letters(2))


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length in one compressed value; bytes of one place stand together."""
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + CODEC.compress(raw, asbytes=True)


def spread(value: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(CODEC.decompress(value[8:], decompressed_size=int.from_bytes(value[:8], "little"), asbytes=True), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(sizes), [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def packed(docs: DataFrame) -> DataFrame:
    """docs' (doc_id, text) in parts, saved: (part, data, size, and for each row in it: doc_id, one, two (a digest), words)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for b in batches:
            all_texts, at = b.column(1).cast(pa.large_binary()).fill_null(b""), 0
            sizes = pc.binary_length(all_texts).to_numpy()
            while at < b.num_rows:
                upto = max(at + 1, min(at + PART_ROWS, at + int(np.searchsorted(np.cumsum(sizes[at:]), PART_BYTES, "right"))))
                own = pa.RecordBatch.from_arrays([b.column(0).slice(at, upto - at), all_texts.slice(at, upto - at)], ["doc_id", "text"])
                texts = own.column(1).to_pylist()
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_intdigest(t).to_bytes(16, "little") for t in texts), np.int64).reshape(-1, 2)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                    out.write_batch(own)
                row = {"part": [part], "data": [sink.getvalue().to_pybytes()], "size": [int(sizes[at:upto].sum())], "doc_id": [own.column(0).to_pylist()], "one": [digests[:, 0].tolist()], "two": [digests[:, 1].tolist()], "words": [[len(t.split()) for t in texts]]}
                yield pa.RecordBatch.from_pydict(row, schema=PARTS)
                part, at = part + 1, upto

    return saved(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(each, "part long, data binary, size long, doc_id array<long>, one array<long>, two array<long>, words array<int>"))


PARTS = pa.schema([("part", pa.int64()), ("data", pa.binary()), ("size", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("one", pa.list_(pa.int64())), ("two", pa.list_(pa.int64())), ("words", pa.list_(pa.int32()))])


def opened(data: bytes) -> tuple[pa.Array, pa.Array]:
    batch = next(iter(pa.ipc.open_stream(data)))
    return batch.column(0), batch.column(1)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of texts in turn: two independent hashes, and the place of its text."""
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(texts) else np.empty(0, np.uint8)
    off = off - off[0]
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = off[:-1][off[1:] > off[:-1]]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    hashes = [np.empty(len(starts), U), np.empty(len(starts), U)]
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK)))
        lo, hi = int(starts[at]), int(starts[upto]) if upto < len(starts) else len(data)
        own = starts[at:upto] - lo
        for k in range(2):
            power, back = powers(k, hi - lo)
            hashes[k][at:upto] = mixed(np.add.reduceat(LETTERS[k][data[lo:hi]] * power, own) * back[own])
        at = upto
    return hashes[0], hashes[1], np.searchsorted(off, starts, "right") - 1


def powers(k: int, n: int, kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  the tables of a worker
    if n > len(kept.get(k, ((),))[0]):
        size = max(n, CHUNK + 4096)
        table = [np.cumprod(np.concatenate((np.ones(1, U), np.full(size - 1, x, U)))) for x in (ROLL[k], pow(ROLL[k], -1, 1 << 64))]
        if n > 2 * CHUNK:  # a very long word: not kept
            return table[0][:n], table[1][:n]
        kept[k] = table
    return kept[k][0][:n], kept[k][1][:n]


def grams(h: np.ndarray, n: int, k: int) -> np.ndarray:
    """The hash of each n words in a row, from their hashes; of two families by k."""
    if len(h) < n:
        return np.empty(0, U)
    out, span, r = h, 1, GRAM[k]
    done: np.ndarray | None = None
    have = 0
    left = n
    while left:
        if left & 1:
            done, have = (out, span) if done is None else (done[: len(h) - have - span + 1] + U(pow(r, have, 1 << 64)) * out[have : have + len(h) - have - span + 1], have + span)
        left >>= 1
        if left:
            out, span = out[: len(out) - span] + U(pow(r, span, 1 << 64)) * out[span:], span * 2
    return mixed(done)


def least(v: np.ndarray, n: int, op=np.minimum) -> np.ndarray:
    """The least of each n numbers in a row."""
    out, span = v, 1
    while span * 2 <= n:
        out, span = op(out[: len(out) - span], out[span:]), span * 2
    return out if span == n else op(out[: len(v) - n + 1], out[n - span :])


class Runs:
    """The runs of `width` words of a part's texts, by the place of their first word, and their seeds."""

    def __init__(self, data: bytes, width: int):
        self.ids, self.texts = opened(data)
        self.width, self.seed = width, min(SEED, width)
        self.one, self.two, self.doc = word_hashes(self.texts)
        n = max(0, len(self.one) - width + 1)
        self.whole = self.doc[:n] == self.doc[width - 1 :] if n else np.zeros(0, bool)
        self.first = np.searchsorted(self.doc, np.arange(len(self.texts)))  # of each text's words

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hash of each seed's words, the least in each run, and which places hold a run's least."""
        v = grams(self.one, self.seed, 0)
        if not len(self.whole):
            return v, np.zeros(0, U), np.zeros(len(v), bool)
        reach = self.width - self.seed + 1
        low = least(v, reach)
        pad = np.zeros(reach - 1, U)
        top = least(np.concatenate((pad, np.where(self.whole, low, U(0)), pad)), reach, np.maximum)
        return v, low, (top == v) & (top > 0)

    def asked(self, v: np.ndarray, chosen: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct seeds in the order of their first places: (hash, the text's digest or 0 if several), the chosen places, and which seed each is."""
        at = np.flatnonzero(chosen)
        values, first, which = np.unique(v[at], return_index=True, return_inverse=True)
        t = digest[self.doc[at]]
        lo, hi = np.full(len(values), TOP), np.zeros(len(values), U)
        np.minimum.at(lo, which, t)
        np.maximum.at(hi, which, t)
        order = np.argsort(first)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return values[order], np.where(lo == hi, lo, U(0))[order], at, place[which]

    def repeated(self, at: np.ndarray, v: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Runs of which one of the seeds at these places is the least."""
        marked = np.full(len(v), TOP)
        marked[at] = v[at]
        return self.whole & (least(marked, self.width - self.seed + 1) == low) if len(self.whole) else self.whole


def split(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(ends)):
        yield int(k), order[ends[k] : ends[k + 1]]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def table_of(schema: str, rows: dict[str, list]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_pydict(rows, schema=pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]))


SENT = "bucket long, part long, data binary"
REPLY = "part long, bucket long, data binary"


def seeds_sent(parts: DataFrame, width: int, buckets: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, digest in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                runs = Runs(data.as_buffer(), width)
                v, _, chosen = runs.seeds()
                h, t, _, _ = runs.asked(v, chosen, np.array(digest, np.int64).view(U))
                out: dict[str, list] = {"bucket": [], "part": [], "data": []}
                for k, own in split(bucket_of(h, buckets), buckets):
                    out["bucket"].append(k)
                    out["part"].append(part)
                    out["data"].append(squeezed(np.ascontiguousarray(h[own].view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").ravel(), t[own]))
                yield table_of(SENT, out)

    return parts.select("part", "data", "one").mapInArrow(each, SENT)


def seeds_met(sent: DataFrame) -> DataFrame:
    """For each part and bucket, a bit for each seed sent: whether another text has it too."""

    def each(table: pa.Table) -> pa.Table:
        parts, blobs = table.column("part").to_pylist(), [spread(x.as_py(), "V6", "u8") for x in table.column("data")]
        h = np.zeros((sum(len(x[0]) for x in blobs), 8), np.uint8)
        h[:, :6] = np.concatenate([x[0] for x in blobs]).view(np.uint8).reshape(-1, 6)
        h, t = h.view(U).ravel(), np.concatenate([x[1] for x in blobs])
        order = np.argsort(h)
        begins = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        lo, hi = np.minimum.reduceat(t[order], begins), np.maximum.reduceat(t[order], begins)
        bits = np.empty(len(h), bool)
        bits[order] = np.repeat((lo != hi) | (lo == 0), np.diff(np.append(begins, len(h))))
        ends = np.cumsum([0, *[len(x[0]) for x in blobs]])
        rows = [(p, np.packbits(bits[a:b]).tobytes()) for p, a, b in zip(parts, ends[:-1], ends[1:], strict=True) if bits[a:b].any()]
        return pa.Table.from_batches([table_of(REPLY, {"part": [r[0] for r in rows], "bucket": [table.column("bucket")[0].as_py()] * len(rows), "data": [r[1] for r in rows]})])

    return sent.groupBy("bucket").applyInArrow(each, REPLY)


#: What an edge is sent with: its hashes, its document, its place there, and the words before and after it.
EDGE = ("u8", "u4", "i8", "u4", "u4", "u2", "u2")


def edges_sent(parts: DataFrame, replies: DataFrame, copies: DataFrame, width: int, buckets: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, digest, reply, skip in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                runs = Runs(data.as_buffer(), width)
                v, low, chosen = runs.seeds()
                h, _, at, which = runs.asked(v, chosen, np.array(digest, np.int64).view(U))
                flags, bits = np.zeros(len(h), bool), {x["bucket"]: x["data"] for x in reply}
                for k, own in split(bucket_of(h, buckets), buckets):
                    if k in bits:
                        flags[own] = np.unpackbits(np.frombuffer(bits[k], np.uint8))[: len(own)].astype(bool)
                usable = np.array(runs.ids.is_valid())
                usable[skip or []] = False
                edge = np.flatnonzero(runs.repeated(at[flags[which]], v, low) & usable[runs.doc[: len(runs.whole)]])
                out: dict[str, list] = {"bucket": [], "part": [], "data": []}
                if len(edge):
                    sent = local(runs, edge)
                    for k, own in split(bucket_of(sent[0], buckets), buckets):
                        out["bucket"].append(k)
                        out["part"].append(part)
                        out["data"].append(squeezed(*[x[own] for x in sent]))
                yield table_of(SENT, out)

    reply = replies.groupBy("part").agg(F.collect_list(F.struct("bucket", "data")).alias("reply"))
    skip = copies.groupBy("part").agg(F.collect_list("place").alias("skip"))
    rows = parts.select("part", "data", "one").join(reply, "part").join(skip, "part", "left")
    return rows.select("part", "data", "one", "reply", "skip").mapInArrow(each, SENT)


def local(runs: Runs, edge: np.ndarray) -> list[np.ndarray]:
    """A part's distinct edges, each where its first document has it first: the columns of EDGE, in the order of places."""
    h, g = grams(runs.one, runs.width, 0)[edge], grams(runs.two, runs.width, 1)[edge].astype(np.uint32)
    ids, doc = runs.ids.fill_null(0).to_numpy(), runs.doc[edge]
    is_edge = np.zeros(len(runs.doc) + 1, bool)
    is_edge[edge] = True
    word = (runs.one >> U(40)).astype(np.uint16) | np.uint16(2)
    after, before = np.minimum(edge + runs.width, len(runs.doc) - 1), np.maximum(edge - 1, 0)
    following = np.where((runs.doc[after] == doc) & is_edge[edge + 1] & (after == edge + runs.width), word[after], 0).astype(np.uint16)
    leading = np.where((runs.doc[before] == doc) & is_edge[before] & (edge > 0), word[before], 0).astype(np.uint16)
    order = np.lexsort((edge, ids[doc], g, h))
    begins = np.flatnonzero(np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1]))))
    one = lambda x: np.where(np.minimum.reduceat(x[order], begins) == np.maximum.reduceat(x[order], begins), x[order][begins], 1).astype(np.uint16)
    following, leading, first = one(following), one(leading), order[begins]
    back = np.argsort(edge[first], kind="stable")
    first = first[back]
    return [h[first], g[first], ids[doc[first]].astype(np.int64), doc[first].astype(np.uint32), (edge[first] - runs.first[doc[first]]).astype(np.uint32), following[back], leading[back]]


#: What comes back of an edge that an earlier document has: its place, the source's, and whether paths go on through it.
MET = ("u4", "u4", "i8", "u4", "u4", "u1")


def edges_met(sent: DataFrame) -> DataFrame:
    def each(table: pa.Table) -> pa.Table:
        parts, blobs = table.column("part").to_numpy(), [spread(x.as_py(), *EDGE) for x in table.column("data")]
        h, g, ids, doc, pos, following, leading = (np.concatenate(x) for x in zip(*blobs, strict=True))
        part = np.repeat(parts, [len(x[0]) for x in blobs])
        order = np.lexsort((part, ids, g, h))
        begins = np.flatnonzero(np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1]))))
        size = np.diff(np.append(begins, len(h)))
        plain = lambda x: (np.minimum.reduceat(x[order], begins) == np.maximum.reduceat(x[order], begins)) & (x[order][begins] > 1)
        through = np.repeat(plain(following).astype(np.uint8) | plain(leading).astype(np.uint8) << 1, size)
        source = np.repeat(order[begins], size)
        later = ids[order] > ids[source]
        own, source, through = order[later], source[later], through[later]
        back = np.lexsort((pos[own], doc[own], part[own]))
        own, source, through = own[back], source[back], through[back]
        cuts = np.flatnonzero(np.concatenate(([True], part[own][1:] != part[own][:-1]))) if len(own) else np.empty(0, np.int64)
        ends = np.append(cuts[1:], len(own)) if len(own) else cuts
        rows = [(int(part[own[a]]), squeezed(doc[own[a:b]], pos[own[a:b]], part[source[a:b]], doc[source[a:b]], pos[source[a:b]], through[a:b])) for a, b in zip(cuts, ends, strict=True)]
        return pa.Table.from_batches([table_of(REPLY, {"part": [r[0] for r in rows], "bucket": [table.column("bucket")[0].as_py()] * len(rows), "data": [r[1] for r in rows]})])

    return sent.groupBy("bucket").applyInArrow(each, REPLY)


PATH = "part long, place int, start int, words int, source long, source_place int, source_start int"


def compacted(doc: np.ndarray, pos: np.ndarray, source: np.ndarray, source_doc: np.ndarray, source_pos: np.ndarray, through: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges, in the order of places, with which paths begin, and how many edges each has."""
    goes_on = (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1] + 1) & (source[1:] == source[:-1]) & (source_doc[1:] == source_doc[:-1]) & (source_pos[1:] == source_pos[:-1] + 1)
    goes_on &= (through[:-1] & 1 > 0) & (through[1:] & 2 > 0)
    begins = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    return begins, np.diff(np.append(begins, len(doc)))


def paths(met: DataFrame, width: int) -> DataFrame:
    """Edges of each part compacted to paths without branches."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, blobs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [np.concatenate(x) for x in zip(*[spread(x, *MET) for x in blobs], strict=True)]
                order = np.lexsort((found[1], found[0]))
                doc, pos, source, source_doc, source_pos, through = (x[order] for x in found)
                at, n = compacted(doc.astype(np.int64), pos.astype(np.int64), source, source_doc, source_pos.astype(np.int64), through)
                yield table_of(PATH, {"part": np.full(len(at), part), "place": doc[at].astype(np.int32), "start": pos[at].astype(np.int32), "words": (n + width - 1).astype(np.int32), "source": source[at], "source_place": source_doc[at].astype(np.int32), "source_start": source_pos[at].astype(np.int32)})

    return met.groupBy("part").agg(F.collect_list("data").alias("data")).mapInArrow(each, PATH)


def copies_of(parts: DataFrame, width: int) -> DataFrame:
    """Whole texts that a document of a smaller doc_id has too, as paths (PATH)."""
    rows = parts.select("part", F.posexplode(F.arrays_zip("doc_id", "one", "two", "words")).alias("place", "r")).select("part", "place", "r.*").filter(f"doc_id IS NOT NULL AND words >= {width}")
    firsts = saved(rows.groupBy("one", "two", "words").agg(F.min(F.struct("doc_id", "part", "place")).alias("f"), F.count("*").alias("n")).filter("n > 1"))  # read anew, so that the join may split a large group
    later = rows.join(firsts, ["one", "two", "words"]).filter("doc_id > f.doc_id")
    return later.select("part", "place", F.lit(0).alias("start"), F.col("words").cast("int"), F.col("f.part").alias("source"), F.col("f.place").alias("source_place"), F.lit(0).alias("source_start"))


def digest_of(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def sources(parts: DataFrame, found: DataFrame) -> DataFrame:
    """The digests of the words at paths' source coordinates."""
    out_schema = "source long, source_place int, source_start int, words int, digest binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, asks in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                _, texts = opened(data.as_buffer())
                place, words, out = -1, [], []
                for ask in sorted(asks, key=lambda x: x["source_place"]):
                    if ask["source_place"] != place:
                        place = ask["source_place"]
                        words = texts[place].as_py().split()
                    out.append((part, place, ask["source_start"], ask["words"], digest_of(words[ask["source_start"] : ask["source_start"] + ask["words"]])))
                yield table_of(out_schema, dict(zip(("source", "source_place", "source_start", "words", "digest"), map(list, zip(*out, strict=True)), strict=True)))

    asks = found.select("source", "source_place", "source_start", "words").distinct().groupBy(F.col("source").alias("part")).agg(F.collect_list(F.struct("source_place", "source_start", "words")).alias("asks"))
    return parts.select("part", "data").join(asks, "part").select("part", "data", "asks").mapInArrow(each, out_schema)


def inside(runs: Runs) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray, np.ndarray]:
    """Paths that an earlier document of the same part has: (place, start, words, source's place, its start).

    And runs that stand elsewhere under the same doc_id too, where the part asked for them: their places, and those.
    """
    edge = np.flatnonzero(runs.whole & np.array(runs.ids.is_valid())[runs.doc[: len(runs.whole)]])
    h, g = grams(runs.one, runs.width, 0)[edge], grams(runs.two, runs.width, 1)[edge]
    twice = np.argsort(h, kind="stable")
    same = h[twice][1:] == h[twice][:-1]
    keep = np.zeros(len(edge), bool)
    keep[twice[1:][same]] = keep[twice[:-1][same]] = True
    edge, h, g = edge[keep], h[keep], g[keep]
    if not len(edge):
        return [], edge, edge
    ids, doc = runs.ids.fill_null(0).to_numpy(), runs.doc[edge]
    order = np.lexsort((edge, ids[doc], g, h))
    begins = np.flatnonzero(np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1]))))
    source = np.empty(len(edge), np.int64)
    source[order] = np.repeat(order[begins], np.diff(np.append(begins, len(edge))))
    twin = np.flatnonzero((ids[doc] == ids[doc[source]]) & (source != np.arange(len(edge))))
    own = np.flatnonzero(ids[doc] > ids[doc[source]])
    if not len(own):
        return [], edge[twin], edge[source[twin]]
    pos = edge - runs.first[doc]
    at, n = compacted(doc[own], pos[own], np.zeros(len(own), np.int64), doc[source[own]], pos[source[own]], np.full(len(own), 3, np.uint8))
    first = own[at]
    return list(zip(doc[first].tolist(), pos[first].tolist(), (n + runs.width - 1).tolist(), doc[source[first]].tolist(), pos[source[first]].tolist(), strict=True)), edge[twin], edge[source[twin]]


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("kept", pa.string())])


def cut(parts: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """The texts without the words of paths whose words are those of their source."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, far in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                runs = Runs(data.as_buffer(), width)
                words: dict[int, list[bytes]] = {}
                of = lambda place: words.get(place) or words.setdefault(place, runs.texts[place].as_py().split())  # noqa: B023, E731
                gone = np.zeros(len(runs.one) + 1, np.int64)  # how many more removed runs begin at a word than end before it

                def go(place: int, start: int, n: int) -> None:
                    first = runs.first[place] + start  # noqa: B023
                    taken[first : first + n - width + 1] = True  # noqa: B023

                taken = np.zeros(len(runs.whole), bool)
                for x in far or []:
                    if digest_of(of(x["place"])[x["start"] : x["start"] + x["words"]]) == x["digest"]:
                        go(x["place"], x["start"], x["words"])
                near, twin, speaker = inside(runs)
                for place, start, n, source, begin in near:
                    if of(place)[start : start + n] == of(source)[begin : begin + n]:
                        go(place, start, n)
                taken[twin] |= taken[speaker]
                gone[:-1][: len(taken)] += taken
                gone[width : width + len(taken)] -= taken
                covered = np.cumsum(gone[:-1]) > 0
                rows: dict[str, list] = {"doc_id": runs.ids.to_pylist(), "n_words": np.bincount(runs.doc, minlength=len(runs.texts)).tolist(), "removed": [], "kept": []}
                for place, (first, n) in enumerate(zip(runs.first.tolist(), rows["n_words"], strict=True)):
                    mark = np.diff(np.concatenate(([False], covered[first : first + n], [False])).astype(np.int8))
                    spans = list(zip(np.flatnonzero(mark > 0).tolist(), np.flatnonzero(mark < 0).tolist(), strict=True))
                    own, at, kept = of(place), 0, []
                    for start, stop in spans:
                        kept += own[at:start]
                        at = stop
                    rows["removed"].append([{"start": a, "stop": z} for a, z in spans])
                    rows["kept"].append(b" ".join(kept + own[at:]).decode())
                    del words[place]
                yield pa.RecordBatch.from_pydict(rows, schema=OUT)

    far = found.groupBy("part").agg(F.collect_list(F.struct("place", "start", "words", "digest")).alias("far"))
    return parts.select("part", "data").join(far, "part", "left").select("data", "far").mapInArrow(each, "doc_id long, n_words long, removed array<struct<start:int,stop:int>>, kept string")


def deduped(docs: DataFrame, width: int = 13) -> DataFrame:
    """docs' texts without what an earlier document already has: doc_id, n_words, n_removed, removed ([start, stop) in words), kept.

    Words are runs of anything but ASCII white space, unchanged. A word goes if it lies in `width` words in a row that
    also start somewhere in a document of a smaller doc_id; all are judged on the texts as given. kept is what is left,
    joined by single spaces.

    Null and empty texts have no words; texts shorter than `width` stay. Rows of a null doc_id stay whole and are
    nobody's source. Rows of equal doc_id, equal texts or not, leave each other alone; each gives a row. What a document
    repeats within itself stays. Very long texts are taken whole, each in a part of its own. No rows: no result. Further
    columns are left out, whatever their names.
    """
    parts = packed(docs)
    size = parts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(BUCKETS, size // BUCKET_BYTES)
    copies = saved(copies_of(parts, width))
    replies = seeds_met(seeds_sent(parts, width, buckets))
    met = edges_met(edges_sent(parts, replies, copies, width, buckets))
    found = saved(paths(met, width).unionByName(copies))
    checked = found.join(sources(parts, found), ["source", "source_place", "source_start", "words"]).select("part", "place", "start", "words", "digest")
    out = cut(parts, saved(checked), width)
    n = F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"]), F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n.alias("n_removed"), "removed", "kept")
