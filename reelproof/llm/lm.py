"""Language-model scores: a trigram model with Katz backoff, counted from the corpus and applied to all of it.

A text is read as its words and an end; two starts come before it. Start and end are one symbol, so each token is the
context of one other token. Occurrences (u, v, w: w after u v) are dealt by v, the word in the middle, so that one part
has all it takes to count its trigrams and pairs and to evaluate them; they are shuffled once, and counted and scored
where they lie. What a part cannot know, it asks for in messages to the parts that words belong to: how often its words
occur, and, of a v or a pair u v too frequent for one part, how often the other parts have its successors.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counts of more than GOOD_TURING are not discounted.
GOOD_TURING = 5
#: Text that is packed into one block, in bytes, and tokens of a part: what one task holds in memory. A word or pair of
#: PART_TOKENS or more is dealt over several parts.
BLOCK_BYTES, PART_TOKENS = 16 << 20, 3 << 19
EDGE = b"\n"  # start and end: no word has white space
MUL1, MUL2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
PACKED = "part int, block long, n_train int, data binary, doc_id array<long>, tokens array<int>"
PACKED_TYPES = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n_train", pa.int32()), ("data", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int32()))])
ZSTD = "zstd"


def hashed(word: bytes) -> int:
    """48 bits of the word's hash: with 2^48 values even a billion words rarely share one."""
    return xxhash.xxh64_intdigest(word) >> 16


def six(a: np.ndarray) -> bytes:
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def mixed(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """48 bits for a pair of words' hashes."""
    x = u * MUL1 + v * MUL2
    return (x ^ (x >> np.uint64(32))) * MUL1 >> np.uint64(16)


def home(h: np.ndarray, parts: int) -> np.ndarray:
    """The part that a word belongs to."""
    return ((h >> np.uint64(7)) % np.uint64(parts)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def blocks_of(b: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """A batch's rows in runs of about BLOCK_BYTES of text (column 1)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    since = 0
    while since < len(b):
        before = sizes[since - 1] if since else 0
        until = min(int(np.searchsorted(sizes, before + BLOCK_BYTES)) + 1, since + 65535, len(b))
        yield since, until
        since = until


def read(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words (the edge first), all texts' tokens as places in them, and each text's tokens' number."""
    ids: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids[EDGE]
    rows = [np.fromiter(map(ids.__getitem__, (*words, EDGE)), np.int32, len(words) + 1) for words in (t.lower().split() for t in texts)]
    h = np.fromiter(map(hashed, ids), np.uint64, len(ids))
    return h, np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))


def trigrams(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, v, w of all tokens: an end is the start of the next text."""
    t = np.concatenate((np.zeros(2, tokens.dtype), tokens))
    u, v, w = t[:-2].copy(), t[1:-1], t[2:]
    u[v == 0] = 0
    return u, v, w


def frequent(docs: DataFrame, most: int) -> tuple[dict[int, int], dict[int, int], int]:
    """Words and pairs with at least `most` occurrences (some with half as many too) and how many, and the number of tokens.

    A block tells of those that have so large a share of it that all blocks that say nothing of one add up to less than
    half of `most`. So the driver gets tokens / most * 4 words and pairs at most.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    share = most / 2 / max(1, size[0] / 2 + size[1])  # a token takes two bytes, but for the last of each text

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for lo, hi in blocks_of(b):
                h, tokens, _ = read([t.as_py() or b"" for t in texts[lo:hi]])
                c = np.bincount(tokens, minlength=len(h))
                often = c >= max(1, share * len(tokens))
                v, w = np.concatenate((np.zeros(1, np.int32), tokens[:-1])), tokens
                both = often[v] & often[w]
                pair, n = np.unique(v[both].astype(np.int64) * len(h) + w[both], return_counts=True)
                pair, n = pair[n >= max(1, share * len(tokens))], n[n >= max(1, share * len(tokens))]
                keys = np.concatenate((h[often], mixed(h[pair // len(h)], h[pair % len(h)]), np.zeros(1, np.uint64)))
                kind = np.repeat([0, 1, 2], [often.sum(), len(pair), 1]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(keys.astype(np.int64)), pa.array(np.concatenate((c[often], n, [len(tokens)])).astype(np.int64))], ["kind", "k", "c"])

    found = docs.select("doc_id", "text").mapInArrow(each, "kind int, k long, c long").groupBy("kind", "k").agg(F.sum("c").alias("c"))
    rows = found.filter((F.col("kind") == 2) | (F.col("c") >= most / 2)).collect()
    return {r.k: r.c for r in rows if r.kind == 0}, {r.k: r.c for r in rows if r.kind == 1}, sum(r.c for r in rows if r.kind == 2)


class Hot:
    """Hashes of frequent words or pairs, sorted, and over how many parts each is dealt."""

    def __init__(self, found: dict[int, int], most: int):
        self.keys = np.array(sorted(found), np.uint64)
        self.splits = np.array([2 + found[k] // most for k in sorted(found)], np.uint64)

    def at(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each is one, and its splits (else 1)."""
        if not len(self.keys):
            return np.zeros(len(h), bool), np.ones(len(h), np.uint64)
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[i] == h
        return hit, np.where(hit, self.splits[i], np.uint64(1))


def planes(a: np.ndarray) -> bytes:
    """The numbers' low bytes, then the next, and so on: the high ones are mostly zero and vanish when compressed."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(data: memoryview, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, n).T.copy().view(kind).ravel()


def packed(docs: DataFrame, parts: int, words: Hot, pairs: Hot) -> DataFrame:
    """Blocks of texts as occurrences: a row for each block and part, and one with the block's documents, training first."""

    def pack(block: int, ids: list, texts: list[bytes], held: list[bool]) -> Iterator[dict]:
        first = sorted(range(len(ids)), key=held.__getitem__)
        n_train = len(ids) - sum(held)
        h, w, n = read([texts[i] for i in first])
        u, v, w = trigrams(w)
        hot, splits = words.at(h)
        part = home(h, parts)[v] + np.where(hot[v], (h[u] % splits[v]).astype(np.int64), 0)
        both = np.flatnonzero(hot[v] & hot[u])
        if len(both):
            _, more = pairs.at(mixed(h[u[both]], h[v[both]]))
            part[both] += (np.uint64(block) % more).astype(np.int64)
        part %= parts
        order = np.argsort(part * len(h) + v, kind="stable")
        doc = np.repeat(np.arange(len(n), dtype="<u2"), n)[order]
        u, v, w, part = u[order], v[order], w[order], part[order]
        ends = np.searchsorted(part, np.arange(parts + 1))
        codec = pa.Codec(ZSTD, 1)
        for p in np.unique(part).tolist():
            at = slice(ends[p], ends[p + 1])
            own, place = np.unique(np.concatenate((u[at], v[at], w[at])), return_inverse=True)
            place = place.astype("<u2" if len(own) <= 65536 else "<u4").reshape(3, -1)
            data = np.array([place.shape[1], len(own), place.itemsize], "<u4").tobytes() + six(h[own]) + b"".join(map(planes, place)) + planes(doc[at])
            yield {"part": p, "block": block, "n_train": n_train, "data": np.uint32(len(data)).tobytes() + codec.compress(data).to_pybytes()}
        yield {"part": -1 - block % parts, "block": block, "n_train": n_train, "doc_id": [ids[i] for i in first], "tokens": n.tolist()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        for b in batches:
            ids, texts, held = b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist()
            for lo, hi in blocks_of(b):
                rows = []
                for row in pack(block, ids[lo:hi], [t.as_py() or b"" for t in texts[lo:hi]], held[lo:hi]):
                    rows.append(row)
                    if len(rows) == 64:
                        yield pa.RecordBatch.from_pylist(rows, PACKED_TYPES)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, PACKED_TYPES)
                block += 1

    return docs.select("doc_id", "text", "held_out").mapInArrow(each, PACKED)


class Part:
    """A part's occurrences, and its words, trigrams and pairs with how often training texts have them there.

    vocab: hashes of its words. ctx (u, v), tri (ctx, w) and bi (v, w): what occurs, be it in held-out texts alone; of
    each trigram its tri_ctx, tri_w, and bi, and so on. rows: (block, from, to, documents) of its occurrences' kinds.
    """

    def __init__(self, group: pa.Table, parts: int, words: Hot, pairs: Hot):
        own, places, docs, train, self.rows, at, base = [], [], [], [], [], 0, 0
        codec = pa.Codec(ZSTD)
        for i in range(len(group)):
            self.number = group.column("part")[i].as_py()
            if self.number < 0:
                continue
            data = group.column("data")[i].as_buffer()
            data = memoryview(codec.decompress(data[4:], int(np.frombuffer(data, "<u4", 1)[0])))
            n, k, size = map(int, np.frombuffer(data, "<u4", 3))
            own.append(unsix(data[12 : 12 + 6 * k]))
            start, kind = 12 + 6 * k, f"<u{size}"
            places.append([unplanes(data[start + j * n * size : start + (j + 1) * n * size], n, kind).astype(np.int32) + base for j in range(3)])
            doc = unplanes(data[start + 3 * n * size :], n, "<u2")
            docs.append(doc)
            train.append(doc < group.column("n_train")[i].as_py())
            self.rows.append((group.column("block")[i].as_py(), at, at + n, doc))
            at, base = at + n, base + k
        self.parts, self.empty = parts, not own
        if self.empty:
            return
        self.vocab, back = np.unique(np.concatenate(own), return_inverse=True)
        own = None
        nv = self.nv = len(self.vocab)
        u, v, w = (back[np.concatenate([p[j] for p in places])] for j in range(3))
        places = None
        ctx, of = np.unique(v * nv + u, return_inverse=True)
        u = v = None
        tri, self.tri = np.unique(of * nv + w, return_inverse=True)
        of = w = None
        self.tri_c = np.bincount(self.tri, np.concatenate(train)).astype(np.int64)
        self.tri_ctx, self.tri_w = tri // nv, tri % nv
        self.ctx_v, self.ctx_u = ctx // nv, ctx % nv
        bi, self.bi = np.unique(self.ctx_v[self.tri_ctx] * nv + self.tri_w, return_inverse=True)
        self.bi_v, self.bi_w = bi // nv, bi % nv
        self.bi_c = np.bincount(self.bi, self.tri_c).astype(np.int64)
        self.v_c = np.bincount(self.bi_v, self.bi_c, nv).astype(np.int64)
        self.hot, _ = words.at(self.vocab)
        self.hot_ctx = self.hot[self.ctx_v] & self.hot[self.ctx_u]
        if self.hot_ctx.any():
            self.ctx_key = mixed(self.vocab[self.ctx_u], self.vocab[self.ctx_v])
            self.hot_ctx &= pairs.at(self.ctx_key)[0]

    def asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """In the order of their messages: words whose counts are not here, pairs of hot v, and trigrams of hot u v."""
        wanted = np.zeros(self.nv, bool)
        wanted[self.bi_w] = True
        wanted[self.hot] = True
        place = home(self.vocab, self.parts)
        by = lambda some, w: some[np.argsort(place[w[some]], kind="stable")]
        everything = np.arange(self.nv)
        return by(np.flatnonzero(wanted), everything), by(np.flatnonzero(self.hot[self.bi_v]), self.bi_w), by(np.flatnonzero(self.hot_ctx[self.tri_ctx]), self.tri_w)


SENT = "part int, source int, kind int, words binary, firsts binary, contexts binary, counts array<long>"
SENT_TYPES = pa.schema([("part", pa.int32()), ("source", pa.int32()), ("kind", pa.int32()), ("words", pa.binary()), ("firsts", pa.binary()), ("contexts", pa.binary()), ("counts", pa.list_(pa.int64()))])


def histogram(c: np.ndarray, top: int) -> np.ndarray:
    """How many have each count from 1 to top + 1."""
    return np.bincount(np.minimum(c, top + 2), minlength=top + 3)[1 : top + 2]


def sender(parts: int, words: Hot, pairs: Hot, top: int):
    """A part's messages: kind 0 its words' counts, 1 the words that it asks for, 2 and 3 its pairs and trigrams of hot contexts, 4 its histograms."""

    def each(group: pa.Table) -> pa.Table:
        p, out = Part(group, parts, words, pairs), []
        if p.empty:
            return pa.Table.from_pylist([], SENT_TYPES)

        def send(kind: int, w: np.ndarray, firsts=None, contexts=None, counts=None) -> None:
            to = home(w, parts)
            cuts = [*np.flatnonzero(np.diff(to, prepend=-1)), len(w)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part_of = lambda x: None if x is None else six(x[lo:hi])  # noqa: E731, B023
                out.append({"part": int(to[lo]), "source": p.number, "kind": kind, "words": six(w[lo:hi]), "firsts": part_of(firsts), "contexts": part_of(contexts), "counts": None if counts is None else counts[lo:hi]})

        known = np.flatnonzero(p.v_c)
        known = known[np.argsort(home(p.vocab[known], parts), kind="stable")]
        send(0, p.vocab[known], counts=p.v_c[known])
        ask, bi, tri = p.asked()
        send(1, p.vocab[ask])
        send(2, p.vocab[p.bi_w[bi]], p.vocab[p.bi_v[bi]], counts=p.bi_c[bi])
        if len(tri):
            ctx = p.tri_ctx[tri]
            send(3, p.vocab[p.tri_w[tri]], p.vocab[p.ctx_v[ctx]], p.ctx_key[ctx], p.tri_c[tri])
        own = np.concatenate((histogram(p.bi_c[~p.hot[p.bi_v]], top), histogram(p.tri_c[~p.hot_ctx[p.tri_ctx]], top)))
        out.append({"part": p.number, "source": p.number, "kind": 4, "counts": own})
        return pa.Table.from_pylist(out, SENT_TYPES)

    return each


def classes(key: np.ndarray, c: np.ndarray, n: int, top: int) -> np.ndarray:
    """By key (0 to n - 1): how many have each count from 1 to top, and the sum of the greater ones."""
    low = np.bincount(key[c <= top] * top + c[c <= top] - 1, minlength=n * top).reshape(n, top)
    return np.column_stack((low, np.bincount(key[c > top], c[c > top], n))).astype(np.int64)


def answerer(top: int):
    """What a part answers for the words that belong to it.

    Rows (source, [kind, part, counts in the order asked]), and of part -1 sums over all parts to be: [-1, N, V, words'
    histogram], [-2, pairs' histogram], [-3, trigrams' histogram], and of each hot context [its key, and by classes how
    often its successors follow it and how often they occur by themselves (of a hot pair: after v)].
    """

    def each(group: pa.Table) -> pa.Table:
        to, rows = [], []
        kinds, sources = group.column("kind").to_numpy(), group.column("source").to_numpy()
        part = group.column("part")[0].as_py() if len(group) else 0

        def taken(kind: int) -> tuple[list[int], list[np.ndarray], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
            at = np.flatnonzero(kinds == kind)
            get = lambda name: [unsix(group.column(name)[int(i)].as_py() or b"") for i in at]
            counts = [group.column("counts")[int(i)].values.to_numpy() if group.column("counts")[int(i)].is_valid else np.zeros(0, np.int64) for i in at]
            return sources[at].tolist(), get("words"), get("firsts"), get("contexts"), counts

        def put(where: int, row: list) -> None:
            to.append(where)
            rows.append(np.concatenate([np.asarray(x).astype(np.int64).ravel() for x in row]))

        def joined(x: list[np.ndarray], kind=np.uint64) -> np.ndarray:
            return np.concatenate(x) if x else np.zeros(0, kind)

        def totals(keys: tuple[np.ndarray, ...], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The place of each row's key among the distinct ones, and the sums by place."""
            code = np.zeros(len(counts), np.int64)
            for k in keys:
                values, back = np.unique(k, return_inverse=True)
                code = np.unique(code * max(1, len(values)) + back, return_inverse=True)[1]
            return code, np.bincount(code, counts).astype(np.int64)

        _, own, _, _, counts = taken(0)
        words, back = np.unique(joined(own), return_inverse=True)
        c = np.bincount(back, joined(counts, np.int64), len(words)).astype(np.int64)
        put(-1, [-1, c.sum(), (c > 0).sum(), histogram(c, top)])

        def known(w: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(words, w), max(0, len(words) - 1))
            return np.where(words[at] == w, c[at], 0) if len(words) else np.zeros(len(w), np.int64)

        for source, asked in zip(*taken(1)[:2], strict=True):
            put(source, [0, part, known(asked)])
        hist = np.zeros(2 * (top + 1), np.int64)
        for x in taken(4)[4]:
            hist += x
        sources2, w2, v2, _, c2 = taken(2)
        if w2:
            w, v = joined(w2), joined(v2)
            code, total = totals((v, w), joined(c2, np.int64))
            for source, x in zip(sources2, np.split(total[code], np.cumsum([len(x) for x in w2])[:-1]), strict=True):
                put(source, [1, part, x])
            one = np.unique(code, return_index=True)[1]
            one = one[total[code[one]] > 0]
            hist[: top + 1] += histogram(total[code[one]], top)
            keys, back = np.unique(v[one], return_inverse=True)
            own, alone = classes(back, total[code[one]], len(keys), top), classes(back, known(w[one]), len(keys), top)
            for k, x, y in zip(keys, own, alone, strict=True):
                put(-1, [k, x, y])
            sources3, w3, v3, x3, c3 = taken(3)
            if w3:
                ww, vv, ctx = joined(w3), joined(v3), joined(x3)
                code3, total3 = totals((ctx, ww), joined(c3, np.int64))
                for source, x in zip(sources3, np.split(total3[code3], np.cumsum([len(x) for x in w3])[:-1]), strict=True):
                    put(source, [2, part, x])
                one = np.unique(code3, return_index=True)[1]
                one = one[total3[code3[one]] > 0]
                hist[top + 1 :] += histogram(total3[code3[one]], top)
                pair, after = mixed(v, w), mixed(vv[one], ww[one])  # each of these pairs has been told of as a pair too
                order = np.argsort(pair)
                below = total[code][order][np.searchsorted(pair[order], after)]
                keys, back = np.unique(ctx[one], return_inverse=True)
                own, alone = classes(back, total3[code3[one]], len(keys), top), classes(back, below, len(keys), top)
                for k, x, y in zip(keys, own, alone, strict=True):
                    put(-1, [int(k) + (1 << 50), x, y])
        put(-1, [-2, hist[: top + 1]])
        put(-1, [-3, hist[top + 1 :]])
        return pa.table({"part": pa.array(to, pa.int32()), "v": pa.array(rows, pa.list_(pa.int64()))})

    return each


def discounts(n: np.ndarray, top: int) -> np.ndarray:
    """Katz's Good-Turing discount for each count up to top, from counts of counts n[0] (of 1) on; else (r - 1/2) / r.

    The second form is taken where the first is not between 0 and 1, as with very few counts. Index 0 is for no count.
    """
    out = np.ones(top + 2)
    tail = (top + 1) * n[top] / n[0] if n[0] else 1.0
    for r in range(1, top + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail) if n[r - 1] and tail < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    out[top + 1] = 1.0
    return out


class Numbers:
    """Discounts by order, the number of tokens and words, and what hot contexts' successors add up to."""

    def __init__(self, rows: list[list[int]], top: int):
        self.top, by = top, {r[0]: np.array(r[1:], np.int64) for r in rows}
        self.n, self.v = map(int, by[-1][:2])
        self.d = [None, *(discounts(x, top) for x in (by[-1][2 : top + 3], by[-2][: top + 1], by[-3][: top + 1]))]
        r = np.arange(1, top + 1)
        h = by[-1][2 : top + 2]
        mass = ((self.d[1][1:-1] * r * h).sum() + self.n - (r * h).sum()) / self.n if self.n else 0.0
        # The mass of unknown words; if discounts leave none, every count is taken of one token more.
        self.shrink = self.n / (self.n + 1) if mass > 1 - 1e-9 else 1.0
        self.unknown = 1 - mass * self.shrink
        self.by = by

    def kept(self, c: np.ndarray, order: int) -> np.ndarray:
        """Counts after their discount."""
        return self.d[order][np.minimum(c, self.top + 1)] * c

    def word(self, c: np.ndarray) -> np.ndarray:
        """The probability of words by their counts."""
        return np.where(c > 0, self.kept(c, 1) / max(1, self.n) * self.shrink, self.unknown)

    def hot(self, key: int, order: int) -> tuple[float, float, float]:
        """Of a hot context: its count, what discounts leave of it, and what they leave of its successors one order below."""
        t, x = self.top, self.by.get(key, np.zeros(2 * self.top + 2, np.int64))
        own, below = x[: t + 1], x[t + 1 : 2 * t + 2]
        r = np.arange(1, t + 1)
        left = lambda n, d: float((d[1:-1] * r * n[:-1]).sum() + n[-1])
        return float((r * own[:-1]).sum() + own[-1]), left(own, self.d[order]), left(below, self.d[order - 1])


FOUND = "block long, tokens array<int>, doc_id array<long>, n_train int, n long, doc binary, known binary, base binary, score binary"
FOUND_TYPES = pa.schema([
    ("block", pa.int64()), ("tokens", pa.list_(pa.int32())), ("doc_id", pa.list_(pa.int64())), ("n_train", pa.int32()), ("n", pa.int64()), ("doc", pa.binary()), ("known", pa.binary()), ("base", pa.binary()), ("score", pa.binary()),
])


def evaluated(p: Part, said: dict[int, list[np.ndarray]], numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """How often each of a part's words occurs (of those that it asked for, and of contexts), and each trigram's probability.

    Katz's recursion: a trigram seen in training takes its discounted share of its context; else the context's backoff
    weight times the pair's probability; a pair in the same way from its second word's. A weight is what the context's
    seen successors leave over, shared out in proportion to what they leave over one order below.
    """
    ask, bi, tri = p.asked()
    word_c = p.v_c.copy()
    for place, kind, c in ((ask, 0, word_c), (bi, 1, p.bi_c), (tri, 2, p.tri_c)):
        if len(place):
            c[place] = np.concatenate(said[kind])
    room = lambda c, mass: c + (mass > c * (1 - 1e-9))
    weight = lambda c, mass, under: np.where(c > 0, (1 - mass / np.maximum(1, room(c, mass))) / np.maximum(1 - under, 1e-300), 1.0)
    q = numbers.word(word_c[p.bi_w])
    mass, seen = numbers.kept(p.bi_c, 2), p.bi_c > 0
    c, sums, under = p.v_c.astype(float), np.bincount(p.bi_v, mass, p.nv), np.bincount(p.bi_v[seen], q[seen], p.nv)
    for v in np.flatnonzero(p.hot):
        c[v], sums[v], below = numbers.hot(int(p.vocab[v]), 2)
        under[v] = below / max(1, numbers.n) * numbers.shrink
    after = room(c, sums)
    pair = np.where(seen, mass / np.maximum(1, after[p.bi_v]), weight(c, sums, under)[p.bi_v] * q)
    mass, seen = numbers.kept(p.tri_c, 3), p.tri_c > 0
    n = len(p.ctx_v)
    c, sums, under = np.bincount(p.tri_ctx, p.tri_c, n), np.bincount(p.tri_ctx, mass, n), np.bincount(p.tri_ctx[seen], pair[p.bi[seen]], n)
    for x in np.flatnonzero(p.hot_ctx):
        c[x], sums[x], below = numbers.hot(int(p.ctx_key[x]) + (1 << 50), 3)
        under[x] = below / max(1, after[p.ctx_v[x]])
    return word_c, np.where(seen, mass / np.maximum(1, room(c, sums)[p.tri_ctx]), weight(c, sums, under)[p.tri_ctx] * pair[p.bi])


def scorer(parts: int, words: Hot, pairs: Hot, top: int):
    def each(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        """A part's share of the sums of each document of its blocks."""
        p, out = Part(blocks, parts, words, pairs), []
        for i in range(len(blocks)):
            if blocks.column("part")[i].as_py() < 0:
                out.append({c: blocks.column(c)[i].as_py() for c in ("block", "tokens", "doc_id", "n_train")})
        if p.empty:
            return pa.Table.from_pylist(out, FOUND_TYPES)
        rows = sorted((x.values.to_numpy() for x in answers.column("v")), key=lambda x: (x[0], x[1]))
        said = defaultdict(list)
        for x in rows:
            said[int(x[0])].append(x[2:])
        size = int(next(x for x in rows if x[0] == 9)[1])
        numbers = Numbers([x.tolist() for x in said[9][0].reshape(-1, size)], top)
        word_c, probability = evaluated(p, said, numbers)
        context_c = word_c[p.ctx_v][p.tri_ctx]
        # Each token is the context of one other token, so here stands what its own count says of it.
        known, base, score = context_c > 0, np.log10((context_c + 1) / (numbers.n + numbers.v + 1)), np.log10(probability)
        for block, lo, hi, doc in p.rows:
            here, back = np.unique(doc, return_inverse=True)
            sums = [np.bincount(back, x[p.tri[lo:hi]]) for x in (known, base, score)]
            out.append({"block": block, "n": numbers.n, "doc": here.astype("<u2").tobytes(), "known": sums[0].astype("<u4").tobytes(), "base": sums[1].astype("<f8").tobytes(), "score": sums[2].astype("<f4").tobytes()})
        return pa.Table.from_pylist(out, FOUND_TYPES)

    return each


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def gather(group: pa.Table) -> pa.Table:
    """A block's documents with the sums of all parts."""
    rows = group.to_pylist()
    about = next(r for r in rows if r["tokens"] is not None)
    tokens = np.array(about["tokens"], np.int64)
    known, base, score = (np.zeros(len(tokens)) for _ in range(3))
    for r in rows:
        if r["tokens"] is None:
            doc = np.frombuffer(r["doc"], "<u2")
            known[doc] += np.frombuffer(r["known"], "<u4")
            base[doc] += np.frombuffer(r["base"], "<f8")
            score[doc] += np.frombuffer(r["score"], "<f4")
    n = max(r["n"] for r in rows if r["tokens"] is None)
    return pa.table({
        "doc_id": pa.array(about["doc_id"], pa.int64()), "held_out": np.arange(len(tokens)) >= about["n_train"], "n_tokens": tokens, "n_known": known.astype(np.int64), "train_tokens": np.full(len(tokens), n, np.int64), "base_score": base, "score": score,
    })


def scores(docs: DataFrame, top: int = GOOD_TURING) -> DataFrame:
    """Each row of docs with its base and model log10 probability, learned from the rows that are not held out.

    Base is add-one unigrams. The model is Katz's trigram, all counts from 1 on, each order discounted by Good-Turing
    up to `top`; words that training does not have share what the discounts leave of all tokens; a context that
    training does not have has weight 1. Null and empty texts are one end; a very long text is one block; repeated rows
    count and score each, equal texts alike; a null doc_id is in training; without any training text, base is log10(1)
    for each token and so is the model's score; no rows give none. Other columns, whatever their names, are not looked
    at. Words are told apart by 48 bits of their hash; parts' shares of `score` are added as 32-bit numbers, so it is
    exact to about seven digits.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(F.col("doc_id")))
    common, both, tokens = frequent(docs, PART_TOKENS)
    parts = 1 + math.ceil(tokens / PART_TOKENS)
    words, pairs = Hot(common, PART_TOKENS), Hot(both, PART_TOKENS)
    tasks = max(2 * parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # so a task's share does not grow with the table
    blocks = packed(docs, parts, words, pairs).repartition(tasks, "part")  # the one exchange of the occurrences, for counting and for scoring
    sent = blocks.groupBy("part").applyInArrow(sender(parts, words, pairs, top), SENT).repartition(tasks, "part")
    # One exchange for both readers: the values are one array and no filter stands above it, so none goes below it.
    said = sent.groupBy("part").applyInArrow(answerer(top), "part int, v array<long>").repartition(tasks, "part")
    width = 2 * (top + 1) + 1
    # A row of part -1 is numbers to be added up by key: few keys, four and one for each hot context.
    sums = said.groupBy(F.when(F.col("part") == -1, F.get("v", F.lit(0))).alias("key")).agg(*[F.sum(F.when(F.col("part") == -1, F.coalesce(F.get("v", F.lit(i)), F.lit(0)))).alias(f"n{i}") for i in range(1, width)])
    one = sums.agg(F.flatten(F.collect_list(F.when(F.col("key").isNotNull(), F.array("key", *[f"n{i}" for i in range(1, width)])))).alias("all"))
    everywhere = one.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.concat(F.array(F.lit(9).cast("long"), F.lit(width).cast("long")), F.col("all")).alias("v"))
    found = blocks.groupBy("part").cogroup(said.unionByName(everywhere).groupBy("part")).applyInArrow(scorer(parts, words, pairs, top), FOUND)
    return found.groupBy("block").applyInArrow(gather, SCORED)
