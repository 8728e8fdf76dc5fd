from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelproof.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_pack_invariants(sizes):
    lengths = (4, 8, 16)
    sizes = np.array(sorted(sizes, reverse=True), dtype=np.int64)
    bins, offsets, fit = packing.pack(sizes, lengths, 1)
    used = {}
    for n, b, o, f in zip(sizes, bins, offsets, fit, strict=True):
        assert o == used.get(b, (0, 0))[0]
        used[b] = (o + n, f)
    for total, f in used.values():
        assert total <= f and f == min(c for c in lengths if c >= total)


def test_best_fit_takes_the_tightest_bin():
    bins, _, fit = packing.pack(np.array([10, 9, 6, 5]), (16,), 0)
    assert bins.tolist() == [0, 1, 0, 1] and set(fit) == {16}


def cheapest(sizes, lengths):
    """The least cost of any way to share out the sizes, by trying all."""
    best = [float("inf")]

    def go(i, bins):
        if i == len(sizes):
            best[0] = min(best[0], sum(min(packing.price(c, 1, 32) for c in lengths if c >= b) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= max(lengths):
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=7))
def test_cost_is_near_the_best_of_all(sizes):
    """At most 1.35 times the least cost of all, on such small cases; on average much nearer."""
    sizes = sorted(sizes, reverse=True)
    bins, _, fit = packing.pack(np.array(sizes, dtype=np.int64), (4, 8, 16), 1, 32)
    cost = sum(packing.price(int(c), 1, 32) for c in dict(zip(bins.tolist(), fit.tolist(), strict=True)).values())
    assert cost <= 1.35 * cheapest(sizes, (4, 8, 16))


def test_lengths_are_chosen_jointly():
    rng = np.random.default_rng(3)
    sizes = np.sort(np.minimum(4096, rng.lognormal(5.5, 1.2, 8000).astype(np.int64) + 1))[::-1]
    cost = {}
    for lengths in (packing.LENGTHS, (4096,), (512, 4096)):
        bins, _, fit = packing.pack(sizes, lengths)
        own = dict(zip(bins.tolist(), fit.tolist(), strict=True))
        cost[lengths] = sum(packing.price(c) for c in own.values())
    bins, _, fit = packing.pack(sizes, packing.LENGTHS)
    share = {c: list(dict(zip(bins.tolist(), fit.tolist(), strict=True)).values()).count(c) / len(set(bins.tolist())) for c in packing.LENGTHS}
    assert all(x > 0.05 for x in share.values())
    assert cost[packing.LENGTHS] < cost[512, 4096] < cost[4096,]
    assert cost[packing.LENGTHS] < 1.02 * sizes.sum() * min(packing.price(c) / c for c in packing.LENGTHS) + 0.3 * sizes[sizes > 1024].sum()


def test_small_rest_opens_a_small_bin():
    _, _, fit = packing.pack(np.array([3]), (4, 8, 16), 1)
    assert fit.tolist() == [4]


def test_tables(spark):
    texts = [None, "", "one", "a b " * 700] + ["w " * (i % 90) for i in range(500)] + ["same words"] * 5
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "x", 0)] * 2, "doc_id long, text string, piece int")
    rows = packing.packed(df, (64, 256), group=100).collect()
    spans = {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.start, r.start + r.n_tokens))
    for i, t in enumerate(texts):
        at = 0
        for a, b in sorted(spans[i]):
            assert a == at
            at = b
        assert at == len((t or "").split()) + 1
    bins = {}
    for r in rows:
        bins.setdefault((r.bin_id, r.bin_length), []).append((r.bin_offset, r.bin_offset + r.n_tokens))
    full = 0
    for (_, size), own in bins.items():
        at = 0
        for a, b in sorted(own):
            assert a == at
            at = b
        assert at <= size
        full += at
    assert len({b for b, _ in bins}) == len(bins)
    assert full / sum(size for _, size in bins) > 0.95
    assert packing.packed(df.limit(0)).count() == 0


def test_few_long_documents_spread_over_groups(spark):
    """Groups follow the number of pieces, not of documents."""
    df = spark.createDataFrame([(i, 4096 * 50) for i in range(40)], "doc_id long, n long").withColumn("text", F.lit("x"))
    rows = packing.packed(df, tokens=F.col("n"), group=100).select((F.col("bin_id") / (1 << 32)).cast("int").alias("part"), "doc_id").collect()
    size = Counter(r.part for r in rows)
    assert len(rows) == 2000 and len(size) == 21 and max(size.values()) < 200
