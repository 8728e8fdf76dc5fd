import math
import random

import numpy as np
from pyspark.sql import functions as F

from reelproof.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, anchor, positives=5, negatives=10):
    """Every score of every anchor, from the definition; rows (vec_id, label, embedding)."""
    fit = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    own = [(v, lab, [math.floor(256 * float(np.float32(x))) for x in e]) for v, lab, e in fit]
    out = []
    for i, a in enumerate(own):
        if not anchor(a[0]):
            continue
        near = [(-sum(x * y for x, y in zip(a[2], b[2], strict=False)), b[0] is None, b[0] or 0, b[0], b[1]) for j, b in enumerate(own) if j != i]
        for p in sorted(x[:4] for x in near if x[4] == a[1])[:positives]:
            fits = sorted(x[:4] for x in near if x[4] != a[1] and 30 * -p[0] <= 100 * -x[0] <= 90 * -p[0])
            out += [(a[0], p[3], k + 1, x[3], -p[0], -x[0]) for k, x in enumerate(fits[:negatives])]
    return sorted(out, key=str)


def got(spark, rows, schema=SCHEMA):
    return sorted((tuple(r) for r in hard_negatives.mined(spark.createDataFrame(rows, schema), F.col("vec_id") % 10 == 0).collect()), key=str)


def made(n, dim=8, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, i % 3, [c + rng.gauss(0, 0.4) for c in centres[i % 6]]) for i in range(n)]


def test_against_all_scores(spark, monkeypatch):
    for name, n in (("ANCHORS", 7), ("BLOCK", 40), ("BLOCKS", 3), ("LANES", 16)):
        monkeypatch.setattr(hard_negatives, name, n)
    rows = made(230)
    rows += [(300, 1, rows[40][2]), (300, 1, rows[40][2]), (310, 2, rows[40][2])] + [(401 + i, i % 2, rows[7][2]) for i in range(30)]  # ties, repeats
    rows += [(None, 1, rows[3][2]), (501, None, rows[3][2]), (502, 1, None), (503, 1, [None] * 8), (504, 1, [float("nan")] * 8), (505, 1, [float("inf")] * 8)]
    rows += [(510, 0, []), (511, 1, [1.0]), (520, 1, rows[11][2] + [2.0, 3.0]), (530, 2, [0.0] * 8)]
    want = brute(rows, lambda v: v is not None and v % 10 == 0)
    assert len(want) > 500
    assert got(spark, rows) == want


def test_large_components(spark):
    rows = [(i, i % 2, [float(2.0 ** (10 + i % 3)), 3.0e6 * (1 - 0.3 * (i % 2)), -1.5]) for i in range(24)]
    out = got(spark, rows)
    assert out == brute(rows, lambda v: v % 10 == 0) and max(r[4] for r in out) > 1 << 53


def test_empty_and_further_columns(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, 1, [1.0])]) == []
    rows = made(60)
    wide = [(*r, "x", 1) for r in rows]
    assert got(spark, wide, SCHEMA + ", uid string, score int") == brute(rows, lambda v: v % 10 == 0)


def test_bounds_spare_scores(monkeypatch):
    """Rows far from what an anchor looks for are never scored beyond the root."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = rng.normal(size=(1, 16)) * 100
    anchors = np.floor(base + rng.normal(size=(40, 16)))
    rows = np.floor(np.concatenate((base + rng.normal(size=(50, 16)), -base + rng.normal(size=(950, 16)))))
    seen = []
    plain = hard_negatives.exact
    monkeypatch.setattr(hard_negatives, "exact", lambda r, a, safe: seen.append(len(r)) or plain(r, a, safe))
    order, parent, edge = hard_negatives.spanning(anchors)
    assert sorted(order) == list(range(40)) and parent[0] == -1
    struct = lambda v, first, **more: pa.array([{"uid": list(range(first, first + len(v))), "vec_id": list(range(len(v))), "label": [0] * len(v), "vec": v.tolist(), **more}])[0]
    found = hard_negatives.walked(struct(rows, 1000), struct(anchors, 0, tree=order, parent=parent, edge=edge), 5, None)
    assert sum(seen) < 0.2 * 1000 * 40
    scores = rows @ anchors.T
    for node, at, score in found:
        assert sorted(score, reverse=True) == sorted(scores[:, node], reverse=True)[:5] and (scores[at, node] == score).all()
