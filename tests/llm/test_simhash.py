import random

import numpy as np
import xxhash

from reelproof.llm import simhash


def brute(texts):
    out = []
    for t in texts:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    return out


def groups(fps, ids, radius):
    label = list(ids)
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= radius:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_near_matches_popcount():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = np.unique(np.array([b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base for i in range(0, 64, 3) for j in range(0, 64, 5)], np.uint64))
    for radius in (1, 2, 3):
        got = {(i, int(j)) for i, js in simhash.near(fps, radius) for j in js}
        want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
        assert got == want


def test_groups_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [None, "", " \t\n", "One", "one", "A b", "a  B", "é É", "É é"]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(6)]
    texts += base + [b.replace("w1 ", "w2 ", 1) for b in base] + base[:2]
    texts.append(" ".join(rng.choices(words, k=70_000)))
    rows = [(i * 3 + 1, t, "x", "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(df).collect()}
    fps, ids = brute(texts), [r[0] for r in rows]
    assert got == {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, groups(fps, ids, 2), strict=True)}


def test_large_buckets_are_split_without_loss(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = sorted({base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(40)})
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    from reelproof.llm.common import components

    for most in (60, 8192):
        got = {r.node % 2**64: r.root for r in components(simhash.links(df, 2, most)).collect()}
        want = groups(fps, list(range(len(fps))), 2)
        for i, f in enumerate(fps):
            for j, g in enumerate(fps):
                assert (got.get(f, f) == got.get(g, g)) == (want[i] == want[j])


def test_repeated_rows_and_empty_table(spark):
    schema = "doc_id long, text string"
    assert simhash.near_groups(spark.createDataFrame([], schema)).count() == 0
    rows = simhash.near_groups(spark.createDataFrame([(4, "a b c d")] * 3, schema)).collect()
    assert len(rows) == 3 and {r.component_id for r in rows} == {4}
