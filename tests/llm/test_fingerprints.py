import hashlib
import random
from collections import Counter

from reelproof.llm import fingerprints


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    both = sum((a | b).values())
    return sum((a & b).values()) / both if both else 1.0


def test_contract_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 9)
    rng = random.Random(2)
    texts = [None, "", " \n", "ä", "é b", "Same Text here", "Same Text here"]
    words = [f"w{min(rng.randrange(400), rng.randrange(400))}" for _ in range(400)]
    texts += [" ".join(rng.choices(words, k=rng.randrange(20, 200))) for _ in range(120)] + ["x y " * 3000]
    rng.shuffle(texts)
    ids = rng.sample(range(10**6), len(texts))
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, next string, pos int")
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(df).collect()}
    order = sorted(zip(ids, texts, strict=True), reverse=True)
    errors, seen = [], {}
    for k, (i, t) in enumerate(order):
        t, nxt, r = t or "", order[(k + 1) % len(order)][1] or "", got[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
        errors += [r.near_edited - jaccard(t, edited), r.near_next - jaccard(t, nxt)]
    assert abs(sum(errors) / len(errors)) < 0.01
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.06
    assert len(got) == len(texts)


def test_small_tables(spark):
    schema = "doc_id long, text string"
    assert fingerprints.edited_fingerprints(spark.createDataFrame([], schema)).count() == 0
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(5, "abcd")], schema)).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1.0
    rows = fingerprints.edited_fingerprints(spark.createDataFrame([(1, "a b")] * 3 + [(None, "z")], schema)).collect()
    assert len(rows) == 4
