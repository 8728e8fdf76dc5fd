import random
import zlib

import numpy as np

from reelproof.llm import quality


def test_traversal_matches_one_row_at_a_time():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.train(x, y)
    for row, score in zip(x[:20], model.score(x[:20]), strict=True):
        total = model.start
        for f, c, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            at = 0
            for _ in range(quality.DEPTH):
                at = 2 * at + 1 + int(row[f[at]] > c[at])
            total += leaf[at - len(f)]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97


def test_statistics():
    found = dict(zip(quality.STATISTICS, quality.statistics("AB cd!\ncd! é".encode()), strict=True))
    assert found["capital_words"] == 0.25 and found["commonest_word"] == 0.5 and found["mark_21"] == 2 / 13
    assert quality.statistics(b" \n") == [0.0] * len(quality.STATISTICS)


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choices("aeinrst", k=rng.randrange(2, 9))) for _ in range(rng.randrange(5, 80))]
        good = rng.random() < 0.8
        rows.append((i, " ".join(words) if good else " ".join(w + rng.choice(("***", "!!", "")) for w in words).upper(), "x"))
        labels.append((i, int(good), 7))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "word " * 50_000, "x"), (None, "abc", "x"), (3, rows[3][1], "x")]
    labels += [(5, None, 7), (None, 1, 7), (6, labels[6][1], 7)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, text int")
    got = quality.scored(docs, known).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, q, _ in labels if q is not None}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert sum(right) / len(right) > 0.95
    same = quality.scored(docs, known.limit(0)).collect()
    assert {r.score for r in same} == {0.5}
    assert quality.scored(docs.limit(0), known).count() == 0
