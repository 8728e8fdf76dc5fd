"""Sample tables of containers: spans without joins of samples, and overlaps without comparing each span with each."""

import random
import time

from reelproof.operators import digest

CHUNK = "rel long, track int, chunk_no int, offset long"
PER = "rel long, track int, first_chunk int, samples_per_chunk int"
SIZE = "rel long, track int, sample_no int, size long"


def test_spans_from_their_definition(spark):
    """Tables that end early, or have samples left, several ranges, and tracks without ranges or sizes."""
    rng = random.Random(5)
    chunks, per, sizes, want = [], [], [], set()
    for rel in range(30):
        n, left = rng.randrange(1, 12), rng.randrange(0, 25)
        marks = {k: rng.randrange(1, 4) for k in rng.sample(range(1, 12), rng.randrange(0, 4))}
        own = [rng.randrange(0, 9) for _ in range(left)]
        chunks += [(rel, 1, k + 1, 100 * k) for k in range(n)]
        per += [(rel, 1, k, v) for k, v in marks.items()]
        sizes += [(rel, 1, k + 1, v) for k, v in enumerate(own)]
        at = 0
        for k in range(1, n + 1):
            step = marks[max(m for m in marks if m <= k)] if any(m <= k for m in marks) else 1
            if sum(own[at : at + step]):
                want.add((rel, 1, k, 100 * (k - 1), 100 * (k - 1) + sum(own[at : at + step])))
            at += step
    got = digest.chunk_spans(spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(per, PER), spark.createDataFrame(sizes, SIZE)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_overlaps_from_their_definition(spark):
    rng = random.Random(9)
    rows = [(rel, rng.choice(("meta", "essence", "other")), s, s + rng.randrange(1, 30)) for rel in range(200) for s in rng.sample(range(200), 5)]
    want = {r for r, k, s, e in rows for r2, k2, s2, e2 in rows if r == r2 and (k, k2) == ("meta", "essence") and s < e2 and s2 < e}
    got = digest.overlapping(spark.createDataFrame(rows, "rel long, kind string, start long, stop long"), "rel").collect()
    assert {r.rel for r in got} == want and len(got) == len(want) and 20 < len(want) < 180


def test_many_spans_of_one_file_are_not_paired(spark):
    """A file of 2 * 60,000 small spans, none of which overlap: 3.6 thousand million pairs of one cell."""
    n = 60_000
    rows = spark.range(2 * n).selectExpr("CAST(1 AS BIGINT) AS rel", "if(id % 2 = 0, 'meta', 'essence') AS kind", "id * 10 AS start", "id * 10 + 10 AS stop")
    began = time.time()
    assert digest.overlapping(rows, "rel").count() == 0
    assert time.time() - began < 15
