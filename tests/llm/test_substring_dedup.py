import random

import numpy as np
import pyarrow as pa
import pytest

from reelproof.llm import substring_dedup as sd


def brute(rows, width=13):
    """From the definition: every run of words of every document, and the least doc_id that has it."""
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - width + 1):
            run = tuple(w[k : k + width])
            if i is not None:
                first[run] = min(first.get(run, i), i)
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def got(spark, rows, width=13, schema="doc_id long, text string"):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in sd.deduped(spark.createDataFrame(rows, schema), width).collect()), key=str)


def made(n, seed=5):
    """Documents with shared passages, near and exact copies, and passages that cross and branch."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["é", "ß", "a", "#"]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    passages = [text(rng.randint(10, 60)) for _ in range(8)]
    rows = []
    for i in range(n):
        w = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = passages[min(7, int(rng.expovariate(0.6)))]
            a = rng.randint(0, 5)
            w += p[a : len(p) - rng.randint(0, 5)] + text(rng.randint(0, 20))
        if rows and i % 6 == 0:
            w = list(rng.choice(rows)[1].split())
            if w and i % 12 == 0:
                w[rng.randrange(len(w))] = "changed"
        rows.append((rng.randint(0, n), rng.choice([" ", "\n", "\t ", "\x0b"]).join(w)))
    return rows


def small(monkeypatch, **more):
    for name, n in (("PART_BYTES", 3000), ("BUCKETS", 3), ("CHUNK", 500)):
        monkeypatch.setattr(sd, name, n)


def test_against_every_run(spark, monkeypatch):
    small(monkeypatch)
    rows = made(260)
    long = made(1, 9)[0][1] + " " + " ".join(f"x{k}" for k in range(30_000)) + " " + rows[6][1]
    rows += [(None, rows[3][1]), (None, rows[3][1]), (900, None), (901, ""), (902, " \n "), (903, "a b"), (904, long), (905, long), (905, long), (906, "same " * 60), (907, "same " * 25), (908, " ".join(["nbsp"] * 30))]
    want = brute(rows)
    assert sum(x[2] > 0 for x in want) > 60 and sum(0 < x[2] < x[1] for x in want) > 30
    assert got(spark, rows) == want


@pytest.mark.parametrize("width", [3, 7])
def test_other_widths(spark, monkeypatch, width):
    small(monkeypatch)
    rows = made(80, width)
    assert got(spark, rows, width) == brute(rows, width)


def test_empty_and_further_columns(spark):
    assert got(spark, []) == []
    rows = made(30)
    assert got(spark, [(*r, "x", 1) for r in rows], schema="doc_id long, text string, part string, kept int") == brute(rows)


def test_hashes_and_seeds(monkeypatch):
    """Hashes are of words alone, wherever they stand; two texts that share a run share its seed."""
    monkeypatch.setattr(sd, "CHUNK", 64)
    sd.powers.__defaults__[0].clear()
    texts = pa.array([b"", b" ab  cd ", b"cd", b"x" * 300 + b" ab", b"\n"], pa.large_binary())
    one, two, doc = sd.word_hashes(texts)
    assert doc.tolist() == [1, 1, 2, 3, 3] and one[0] == one[4] and one[1] == one[2] and two[1] == two[2] and len(set(one.tolist())) == 3
    sd.powers.__defaults__[0].clear()
    h = np.array([random.Random(1).getrandbits(64) for _ in range(200)], np.uint64)
    for n in (1, 2, 7, 13):
        r = sd.GRAM[0]
        want = [sum(int(h[i + j]) * pow(r, j, 1 << 64) for j in range(n)) % (1 << 64) for i in range(200 - n + 1)]
        assert (sd.grams(h, n, 0) == sd.mixed(np.array(want, np.uint64))).all()
        assert sd.least(h, n).tolist() == [min(h[i : i + n].tolist()) for i in range(200 - n + 1)]


def test_words_at_the_source_decide(spark, monkeypatch):
    """If a hash says equal where the words are not, nothing is removed."""
    small(monkeypatch)
    rows = made(60)
    monkeypatch.setattr(sd, "digest_of", lambda words: str(id(words)).encode())
    out = sd.deduped(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
