import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from reelproof.llm import lm


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()


class Brute:
    """The model, from its definition, by dictionaries."""

    def __init__(self, texts, top):
        self.c = [None, Counter(), defaultdict(Counter), defaultdict(Counter)]
        for t in texts:
            seq = [None, None, *low(t), None]
            for u, v, w in zip(seq, seq[1:], seq[2:], strict=False):
                self.c[1][w] += 1
                self.c[2][v][w] += 1
                self.c[3][u, v][w] += 1
        self.uni = self.c[1]
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        d = [None, self.discount(Counter(self.uni.values()), top), *(self.discount(Counter(c for x in self.c[k].values() for c in x.values()), top) for k in (2, 3))]
        q = {w: d[1].get(c, 1) * c / self.n for w, c in self.uni.items()}
        shrink = self.n / (self.n + 1) if sum(q.values()) > 1 - 1e-9 else 1
        self.q = {w: x * shrink for w, x in q.items()}
        self.unknown = 1 - sum(self.q.values())
        self.p, self.back = [None, None, {}, {}], [None, None, {}, {}]
        for k in (2, 3):
            for a, x in self.c[k].items():
                mass = {b: d[k].get(c, 1) * c for b, c in x.items()}
                total = sum(x.values())
                room = total + (sum(mass.values()) > total * (1 - 1e-9))
                self.p[k][a] = {b: m / room for b, m in mass.items()}
                below = sum(self.q[b] if k == 2 else self.p[2][a[1]][b] for b in mass)
                self.back[k][a] = (1 - sum(self.p[k][a].values())) / (1 - below)

    @staticmethod
    def discount(n, top):
        out = {}
        tail = (top + 1) * n[top + 1] / n[1] if n[1] else 1
        for r in range(1, top + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    def two(self, v, w):
        if w in self.p[2].get(v, {}):
            return self.p[2][v][w]
        return self.back[2].get(v, 1) * self.q.get(w, self.unknown)

    def prob(self, u, v, w):
        if w in self.p[3].get((u, v), {}):
            return self.p[3][u, v][w]
        return self.back[3].get((u, v), 1) * self.two(v, w)

    def score(self, t):
        seq = [None, None, *low(t), None]
        return sum(math.log10(self.prob(*x)) for x in zip(seq, seq[1:], seq[2:], strict=False))


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("tokens,block", [(1 << 20, 5000), (60, 900)])
def test_matches_brute_force(spark, monkeypatch, tokens, block):
    """In one part, and in many, with hot words and hot pairs of words."""
    monkeypatch.setattr(lm, "PART_TOKENS", tokens)
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    rng = random.Random(tokens)
    words = ["the", "The", "of", *(f"w{i}" for i in range(80))]
    texts = [" ".join(rng.choice(words[: rng.choice((3, 20, 83))]) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    texts += [None, "", " \n", "é É", texts[0], "q " * 3000, "the of " * 300]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "the of", "x", 1), (3, texts[3], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, block int").repartition(3)
    got = lm.scores(df).collect()
    brute = Brute([t for i, t, *_ in rows if not is_held(i)], lm.GOOD_TURING)
    assert len(got) == len(rows)
    known = dict((i, t) for i, t, *_ in rows)
    for r in got:
        t = known[r.doc_id]
        tokens = [*low(t), None]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (is_held(r.doc_id), len(tokens), brute.n)
        assert r.n_known == sum(brute.uni[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((brute.uni[w] + 1) / (brute.n + brute.v + 1)) for w in tokens), rel=1e-9)
        assert r.score == pytest.approx(brute.score(t), rel=1e-6)
    vocabulary = set(brute.uni)
    for u, v in [*list(brute.c[3])[:60], (b"the", b"never"), (b"never", b"the")]:
        assert sum(brute.prob(u, v, w) for w in vocabulary) + brute.prob(u, v, b"not there") == pytest.approx(1)


def test_small_tables(spark):
    schema = "doc_id long, text string"
    assert lm.scores(spark.createDataFrame([], schema)).count() == 0
    held = next(i for i in range(100) if is_held(i))
    row = lm.scores(spark.createDataFrame([(held, "a b")], schema)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
