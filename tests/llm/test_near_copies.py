import random

import corpus_pipeline
from reelproof.llm import near_copies


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute(rows):
    """The rows that stay: the smallest (doc_id, null last) of each component of Jaccard 0.8."""
    texts = sorted({t or "" for _, t in rows})
    sets, label = [grams(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and len(a & b) >= 0.8 * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    group = dict(zip(texts, label, strict=True))
    best = {}
    for i, t in rows:
        g = group[t or ""]
        best[g] = min(best.get(g, (True, 0)), (i is None, i or 0))
    return best, group


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def held(spark, rows):
    best, group = brute(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string")
    got = corpus_pipeline.without_near_copies(spark, df, "").collect()
    assert {group[r.text or ""]: (r.doc_id is None, r.doc_id or 0) for r in got} == best and len(got) == len(best)
    return len(got)


def test_matches_brute_force_jaccard(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    base = [prose(rng.choice((6, 40, 200, 600))) for _ in range(40)]
    texts = base + [edited(rng, b, rng.randrange(1, 2 + len(b.split()) // 25)) for b in base for _ in range(3)]
    texts += base[:5] + [None, "", " \n", "one", "One", "two words", "a b c d", "a b c d e"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert 50 < held(spark, rows) < len(rows) - 30


def test_large_groups_and_a_common_passage(spark, monkeypatch):
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    base, passage = prose(150), prose(60)
    chain = [base]
    for _ in range(60):
        chain.append(edited(rng, chain[-1] if rng.random() < 0.5 else base, 2))
    rows = list(enumerate(chain + [f"{prose(40)} {passage} {prose(20)}" for _ in range(60)]))
    assert held(spark, rows) > 60
    monkeypatch.setattr(near_copies, "COUNTED", 1)
    held(spark, rows)


def test_rows_of_null_or_one_doc_id(spark):
    rng = random.Random(7)
    prose = [" ".join(f"w{rng.randrange(5000)}" for _ in range(50)) for _ in range(6)]
    rows = [(None, prose[0]), (None, prose[1]), (3, prose[2]), (3, prose[3]), (3, prose[3]), (4, prose[3]), (None, prose[3]), (None, prose[4]), (5, prose[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.without_near_copies(spark, df, "").collect()), key=str)
    assert got == sorted([(None, prose[0]), (None, prose[1]), (3, prose[2]), (3, prose[3]), (5, prose[4])], key=str)


def test_fingerprints_link_what_sets_do_not(spark):
    """Texts that are one passage many times, each with an end of its own: few different shingles are shared, nearly all counted ones are."""
    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage, other = prose(9), prose(60)
    rows = [(k, f"{passage} " * 200 + prose(8)) for k in (1, 2, 3)] + [(4, f"{passage} {other}"), (5, other)]
    assert not any(len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b)) for i, (_, a) in enumerate(rows[:4]) for _, b in rows[:i])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, df, "").collect()) == [1, 4]
