import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelproof.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def is_near(a, b):
    x, y = a.split(), b.split()
    if len(x) >= 5 and len(y) >= 5:
        return abs(len(x) - len(y)) < 2 and distance(x, y) <= 1
    return len(x) < 5 and len(y) < 5 and len(a) >= 10 and len(b) >= 10 and abs(len(a) - len(b)) < 2 and distance(a, b) <= 1


def brute(docs):
    """docs: {doc_id: text}; what stays of each, by plain edit distance to all earlier lines."""
    seen, out = {}, {}
    for i, t in sorted(docs.items()):
        if t is None:
            out[i] = None
            continue
        stay = []
        for line in t.split("\n"):
            own = line.strip(" \t\r\x0b\x0c")
            if not own or not (own in seen or any(is_near(o, own) for o in seen)):
                stay.append(line)
            if own:
                seen[own] = True
        out[i] = "\n".join(stay)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
def test_within_one(a, b):
    assert line_dedup.within_one(a, b) == (distance(a, b) <= 1)


def test_deletion_keys():
    words = [b"a", b"b", b"b", b"c"]
    at, keys = line_dedup.deletions(words)
    for i, k in zip(at, keys, strict=True):
        rest = words if i < 0 else words[:i] + words[i + 1 :]
        assert k == line_dedup.deletions(rest)[1][0]


def test_matches_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(30)]
    base = [rng.choices(vocabulary, k=rng.choice((2, 3, 4, 5, 6, 9, 10, 11, 14, 20))) for _ in range(40)]

    def edit(line):
        line = list(line)
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            i = rng.randrange(len(line))
            rng.choice((lambda: line.pop(i), lambda: line.insert(i, rng.choice(vocabulary)), lambda: line.__setitem__(i, "zz")))()
        text = " ".join(line)
        if rng.random() < 0.3:
            i = rng.randrange(len(text))
            text = text[:i] + rng.choice(("", "x", "é")) + text[i + rng.randrange(2) :]
        return rng.choice(("", "  ")) + text

    docs = {i: "\n".join(edit(rng.choice(base)) if rng.random() < 0.9 else "" for _ in range(rng.randrange(1, 9))) for i in range(60)}
    docs |= {100: None, 101: "", 102: "\n\n", 103: docs[3], 104: " ".join(["long"] * 5000), 105: " ".join(["long"] * 5001)}
    rows = [(i, t, "en", len(t or ""), "x", 1) for i, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, h1 string, lines_removed int")
    got = line_dedup.dedup_lines(df).collect()
    want = brute(docs)
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text or "") and r.h1 == "x" for r in got) and len(got) == len(rows)
    assert sum(r.lines_removed for r in got) > 50


def test_short_lines_and_shared_ids(spark):
    schema = "doc_id long, text string"
    nine = "this line of nine words has a typo inside"
    rows = [(1, f"{nine}\nchapter twelve\nPage 1"), (2, nine.replace("typo", "slip") + "\nchapter twelwe\nPage 2"), (5, "only here\nkept"), (5, "else there\nkept"), (6, "only here")]
    got = {r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, schema)).collect()}
    assert f"{nine}\nchapter twelve\nPage 1" in got and "Page 2" in got and "" in got
    assert {t for t in got if "here" in t} in ({"only here\nkept", "else there"}, {"only here", "else there\nkept"})


def test_repeated_rows_null_ids_and_empty(spark):
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (2, "b\nc\nc"), (None, "a\na")], schema)
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(0, "a\na"), (1, "a\nb"), (1, "a\nb"), (2, "c")]
    assert line_dedup.dedup_lines(spark.createDataFrame([], schema)).count() == 0


def test_texts_of_one_doc_id_whose_short_hashes_are_equal(spark):
    """Two texts of one doc_id that 32 bits can't tell apart keep their own lines."""
    rows = spark.range(300_000).select(F.concat(F.lit("first line of text "), F.col("id"), F.lit("\ncommon line here\nlast line of "), F.col("id")).alias("text"))
    pair = rows.groupBy(F.hash("text")).agg(F.collect_list("text").alias("t"), F.count("*").alias("n")).filter("n = 2").first().t
    other = "common line here\nsomething"
    got = {r.text for r in line_dedup.dedup_lines(spark.createDataFrame([(1, other), (2, pair[0]), (2, pair[1])], "doc_id long, text string")).collect()}
    first, second = sorted(pair, key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])
    lines = lambda t: [x for x in t.split("\n") if x != "common line here"]
    assert other in got and "\n".join(lines(first)) in got and len(got) == 3
    later = [x for x in lines(second) if not any(line_dedup.near(x.encode(), y.encode()) for y in lines(first))]
    assert "\n".join(later) in got
