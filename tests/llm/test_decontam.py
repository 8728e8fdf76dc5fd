import random

from reelproof.llm import decontam


def test_template(spark):
    text = "Anna paid $3.50 for 12 apples, then Ben Oak ran 5 km. He saw Ünal at 7%."
    row = spark.createDataFrame([(text,)], "t string").select(decontam.template(decontam.F.col("t")).alias("w"), decontam.slots(decontam.F.col("t")).alias("v")).first()
    assert " ".join(row.w) == "\x02anna\x03\x03 paid \x01u for \x01n apples then \x01a ran \x01u \x02he\x03\x03 saw \x01a at \x01u"
    assert row.v == ["anna", "$3.50", "12", "ben oak", "5 km", "he", "ünal", "7%"]


def test_planted_leaks(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    item = "A farmer called Tom has 12 cows and buys 7 more cows from Tom who keeps 12 goats in a very large field near Rome"
    items = [(1, prose(30)), (2, item), (3, "tiny unique words"), (4, ""), (5, None), (6, prose(40))]
    plain = dict(items)
    edited = plain[6].split()
    edited[20] = "zzzzz"
    docs = {
        10: prose(50) + " " + plain[1].upper() + "!! " + prose(50),
        11: plain[1][:70],
        12: "x " + item.replace("Tom", "Sue").replace("12", "31").replace("7", "9"),
        13: "x " + item.replace("12 cows", "31 cows").replace("Tom has", "Sue has"),
        14: "They left. Tiny, unique words.",
        15: " ".join(edited),
        16: None,
        17: "",
        18: prose(20_000),
        19: f"{plain[1]} {item}",
    }
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs.items()] + [(10, docs[10], 0, "x")], "doc_id long, text string, item_id int, h string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = {(10, 1), (12, 2), (14, 3), (15, 6), (19, 1), (19, 2)}
    for most in (decontam.BROADCAST_WINDOWS, 0):
        rows = decontam.leaks(df, bench, most=most).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    assert decontam.leaks(df.limit(0), bench).count() == 0
    assert decontam.leaks(df, bench.limit(0)).count() == 0


def test_one_alignment_and_exact_copies(spark):
    run = "what is the next number in the row 2 4 6 8 10 12"
    ops = "work out 3 plus 4 plus 5 plus 6 plus 7 and say it"
    short = "Paris lies on which river bank"
    two = "how many eggs are left if Ida has 5 eggs and eats 5 eggs today"
    items = [(1, run), (2, ops), (3, short), (4, two)]
    docs = {
        10: f"a few lines before {run} and after",
        11: run.replace("2 4 6 8 10 12", "3 5 7 9 11 13"),
        12: f"so they said {ops} at once",
        13: ops.replace("3 plus 4", "9 plus 8"),
        14: f"and then, {short}, they asked",
        15: f"they asked whether {short} or not",
        16: "so Rome lies on which river bank",
        17: two.replace("5 eggs and", "6 eggs and"),
        18: f"{two.replace('5 eggs and', '6 eggs and')} {'other words here ' * 9} {two}",
        19: "what is then the next number in the row 2 4 6 8 10 12",
        20: "The row 2 4 6 8 10 12 is long",
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = decontam.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(10, 1), (11, 1), (12, 2), (13, 2), (14, 3), (15, 3), (16, 3), (18, 4), (19, 1)}
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    assert all(r.n_found <= r.n_windows for r in rows)


def test_series_names_and_numbers_alone(spark):
    series = "Complete the series that begins with 2, 4, 6, 8, 10, 12, 14, 16 and then 18"
    walk = "Mary walked to Paris"
    pure = "3 1 4 1 5 9 2 6"
    lower = "the tower that Eiffel built near the Seine has how many steps"
    items = [(1, series), (2, walk), (3, pure), (4, lower)]
    docs = {
        10: f"so. {series} ok", 11: series, 12: "John walked to New York", 13: "and then John walked to Rome, they said", 14: "walked to Paris", 15: "x 3 1 4 1 5 9 2 6 y",
        16: "x 3 1 4 1 5 9 2 7 1 2 3 4 5", 17: lower.upper(), 18: "11 22 33 44 55 66 77 88 99", 19: lower.replace("Eiffel", "Some Builder").replace("Seine", "Long River"),
        20: series.replace("2, 4, 6, 8, 10, 12, 14, 16 and then 18", "3, 5, 7, 9, 11, 13, 15, 17 and then 19"),
    }
    rows = [(i, t) for i, t in docs.items()] + [(None, walk), (None, "nothing of it"), (30, walk), (30, "other words here"), (30, walk)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontam.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(10, 1), (11, 1), (12, 2), (13, 2), (15, 3), (17, 4), (19, 4), (20, 1), (None, 2), (30, 2)}
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)


def shape(text):
    """A word of a number is one type, any other word itself."""
    return [("n", w) if w.isdigit() else ("w", w) for w in text.split()]


def brute(doc, item):
    """An item is held if a stretch of the document has 0.8 of its windows at one shift, and each number stands for one other."""
    a, b = shape(item), shape(doc)
    mask = lambda run: tuple(w if k == "w" else k for k, w in run)
    size = min(5, len(a))
    asked = range(len(a) - size + 1)
    there = {mask(b[j : j + size]) for j in range(len(b) - size + 1)}
    hit = [i for i in asked if mask(a[i : i + size]) in there]
    if len(hit) < 0.8 * len(asked):
        return False
    if f" {item} " in f" {doc} ":
        return True
    at = next(j for j in range(len(b)) if mask(b[j : j + len(a)]) == mask(a))
    pairs = {(x[1], y[1]) for x, y in zip(a, b[at : at + len(a)], strict=True) if x[0] == "n"}
    return len({x for x, _ in pairs}) == len(pairs)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeo" for c in "lmn"]
    items = [(i, " ".join(rng.choice("1234") if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(6, 14)))) for i in range(25)]
    docs = []
    for i in range(200):
        renamed = dict(zip("1234", rng.choices(["5", "6", "7", "8"], k=4), strict=True))
        own = [renamed[w] if w in renamed and i % 2 else w for w in rng.choice(items)[1].split()]
        if i % 3 == 0:
            own = [rng.choice("5678") if w.isdigit() else w for w in own]
        docs.append((i, " ".join([*rng.choices(words, k=4), *own, *rng.choices(words, k=4)])))
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(d, i) for d, t in docs for i, x in items if brute(t, x)}
    assert {(r.doc_id, r.item_id) for r in found} == want and 60 < len(want) < 200


def test_runs_of_any_length(spark):
    # Names in a row, numbers joined by commas, digits alone.
    names, numbers, digits = "Von " * 30_000, ",".join(["7"] * 60_000), "7" * 60_000
    bench = spark.createDataFrame([(1, "the grey heron stands in the pond all day long")], "item_id long, text string")
    texts = [f"so said {names}and {numbers} km, {digits}, {numbers} x", f"Of {names}the grey heron stands in the pond all day long", f"${numbers} {digits} the grey heron stands in the pond all day long"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select(decontam.template(decontam.F.col("text")).alias("w"), decontam.slots(decontam.F.col("text")).alias("v")).collect()
    assert rows[0].w == ["so", "said", "\x01a", "and", "\x01u", "\x01n", "\x01n", "x"]
    assert rows[0].v == [names.strip().lower(), f"{numbers} km", digits, numbers]
    assert rows[1].w[0] == "\x02of\x03von\x03von" and rows[1].w[-11:] == ["\x01a", *texts[1].split()[-10:]] and len(rows[1].v) == 2
    assert rows[2].w[:2] == ["\x01u", "\x01n"] and rows[2].v == [f"${numbers}", digits]
    assert sorted(r.doc_id for r in decontam.leaks(docs, bench).collect()) == [1, 2]
