"""Benchmark leaks: texts as templates, hash-joined window by window, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

WINDOW, SIMILARITY = 5, 0.8
#: The benchmark's windows are sent to every task up to this many (each some 40 bytes), and shuffled beyond.
BROADCAST_WINDOWS = 200_000
#: A slot's two sides may lie this many words further apart or closer than in most windows of the passage.
DRIFT = 4
# Unit words that belong to the number before them.
UNITS = (
    "km", "m", "cm", "mm", "miles", "mile", "feet", "foot", "ft", "inches", "inch", "yards", "kg", "g", "mg", "lbs", "lb", "oz",
    "pounds", "tons", "liters", "litres", "l", "ml", "gallons", "seconds", "second", "minutes", "minute", "hours", "hour", "days",
    "day", "weeks", "week", "months", "month", "years", "year", "dollars", "dollar", "cents", "cent", "euros", "euro", "percent", "mph",
)
# Fixed patterns: numbers, numbers with their unit, and capitalised words in a row, amid a sentence (a name) or at the
# start of one (a name, or any first word). Runs are possessive: Java's matcher would else call itself once for each word
# or number of a run, and a run of some thousand overflows the stack, which ends the executor. Nothing that follows a run
# could match inside it, and from inside it no match ends elsewhere than from its start, so the matches are the same.
DIGITS = r"\d++(?:[.,]\d++)*+"
WITH_UNIT = rf"[$€£]{DIGITS}|(?<!\d)(?<!\d[.,]){DIGITS}\s?(?:[%€£$]|(?:{'|'.join(UNITS)})(?!\p{{L}}))"
CAPITALISED = r"\p{Lu}\p{Ll}+"
NAME = rf"(?<=[\p{{Ll}}\p{{Nd}},;:]\s){CAPITALISED}(?:\s{CAPITALISED})*+"
FIRST = rf"(?<![\p{{L}}\p{{M}}\p{{Nd}}])(?<![\p{{Ll}}\p{{Nd}},;:]\s)({CAPITALISED})(?:\s({CAPITALISED}))?(?:\s({CAPITALISED}))?"
NAME_SLOT, NUMBER_SLOT, UNIT_SLOT = "\u0001a", "\u0001n", "\u0001u"
#: What stands before capitalised words that start a sentence, and between them.
START, BETWEEN = "\u0002", "\u0003"


def template(text: Column) -> Column:
    """The words of a text in lower case, with a typed placeholder for each name, number, and number with its unit.

    Capitalised words that start a sentence may be a name or not, so they stay, as one word behind START.
    """
    text = F.regexp_replace(text, FIRST, f" {START}$1{BETWEEN}$2{BETWEEN}$3 ")
    text = F.regexp_replace(text, NAME, f" {NAME_SLOT} ")
    text = F.regexp_replace(text, WITH_UNIT, f" {UNIT_SLOT} ")
    text = F.regexp_replace(text, DIGITS, f" {NUMBER_SLOT} ")
    return F.array_remove(F.split(F.lower(text), rf"[^\p{{L}}\p{{M}}\u0001{START}{BETWEEN}]+"), "")


def slots(text: Column) -> Column:
    """The values of template()'s placeholders and of its words behind START, in lower case, in their order."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"{FIRST}|{NAME}|{WITH_UNIT}|{DIGITS}"), F.lit(0)), lambda v: F.lower(v))


def is_slot(word: Column) -> Column:
    return F.startswith(word, F.lit("\u0001"))


def is_start(word: Column) -> Column:
    return F.startswith(word, F.lit(START))


def read(word: Column) -> Column:
    """A word as it is matched if what starts a sentence is no name."""
    return F.when(is_start(word), F.translate(word, START + BETWEEN, "")).otherwise(word)


def named(word: Column) -> Column:
    """A word as it is matched if what starts a sentence is a name."""
    return F.when(is_start(word), F.lit(NAME_SLOT)).otherwise(word)


def windows(words: str, size: int) -> Column:
    """The hash of each run of so many words of a column."""
    at = F.sequence(F.lit(1), F.size(words) - (size - 1))
    return F.when(F.size(words) >= size, F.transform(at, lambda i: F.xxhash64(F.slice(words, i, size)))).otherwise(F.array().cast("array<long>"))


def with_windows(texts: DataFrame, size: int) -> DataFrame:
    """(at, h) of each window of words, as it reads, and as it reads with names at the starts of sentences if that differs."""
    pair = F.zip_with(windows("one", size), windows("two", size), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = texts.select("doc_id", "text_key", F.posexplode(pair).alias("at", "p"))
    return rows.select("doc_id", "text_key", "at", F.explode(F.when(F.col("p.a") == F.col("p.b"), F.array("p.a")).otherwise(F.array("p.a", "p.b"))).alias("h"))


def with_words(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, one, two): the words in both readings. A generator's column is computed once, however often it is read."""
    key = [F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key")]
    rows = docs.filter("text IS NOT NULL").select(*key, F.explode(F.array(template(F.col("text")))).alias("words"))
    return rows.select("doc_id", "text_key", F.inline(F.array(F.struct(F.transform("words", read).alias("one"), F.transform("words", named).alias("two")))))


def plain(text: Column) -> Column:
    """The text's letters and digits in lower case, one space between words and at both ends."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " ")), F.lit(" "))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def value_hash(values: Column) -> Column:
    """The hash of a run of values, told apart from words'."""
    return F.xxhash64(F.transform(values, lambda v: F.concat(F.lit(f"{START} "), v)))


def value_windows(values: str, size: int) -> Column:
    at = F.sequence(F.lit(1), F.size(values) - (size - 1))
    return F.when(F.size(values) >= size, F.transform(at, lambda i: value_hash(F.slice(values, i, size))))


def questions(benchmark: DataFrame, window: int) -> DataFrame:
    """Items with what is asked for them: (item_id, variant, words, values, plain, size, value_size, pure, asked, blank).

    Variant 0 is the item's template. An item with names has variant 1 too, its text in lower case, for copies that
    have lost their capitals. asked and blank hold (pos, h) of windows: blank ones, of placeholders alone, occur
    wherever there are numbers, so no document is looked for by them. If they are most of an item's (pure), it is asked
    for by its values instead, at negative places.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("text IS NOT NULL").distinct()
    has_names = F.size(F.regexp_extract_all("text", F.lit(f"{FIRST}|{NAME}"), F.lit(0))) > 0
    items = items.select("item_id", "text", F.explode(F.when(has_names, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("variant"))
    cased = F.when(F.col("variant") == 0, F.col("text")).otherwise(F.lower("text"))
    items = saved(items.select("item_id", "variant", template(cased).alias("words"), slots(cased).alias("values"), plain(F.col("text")).alias("plain")).filter("size(words) > 0"))
    items = items.withColumns({"size": F.least(F.size("words"), F.lit(window)), "value_size": F.least(F.size("values"), F.lit(window))})
    at = F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)
    cut = F.transform(at, lambda i: F.struct((i - 1).alias("pos"), F.slice("words", i, F.col("size")).alias("w")))
    tells = lambda x: F.exists(x["w"], lambda w: ~is_slot(w))
    items = saved(items.withColumns({"telling": F.filter(cut, tells), "blank": F.filter(cut, lambda x: ~tells(x))}))
    hashes = lambda x, form: F.struct(x["pos"].alias("pos"), F.xxhash64(F.transform(x["w"], form)).alias("h"))
    amid = F.filter("telling", lambda x: F.exists(x["w"], is_start) & F.exists(x["w"], lambda w: ~is_slot(w) & ~is_start(w)))
    runs = F.transform(F.sequence(F.lit(1), F.size("values") - F.col("value_size") + 1), lambda i: F.struct((-i).alias("pos"), value_hash(F.slice("values", i, F.col("value_size"))).alias("h")))
    none = F.array().cast("array<struct<pos:int,h:long>>")
    pure = F.size("telling") < F.size("blank")
    asked = [F.transform("telling", lambda x: hashes(x, read)), F.when(F.size("words") >= 3, F.transform(amid, lambda x: hashes(x, named))).otherwise(none), F.when(pure, runs).otherwise(none)]
    blank = F.when(pure, none).otherwise(F.transform("blank", lambda x: hashes(x, read)))
    return items.select("item_id", "variant", "words", "values", "plain", "size", "value_size", pure.alias("pure"), F.array_distinct(F.concat(*asked)).alias("asked"), blank.alias("blank"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, coverage, text_key) for each document that holds an item of the benchmark.

    A document holds an item if it has at least `similarity` of the item's windows, anywhere (see questions()), and if
    the values in the slots agree: each value of the item stands for one value in the document throughout, so a
    question with other numbers and names is caught, and a passage that shares a shape alone is not; an item that is
    there word for word, values too, is always held. What starts a sentence with a capital matches both as a word and
    as a name (but for items of one or two words, of which too little would be left). An item of fewer words than a
    window is one window of all its words; an item without words is never held, one of values alone where these stand
    in a row. Null and empty texts hold nothing; very long ones are read whole; rows equal in doc_id and text give one
    row, rows of one doc_id (or none) and different texts are documents apart, told by text_key; equal items give one
    each; an empty table on either side gives none; further columns, whatever their names, are not looked at.
    """
    items = saved(questions(benchmark, window))
    # Fewer numbers than a window has words.
    about = items.agg(F.collect_set("size").alias("sizes"), F.collect_set(F.when(F.col("pure") & (F.col("value_size") > 0), F.col("value_size"))).alias("value_sizes"), F.bool_or(F.size("blank") > 0).alias("blank"), F.bool_or(F.size("values") > 0).alias("values"), F.sum(F.size("asked")).alias("asked")).first()
    asked = items.select("item_id", "variant", F.inline("asked"))
    total = items.select("item_id", "variant", (F.size(F.array_distinct(F.transform("asked", lambda x: x["pos"]))) + F.size("blank")).cast("long").alias("n_windows"), F.size("blank").alias("n_blank"))
    total = total.groupBy("item_id", "variant").agg(F.sum("n_windows").alias("n_windows"), F.sum("n_blank").alias("n_blank"))
    small = (about.asked or 0) <= most
    if small:
        asked, total = F.broadcast(asked), F.broadcast(total)
    texts, found = with_words(docs), None
    for n in sorted({window, *about.sizes}):
        one = with_windows(texts, n)
        found = one if found is None else found.unionByName(one)
    for n in sorted(about.value_sizes):
        numbers = docs.filter(F.col("text").rlike(r"\d")).select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.explode(F.array(slots(F.col("text")))).alias("v"))
        found = found.unionByName(numbers.select("doc_id", "text_key", F.posexplode(value_windows("v", n)).alias("at", "h")))
    document = F.struct("doc_id", "text_key").alias("d")  # equal where doc_ids are null, too
    met = saved(found.join(asked, "h").select(document, "item_id", "variant", "pos", "at"))
    one_of = ["d", "item_id", "variant"]
    count = lambda rows: rows.select(*one_of, "pos").distinct().groupBy(*one_of).agg(F.count("*").alias("n_found"))
    pairs = count(met).join(total, ["item_id", "variant"]).filter(F.col("n_found") + F.col("n_blank") >= F.col("n_windows") * similarity)
    if about.blank:
        # Blank windows are looked for where the others leave it open, in those documents and for those items alone.
        pairs = saved(pairs)
        left = pairs.filter("n_blank > 0")
        there = with_windows(with_words(docs.withColumn("d", F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"))).join(left.select("d").distinct(), "d", "left_semi")), window)
        blank = left.select(*one_of).join(items.select("item_id", "variant", F.inline("blank")), ["item_id", "variant"])
        more = blank.join(there.select(document, "at", "h"), ["d", "h"]).select(*one_of, "pos", "at")
        met = saved(met.unionByName(more))
        pairs = count(met).join(pairs.drop("n_found"), one_of)
    pairs = pairs.withColumn("coverage", F.col("n_found") / F.col("n_windows")).filter(F.col("coverage") >= similarity)
    if about["values"]:
        pairs = saved(pairs)
        wrong = unlike(docs, met, pairs.join(items.filter("size(values) > 0").select("item_id", "variant", "words", "values", "plain"), ["item_id", "variant"]), window)
        pairs = pairs.join(wrong, one_of, "left_anti")
    best = pairs.groupBy("d", "item_id").agg(F.max_by(F.struct("n_windows", "n_found", "coverage"), F.struct("coverage", -F.col("variant"))).alias("m"))
    return best.select("d.doc_id", "item_id", "m.n_windows", "m.n_found", "m.coverage", "d.text_key")


def unlike(docs: DataFrame, met: DataFrame, pairs: DataFrame, window: int) -> DataFrame:
    """(d, item_id, variant) of the pairs in which one value of the item stands for several in the document.

    Each window of the item is looked at in one place: of those near the best shift, the one in the longest run of
    windows that keep their distance, so that equal windows side by side are not mistaken for each other. What starts a
    sentence is only a value if the item has it as a name elsewhere.
    """
    one_of = ["d", "item_id", "variant"]
    here = met.filter("pos >= 0").join(pairs.select(*one_of), one_of, "left_semi").distinct().withColumn("shift", F.col("at") - F.col("pos"))
    shift = here.groupBy(*one_of, "shift").agg(F.countDistinct("pos").alias("n"))
    best = shift.groupBy(*one_of).agg(F.max_by("shift", F.struct("n", -F.col("shift"))).alias("best"))
    texts = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key")).alias("d"), "text").join(pairs.select("d").distinct(), "d", "left_semi")
    texts = texts.dropDuplicates(["d"]).select("d", template(F.col("text")).alias("own"), slots(F.col("text")).alias("own_values"), plain(F.col("text")).alias("own_plain"))
    both = here.join(best, one_of).filter(F.abs(F.col("shift") - F.col("best")) <= DRIFT)
    run = Window.partitionBy(*one_of, "shift")
    both = both.withColumn("run", F.col("pos") - F.row_number().over(run.orderBy("pos")))
    both = both.withColumn("n", F.count("*").over(Window.partitionBy(*one_of, "shift", "run")))
    one = F.struct("n", -F.abs(F.col("shift") - F.col("best")), -F.col("shift"))
    both = both.groupBy(*one_of, "pos").agg(F.max_by("at", one).alias("at"))
    both = both.join(pairs.select(*one_of, "words", "values", "plain"), one_of).join(texts, "d")
    both = both.filter(~F.contains("own_plain", "plain"))
    both = both.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(window), F.size("words") - F.col("pos")))))
    i, j = F.col("pos") + F.col("k"), F.col("at") + F.col("k")
    valued = lambda w: is_slot(w) | is_start(w)
    mine, other = F.get("words", i - 1), F.get("own", j - 1)
    both = both.filter(valued(mine) & valued(other))
    nth = lambda words, upto: F.size(F.filter(F.slice(words, F.lit(1), upto), valued)) - 1
    kind = F.when(is_start(mine), F.lit(NAME_SLOT)).otherwise(mine)
    values = both.select(*one_of, kind.alias("kind"), is_slot(mine).alias("sure"), F.get("values", nth(F.col("words"), i)).alias("value"), F.get("own_values", nth(F.col("own"), j)).alias("other"))
    values = values.groupBy(*one_of, "kind", "value").agg(F.countDistinct("other").alias("n"), F.bool_or("sure").alias("sure"))
    return values.filter("n > 1 AND sure").select(*one_of).distinct()
