import zlib
from collections import defaultdict

import duckdb
import numpy as np
from test_line_dedup import brute as brute_lines
from test_near_copies import brute as brute_copies

import corpus_pipeline
from reelproof.llm import quality

SF = "/root/testdata/sf0.001"


def brute(docs, labels, items):
    x = np.array([quality.statistics((t or "").encode()) for t in docs.values()], np.float32).astype(np.float64)
    learn = [(i, q) for i, q in labels if i in docs and zlib.crc32(str(i).encode()) % 3 != 1]
    rows = {i: k for k, i in enumerate(docs)}
    model = quality.train(x[[rows[i] for i, _ in learn]], np.array([float(q) for _, q in learn]))
    docs = {i: t for (i, t), s in zip(docs.items(), model.score(x), strict=True) if s >= 0.5}
    docs = brute_lines(docs)
    best, _ = brute_copies(list(docs.items()))
    docs = {i: t for i, t in docs.items() if (False, i) in best.values()}
    def grams(t):
        words = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    asked = [grams(t) for t in items]
    return {i: t for i, t in docs.items() if not any(len(own & g) >= 0.8 * len(g) for own in [grams(t)] for g in asked)}


def test_stages_match_brute_force(spark):
    read = lambda t, c: duckdb.sql(f"SELECT {c} FROM '{SF}/{t}.parquet' ORDER BY 1").fetchall()
    docs = dict(read("documents", "doc_id, text"))
    want = brute(docs, read("labels", "doc_id, quality"), [t for (t,) in read("benchmark", "text")])
    df, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = columns or df.columns
        df = corpus_pipeline.saved(stage(spark, df, SF))
        assert df.columns == columns
    assert {r.doc_id: r.text for r in df.collect()} == want
    assert 20 < len(want) < len(docs)
    spans = defaultdict(int)
    for r in corpus_pipeline.STAGES[-1][1](spark, df, SF).collect():
        spans[r.doc_id] += r.n_tokens
    assert spans == {i: len((t or "").split()) + 1 for i, t in want.items()}


def test_empty_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.saved(stage(spark, df, SF))
    assert df.count() == 0


def test_odd_rows(spark, monkeypatch):
    """Nulls, empty and very long texts, ties, repeated rows, shared and missing ids, clashing names: each stage keeps every document that it should."""
    good = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 500").orderBy("doc_id").limit(4).collect()
    words = [w for r in good for w in r.text.split()]
    texts = [" ".join(words[k * 97 : k * 97 + 80]) for k in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (7, None), (8, ""), (9, " ".join(f"{w}{i}" for i, w in enumerate(words * 40))), (10, texts[4]), (10, texts[4] + " " + texts[5])]
    df = spark.createDataFrame([(i, t, None, None, len(t or ""), 3, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, item_id int, h string")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        df = corpus_pipeline.saved(stage(spark, df, SF))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "item_id", "h"]
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())
    assert ids == [(False, 1), (False, 1), (False, 7), (False, 9), (False, 10), (False, 10), (True, 0), (True, 0)]
    assert sum(r.n_tokens for r in corpus_pipeline.packed(spark, df, SF).collect()) == sum(len((r.text or "").split()) + 1 for r in df.collect())
