import struct
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from reelproof.llm import sharding


def test_contract(spark):
    texts = [None, "", "ä b", "same", "same"] + [f"t{i}" for i in range(3000)]
    rows = [(i * 7, t, i, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot string")
    got = sharding.shards(df, 16).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        data = (t or "").encode()
        assert (by[i].size, by[i].text_crc32, by[i].law) == (len(data) + 1, zlib.crc32(data), "key")
        assert by[i].grown_shard in (by[i].shard, 16)
    for shard, n in Counter(r.shard for r in got).items():
        assert 0 <= shard < 16 and sorted(r.slot for r in got if r.shard == shard) == list(range(n))
        assert 120 < n < 260
    moved = sum(r.grown_shard == 16 for r in got)
    assert 120 < moved < 240


def test_every_growth_moves_only_into_the_new_shard(spark):
    df = spark.range(2000).select(F.col("id"), *[sharding.jump(F.col("id"), n).alias(f"s{n}") for n in range(1, 9)])
    for r in df.collect():
        assert r.s1 == 0
        for n in range(2, 9):
            assert r[f"s{n}"] in (r[f"s{n - 1}"], n - 1)


def test_many_parts_ties_nulls_and_empty(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 5)
    df = spark.createDataFrame([(i % 40, "a") for i in range(400)] + [(None, None)] * 3, "doc_id long, text string")
    got = sharding.shards(df, 4).collect()
    assert len(got) == 403
    for shard, n in Counter(r.shard for r in got).items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    assert sharding.shards(df.limit(0), 4).count() == 0


def jumped(key, shards):
    """The law in plain numbers: from shard b the key jumps on to floor((b + 1) / u), u its next number in (0, 1]."""
    at, to = -1, 0
    while to < shards:
        at = to
        seed = xxhash.xxh64_intdigest(struct.pack("<q", key), 42) if key is not None else 42
        u = ((xxhash.xxh64_intdigest(struct.pack("<q", at), seed) >> 33) + 1) / 2**31
        to = int((at + 1) / u)
    return at


def test_against_a_second_jump_hash(spark):
    keys = [None, 0, 1, -1, 7, 2**62, -(2**63), *range(100, 1300, 3)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump(F.col("k"), 16).alias("a"), sharding.jump(F.col("k"), 97).alias("b"))
    assert {r.k: (r.a, r.b) for r in df.collect()} == {k: (jumped(k, 16), jumped(k, 97)) for k in keys}


def test_repeated_rows_in_bulk(spark):
    """A third of all rows are one row: each has a slot of its own in the one shard that the key has."""
    df = spark.createDataFrame([(i, "a") for i in range(2000)], "doc_id long, text string").unionByName(spark.range(1000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("b").alias("text")))
    got = sharding.shards(df).collect()
    assert len({r.shard for r in got if r.doc_id == 5}) == 1 and len(got) == 3000
    for shard, n in Counter(r.shard for r in got).items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
