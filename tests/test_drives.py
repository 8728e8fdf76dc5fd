"""Files on disk: inventories, byte ranges, and archive drives checked again from what lies on them."""

import random

import xxhash
from pyspark.sql import functions as F

from reelproof.operators import account
from reelproof.plans import drives
from reelproof.sources import files, ranges


def put(root, rel, data):
    path = root / rel
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return path


def test_inventory_of_awkward_folders(spark, tmp_path):
    """A folder whose name occurs twice in its path, one with brackets and a plus in its name, and litter."""
    for root in (tmp_path / "card" / "b" / "card", tmp_path / "card (1) [x] a+b {c}"):
        put(root, "DCIM/x.ARW", b"abc")
        put(root, "DCIM/ä b#1%.txt", b"")
        put(root, "$RECYCLE.BIN/sub/y.ARW", b"gone")
        put(root, "DCIM/.DS_Store", b"litter")
        put(root, "card/b/card/z", b"z")
        got = {r.rel: (r.size, r.skipped) for r in files.inventory(spark, str(root), litter=True).collect()}
        want = {"DCIM/x.ARW": (3, False), "DCIM/ä b#1%.txt": (0, False), "card/b/card/z": (1, False)}
        assert got == want | {"DCIM/.DS_Store": (6, True)}
        assert {r.rel for r in files.inventory(spark, str(root) + "/").collect()} == set(want)
    assert files.destination(spark, str(tmp_path / "none")).count() == 0


def test_walking_in_rounds(spark, tmp_path):
    for k in range(30):
        put(tmp_path, "/".join([*(f"d{j}" for j in range(k % 6)), f"s{k}/f{k}"]), b"x" * k)
    (tmp_path / "loop").symlink_to(tmp_path)
    got = {r.rel: r.size for r in ranges.walked(spark, str(tmp_path), folders=4).collect()}
    assert len(got) == 30 and all(size == int(rel.rsplit("f")[-1]) for rel, size in got.items())


def test_byte_ranges(spark, tmp_path):
    """Files over the limit of a value are read, digested and compared by ranges; the limit here is a range of 1,000 bytes."""
    rng = random.Random(4)
    data = {"a.mov": rng.randbytes(25_300), "sub/b (2).mov": rng.randbytes(999), "c.mov": b"", "d.mov": rng.randbytes(2000)}
    for rel, x in data.items():
        put(tmp_path / "one", rel, x)
    listing = files.inventory(spark, str(tmp_path / "one"))
    got = {r.rel: (r.bytes, r.hash) for r in listing.select("path", "rel").join(ranges.digests(listing), "path").collect()}
    assert got == {rel: (len(x), xxhash.xxh64_hexdigest(x)) for rel, x in data.items()}

    rows = ranges.registered(spark).read.format("byte_ranges").option("range", 1000).option("partition", 3).load(str(tmp_path / "one"))
    parts = sorted((r.path, r.no, r.offset, bytes(r.content)) for r in rows.collect())
    assert max(len(p[3]) for p in parts) == 1000 and rows.rdd.getNumPartitions() == 12
    for rel, x in data.items():
        own = [p for p in parts if p[0].endswith("/" + rel)]
        assert b"".join(p[3] for p in own) == x and [p[2] for p in own] == [1000 * k for k in range(len(own))]

    each = {(r.rel, r.no): (r.length, r.hash) for r in ranges.range_digests(ranges.cut(listing, 1000), ["rel"]).collect()}
    assert each == {(rel, k): (len(x[k * 1000 : k * 1000 + 1000]), xxhash.xxh64_hexdigest(x[k * 1000 : k * 1000 + 1000])) for rel, x in data.items() for k in range(max(1, -(-len(x) // 1000)))}
    gone = spark.createDataFrame([(str(tmp_path / "not-there"),)], "path string")
    assert [tuple(r)[1:] for r in ranges.digests(gone).collect()] == [(None, None)]


def test_differences_between_files(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    a = bytearray(rng.randbytes(30_000))
    b = bytearray(a)
    for at, n in ((0, 3), (999, 2), (5000, 1), (8190, 4), (29_998, 2)):
        for k in range(at, at + n):
            b[k] ^= 255
    one, other = put(tmp_path, "a", bytes(a)), put(tmp_path, "b", bytes(b))
    cuts = ranges.cut(spark.createDataFrame([("k", str(one), str(other), 30_000)], "key string, a string, b string, size long"), 10_000).withColumn("budget", F.lit(10))
    got = sorted((r.key, r.start, r.length) for r in ranges.diff_runs(cuts, ["key"]).collect())
    assert got == [("k", 0, 3), ("k", 999, 2), ("k", 5000, 1), ("k", 8190, 4), ("k", 29_998, 2)]
    less = ranges.diff_runs(cuts.withColumn("budget", F.lit(3)), ["key"]).collect()
    assert sorted((r.start, r.length) for r in less if r.start is not None) == [(29_998, 2)] and [r.length for r in less if r.start is None] == [10]


def twins(spark, tmp_path, cases):
    """Files of twins and their tables: 16 bytes of structure, then chunks of 20 bytes: 6 of metadata, 2 free, 10 of essence, 2 free."""
    pairs, structures, kinds, chunks, spans, sizes = [], [], [], [], [], []
    for name, (a, b, c) in cases.items():
        put(tmp_path, f"a/{name}", a), put(tmp_path, f"b/{name}", b)
        pairs.append((name, str(tmp_path / "a" / name), str(tmp_path / "b" / name), len(a), len(b), name.split(".")[-1]))
        if c.get("structure", True):
            structures += [(name, side, 0, 16, xxhash.xxh64_hexdigest(c.get("stale") or x[:16])) for side, x in (("a", a), ("b", b))]
        n = c.get("chunks", (len(a) - 16) // 20)
        kinds += [(name, 1, "meta"), (name, 2, "essence")] if c.get("essence", True) else [(name, 1, "meta")]
        chunks += [(name, t, k + 1, 16 + 20 * k + (8 - c.get("shift", 0)) * (t - 1)) for t in ((1, 2) if c.get("essence", True) else (1,)) for k in range(n)]
        spans += [(name, 1, 1, 2), (name, 2, 1, 1)]
        sizes += [(name, t, k + 1, 3 if t == 1 else 10) for t in (1, 2) for k in range(n * (2 if t == 1 else 1))]
    make = spark.createDataFrame
    return (
        make(pairs, "rel string, a string, b string, size_a long, size_b long, ext string"), make(structures, "rel string, side string, start long, stop long, hash string"), make(kinds, "rel string, track int, kind string"),
        make(chunks, "rel string, track int, chunk_no int, offset long"), make(spans, "rel string, track int, first_chunk int, samples_per_chunk int"), make(sizes, "rel string, track int, sample_no int, size long"),
    )


def test_twins_accounted_for(spark, tmp_path, monkeypatch):
    base = bytes(random.Random(6).randbytes(16 + 20 * 40))

    def changed(*at, of=base):
        out = bytearray(of)
        for k in at:
            out[k] ^= 1
        return bytes(out)

    meta, essence, free = [16 + 20 * k for k in range(40)], [16 + 20 * k + 9 for k in range(40)], 16 + 7
    cases = {
        "meta.mp4": (base, changed(*meta[:5], free), {}), "same.mp4": (base, base, {}), "essence.mp4": (base, changed(meta[3], *essence[:2]), {}), "much.mp4": (base, changed(*meta[:17]), {}),
        "just.mp4": (base, changed(*meta[:16]), {}), "long.mp4": (base, base + b"x", {}), "photo.arw": (base, changed(meta[0]), {}), "moov.mp4": (base, changed(3), {}), "bare.mp4": (base, changed(meta[0]), {"structure": False}),
        "stale.mp4": (base, changed(meta[0]), {"stale": b"other"}), "few.mp4": (base[:216], changed(meta[0], of=base[:216]), {}), "mute.mp4": (base, changed(meta[0]), {"essence": False}), "cross.mp4": (base, changed(meta[0]), {"shift": 4}),
    }
    facts = account.facts(*twins(spark, tmp_path, cases), size=64)
    got = {r.rel: (r.state, r.differing, r.essence_overlap) for r in account.ladder(facts).collect()}
    assert got == {
        "meta.mp4": ("Accounted", 6, 0), "same.mp4": ("Accounted", 0, 0), "essence.mp4": ("EssenceDiffers", 3, 2), "much.mp4": ("TooMuchDiffers", None, None), "just.mp4": ("Accounted", 16, 0), "long.mp4": ("LengthMismatch", None, None),
        "photo.arw": ("NotPinnedContainer", None, None), "moov.mp4": ("MoovDiffers", None, None), "bare.mp4": ("Unparsable", None, None), "stale.mp4": ("MoovNotStable", 1, 0), "few.mp4": ("TooFewSamples", None, None),
        "mute.mp4": ("Unparsable", None, None), "cross.mp4": ("Unparsable", None, None),
    }


def mhl(entries, head=True):
    begun = "<creatorinfo><name>n</name><startdate>2026-01-01T10:00:00Z</startdate></creatorinfo>" if head else ""
    return ('<hashlist version="1.1">' + begun + "".join(entries) + "</hashlist>").encode()


def entry(rel, data):
    return f"<hash><file>{rel}</file><size>{len(data)}</size><xxhash64be>{xxhash.xxh64_hexdigest(data)}</xxhash64be></hash>"


def asc(rel, data):
    return f'<hash><path size="{len(data)}">{rel}</path><xxh64 action="original">{xxhash.xxh64_hexdigest(data)}</xxh64></hash>'


def test_drives_from_their_files(spark, tmp_path):
    root = tmp_path / "archive (2026)"
    x, y = b"first clip" * 500, b"second"
    put(root, "d1/2026-01-01_good/A/x.mov", x)
    put(root, "d1/2026-01-01_good/y.mov", y)
    put(root, "d1/2026-01-01_good/custody_1.mhl", mhl([entry("A/x.mov", x), entry("./y.mov", y)]))
    put(root, "d1/2026-01-01_good/Thumbs.db", b"litter")
    put(root, "d1/2026-01-02_asc/y.mov", y)
    put(root, "d1/2026-01-02_asc/ascmhl/0001_x.mhl", mhl([asc("y.mov", y)]))
    put(root, "d1/2026-01-02_asc/ascmhl/ascmhl_chain.xml", b"<x/>")
    put(root, "d1/2026-01-03_flip/x.mov", x[:-1] + b"!")
    put(root, "d1/2026-01-03_flip/custody_1.mhl", mhl([entry("x.mov", x)]))
    put(root, "d1/2026-01-04_lost/other", y)
    put(root, "d1/2026-01-04_lost/custody_1.mhl", mhl([entry("x.mov", x)]))
    put(root, "d1/2026-01-05_none/x.mov", x)
    put(root, "d2/2026-01-01_good/x.mov", x)
    put(root, "d2/2026-01-01_good/z.mov", x)
    put(root, "d2/2026-01-01_good/custody_1.mhl", mhl([entry("x.mov", x)]))
    put(root, "d2/2026-01-01_good/custody_2.mhl", mhl([entry("x.mov", x)]))
    put(root, "d2/2026-01-02_bad/x.mov", x)
    put(root, "d2/2026-01-02_bad/custody_1.mhl", mhl([entry("x.mov", x), "<hash><file>q</file></hash>"]))
    put(root, "d2/2026-01-03_empty/custody_1.mhl", mhl([]))
    put(root, "d2/2026-01-04_torn/custody_1.mhl", b"")
    put(root, "d2/holiday/x.mov", x)
    states, outcomes = drives.recheck_drives(spark, str(root))
    got = {(r.session_id, r.folder[11:] or r.folder): (r.state, r.clean, r.matched, r.bad, r.residual) for r in states.collect()}
    assert got == {
        ("d1", "good"): ("INTACT", True, 2, 0, 0), ("d1", "asc"): ("INTACT", True, 1, 0, 0), ("d1", "flip"): ("DAMAGED", False, 0, 1, 0), ("d1", "lost"): ("DAMAGED", False, 0, 1, 1),
        ("d1", "none"): ("NO MANIFEST", False, 0, 0, 1), ("d2", "good"): ("INTACT", False, 2, 0, 1), ("d2", "bad"): ("UNREADABLE", False, 0, 0, 1), ("d2", "empty"): ("EMPTY MANIFEST", False, 0, 0, 0), ("d2", "torn"): ("UNREADABLE", False, 0, 0, 0),
    }
    told = {(r.folder[11:], r.rel): r.outcome for r in outcomes.filter("session_id = 'd1'").collect()}
    assert told == {("good", "A/x.mov"): "Matched", ("good", "y.mov"): "Matched", ("asc", "y.mov"): "Matched", ("flip", "x.mov"): "Changed", ("lost", "x.mov"): "Missing"}


def test_files_that_no_manifest_lists_are_not_read(spark, tmp_path):
    x = b"clip"
    put(tmp_path, "d/2026-01-01_a/x.mov", x)
    put(tmp_path, "d/2026-01-01_a/unlisted.mov", x)
    put(tmp_path, "d/2026-01-01_a/custody_1.mhl", mhl([entry("x.mov", x)]))
    listing = drives.listed(spark, str(tmp_path))
    good = drives.entries(spark, str(tmp_path), listing)
    got = {r.rel: r.hash for r in drives.digested(listing, good).collect()}
    assert got == {"x.mov": xxhash.xxh64_hexdigest(x), "unlisted.mov": None, "custody_1.mhl": None}


def test_writing_named_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i % 3}/n {i % 5}.bin", i, bytes([i]) * i) for i in range(40)], "rel string, part int, value binary")
    sizes = {r.rel: r.size for r in ranges.written(rows, str(tmp_path / "out")).collect()}
    for rel, size in sizes.items():
        want = b"".join(bytes([i]) * i for i in range(40) if f"f{i % 3}/n {i % 5}.bin" == rel)
        assert (tmp_path / "out" / rel).read_bytes() == want and size == len(want)
    assert len(sizes) == 15 and ranges.written(rows.filter(F.lit(False)), str(tmp_path / "none")).count() == 0
