"""The rules that the catalog's data does not exercise in full: exhaustive tuples, scenarios, digests, round trips."""

import itertools

import pytest
import xxhash
from pyspark.sql import functions as F

from reelproof.functions import formats, paths
from reelproof.operators import devices, diagnose, digest, history, manifests, recheck, reconcile, telemetry, verdict
from reelproof.sources import files


def diagnosis(sc, c1, c2, a, b, c):
    """The rules as plain tests over one tuple."""
    dests = [x for x in (a, b, c) if x is not None]
    if c1 is not None and c2 is not None and c1 != c2:
        return "TwinMismatch"
    card = c1 if c1 is not None else c2
    if card is None or not dests:
        return "Unclassified"
    off = [x for x in dests if x != card]
    if sc is None or sc == card:
        if not off:
            return "Clean"
        return "Systematic" if len(dests) >= 2 and len(off) == len(dests) and len(set(dests)) == 1 else "BadDestination"
    if not off:
        return "UnrepeatableSourceRead"
    return "SourceReadCorrupt" if all(x == sc for x in dests) else "Unclassified"


def test_all_4096_tuples(spark):
    tuples = list(itertools.product((None, "good", "bad", "other"), repeat=6))
    df = spark.createDataFrame([(i, "f", *t) for i, t in enumerate(tuples)], "session_id long, rel string, sc string, c1 string, c2 string, a string, b string, c string")
    got = {r.session_id: r for r in diagnose.diagnose(df).collect()}
    for i, t in enumerate(tuples):
        assert got[i].kind == diagnosis(*t), t
        if got[i].kind == "Clean":
            assert len({x for x in t[1:] if x is not None}) == 1
        _, c1, c2, *_ = t
        witnesses = [x for x in (t[3], t[4], t[5], t[0]) if x is not None]
        if got[i].kind == "TwinMismatch":
            one, two = witnesses.count(c1), witnesses.count(c2)
            assert got[i].suspect == ("C2" if one > two else "C1" if two > one else None)


BASE = {"session_id": 1, "had_card2": True, "aborted": None, "manifests_written": True, "card_mode": "Backup", "conflicts": 0, "untwinned": 0, "files": 2, "twin_matched": True, "dests": "Distinct", "cards": "Distinct", "dest_on_card": False, "failures": 0, "scan_errors": 0, "most_retries": 0, "dest_count": 2, "sure_dests": 2, "cached_dests": 0, "network_dests": 0}
SCHEMA = "session_id long, had_card2 boolean, aborted string, manifests_written boolean, card_mode string, conflicts long, untwinned long, files long, twin_matched boolean, dests string, cards string, dest_on_card boolean, failures long, scan_errors long, most_retries long, dest_count long, sure_dests long, cached_dests long, network_dests long"


@pytest.mark.parametrize(
    "change,want",
    [
        ({}, "SAFE_TO_FORMAT"), ({"dests": "SameDevice"}, "VERIFIED_DO_NOT_FORMAT"), ({"failures": 1}, "FAILED"), ({"conflicts": 1, "twin_matched": False}, "FAILED"), ({"aborted": "x"}, "FAILED"),
        ({"had_card2": False, "twin_matched": False, "card_mode": None, "cards": None}, "VERIFIED_ONE_SOURCE"), ({"dest_count": 1, "sure_dests": 1, "dests": "Unproven"}, "VERIFIED_ONE_COPY"), ({"files": 0}, "VERIFIED_DO_NOT_FORMAT"),
        ({"most_retries": 5}, "SAFE_TO_FORMAT"), ({"most_retries": 6}, "VERIFIED_DO_NOT_FORMAT"), ({"manifests_written": False}, "FAILED"), ({"network_dests": 1, "sure_dests": 1}, "VERIFIED_DO_NOT_FORMAT"), ({"network_dests": 1, "sure_dests": 2, "dest_count": 3}, "SAFE_TO_FORMAT"),
        ({"cached_dests": 1, "sure_dests": 1}, "VERIFIED_DO_NOT_FORMAT"), ({"cached_dests": 1, "sure_dests": 2, "dest_count": 3}, "SAFE_TO_FORMAT"), ({"cards": "SameDevice"}, "VERIFIED_DO_NOT_FORMAT"), ({"scan_errors": 1}, "VERIFIED_DO_NOT_FORMAT"), ({"dest_on_card": True}, "VERIFIED_DO_NOT_FORMAT"), ({"dests": "Unproven"}, "VERIFIED_DO_NOT_FORMAT"), ({"untwinned": 1, "twin_matched": False, "card_mode": "Mixed"}, "VERIFIED_ONE_SOURCE"),
    ],
)
def test_verdicts(spark, change, want):
    row = {**BASE, **change}
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in SCHEMA.split(", "))], SCHEMA)
    assert verdict.ladder(df).first().verdict == want


def test_evidence(spark):
    rows = [(1, "A", "device"), (1, "A", "cache"), (1, "B", "device"), (2, "A", None)]
    got = {(r.session_id, r.slot): (r.from_device, r.cached) for r in diagnose.evidence(spark.createDataFrame(rows, "session_id long, slot string, read_mode string")).collect()}
    assert got == {(1, "A"): (False, 1), (1, "B"): (True, 0), (2, "A"): (False, 1)}


def test_trail_with_ties(spark):
    rows = [("session", 1, 7), ("format", 1, 7), ("format", 3, 7), ("session", 3, 7), ("format", 5, 7), ("session", 9, 7), ("session", 2, 8)]
    got = {(r.seq, r.serial): (r.formatted_after, r.formats_after) for r in history.trail(spark.createDataFrame(rows, "kind string, seq long, serial long")).collect()}
    assert got == {(1, 7): (3, 2), (3, 7): (5, 1), (9, 7): (None, 0), (2, 8): (None, 0)}


def test_places_over_ranges(spark):
    got = sorted((r.k, r.place) for r in telemetry.placed(spark.range(0, 500, 3).withColumnRenamed("id", "k"), "k").collect())
    assert got == [(k, i + 1) for i, k in enumerate(range(0, 500, 3))]


def test_renderings(spark):
    n = spark.createDataFrame([(999, 0.0), (1500, 12.4), (2_340_000, -1.0), (5_120_000_000_000, 1234.6)], "n long, r double")
    got = [(r[0], r[1], r[2]) for r in n.select(formats.fixed_bytes(F.col("n")), formats.human_bytes(F.col("n")), formats.mbps(F.col("r"))).collect()]
    assert got == [("    999 B ", "999 B", "          —"), ("   1.50 kB", "1.5 KB", "    12 MB/s"), ("   2.34 MB", "2.3 MB", "          —"), ("   5.12 TB", "5120.0 GB", "  1235 MB/s")]
    line = lambda *x: spark.range(1).select(formats.detail_line(*map(F.lit, x))).first()[0]
    assert line(12_345, 66_000_000_000, True, True, 0) == "12,345 files · 66.0 GB · twin-matched · 2 distinct volumes"
    assert line(2, 1_040_000_000, False, False, 3) == "2 files · 1.0 GB · 3 FAILED"


def test_only_one_verdict_authorises():
    assert [v[0] for v in verdict.VERDICTS if v[3]] == ["SAFE_TO_FORMAT"] and [v[2] for v in verdict.VERDICTS] == [0, 10, 11, 12, 20]


def test_card_modes(spark):
    files_of = lambda rows: spark.createDataFrame(rows, "session_id long, rel string, size long, mtime timestamp")
    c1 = files_of([(1, "a.ARW", 1, None), (2, "a.ARW", 1, None), (3, "a.ARW", 1, None), (4, "a.ARW", 1, None), (4, "b.ARW", 2, None)])
    c2 = files_of([(1, "a.ARW", 1, None), (2, "b.MP4", 1, None), (3, "b.ARW", 1, None), (4, "a.ARW", 1, None)])
    sessions = spark.createDataFrame([(i, i != 6) for i in range(1, 7)], "session_id long, had_card2 boolean")
    got = {r.session_id: r.card_mode for r in reconcile.summary(sessions, reconcile.reconcile(c1, c2)).collect()}
    assert got == {1: "Backup", 2: "SplitByType", 3: "Relay", 4: "Mixed", 5: "Backup", 6: None}


def test_distinctness(spark):
    schema = "session_id long, slot string, device_number int, guid string, serial long, label string, root string"
    rows = [(1, "A", 1, "g", 1), (1, "B", 1, "h", 2), (2, "A", 1, "g", 1), (2, "B", 2, "g", 1), (3, "A", None, "g", 1), (3, "B", 2, "g", 2), (4, "A", None, None, 1), (4, "B", None, None, 1), (5, "A", None, None, 1), (5, "B", None, None, None)]
    df = spark.createDataFrame([(*r, "L", "G:/" + r[1]) for r in rows], schema)
    got = {r.session_id: r.state for r in devices.pairs(df).collect()}
    assert got == {1: "SameDevice", 2: "Distinct", 3: "SameDevice", 4: "SameDevice", 5: "Unproven"}


def test_digest_vectors(spark):
    texts = ["", "a", "abc", "x" * 101, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", digest.xxh64(F.col("t").cast("binary")).alias("h"))
    for r in df.collect():
        assert r.h == (None if r.t is None else xxhash.xxh64_hexdigest(r.t.encode()))
    chunks = spark.createDataFrame([("p", 1, b"cd"), ("q", 0, b""), ("p", 0, b"ab"), ("p", 2, None)], "path string, chunk_no int, content binary")
    assert {(r.path, r.bytes, r.hash) for r in digest.chunk_digests(chunks).collect()} == {("p", 4, xxhash.xxh64_hexdigest(b"abcd")), ("q", 0, xxhash.xxh64_hexdigest(b""))}


def test_diff_runs_and_overlaps(spark):
    a = bytearray(100)
    b = bytearray(a)
    for i in (0, 1, 2, 15, 16, 17, 50):
        b[i] = 1
    df = spark.createDataFrame([(1, bytes(a), bytes(b)), (2, bytes(a), bytes(a)), (3, b"", b"")], "k long, a binary, b binary")
    runs = digest.diff_runs(digest.chunked(df, "k", "a", 16), digest.chunked(df, "k", "b", 16), "k", 16)
    assert sorted((r.start, r.length) for r in runs.collect()) == [(0, 3), (15, 1), (16, 2), (50, 1)]
    spans = spark.createDataFrame([(1, 2, 17), (1, 40, 60)], "k long, start long, stop long")
    assert digest.overlaps(runs, spans, "k", 8).first().bytes == 1 + 1 + 1 + 1


def test_masking(spark):
    rows = [(1, '<x umid="AB1"/>', '<x umid="ZZ9"/>'), (2, '<x xumid="AB1"/>', '<x xumid="ZZ9"/>'), (3, '<x umid="AB1">p</x>', '<x umid="AB1">q</x>'), (4, "a", "ab"), (5, "a", "a")]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    got = {r.k: r.state for r in digest.identifiers_only(df, "k", ("umid", "mediaId")).collect()}
    assert got == {1: "IdentifiersOnly", 2: "Unparsable", 3: "EssenceDiffers", 4: "LengthMismatch", 5: "Equal"}


def test_manifest_readers(spark, tmp_path):
    (tmp_path / "a.mhl").write_text('<hashlist version="1.1"><creatorinfo><name>n</name><tool>t</tool><startdate>2026-01-01T10:00:00+02:00</startdate></creatorinfo><hash><file>./a\\b.mov</file><size>3</size><lastmodificationdate>2026-01-01T00:00:00Z</lastmodificationdate><xxhash64be>AB</xxhash64be></hash><hash><file>../e</file><size>1</size><md5>x</md5></hash></hashlist>')
    (tmp_path / "b.mhl").write_text('<hashlist xmlns="urn:ASC:MHL:v2.0"><hashes><hash><path size="4">c.mov</path><xxh64 action="original">00000000000000ff</xxh64></hash></hashes></hashlist>')
    rows = sorted((r.rel, r.size, r.hash, r.other_hash) for r in files.manifest_entries(spark, f"{tmp_path}/*.mhl").collect())
    assert rows == [("../e", 1, None, "x"), ("a/b.mov", 3, "00000000000000ab", None), ("c.mov", 4, "00000000000000ff", None)]
    head = files.manifest_headers(spark, f"{tmp_path}/*.mhl").collect()
    assert [(r.name, r.tool, r.start.hour) for r in head] == [("n", "t", 8)]
    got = {r.name: r.hash for r in files.generations(spark, str(tmp_path)).collect()}
    assert got["a.mhl"] == xxhash.xxh64_hexdigest((tmp_path / "a.mhl").read_bytes())


def test_truncated_history(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"kind":"session","session":"a"}\n{"kind":"format","note":"x"}\n{"kind":"sess')
    assert sorted(r.kind for r in files.json_rows(spark, str(tmp_path), files.HISTORY).collect()) == ["format", "session"]
    assert files.bad_lines(spark, str(tmp_path), files.HISTORY) == 1


def test_history_rules(spark):
    schema = "kind string, seq long, at timestamp, serial long, slot string, label string, retries long, suspect boolean"
    rows = [("session", 1, None, 7, "C1", "OLD", 3, False), ("session", 1, None, 7, "C2", "", 3, False), ("session", 3, None, 7, "C1", "", 0, False), ("format", 2, None, 7, "C1", "NEW", 0, False)]
    r = history.summarise(spark.createDataFrame(rows, schema)).first()
    assert (r.sessions, r.retries, r.formats, r.label, r.suspect, r.warning) == (2, 6, 1, "NEW", True, "6 retries")


def test_paths(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = F.lit
    assert one(paths.is_contained(lit("a/../b"))) is False and one(paths.is_contained(lit("C:/x"))) is False and one(paths.is_contained(lit("a/b..c"))) is True
    assert one(paths.in_litter_dir(lit("x/$Recycle.bin/y"))) is True and one(paths.in_litter_dir(lit("RECYCLER"))) is False
    assert one(paths.is_sidecar(lit("ascmhl/0001_x.mhl"))) is True and one(paths.is_sidecar(lit("a/b.mhl"))) is False
    assert one(paths.sanitise(lit(" ..a:b. "))) == "a-b" and one(paths.sanitise(lit("..."))) == "session"
    assert one(paths.manifest_base(lit("s/ascmhl/0001.mhl"))) == "s" and one(paths.manifest_base(lit("s/x.mhl"))) == "s"
    assert one(paths.extension(lit("A.b/c"))) == "b/c" and one(paths.extension(lit("abc"))) is None
    assert one(formats.plain_duration(lit(6120))) == "1 h 42 m" and one(formats.clock_duration(lit(492))) == "8m 12s"
    assert one(formats.human_bytes(lit(1_500_000))) == "1.5 MB" and one(formats.parse_hex(lit("AB"))) == "00000000000000ab"
    assert one(formats.with_field(lit('{"a":"x"}'), "a string, b string", "b", lit("y"))) == '{"a":"x","b":"y"}'
    assert one(verdict.preview(F.array(*[lit(x) for x in "abcd"]))) == "a, b, c and 1 more"


def test_free_names(spark):
    """The first name that is free, whatever gaps others leave; session ids have a hyphen and digits of their own."""
    taken = [("d", "20260115-143000"), ("d", "shoot"), ("d", "shoot-3"), ("d", "shoot-3"), ("e", "shoot-4"), ("d", "x-2")]
    asked = [("d", "20260115-143000", 1), ("d", "20260115-143000", 2), ("d", "shoot", 1), ("d", "shoot", 2), ("e", "shoot", 1), ("d", "x", 1), ("d", "x", 2), ("d", "x-2", 1), ("f", "y", 1), ("f", "y", 2), ("f", "y-2", 1)]
    rows = manifests.free_names(spark.createDataFrame(asked, "folder string, id string, ord long"), spark.createDataFrame(taken, "folder string, name string")).collect()
    got = {(r.folder, r.id, r.ord): r.name for r in rows}
    assert got == {("d", "20260115-143000", 1): "20260115-143000-2", ("d", "20260115-143000", 2): "20260115-143000-3", ("d", "shoot", 1): "shoot-2", ("d", "shoot", 2): "shoot-4", ("e", "shoot", 1): "shoot", ("d", "x", 1): "x", ("d", "x", 2): "x-3", ("d", "x-2", 1): "x-2-2", ("f", "y", 1): "y", ("f", "y", 2): "y-3", ("f", "y-2", 1): "y-2"}


def test_drives_may_share_folder_names(spark):
    entries = spark.createDataFrame([(1, "shoot", 10, "a", 1, "h"), (2, "shoot", 20, "b", 1, "h")], "session_id long, folder string, manifest_id long, rel string, size long, hash string")
    device = spark.createDataFrame([(1, "shoot", "a", 1, "h"), (2, "shoot", "b", 1, "h")], "session_id long, folder string, rel string, size long, hash string")
    assert sorted((r.session_id, r.outcome) for r in recheck.recheck(entries, device).collect()) == [(1, "Matched"), (2, "Matched")]
    assert recheck.extras(entries, device).count() == recheck.residual(entries, device).count() == 0
    checked = recheck.validated(entries.withColumn("other_hash", F.lit(None).cast("string")))
    assert {r.state for r in recheck.sweep(device, checked).collect()} == {"INTACT"} and all(r.clean for r in recheck.sweep(device, checked).collect())


def test_warnings_are_of_the_same_serial(spark):
    summary = spark.createDataFrame([(4, True, "bad")], "serial long, suspect boolean, warning string")
    volumes = spark.createDataFrame([(1, "C1", 1004), (1, "C2", 54), (2, "C1", 4)], "session_id long, slot string, serial long")
    assert [(r.session_id, r.slot, r.serial) for r in history.warnings(volumes, summary).collect()] == [(2, "C1", 4)]
