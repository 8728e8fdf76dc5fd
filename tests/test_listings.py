"""Folders of many small files: no list of them goes through the driver, no task is made for each."""

from reelproof.plans import drives
from reelproof.sources import files, ranges


def test_small_files_share_tasks(spark, tmp_path):
    """H1: many small files are read range by range in few tasks."""
    want = {}
    for k in range(300):
        (tmp_path / f"f{k}").write_bytes(data := bytes([k % 251]) * (k * 37 % 2600))
        want[str(tmp_path / f"f{k}")] = data
    rows = ranges.values(files.inventory(spark, str(tmp_path)), 1000, 8)
    assert rows.rdd.getNumPartitions() == 8
    got: dict[str, dict[int, bytes]] = {}
    for r in rows.collect():
        assert len(r.content) <= 1000 and r.offset == 1000 * r.no
        got.setdefault(r.path, {})[r.no] = bytes(r.content)
    assert {p: b"".join(x[n] for n in sorted(x)) for p, x in got.items()} == want
    assert {p: len(x) for p, x in got.items()} == {p: max(1, -(-len(x) // 1000)) for p, x in want.items()}


def test_only_manifests_are_listed_by_the_driver(spark, tmp_path, monkeypatch):
    """Q3: Spark's readers are given the manifests that the walk has found, not the drives with all their files."""
    for k in range(3):
        folder = tmp_path / "drive" / f"2026-01-0{k + 1}_a[{k}]"
        folder.mkdir(parents=True)
        (folder / "clip.txt").write_bytes(b"x")
        if k < 2:
            (folder / "m.mhl").write_text('<hashlist version="1.1"><creatorinfo><startdate>2026-01-01T10:00:00Z</startdate></creatorinfo><hash><file>clip.txt</file><size>1</size><xxhash64be>5c80c09683041123</xxhash64be></hash></hashlist>')
    seen = []
    for name in ("manifest_entries", "manifest_headers"):
        real = getattr(files, name)
        monkeypatch.setattr(files, name, lambda spark, path, *rest, real=real: seen.append(path) or real(spark, path, *rest))
    states, _ = drives.recheck_drives(spark, str(tmp_path))
    assert {r.folder[:10]: r.state for r in states.collect()} == {"2026-01-01": "INTACT", "2026-01-02": "INTACT", "2026-01-03": "NO MANIFEST"}
    assert len(seen) == 2 and all(len(p) == 2 and all(x.endswith(".mhl") for x in p) for p in seen)
