"""Session bundles: their files, what is said of them, and that lines are gone through once, as narrow as they come."""

from pyspark.sql import functions as F

from reelproof.plans import catalog, fixtures
from reelproof.sources import files, ranges

SF = "/root/testdata/sf0.001"


def test_lines_are_gone_through_once(spark, tmp_path):
    """Of each line that goes into a bundle, one is made: neither the state nor what is returned makes them anew."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = [(1, "log.txt", k, f"line {k}") for k in range(50)] + [(2, "log.txt", 0, None), (3, "log.txt", 0, "other session"), (1, "other.txt", 0, "other artifact")]
    lines = spark.createDataFrame(rows, "session_id long, artifact string, part long, value string").mapInArrow(counted, "session_id long, artifact string, part long, value string")
    expected = spark.createDataFrame([(s, a) for s in (1, 2) for a in ("log.txt", "errors.txt")] * 2, "session_id long, artifact string")
    state = files.export_bundles(expected, lines, str(tmp_path / "b"))
    size = sum(len(f"line {k}\n") for k in range(50))
    want = [(1, "errors.txt", False, None), (1, "log.txt", True, size), (2, "errors.txt", False, None), (2, "log.txt", True, 0)]
    assert sorted(tuple(r) for r in state.collect()) == want and made.value == len(rows)
    assert sorted(str(p.relative_to(tmp_path / "b")) for p in (tmp_path / "b").rglob("*.txt")) == ["1/contents.txt", "1/log.txt", "2/contents.txt", "2/log.txt"]
    assert (tmp_path / "b/1/log.txt").read_text() == "".join(f"line {k}\n" for k in range(50))
    assert (tmp_path / "b/2/contents.txt").read_text() == "gathered: log.txt\nnot gathered: errors.txt\n"


def test_an_artifact_called_like_the_contents(spark, tmp_path):
    lines = spark.createDataFrame([(1, "contents.txt", k, f"own {k}") for k in (2, 1)] + [(1, "a", 0, "x")], "session_id long, artifact string, part long, value string")
    expected = spark.createDataFrame([(s, a) for s in (1, 2) for a in ("contents.txt", "a")], "session_id long, artifact string")
    state = files.export_bundles(expected, lines, str(tmp_path / "b"))
    one, two = "gathered: a\ngathered: contents.txt\nown 1\nown 2\n", "not gathered: a\nnot gathered: contents.txt\n"
    assert (tmp_path / "b/1/contents.txt").read_text() == one and (tmp_path / "b/2/contents.txt").read_text() == two
    assert sorted(tuple(r) for r in state.collect()) == sorted([(1, "a", True, 2), (1, "contents.txt", True, len(one)), (2, "a", False, None), (2, "contents.txt", False, len(two))], key=str)


def test_values_are_made_after_the_shuffle(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "rel string, part int, short string")
    out = ranges.written(rows, str(tmp_path / "w"), F.concat(F.repeat("short", 3), F.lit("\n")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("repeat(") < plan.index("RepartitionByExpression")
    assert sorted(tuple(r) for r in out.collect()) == [("a", 8), ("b", 0)] and (tmp_path / "w/a").read_text() == "yyy\nxxx\n"


def test_sessions_without_the_files(spark):
    """Sessions are seen from the orders' numbers: no files are told apart for that."""
    t = fixtures.Tables(spark, SF)
    assert "Window" not in t.sessions._jdf.queryExecution().optimizedPlan().toString()
    told = spark.sql(fixtures.TABLES["sessions"].replace("FROM files", "FROM {files}"), files=t.files)
    assert sorted(map(str, t.sessions.collect())) == sorted(map(str, told.collect()))


def test_bundles_of_the_catalog_write_manifests_in_order(spark):
    rows = catalog.QUERIES["s18_bundle_files"](spark, SF)
    assert rows.filter("artifact = 'manifest.mhl' AND gathered").agg(F.sum("lines")).first()[0] == fixtures.Tables(spark, SF).manifest_entries.count()
