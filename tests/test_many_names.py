"""Paths given many times in a session, and files without a path: files that are dealt by path once give the rows that joins of the cards give."""

from pathlib import Path

import duckdb
import pytest

from reelproof.operators import reconcile
from reelproof.plans import catalog, fixtures

from test_catalog import rows

SF = "/root/testdata/sf0.001"
VERDICTS = ("a11_a12_diagnosis", "a13_assessment", "a14_verdict_ladder", "h2_two_reads", "j18_unrepeatable_read", "k2_item_order", "k2_verdict_files", "p18_descriptions", "p22_result_lines", "q2_offload_verdict")
PLANS = ("a7_bytes_needed", "a8_copy_plan", "j3_resume_match", "j4_clash_advice", "j4_overwrite_clash", "j5_needed_work", "j5_skip_list")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Orders of nine digits, dozens of which are cut to one path of one session; every 97th line item lacks its supplier, and so its path."""
    out = tmp_path_factory.mktemp("sf")
    for f in Path(SF).glob("*.parquet"):
        if f.stem != "lineitem":
            (out / f.name).symlink_to(f)
    duckdb.execute(f"""COPY (SELECT * REPLACE (100000000 + l_orderkey * 37 + l_orderkey % 5 AS l_orderkey, CASE WHEN l_partkey % 97 <> 0 THEN l_suppkey END AS l_suppkey)
      FROM '{SF}/lineitem.parquet') TO '{out}/lineitem.parquet' (FORMAT parquet)""")
    return str(out)


@pytest.mark.parametrize("name", VERDICTS + PLANS)
def test_query(spark, folder, name):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cur = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cur.description]
    place = [i for i, c in enumerate(columns) if name != "k2_verdict_files" or c != "ord"]  # files of one path have no order of their own
    names = [columns[i] for i in place]
    got, want = rows(names, catalog.QUERIES[name](spark, folder).select(*names).collect()), rows(names, [[r[i] for i in place] for r in cur.fetchall()])
    assert got == want and (want or name == "j18_unrepeatable_read")  # which has none among so few files


def test_paths_are_given_many_times(spark, folder):
    t = catalog.Tables(spark, folder)
    assert t.sql("SELECT max(n) FROM (SELECT count(*) AS n FROM files GROUP BY session_id, rel HAVING rel IS NOT NULL)").first()[0] > 2
    assert t.sql("SELECT count(*) FROM files WHERE rel IS NULL").first()[0] > 0


def test_items_meet_in_one_shuffle():
    """Items come from the files themselves, not from joins of the cards to them."""
    text = fixtures.sql("SELECT * FROM items", False)
    assert "c1 AS (" not in text and "c2 AS (" not in text and text.count("REPARTITION(") == 1


def test_reconcile_dealt(spark):
    """What meets by path is what a join of the cards gives, however often a path is given."""
    all_ = spark.createDataFrame([(1, "a", 5, 5), (1, "a", 6, None), (1, "b", None, 7), (1, "c", 8, 9), (2, "a", 1, 1), (2, "d", None, None)], "session_id long, rel string, x long, y long")
    cards = all_.selectExpr("session_id", "rel", "CASE WHEN x IS NOT NULL THEN struct(x AS size, CAST(x AS timestamp) AS mtime) END AS c1", "CASE WHEN y IS NOT NULL THEN struct(y AS size, CAST(y AS timestamp) AS mtime) END AS c2")
    one, two = (all_.filter(f"{c} IS NOT NULL").selectExpr("session_id", "rel", f"{c} AS size", f"CAST({c} AS timestamp) AS mtime") for c in "xy")
    got, want = reconcile.reconcile_dealt(cards), reconcile.reconcile(one, two)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 5


def test_failures_of_one_path_have_an_order(spark, folder):
    """K2: of one path's failures, the kind says which comes first, so that two runs agree."""
    got = [tuple(r) for r in catalog.QUERIES["k2_verdict_files"](spark, folder).select("session_id", "ord", "rel", "kind").collect()]
    in_order = sorted(got, key=lambda r: (r[0], r[2], r[3]))
    assert [r[:2] for r in in_order] == sorted(r[:2] for r in got)
