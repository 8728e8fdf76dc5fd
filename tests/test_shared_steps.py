"""Steps that several queries share are done once, and rows are no wider than they must be when they are shuffled."""

from pyspark.sql import functions as F

from reelproof.operators import manifests
from reelproof.plans import catalog, fixtures
from reelproof.sources import files

SF = "/root/testdata/sf0.001"


def test_a_path_is_digested_once():
    assert fixtures.sql("SELECT * FROM tuples", False).count("md5(rel)") == 1


def test_items_are_derived_once(spark):
    """J19 reads items, and the digests that are made of them, as they were written."""
    plan = catalog.QUERIES["j19_manifest_contents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan


def test_manifests_are_rendered_after_the_shuffle(spark, tmp_path):
    """Entries are dealt as they are; the text of a manifest's lines is made where they are written, in order, with head and tail."""
    rows = spark.createDataFrame([("m", "b", 2, "02"), ("m", "a", 1, "01"), ("n", "c", 3, None)], "manifest_id string, rel string, size long, hash string").withColumn("mtime", F.lit(None).cast("timestamp"))
    lines = manifests.dealt(rows, manifests.mhl_line(), "hashlist", "1.1")
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("to_xml") < plan.index("RepartitionByExpression")
    files.write_manifests(lines, str(tmp_path / "out"))
    text = next((tmp_path / "out" / "manifest_id=m").glob("*.txt")).read_text()
    assert text.startswith('<?xml version="1.0" encoding="UTF-8"?>\n<hashlist version="1.1">\n<hash>') and text.endswith("</hash>\n</hashlist>\n") and text.index("<file>a<") < text.index("<file>b<")
    got = files.manifest_entries(spark, f"{tmp_path}/out/*/*.txt").select("rel", "size", "hash").collect()
    assert sorted((r.rel, r.size, r.hash) for r in got) == [("a", 1, f"{1:016x}"), ("b", 2, f"{2:016x}"), ("c", 3, None)]
