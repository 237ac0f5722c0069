import os

from tidemark.sources.scratch import SETTING, Scratch
from tidemark.sources.tables import open_store, read_once


def test_read_once(spark, tmp_path):
    """Of rows with one key the first by place stays; texts aren't moved."""
    rows = [(1, "a"), (2, "b"), (2, "b"), (None, "n"), (None, "m"), (3, None)]
    spark.createDataFrame(rows, "k long, markdown string").repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    once = read_once(spark, str(tmp_path), "t", "k", "markdown")
    got = once.collect()
    assert sorted((r.k or 0) for r in got) == [0, 1, 2, 3] and {(r.k, r.markdown) for r in got} - set(rows) == set()
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "markdown" in line]
    assert read_once(spark, str(tmp_path), "t", "k", "markdown").filter("k = 9").isEmpty()


def test_open_store(spark, tmp_path):
    """A named place is shared; without one the session has its own."""
    spark.createDataFrame([("a", 1)], "k string, n long").write.parquet(str(tmp_path / "pages"))
    assert [tuple(r) for r in open_store(spark, "pages", "k string, n long", f"{tmp_path}/").collect()] == [("a", 1)]
    assert open_store(spark, "own_pages", "k string, n long").isEmpty() and spark.catalog.tableExists("own_pages")
    spark.createDataFrame([("b", 2)], "k string, n long").createOrReplaceTempView("own_pages")
    assert open_store(spark, "own_pages", "k string, n long").count() == 1


def test_scratch_leaves_settings(spark):
    before = spark.conf.get(SETTING, None)
    scratch = Scratch(spark, "t")
    kept = scratch.keep(spark.range(3), "x")
    assert kept.count() == 3 and scratch.bytes("x") > 0 and spark.conf.get(SETTING, None) == before
    path = scratch.path("x").removeprefix("file:")
    assert os.path.exists(path)
    scratch.close()
    assert not os.path.exists(path)
