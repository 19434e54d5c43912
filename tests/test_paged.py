"""Landed lists of pages as a data source: where lists end, which are opened, and a stream that is restarted."""

import json

import pytest
from pyspark.sql import functions as F

from tapeline.sources.paged import Pages, register, rows_of


def page(*rows):
    return json.dumps({"history": {"columns": ["X"], "data": [[str(r)] for r in rows]}})


def land(spark, path, pages):
    spark.createDataFrame(pages, "list string, page long, payload string").coalesce(1).write.mode("append").partitionBy("list", "page").text(path)


@pytest.fixture
def source(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "pages")
    return path, lambda how: how.format("landed_pages").option("path", path).option("block", "history").option("limit", 2).load()


def test_lists_end(spark, source):
    path, load = source
    land(spark, path, [("short", 0, page(1, 2)), ("short", 1, page(3)), ("short", 2, page(9, 9)), ("empty", 0, page(1, 2)), ("empty", 1, page()), ("empty", 2, page(9, 9))])
    land(spark, path, [("again", 0, page(1, 2)), ("again", 10, page(3, 4)), ("again", 20, page(3, 4)), ("again", 30, page(9, 9)), ("odd", 0, "<html>"), ("none", 0, page())])
    got = sorted((r.list, r.page) for r in load(spark.read).collect())
    assert got == [("again", 0), ("again", 10), ("empty", 0), ("short", 0), ("short", 1)]
    one = load(spark.read).filter(F.col("list") == "short")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 2
    assert load(spark.read).filter(F.col("list").isin("short", "empty")).rdd.getNumPartitions() == 2
    assert load(spark.read).filter((F.col("list") == "again") & (F.col("page") > 5)).count() == 1


def test_no_pages(spark, source):
    _, load = source
    assert load(spark.read).count() == 0
    with pytest.raises(ValueError, match="block"):
        Pages({"path": "/x"})
    assert rows_of("<a id=1><a id=2>", None, "<a ") == 2 and rows_of("x", "history", None) == 0


def test_a_stream_goes_on_where_it_stopped(spark, source, tmp_path):
    path, load = source

    def take():
        q = load(spark.readStream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).start(str(tmp_path / "out"))
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r.list, r.page) for r in spark.read.schema("list string, page long").parquet(str(tmp_path / "out")).collect())

    land(spark, path, [("a", 0, page(1, 2)), ("b", 0, page(1, 2)), ("b", 1, page(3))])
    first = [("a", 0), ("b", 0), ("b", 1)]
    assert take() == first
    land(spark, path, [("a", 1, page(3, 4)), ("a", 2, page(3, 4)), ("b", 2, page(9, 9)), ("c", 0, page(5))])
    assert take() == sorted([*first, ("a", 1), ("c", 0)])  # a repeats itself, b had ended
    assert take() == sorted([*first, ("a", 1), ("c", 0)])
