"""Stores, reports, streams, and the catalog against DuckDB on the smallest tables."""

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tapeline.plans import report
from tapeline.schema import MESSAGES, PRICES
from tapeline.sources import ranged, sinks
from tapeline.streaming import feeds as streams

SF = "/root/testdata/sf0.001"


def test_append_keeps_the_last(spark, tmp_path):
    path = str(tmp_path / "m")
    assert sinks.load(spark, path, MESSAGES).count() == 0
    row = lambda e, t: (e, 1, "A", datetime(2024, 1, 1), t, "u")
    sinks.append_dedup(spark.createDataFrame([row("a", "x"), row("b", "x")], MESSAGES), path, MESSAGES, ["event_id"])
    sinks.append_dedup(spark.createDataFrame([row("b", "y")], MESSAGES), path, MESSAGES, ["event_id"])
    assert {(r.event_id, r.event_type) for r in sinks.load(spark, path, MESSAGES).collect()} == {("a", "x"), ("b", "y")}


def test_prices_behind_the_mark(spark, tmp_path):
    path = str(tmp_path / "p")
    df = lambda *days: spark.createDataFrame([(date(2024, 1, d), "A", c) for d, c in days], "date date, secid string, close double")
    assert sinks.append_prices(df(), path, PRICES) is None
    sinks.append_prices(df((5, 1.0), (6, 2.0)), path, PRICES)
    sinks.append_prices(df((4, 9.0), (6, 9.0), (7, 3.0)), path, PRICES)
    assert [(r.date.day, r.close) for r in sinks.load(spark, path, PRICES).orderBy("date").collect()] == [(5, 1.0), (6, 2.0), (7, 3.0)]


def data_files(store):
    return {r.file: r for r in store.files().collect()}


def test_an_append_touches_its_ranges_only(spark, tmp_path, monkeypatch):
    """Files by range of securities: an append of a day adds files and rewrites none, an upsert rewrites those that it meets, scans open few."""
    monkeypatch.setattr(ranged, "ROWS_A_RANGE", 40)
    path = str(tmp_path / "store")
    df = lambda rows: spark.createDataFrame(rows, "date date, secid string, close double")
    secids = [f"S{k:02}" for k in range(20)]
    store = lambda: ranged.Store(spark, path, PRICES)
    assert store().scan().count() == 0 and store().append(df([])) == 0 and store().version is None
    assert store().append(df([(date(2024, 1, d), s, d + 0.5) for s in secids for d in range(1, 11)])) == 5
    first = data_files(store())
    assert len({r.range for r in first.values()}) == 5 and sum(r.n for r in first.values()) == 200
    # one day of some securities, with back-fill and repeats
    late = [(date(2024, 1, 11), s, 1.0) for s in ("S00", "S01", "S19")] + [(date(2024, 1, 3), "S00", 9.0), (date(2024, 1, 11), "S00", 0.5), (date(2024, 1, 5), "T99", 7.0), (None, "S00", 1.0)]
    assert store().append(df(late)) == 2
    second = data_files(store())
    assert set(first) < set(second) and len(second) == 7
    assert {r.secid: r.last_date.day for r in store().marks().collect()} == {s: 11 if s in ("S00", "S01", "S19") else 10 for s in secids} | {"T99": 5}
    assert store().append(df(late)) == 0 and set(data_files(store())) == set(second)
    # scans open the files that can match
    opened = lambda d: {x.rpartition("/")[2] for x in d.inputFiles()}
    one = store().scan(["S07"])
    assert one.count() == 10 and len(opened(one)) == 1
    assert len(opened(store().scan(["S00"], "2024-01-11"))) == 1 and store().scan(["S00"], "2024-01-11").first().close == 1.0
    assert store().scan(start="2024-01-03", end="2024-01-04").count() == 40 and store().scan(["none"]).count() == 0
    assert [(r.date.day, r.close) for r in sinks.load(spark, path, PRICES).filter("secid = 'S00'").orderBy("date").collect()][2] == (3, 3.5)
    # an upsert rewrites only what it meets
    assert store().upsert(df([(date(2024, 1, 3), "S07", 99.0), (date(2024, 1, 20), "S07", 98.0)])) == 1
    third = data_files(store())
    assert len(set(second) - set(third)) == 1 and len(set(third) - set(second)) == 1
    assert {r.date.day: r.close for r in store().scan(["S07"]).collect()} == {d: d + 0.5 for d in range(1, 11)} | {3: 99.0, 20: 98.0}
    assert store().compact(1) == 2 and len(data_files(store())) == 5 and store().scan().count() == 205
    broken = df([(date(2024, 2, 1), "S00", 1.0)]).withColumn("close", F.raise_error(F.lit("dies")).cast("double"))
    with pytest.raises(Exception, match="dies"):
        store().append(broken)
    assert store().scan().count() == 205 and store().append(df([(date(2024, 2, 1), "S00", 1.0)])) == 1


def test_an_older_store_is_taken_over(spark, tmp_path):
    path = str(tmp_path / "old")
    old = spark.createDataFrame([(date(2024, 1, 5), "A", 1.0)], "date date, secid string, close double")
    sinks.append_dedup(old, path, PRICES, ["secid", "date"])
    assert sorted((r.date.day, r.close) for r in sinks.append_prices(spark.createDataFrame([(date(2024, 1, 5), "A", 9.0), (date(2024, 1, 6), "A", 2.0)], old.schema), path, PRICES).collect()) == [(5, 1.0), (6, 2.0)]


def test_a_store_is_never_gone(spark, tmp_path, monkeypatch):
    """The old version stands until the pointer names the new one, and a run that dies leaves the old."""
    path = str(tmp_path / "s")
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    sinks.replace(one, path)
    opened = spark.read.parquet(sinks.current(spark, path))
    sinks.replace(one.union(one), path)
    assert opened.count() == 1 and sinks.load(spark, path, "k STRING, v INT").count() == 2
    broken = spark.createDataFrame([("x", 0)], "k string, v int").select("k", F.raise_error(F.lit("dies")).cast("int").alias("v"))
    with pytest.raises(Exception, match="dies"):
        sinks.replace(broken, path)
    assert sinks.load(spark, path, "k STRING, v INT").count() == 2
    for _ in range(3):
        sinks.replace(one, path)
    assert sum(x.startswith("v-") for x in os.listdir(path)) == 2 and sinks.load(spark, path, "k STRING, v INT").count() == 1
    plain = str(tmp_path / "plain")  # a folder that another tool wrote
    one.write.parquet(plain)
    assert sinks.load(spark, plain, "k STRING, v INT").count() == 1 and sinks.current(spark, str(tmp_path / "none")) is None


def test_values_in_reports():
    cases = {None: "", float("nan"): "", -0.00001: "0", 1.5: "1.5", True: "True", float("inf"): "inf", datetime(2024, 1, 2): "2024-01-02", datetime(2024, 1, 2, 3, 4, 5): "2024-01-02 03:04", date(2024, 1, 2): "2024-01-02", 7: "7"}
    assert [report.format_value(v) for v in cases] == list(cases.values())


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(1.23456, "a|b"), (None, None)], "x double, y string")
    assert "| 1.2346 | a\\|b |" in report.markdown_table(df)
    out = report.write_report(str(tmp_path / "r.md"), "T", {"rows": df, "facts": {"n": 2}})
    assert out.startswith("# T") and "| n | 2 |" in out


def test_streamed_prices_and_confounders(spark, tmp_path):
    src, store = str(tmp_path / "p"), str(tmp_path / "store")
    row = lambda d, c: (date(2024, 1, d), "A", None, None, None, c, None, None, None)
    spark.createDataFrame([row(1, 1.0), row(2, 2.0)], PRICES).write.parquet(src)
    stream = spark.readStream.schema(PRICES).parquet(src)
    streams.merge_prices(stream, store, str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([row(2, 9.0), row(3, 3.0)], PRICES).write.mode("append").parquet(src)
    streams.merge_prices(stream, store, str(tmp_path / "c")).awaitTermination()
    assert [(r.date.day, r.close) for r in sinks.load(spark, store, PRICES).orderBy("date").collect()] == [(1, 1.0), (2, 2.0), (3, 3.0)]
    ddl = "event_id string, secid string, published_at timestamp"
    for name, rows in (("e", [("a", "S", datetime(2024, 1, 10)), ("b", "S", datetime(2024, 1, 20))]), ("f", [("c", "S", datetime(2024, 1, 14)), ("a", "S", datetime(2024, 1, 10)), ("d", "T", datetime(2024, 1, 20))])):
        spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / name))
    read = lambda n: spark.readStream.schema(ddl).parquet(str(tmp_path / n))
    q = streams.confounded(read("e"), read("f")).writeStream.format("memory").queryName("near").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.event_id, r.c_id) for r in spark.table("near").collect()] == [("a", "c")]


def test_stream_dedup(spark, tmp_path):
    src = str(tmp_path / "in")
    ddl = MESSAGES.replace("TIMESTAMP_NTZ", "TIMESTAMP")
    rows = [("a", 1, "A", datetime(2024, 1, 1), "x", "u"), ("a", 1, "A", datetime(2024, 1, 2), "x", "u"), ("b", 1, "A", datetime(2024, 1, 2), "x", "u")]
    spark.createDataFrame(rows, ddl).write.parquet(src)
    q = streams.dedup_messages(streams.read_messages(spark, src)).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.event_id for r in spark.table("seen").collect()) == ["a", "b"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["summarize", "car_coverage", "event_filter_diagnostics", "liquidity_stats", "flag_confounders", "map_companies", "classify_messages", "fuzzy_candidates", "signal_trades"])
def test_catalog_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({entry.oracle_sql()[name]})").fetchall()
    text = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(text, r)) for r in got.select(*[F.col(f"`{c}`") for c in cols]).collect()) == sorted(tuple(map(text, r)) for r in want)
