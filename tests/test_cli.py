"""Commands over landed tables, from pages to reports."""

import json
import os
from datetime import datetime

from tapeline import cli
from tapeline.schema import COMPANIES, INDEX, MESSAGES, SECURITIES
from tapeline.sources import sinks, synthetic


def test_study_and_backtest(spark, tmp_path, capsys):
    data, out = str(tmp_path / "data"), str(tmp_path / "out")
    moved = synthetic.events(spark, secids=10, days=260, n=160)
    sinks.replace(moved.drop("pos"), f"{data}/events")
    sinks.replace(synthetic.prices(spark, secids=10, days=260, moved_by=moved), f"{data}/prices")
    sinks.replace(synthetic.index(spark, days=260), f"{data}/index")
    assert cli.main(["study", "--data", data, "--out", out, "--bootstrap", "50", "--model", "market_adjusted"], spark) == 0
    assert "insider" in capsys.readouterr().out
    assert cli.main(["backtest", "--data", data, "--out", out, "--categories", "insider", "--hold-days", "10", "--placebo", "3", "--split-date", "2022-07-01"], spark) == 0
    made = set(os.listdir(out))
    assert {"event_study.md", "backtest.md", "car_table", "summary", "screening", "car_paths", "car_curves", "trades", "equity", "equity_curves"} <= made
    text = open(f"{out}/backtest.md", encoding="utf-8").read()
    assert "exit_reasons" in text and "Placebo: the same trades on random days, 3 runs" in text and "Walk-forward, split on 2022-07-01" in text and "| hold_days |" in text
    summary = spark.read.option("header", True).csv(f"{out}/summary")
    assert {"ci_low", "ci_high", "p_value", "sign_test_p"} <= set(summary.columns) and summary.count()


def test_from_landed_pages_to_events(spark, tmp_path, capsys):
    data = str(tmp_path)
    page = lambda rows: json.dumps({"history": {"columns": ["TRADEDATE", "SECID", "CLOSE", "VOLUME"], "data": rows}})
    spark.createDataFrame([("A", 0, page([["2024-01-02", "AAAA", 1.0, 5], ["2024-01-03", "AAAA", None, 0]]))], "list string, start long, payload string").write.parquet(f"{data}/history_pages")
    cli.main(["prices", "--data", data], spark)
    answer = json.dumps({"items": [{"guid": "m1", "companyId": 1, "title": "Об изменении размера доли участия члена органа управления эмитента", "date": "2024-02-03T10:00:00"}, {"guid": "m2", "companyId": 1, "title": "О прочем", "date": "03.02.2023 10:00"}]})
    spark.createDataFrame([(answer,)], "payload string").write.parquet(f"{data}/search_answers")
    rows = "<tr><td>04.02.2024 11:00</td><td><a href='/portal/company.aspx?id=1'>A</a></td><td><a href='/event/m3abc'>Об изменении размера доли участия члена органа управления эмитента</a></td></tr>"
    spark.createDataFrame([(f"<table>{rows}</table>",)], "html string").write.parquet(f"{data}/list_pages")
    cli.main(["messages", "--data", data], spark)
    cli.main(["counts", "--data", data, "--from", "2024"], spark)
    spark.createDataFrame([(1, "A", "7707083893", None, None, None)], COMPANIES).write.parquet(f"{data}/companies")
    spark.createDataFrame([("AAAA", "A", "A", None, 1, None, "A", "7707083893", None, "common_share", None, None)], SECURITIES).write.parquet(f"{data}/securities")
    stake = "ФИО: Иванов\nДолжность: Генеральный директор\nДоля до изменения: 1\nДоля после изменения: 3"
    sinks.save_events_json(spark.createDataFrame([("m1", stake), ("m2", "ничего")], "event_id string, body_text string"), f"{data}/event_pages")
    cli.main(["events", "--data", data], spark)
    assert capsys.readouterr().out.split("\n")[:2] == ["1", "3"]
    got = {r.event_id: (r.secid, r.direction, r["size"], r.role) for r in spark.read.parquet(sinks.current(spark, f"{data}/events")).collect()}
    assert got == {"m1": ("AAAA", 1, 2.0, "ceo"), "m3abc": ("AAAA", 0, None, None)}
    assert sinks.load(spark, f"{data}/messages", MESSAGES).filter("event_id = 'm1'").first().published_at == datetime(2024, 2, 3, 10)


def test_lists_land_in_stores(spark, tmp_path):
    """Index history, lists of shares and company pages, page by page; what comes again replaces or is left out."""
    data = str(tmp_path)
    answer = lambda block, names, rows: json.dumps({block: {"columns": names, "data": rows}})
    pages = [("IMOEX", 0, answer("history", ["CLOSE", "TRADEDATE"], [[100 + k, f"2024-{1 + k // 28:02}-{1 + k % 28:02}"] for k in range(100)])), ("IMOEX", 100, answer("history", ["CLOSE", "TRADEDATE"], [[7, "2024-01-01"], [None, "2024-12-30"], [8, "2024-12-31"]])), ("IMOEX", 200, answer("history", ["CLOSE", "TRADEDATE"], [[1, "2025-01-01"]]))]
    spark.createDataFrame(pages, "list string, start long, payload string").write.parquet(f"{data}/index_pages")
    cli.main(["index", "--data", data], spark)
    cli.main(["index", "--data", data], spark)
    index = {str(r.date): r.close for r in sinks.load(spark, f"{data}/index", INDEX).collect()}
    assert len(index) == 101 and index["2024-01-01"] == 7 and index["2024-12-31"] == 8
    names = ["secid", "shortname", "is_traded", "emitent_inn", "type"]
    lists = [("traded", 0, answer("securities", names, [["AAAA", "A", 1, "7707083893", "common_share"], ["BBBB", "B", 1, "7707083894", "common_share"]])), ("all", 0, answer("securities", names, [["AAAA", "old", 0, "7707083893", "common_share"], ["GONE", "G", 0, "7707083895", "common_share"]]))]
    spark.createDataFrame(lists, "list string, start long, payload string").write.parquet(f"{data}/securities_pages")
    cli.main(["securities", "--data", data], spark)
    assert {(r.secid, r.shortname, r.is_traded) for r in sinks.load(spark, f"{data}/securities", SECURITIES).collect()} == {("AAAA", "A", 1), ("BBBB", "B", 1), ("GONE", "G", 0)}
    html = lambda i, inn: f"<h1>Company {i}</h1><a href='/portal/company.aspx?id={i}'>c</a><p>ИНН: {inn}</p>"
    spark.createDataFrame([(html(1, "7707083893"),), (html(2, "1111111111"),), (html(3, "7707083895"),), ("<p>nothing</p>",)], "html string").write.parquet(f"{data}/company_pages")
    cli.main(["companies", "--data", data], spark)
    assert {(r.company_id, r.inn) for r in sinks.load(spark, f"{data}/companies", COMPANIES).collect()} == {(1, "7707083893"), (3, "7707083895")}
