"""Registered queries work on every row of their tables."""

import os
from datetime import datetime, timedelta

import pytest

import __spark_entry__ as entry

EVENTS = [(i, datetime(2024, 1, 1) + timedelta(minutes=37 * i, seconds=i % 60), i % 450, f"kind{i % 7}") for i in range(2500)]


@pytest.fixture(scope="module")
def events_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(EVENTS, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string").write.parquet(f"{d}/events.parquet")
    return d


def test_search_json_parses_every_event(spark, events_dir):
    got = entry.queries()["parse_search_json"](spark, events_dir).collect()
    known = lambda i, u: u if i // 1000 % 3 < 2 else None  # noqa: E731  every third page names no company, every second no seconds
    at = lambda i, t: t.replace(second=0) if i // 1000 % 3 == 1 else t
    want = [(str(i), known(i, u), k, at(i, t), f"https://e-disclosure.ru/portal/event.aspx?EventId={i}") for i, t, u, k in EVENTS]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_message_list_parses_every_event(spark, events_dir):
    got = entry.queries()["parse_message_list"](spark, events_dir).collect()
    assert sorted((r.event_id, r.company_id, r.company_name, r.published_at, r.event_type) for r in got) == sorted((f"e{i}", u, f"К {u}", t.replace(second=0), k) for i, t, u, k in EVENTS)


def test_event_json_keeps_every_event(spark, events_dir, monkeypatch):
    from tapeline.sources import feeds

    seen, scan = [], feeds.scan_event_json
    monkeypatch.setattr(feeds, "scan_event_json", lambda *a, **k: seen.append(a) or scan(*a, **k))
    got = entry.queries()["scan_event_json"](spark, events_dir).collect()
    assert sorted(tuple(r) for r in got) == sorted((str(i), k) for i, _, _, k in EVENTS) and seen


SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@needs_tables
@pytest.mark.parametrize("name", ["json_block", "history_to_prices", "price_panel"])
def test_every_price_row(spark, name):
    from tapeline.sources import market

    got = entry.queries()[name](spark, SF).withColumnRenamed("tradedate", "date")
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect())) == sorted(map(tuple, market.prices(spark, SF).select(*sorted(got.columns)).collect()))


@needs_tables
def test_payloads_are_bounded(spark):
    from tapeline.plans import catalog_runs

    assert catalog_runs.payloads(spark, SF).selectExpr("max(size(regexp_extract_all(payload, '[0-9]{4}-[0-9]{2}-[0-9]{2}', 0))) AS n").first().n <= 366


@needs_tables
def test_wide_has_every_security(spark):
    from tapeline.sources import market

    wide = entry.queries()["to_wide"](spark, SF).collect()
    got = {(k, r.date, v) for r in wide for k, v in r.asDict().items() if k != "date" and v is not None}
    assert got == {(r.secid, r.date, r.close) for r in market.prices(spark, SF).collect()}


@needs_tables
def test_placebo_runs_as_often_as_the_reference(spark):
    assert {r.run_id for r in entry.queries()["placebo"](spark, SF).collect()} == {f"p{i}" for i in range(200)}


@needs_tables
def test_bootstrap_draws_as_often_as_the_reference(spark, monkeypatch):
    from tapeline.operators import eventstudy as es

    seen, of = [], es.bootstrap_ci
    monkeypatch.setattr(es, "bootstrap_ci", lambda *a, **k: seen.append(k["draws"]) or of(*a, **k))
    assert entry.queries()["bootstrap_ci"](spark, SF).count() and seen == [2000]


@needs_tables
def test_walk_forward_table_has_all_key_metrics(spark, monkeypatch):
    from tapeline.operators import backtest as bt

    seen, of = [], bt.compute_metrics
    monkeypatch.setattr(bt, "compute_metrics", lambda *a, **k: seen.append(of(*a, **k)) or seen[-1])
    got = {r.metric: (r.in_sample, r.out_of_sample) for r in entry.queries()["walk_forward_table"](spark, SF).collect()}
    runs = {r.run_id: r for r in seen[0].collect()}
    best = min((n[3:] for n in runs if n.startswith("is:")), key=lambda n: (-(float("-inf") if runs[f"is:{n}"].sharpe is None else runs[f"is:{n}"].sharpe), n))
    names = ["total_return", "cagr", "sharpe", "max_drawdown", "hit_rate", "n_trades", "alpha_annual", "alpha_t", "beta"]
    near = lambda v: v if v is None else pytest.approx(v, abs=1e-4)
    assert got == {n: (near(runs[f"is:{best}"][n]), near(runs[f"oos:{best}"][n])) for n in names}
