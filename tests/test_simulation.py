"""Accounting identities, exits and skips of the sequential kernel; the injected effect in the event study."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapeline.operators import backtest as bt
from tapeline.operators import eventstudy as es
from tapeline.operators import panel
from tapeline.sources import synthetic
from tapeline.sources.scratch import staged


@pytest.fixture(scope="module")
def market(spark):
    e = synthetic.events(spark, secids=12, days=200, n=120).persist()
    return e, synthetic.prices(spark, secids=12, days=200, moved_by=e).persist(), synthetic.index(spark, days=200).persist()


def run(spark, market, **kw):
    e, p, i = market
    cfg = bt.BacktestConfig(**kw)
    cal = panel.trading_calendar(p, i)
    s = bt.prepare_signals(e.drop("pos"), p, cal, cfg).withColumn("run_id", F.lit("x"))
    out = bt.run_backtests(s, bt.backtest_panel(p, i, cfg), {"x": cfg}).persist()
    return cfg, bt.trades_of(out).toPandas(), bt.daily_of(out).orderBy("pos").toPandas(), bt.outcomes_of(out).toPandas()


def test_accounting(spark, market):
    cfg, trades, daily, outcome = run(spark, market, hold_days=5)
    assert len(trades) and set(outcome.status) <= {"executed", "skipped"}
    assert daily.equity.iloc[-1] == pytest.approx(cfg.initial_capital + trades.pnl.sum())
    s, c = cfg.slippage_bps / 1e4, cfg.commission_bps / 1e4
    ratio = (1 + trades.gross_ret) * (1 - s) / (1 + s)
    assert (trades.net_ret - (ratio - 1 - c * (1 + ratio))).abs().max() < 1e-9
    assert (daily.cash + 1e-6 >= 0).all() and trades.trade_id.is_unique


def test_shorts_and_stops(spark, market):
    _, trades, _, _ = run(spark, market, allow_short=True, direction_filter=None, stop_loss=0.02, entry="t0_close")
    assert set(trades.side) == {1, -1} and "stop_loss" in set(trades.exit_reason)
    _, _, _, outcome = run(spark, market, direction_filter=None)
    assert "short_not_allowed" in set(outcome.skip_reason)


BOARD = "secid string, pos int, open double, close double, last_close double, last_valid_pos int, adv double, mkt_close double"
SIGNALS = "run_id string, event_id string, secid string, published_at timestamp, category string, direction int, side int, entry_pos int, status string, skip_reason string, start_pos int, end_pos int"


def small(spark, cells, signals, cfg, end):
    """(trades by event, days, outcomes) of a run over a board given by hand: secid -> (open, close) by session, None without a price."""
    board = []
    for secid, days in cells.items():
        valid = max(d for d, x in enumerate(days) if x and x[1] is not None)
        last = None
        for d, x in enumerate(days):
            o, c = x or (None, None)
            last = c if c is not None else last
            board.append((secid, d, o, c, last, valid, None, 100.0 + d))
    at = lambda k: datetime(2024, 1, 1, k)
    rows = [("x", e, s, at(k), "c", side, side, d, "pending", "", 0, end) for k, (e, s, d, side) in enumerate(signals)]
    out = bt.run_backtests(spark.createDataFrame(rows, SIGNALS), spark.createDataFrame(board, BOARD), {"x": cfg}).persist()
    return {t.event_id: t for t in bt.trades_of(out).collect()}, bt.daily_of(out).orderBy("pos").collect(), {o.event_id: o.skip_reason for o in bt.outcomes_of(out).collect()}


PLAIN = {"min_turnover": None, "max_participation": None, "commission_bps": 0, "slippage_bps": 0}


def test_delisted_and_end(spark):
    cells = {"A": [(10.0, 10.0 + d) for d in range(3)] + [None] * 7, "B": [(20.0, 20.0)] * 10}
    trades, days, outcome = small(spark, cells, [("a", "A", 1, 1), ("b", "B", 7, 1), ("late", "A", 4, 1)], bt.BacktestConfig(hold_days=5, **PLAIN), 9)
    assert {(t.event_id, t.exit_reason, t.exit_pos) for t in trades.values()} == {("a", "delisted", 2), ("b", "end", 9)}
    assert outcome == {"a": "", "b": "", "late": "no_price"}
    assert days[-1].equity == pytest.approx(1e6 + sum(t.pnl for t in trades.values()))
    assert [d.n_positions for d in days] == [0, 1, 1, 0, 0, 0, 0, 1, 1, 0]  # the delisting shows on the session after the last price
    assert days[0].index_ret == 0 and days[5].index_ret == pytest.approx(105 / 104 - 1) and days[9].index_equity == pytest.approx(1e6 * 1.09)


def test_exits_are_resolved_before_the_run(spark):
    """Stop on the day of entry, halts that delay the exit, an entry that waits for a price, entries at the close."""
    flat = [(10.0, 10.0)] * 12
    cells = {
        "S": [*flat[:2], (10.0, 8.0), *flat[3:]], "H": [*flat[:6], None, None, *flat[8:]], "W": [flat[0], flat[1], None, None, (11.0, 11.0), *flat[5:]],
        "O": [*flat[:3], (10.0, None), *flat[4:]], "L": flat,
    }
    cfg = bt.BacktestConfig(hold_days=4, stop_loss=0.1, max_positions=5, **PLAIN)
    trades, days, _ = small(spark, cells, [("s", "S", 2, 1), ("h", "H", 2, 1), ("w", "W", 2, 1), ("o", "O", 3, 1), ("l", "L", 10, 1)], cfg, 11)
    assert {e: (t.entry_pos, t.exit_pos, t.exit_reason) for e, t in trades.items()} == {"s": (2, 2, "stop_loss"), "h": (2, 8, "hold_days"), "w": (4, 8, "hold_days"), "o": (3, 7, "hold_days"), "l": (10, 11, "end")}
    assert trades["w"].entry_price_raw == 11.0 and trades["s"].net_ret == pytest.approx(-0.2)
    at_close = bt.BacktestConfig(hold_days=4, stop_loss=0.1, entry="t0_close", **PLAIN)
    trades, days, outcome = small(spark, cells, [("s", "S", 2, 1), ("l", "L", 11, 1)], at_close, 11)
    assert {e: (t.entry_pos, t.exit_pos, t.exit_reason) for e, t in trades.items()} == {"s": (2, 6, "hold_days")} and trades["s"].gross_ret == pytest.approx(0.25)
    assert outcome["l"] == "" and days[-1].n_positions == 1  # opened at the last close, never closed


def test_who_gets_in(spark):
    """One slot a session order: natives before those that waited, refusals in their order, shorts pay and earn the other way."""
    flat = [(10.0, 10.0)] * 8
    cells = {"A": flat, "B": [*flat[:2], None, *flat[3:]], "C": [*flat[:5], (10.0, 12.0), *flat[6:]], "D": [(3e6, 3e6)] * 8}
    cfg = bt.BacktestConfig(hold_days=2, max_positions=1, allow_short=True, **PLAIN)
    trades, _, outcome = small(spark, cells, [("waits", "B", 2, 1), ("first", "A", 3, 1), ("again", "A", 4, 1), ("dear", "D", 6, 1), ("short", "C", 7, -1)], cfg, 7)
    assert outcome == {"waits": "no_slot", "first": "", "again": "already_held", "dear": "qty_zero", "short": ""}
    two = bt.BacktestConfig(hold_days=2, max_positions=2, allow_short=True, **PLAIN)
    trades, days, _ = small(spark, cells, [("short", "C", 3, -1)], two, 7)
    assert (trades["short"].qty, trades["short"].pnl) == (50_000, -100_000) and days[4].cash == 1.5e6 and days[4].equity == 1e6


def test_signals_pass_a_run_as_a_stream(spark):
    """Many signals a security and session give what a plain ledger over each of them gives; what is worked out beforehand does not follow their number."""
    rnd, end, secids = random.Random(16), 19, [f"S{k}" for k in range(20)]
    price = {(s, d): (10 * 1.6**d * rnd.uniform(0.9, 1.1), 10 * 1.6**d * rnd.uniform(0.9, 1.1)) for s in secids for d in range(end + 1)}
    adv = {s: rnd.choice((5e3, 4e4, 4e5)) for s in secids}
    board = [(s, d, o, c, c, end, adv[s], 100.0) for (s, d), (o, c) in price.items()]
    rows = []
    for k in range(300):
        side = rnd.choice((1, 1, -1))
        rows.append(("x", f"e{k}", rnd.choice(secids), datetime(2024, 1, 1) + timedelta(minutes=rnd.randrange(100_000)), "c", side, side, rnd.randrange(end + 1), "pending", "", 0, end))
    cfg = bt.BacktestConfig(hold_days=4, max_positions=12, allow_short=True, min_cash_fraction=0.9, **PLAIN | {"max_participation": 1.0})
    signals = spark.createDataFrame(rows, SIGNALS)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(batch)
    spark.conf.set(batch, 70)
    try:
        out = bt.run_backtests(signals, spark.createDataFrame(board, BOARD), {"x": cfg})
        plan = out._jdf.queryExecution().executedPlan().toString()
        found = staged(out)
    finally:
        spark.conf.set(batch, kept)
    cash, equity, held, want, pnl = 1e6, 1e6, [], {}, {}
    for day in range(end + 1):
        for _, e, s, _, _, side, *_ in sorted((r for r in rows if r[7] == day), key=lambda r: (r[3], r[1])):
            meant, at = min(equity / 12, adv[s]), price[s, day][0]
            why = "already_held" if s in {p[1] for p in held} else "no_slot" if len(held) == 12 else "no_cash" if cash < 0.9 * meant else "qty_zero" if min(meant, cash) // at < 1 else ""
            want[e] = why
            if not why:
                qty = int(min(meant, cash) // at)
                cash -= side * qty * at
                held.append((e, s, side, qty, at, day))
        for p in [p for p in held if day in (p[5] + 4, end)]:
            held.remove(p)
            cash += p[2] * p[3] * price[p[1], day][1]
            pnl[p[0]] = p[2] * p[3] * (price[p[1], day][1] - p[4])
        equity = cash + sum(side * qty * price[s, day][1] for _, s, side, qty, _, _ in held)
    assert {"no_cash", "no_slot", "already_held", "qty_zero", ""} == set(want.values())
    assert {o.event_id: o.skip_reason for o in bt.outcomes_of(found).collect()} == want
    assert {t.event_id: t.pnl for t in bt.trades_of(found).collect()} == pytest.approx(pnl)
    assert bt.daily_of(found).orderBy(F.desc("pos")).first().equity == pytest.approx(equity)
    assert "MapInArrow" in plan and "FlatMapGroupsIn" not in plan  # no group of a run's signals
    assert bt.itineraries(signals, spark.createDataFrame(board, BOARD), {"x": cfg}, {"x": ["x"]}).count() == len({r[2:3] + r[6:8] for r in rows}) < 300
    assert {r.kind for r in bt.run_backtests(signals, spark.createDataFrame(board, BOARD), {"x": cfg}, outcomes=False).collect()} == {"trade", "day"}


def test_refusals_are_asked_anew_after_an_entry(spark):
    """Cash of a short lets in what was refused for cash earlier on the same day."""
    secids = {"A": 1e9, "B": 1e9, "C": 1e9, "D": 1e5, "E": 1e9}
    board = [(s, d, 10.0 * 3**d, 10.0 * 3**d, 10.0 * 3**d, 3, adv, 100.0) for s, adv in secids.items() for d in range(4)]
    asks = [("a", "A", 0, 1), ("b", "B", 0, 1), ("e", "E", 0, 1), ("c1", "C", 2, 1), ("c2", "C", 2, 1), ("d", "D", 2, -1), ("c3", "C", 2, 1), ("c4", "C", 2, 1)]
    rows = [("x", e, s, datetime(2024, 1, 1, k), "c", side, side, d, "pending", "", 0, 3) for k, (e, s, d, side) in enumerate(asks)]
    cfg = bt.BacktestConfig(hold_days=5, max_positions=5, allow_short=True, min_cash_fraction=0.95, **PLAIN | {"max_participation": 1.0})
    out = bt.run_backtests(spark.createDataFrame(rows, SIGNALS), spark.createDataFrame(board, BOARD), {"x": cfg})
    assert {o.event_id: o.skip_reason for o in bt.outcomes_of(out).collect()} == {"a": "", "b": "", "e": "", "c1": "no_cash", "c2": "no_cash", "d": "", "c3": "", "c4": "already_held"}


def test_effect_is_found(spark, market):
    e, p, i = market
    cal = panel.trading_calendar(p, i)
    grid = panel.price_grid(p, cal)
    ret = panel.market_adjusted(panel.with_returns(grid), panel.index_series(i, cal))
    cfg = es.StudyConfig(min_est_obs=30)
    used = es.with_drop_reason(e.drop("pos"), grid, cal, cfg).filter("drop_reason IS NULL")
    fitted = es.market_model(used, ret, (-60, -5), 30).persist()
    s = {(r.category): r for r in es.summarize(es.signed(es.car_table(fitted, ret, ((0, 10),), model="market_model")), ("category",), "signed_car", "signed_bhar").collect()}
    assert s["insider"].mean_car > 0.02 and s["insider"].p_value < 1e-3
    assert abs(s["noise"].mean_car) < s["insider"].mean_car / 2


def test_windows_by_running_sums(spark, market):
    """Two look-ups give what the window's days give one by one, at both ends of the panel, with either model."""
    e, p, i = market
    cal = panel.trading_calendar(p, i)
    ret = panel.market_adjusted(panel.with_returns(panel.price_grid(p, cal)), panel.index_series(i, cal)).withColumn("ret", F.expr("CASE WHEN pos = 57 AND secid < 'S05' THEN -1.0D WHEN pos % 13 = 5 THEN NULL ELSE ret END")).persist()
    last = cal.agg(F.max("pos")).first()[0]
    ends = spark.createDataFrame([("e0", 0), ("e1", 1), ("e2", last), ("e3", last - 1), ("e4", 56)], "event_id string, t0_pos int").withColumn("secid", F.lit(ret.agg(F.min("secid")).first()[0]))
    ends = ends.unionByName(spark.createDataFrame([("e5", 5, "none")], "event_id string, t0_pos int, secid string"))
    ev = ends.select("event_id", "secid", F.lit("c").alias("category"), F.lit(1).alias("direction"), F.current_date().alias("t0"), "t0_pos", F.lit(0.001).alias("alpha"), F.lit(1.2).alias("beta"), (F.col("event_id") == "e1").alias("fallback"))
    windows = ((-3, -1), (-1, 1), (0, 0), (0, 5), (2, 9))
    for model in ("market_adjusted", "market_model"):
        days = es.event_ar(es.gather_window(ev, ret, -3, 9), model).toPandas()
        got = {(r.event_id, r.win_start, r.win_end): r for r in es.car_cells(ev, ret, windows, model).collect()}
        assert len(got) == 6 * len(windows)
        for (event, a, b), r in got.items():
            d = days[(days.event_id == event) & days.rel_day.between(a, b) & days.model_ar.notna()]
            assert r.n_days == len(d) and (r.car is None) == (len(d) == 0)
            if len(d):
                assert r.car == pytest.approx(d.model_ar.sum(), abs=1e-12) and r.raw_ret == pytest.approx((1 + d.ret).prod() - 1, abs=1e-12) and r.bhar == pytest.approx((1 + d.ret).prod() - (1 + d.mkt).prod(), abs=1e-12)
    plan = es.car_table(ev, staged(ret), windows)._jdf.queryExecution().executedPlan().toString()
    assert "sequence" not in plan and plan.count("Generate") == 1  # windows become rows, days do not


def test_gap_returns(spark):
    from datetime import date

    p = spark.createDataFrame([(date(2022, 1, 3), "A", 10.0), (date(2022, 1, 5), "A", 12.0), (date(2022, 1, 4), "B", 5.0)], "date date, secid string, close double")
    g = panel.price_grid(p, panel.trading_calendar(p))
    assert {r.pos: r.ret for r in panel.with_returns(g).filter("secid = 'A'").collect()} == {0: None, 1: None, 2: pytest.approx(0.2)}
    assert {r.pos: r.ret for r in panel.with_returns(g, fill_gaps=False).filter("secid = 'A'").collect()} == {0: None, 1: None, 2: None}


def test_metrics_are_the_definitions(spark, market):
    cfg, trades, daily, outcome = run(spark, market, hold_days=5, direction_filter=None, allow_short=True)
    out = spark.createDataFrame(outcome.assign(run_id="x"))
    m = bt.compute_metrics(spark.createDataFrame(daily), spark.createDataFrame(trades), cfg.initial_capital, out).first()
    ret, eq, net, pnl = daily.ret, daily.equity, trades.net_ret, trades.pnl
    years, year = len(daily) / 252, 252**0.5
    down = (ret.clip(upper=0) ** 2).mean() ** 0.5
    fall = (eq / eq.cummax() - 1).min()
    cagr = (eq.iloc[-1] / cfg.initial_capital) ** (1 / years) - 1
    diff = ret - daily.index_ret
    want = {
        "n_days": len(daily), "total_return": eq.iloc[-1] / cfg.initial_capital - 1, "cagr": cagr, "annual_vol": ret.std() * year, "sharpe": ret.mean() / ret.std() * year, "sortino": ret.mean() / down * year,
        "max_drawdown": fall, "calmar": cagr / abs(fall), "n_trades": len(trades), "hit_rate": (net > 0).mean(), "avg_win": net[net > 0].mean(), "avg_loss": net[net <= 0].mean(),
        "profit_factor": pnl[pnl > 0].sum() / -pnl[pnl < 0].sum(), "avg_hold_days": trades.hold_days.mean(), "avg_net_ret": net.mean(), "turnover": (trades.qty * (trades.entry_price + trades.exit_price)).sum() / eq.mean() / years,
        "total_commission": trades.commission.sum(), "exposure_avg": daily.exposure.mean(), "information_ratio": diff.mean() / diff.std() * year, "index_total_return": daily.index_equity.dropna().iloc[-1] / cfg.initial_capital - 1,
        "n_signals": len(outcome), "skipped_signals": (outcome.status == "skipped").sum(),
    }
    for k, v in want.items():
        assert m[k] == pytest.approx(v), k
    assert m.exit_reasons == trades.exit_reason.value_counts().to_dict()
    assert m.skipped_by_reason == outcome[outcome.status == "skipped"].skip_reason.value_counts().to_dict()
    won = spark.createDataFrame(trades[trades.pnl > 0])
    assert bt.compute_metrics(spark.createDataFrame(daily), won, cfg.initial_capital).first().profit_factor == float("inf")
    none = bt.compute_metrics(spark.createDataFrame(daily), won.limit(0), cfg.initial_capital).first()
    assert none.n_trades == 0 and none.turnover == 0 and none.profit_factor is None and none.exit_reasons == {}
    assert bt.daily_returns(spark.createDataFrame(daily), cfg.initial_capital).orderBy("pos").toPandas().ret.to_list() == pytest.approx(ret.to_list())


@pytest.mark.parametrize("entry", ["next_open", "t0_close", "next_close"])
def test_placebo_stays_in_the_real_range(spark, market, entry):
    e, p, i = market
    cfg = bt.BacktestConfig(hold_days=5, start="2022-03-01", end="2022-07-29", entry=entry)
    cal = panel.trading_calendar(p, i).persist()
    board = bt.backtest_panel(p, i, cfg).persist()
    real = bt.run_backtests(bt.prepare_signals(e.drop("pos"), p, cal, cfg).withColumn("run_id", F.lit("x")), board, {"x": cfg}).persist()
    trades, daily = bt.trades_of(real), bt.daily_of(real)
    fake, configs = bt.placebo(trades, daily, p, cal, board, cfg, n_iter=4)
    span, n = daily.agg(F.min("pos").alias("a"), F.max("pos").alias("b")).first(), trades.count()
    days = {r.date: r.pos for r in cal.collect()}
    got = fake.collect()
    assert n and len(got) == 4 * n and set(configs) == {f"p{k}" for k in range(4)} and {(r.start_pos, r.end_pos) for r in got} == {(span.a, span.b)}
    for r in got:
        at = days[r.published_at.date()]
        assert r.published_at.hour == 12 and span.a <= at <= span.b - cfg.hold_days - 2 and r.entry_pos == at + (entry != "t0_close")
    assert {r.secid for r in got} == {r.secid for r in trades.collect()}


def test_walk_forward_names_its_parameters(spark, market):
    e, p, i = market
    grid = {"hold_days": [3, 8], "entry": ["next_open", "t0_close"]}
    got = bt.walk_forward(e.drop("pos"), p, i, grid, "2022-06-01", base=bt.BacktestConfig(categories=("insider",))).collect()
    assert {(r.hold_days, r.entry) for r in got} == {(str(h), x) for h in (3, 8) for x in ("next_open", "t0_close")}
    assert [r.is_sharpe for r in got if r.best] == [max(r.is_sharpe for r in got)] and all(r.is_n_trades and r.oos_n_trades for r in got)
    cfg = bt.BacktestConfig(categories=("insider",), hold_days=8, entry="t0_close", end="2022-06-01")
    cal = panel.trading_calendar(p, i)
    s = bt.prepare_signals(e.drop("pos").filter("published_at < TIMESTAMP_NTZ'2022-06-01 00:00:00'"), p, cal, cfg).withColumn("run_id", F.lit("x"))
    one = bt.run_backtests(s, bt.backtest_panel(p, i, cfg), {"x": cfg}).persist()
    m = bt.compute_metrics(bt.daily_of(one), bt.trades_of(one)).first()
    assert [(r.is_sharpe, r.is_n_trades) for r in got if (r.hold_days, r.entry) == ("8", "t0_close")] == [(pytest.approx(m.sharpe), m.n_trades)]


def test_plans_have_no_products(spark, market):
    e, p, i = market
    cfg = bt.BacktestConfig()
    configs = {f"r{k}": cfg for k in range(3)}
    s = bt.signals_of_runs(e.drop("pos"), p, panel.trading_calendar(p, i), configs)
    plan = bt.run_backtests(s, bt.backtest_panel(p, i, cfg), configs)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    plain = spark.createDataFrame([], "secid string, date date, volume double, value double")
    assert "NestedLoop" not in panel.liquidity_stats(plain)._jdf.queryExecution().executedPlan().toString()
