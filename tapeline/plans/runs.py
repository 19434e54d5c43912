"""A study or a backtest from tables to artefacts: result tables, plot tables and a Markdown report in one folder."""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.operators import backtest as bt
from tapeline.operators import eventstudy as es
from tapeline.operators import panel
from tapeline.plans import report
from tapeline.sources import sinks
from tapeline.sources.scratch import staged

#: Hold periods that a walk-forward run tries.
HOLDS = [10, 20, 40, 60]


def run_study(events: DataFrame, prices: DataFrame, index: DataFrame, out: str, config: es.StudyConfig = es.StudyConfig(model="market_model"), path: tuple[int, int] = (-20, 60)) -> dict[str, DataFrame]:
    """Event study: diagnostics, CAR table, summary with intervals, screening and average paths, written to ``out``."""
    calendar = panel.trading_calendar(prices, index)
    grid = staged(panel.price_grid(prices, calendar))
    returns = staged(panel.market_adjusted(panel.with_returns(grid), panel.index_series(index, calendar)))
    marked = staged(es.with_drop_reason(events, grid, calendar, config))
    used = marked.filter("drop_reason IS NULL").drop("n_hist", "med_value")
    if config.model == "market_model":
        used = es.market_model(used, returns, config.est_window, config.min_est_obs)
    used = staged(used)
    windows = config.windows
    cars = staged(es.car_table(used, returns, windows, config.coverage, config.model))
    summary = es.summarize(cars)
    if config.bootstrap:
        summary = summary.join(es.bootstrap_ci(cars, draws=config.bootstrap, seed=config.seed).drop("n"), ["category", "direction", "window"], "left")
    summary = staged(summary)
    paths = es.average_path(es.event_ar(es.gather_window(used, returns, *path), config.model))
    tables = {
        "diagnostics": marked.groupBy(F.coalesce("drop_reason", F.lit("used")).alias("reason")).agg(F.count(F.lit(1)).alias("n")),
        "car_table": cars, "summary": summary, "screening": es.screen(summary, "[0,20]", min_n=30), "car_paths": staged(paths),
    }
    sinks.save_artifacts({"car_table": tables["car_table"]}, out)
    sinks.save_artifacts({k: tables[k] for k in ("summary", "screening", "car_paths")}, out, "csv")
    sinks.save_artifacts({"car_curves": report.car_curves(tables["car_paths"])}, out)
    sections = {"Diagnostics": tables["diagnostics"], "Screening of categories, window [0,20]": tables["screening"].orderBy("rank"), "Summary": summary.orderBy("category", "direction", "win_start", "win_end")}
    report.write_report(f"{out}/event_study.md", "Event study", sections)
    return tables


def run_backtest(events: DataFrame, prices: DataFrame, index: DataFrame, out: str, config: bt.BacktestConfig = bt.BacktestConfig(), split: str | None = None, placebo_runs: int = 200) -> dict[str, DataFrame]:
    """Backtest: trades, equity, metrics, and where asked for the placebo and walk-forward tables, written to ``out``."""
    calendar = panel.trading_calendar(prices, index)
    board = staged(bt.backtest_panel(prices, index, config))
    signals = staged(bt.prepare_signals(events, prices, calendar, config)).withColumn("run_id", F.lit("real"))
    done = staged(bt.run_backtests(signals, board, {"real": config}))
    trades, daily = bt.trades_of(done), bt.daily_of(done)
    metrics = staged(bt.compute_metrics(daily, trades, config.initial_capital, bt.outcomes_of(done)))
    tables = {"trades": trades, "equity": daily, "metrics": metrics}
    sinks.save_artifacts({"trades": trades, "equity": daily}, out, "csv")
    sinks.save_artifacts({"equity_curves": report.equity_curves(daily)}, out)
    row = metrics.first()
    sections: dict = {"Strategy": {k: v for k, v in (row.asDict() if row else {}).items() if k != "run_id"}, "Configuration": asdict(config)}
    if placebo_runs and not trades.isEmpty():
        fake, configs = bt.placebo(trades, daily, prices, calendar, board, config, n_iter=placebo_runs)
        runs = staged(bt.run_backtests(fake, board, configs, outcomes=False))
        tables["placebo"] = staged(bt.placebo_table(bt.compute_metrics(bt.daily_of(runs), bt.trades_of(runs), config.initial_capital), metrics))
        sections[f"Placebo: the same trades on random days, {placebo_runs} runs"] = tables["placebo"]
    if split:
        tables["walk_forward"] = staged(bt.walk_forward(events, prices, index, {"hold_days": HOLDS}, split, base=replace(config, start=None, end=None)))
        best = tables["walk_forward"].filter("best")
        pairs = ", ".join(f"'{n}', CAST(is_{n} AS DOUBLE), CAST(oos_{n} AS DOUBLE)" for n in bt.KEY_METRICS)
        sections[f"Walk-forward, split on {split}"] = best.select("hold_days", F.expr(f"stack({len(bt.KEY_METRICS)}, {pairs}) AS (metric, in_sample, out_of_sample)"))
    report.write_report(f"{out}/backtest.md", "Backtest", sections)
    return tables
