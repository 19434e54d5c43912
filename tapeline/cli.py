"""Command line over landed tables: ``python -m tapeline.cli study --data DIR --out DIR`` and the like.

DIR holds prices, index, events, messages, history pages and so on as Parquet folders or stores. There are no network
commands: pages and answers are read as they were landed.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline import schema
from tapeline.functions import text
from tapeline.operators import backtest as bt
from tapeline.operators import eventstudy as es
from tapeline.operators import mapping
from tapeline.plans import report, runs
from tapeline.sources import feeds, sinks, synthetic


def _names(text: str | None) -> list[str] | None:
    return [x.strip() for x in text.split(",") if x.strip()] if text else None


def _market(spark: SparkSession, data: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(sinks.load(spark, f"{data}/{name}", ddl) for name, ddl in (("events", schema.EVENTS), ("prices", schema.PRICES), ("index", schema.INDEX)))


def study(spark: SparkSession, a: argparse.Namespace) -> None:
    events, prices, index = _market(spark, a.data)
    if _names(a.categories):
        events = events.filter(F.col("category").isin(_names(a.categories)))
    out = runs.run_study(events, prices, index, a.out, es.StudyConfig(model=a.model, bootstrap=a.bootstrap))
    print(report.markdown_table(out["screening"].orderBy("rank")))


def backtest(spark: SparkSession, a: argparse.Namespace) -> None:
    events, prices, index = _market(spark, a.data)
    config = bt.BacktestConfig(hold_days=a.hold_days, direction_filter=a.direction, allow_short=a.direction < 0, categories=tuple(_names(a.categories) or ()) or None)
    out = runs.run_backtest(events, prices, index, a.out, config, a.split_date, a.placebo)
    print(report.markdown_table(out["metrics"].select("n_trades", "total_return", "cagr", "sharpe", "max_drawdown", "alpha_t")))


def demo(spark: SparkSession, a: argparse.Namespace) -> None:
    moved = synthetic.events(spark, days=750, n=400, seed=a.seed)
    events, prices, index = moved.drop("pos"), synthetic.prices(spark, days=750, seed=a.seed, moved_by=moved), synthetic.index(spark, days=750, seed=a.seed)
    runs.run_study(events, prices, index, a.out)
    runs.run_backtest(events, prices, index, a.out, bt.BacktestConfig(hold_days=10, categories=("insider",)), placebo_runs=50)
    print(os.path.join(a.out, "event_study.md"), os.path.join(a.out, "backtest.md"))


def prices(spark: SparkSession, a: argparse.Namespace) -> None:
    """Landed history pages (list, start, payload) into the price store, behind each security's last stored day."""
    pages = feeds.listed_pages(spark.read.parquet(f"{a.data}/history_pages"), "history", key="list")
    stored = sinks.append_prices(feeds.history_to_prices(pages), f"{a.data}/prices", schema.PRICES)
    print(0 if stored is None else stored.count())


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    """Landed pages (list, start, payload) of the benchmark's history into the index store; a day that comes again replaces the stored one."""
    pages = feeds.listed_pages(spark.read.parquet(f"{a.data}/index_pages"), "history", key="list")
    print(sinks.append_dedup(feeds.index_history(pages), f"{a.data}/index", schema.INDEX, ["date"]).count())


def securities(spark: SparkSession, a: argparse.Namespace) -> None:
    """Landed pages (list, start, payload) of the lists of shares, traded and delisted, into the securities store."""
    pages = feeds.listed_pages(spark.read.parquet(f"{a.data}/securities_pages"), "securities", key="list")
    print(sinks.append_dedup(feeds.listed_securities(pages), f"{a.data}/securities", schema.SECURITIES, ["secid"]).count())


def companies(spark: SparkSession, a: argparse.Namespace) -> None:
    """Landed company pages (html) whose INN is that of a listed issuer into the company store."""
    listed = mapping.primary_security(sinks.load(spark, f"{a.data}/securities", schema.SECURITIES)).select("inn").distinct()
    found = feeds.company_pages(spark.read.parquet(f"{a.data}/company_pages")).select("company.*").filter("company_id IS NOT NULL")
    known = found.withColumn("inn", text.normalize_inn(F.col("inn"))).join(listed, "inn", "left_semi")
    print(sinks.append_dedup(known, f"{a.data}/companies", schema.COMPANIES, ["company_id"]).count())


def messages(spark: SparkSession, a: argparse.Namespace) -> None:
    """Landed search answers (payload) and list pages (html) into the message store."""
    parts = [feeds.search_json(spark.read.parquet(f"{a.data}/search_answers"))] if sinks.exists(spark, f"{a.data}/search_answers") else []
    if sinks.exists(spark, f"{a.data}/list_pages"):
        parts.append(feeds.message_lists(spark.read.parquet(f"{a.data}/list_pages")))
    for part in parts:
        sinks.append_dedup(part, f"{a.data}/messages", schema.MESSAGES, ["event_id"])
    print(sinks.load(spark, f"{a.data}/messages", schema.MESSAGES).count())


def events(spark: SparkSession, a: argparse.Namespace) -> None:
    """Messages, companies and securities into the event store, with the stake changes of landed event pages (JSON)."""
    load = lambda name, ddl: sinks.load(spark, f"{a.data}/{name}", ddl)
    trades = None
    if sinks.exists(spark, f"{a.data}/event_pages"):
        trades = mapping.insider_trades(feeds.scan_event_json(spark, f"{a.data}/event_pages"))
    made = mapping.events_table(load("messages", schema.MESSAGES), load("companies", schema.COMPANIES), mapping.primary_security(load("securities", schema.SECURITIES)), trades, _names(a.categories))
    sinks.replace(made, f"{a.data}/events")
    print(sinks.load(spark, f"{a.data}/events", schema.EVENTS).count())


def counts(spark: SparkSession, a: argparse.Namespace) -> None:
    """Messages by year, of some categories or all."""
    m = mapping.classify_messages(sinks.load(spark, f"{a.data}/messages", schema.MESSAGES)).withColumn("year", F.year("published_at"))
    if _names(a.categories):
        m = m.filter(F.col("category").isin(_names(a.categories)))
    m = m.filter(F.col("year").between(a.year_from, a.year_till))
    print(report.markdown_table(m.groupBy("year").agg(F.count(F.lit(1)).alias("n")).orderBy("year")))


COMMANDS = {f.__name__: f for f in (study, backtest, demo, prices, index, securities, companies, messages, events, counts)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tapeline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    made = {name: sub.add_parser(name, help=(f.__doc__ or name).split("\n")[0]) for name, f in COMMANDS.items()}
    for name, s in made.items():
        if name != "demo":
            s.add_argument("--data", required=True)
        if name in ("study", "backtest", "demo"):
            s.add_argument("--out", required=True)
        if name in ("study", "backtest", "events", "counts"):
            s.add_argument("--categories", default="insider_stake_change" if name in ("backtest", "events") else None, help="comma-separated")
    made["study"].add_argument("--model", default="market_model", choices=["market_model", "market_adjusted"])
    made["study"].add_argument("--bootstrap", type=int, default=2000)
    made["backtest"].add_argument("--hold-days", type=int, default=20)
    made["backtest"].add_argument("--direction", type=int, default=1, choices=[1, -1, 0])
    made["backtest"].add_argument("--split-date")
    made["backtest"].add_argument("--placebo", type=int, default=200)
    made["demo"].add_argument("--seed", type=int, default=0)
    made["counts"].add_argument("--from", dest="year_from", type=int, default=2012)
    made["counts"].add_argument("--till", dest="year_till", type=int, default=9999)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    COMMANDS[a.command](spark or SparkSession.builder.appName("tapeline").getOrCreate(), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
