"""Registered queries of the simulation and of the parsers; imported for its effect on the catalog."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeline.functions import text
from tapeline.operators import backtest as bt
from tapeline.operators import panel
from tapeline.plans.catalog import GRID, MKT, calendar, query, r, rounded
from tapeline.plans.catalog import m as market
from tapeline.sources import feeds
from tapeline.sources.scratch import shared_dir, staged

CONFIG = bt.BacktestConfig(hold_days=10, min_turnover=5e4, allow_short=True, direction_filter=None, max_participation=0.5)
SIGNAL_SQL = "WITH " + GRID + MKT + "," + market.EVENTS_SQL + """,
sg AS (
  SELECT e.*, direction AS side, CASE WHEN o.pos IS NOT NULL AND extract(hour FROM published_at) < 10 THEN o.pos ELSE (SELECT min(pos) FROM cal WHERE date > CAST(published_at AS DATE)) END AS entry_pos
  FROM events_d e LEFT JOIN cal o ON o.date = CAST(e.published_at AS DATE) WHERE direction <> 0
),
sig AS (SELECT *, CASE WHEN entry_pos IS NULL THEN 'no_trading_day' WHEN secid NOT IN (SELECT secid FROM prices) THEN 'unknown_secid' ELSE '' END AS skip_reason FROM sg)"""


def board(s, d):
    return bt.backtest_panel(market.prices(s, d), market.index(s, d), CONFIG)


def signals(s, d, config=CONFIG):
    return bt.prepare_signals(market.events(s, d), market.prices(s, d), calendar(s, d), config)


def runs(s, d, outcomes=True):
    return bt.run_backtests(staged(signals(s, d)).withColumn("run_id", F.lit("base")), board(s, d), {"base": CONFIG}, outcomes=outcomes)


def flat(df):
    """Maps as JSON text, numbers rounded: what a table of results shows."""
    return rounded(df.select(*[F.to_json(c).alias(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes]), 4)


@query("backtest_panel", "WITH " + GRID + MKT + """ SELECT g.secid, g.pos, last_value(g.close IGNORE NULLS) OVER (PARTITION BY secid ORDER BY g.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_close, k.mkt_close,
  round(CASE WHEN count(value) OVER w >= 20 THEN quantile_cont(value, 0.5) OVER w END, 4) AS adv FROM grid g JOIN mk k ON k.pos = g.pos WINDOW w AS (PARTITION BY secid ORDER BY g.pos ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""")
def backtest_panel(s, d):
    return board(s, d).select("secid", "pos", "last_close", "mkt_close", r("adv", 4).alias("adv"))


@query("prepare_signals", SIGNAL_SQL + " SELECT event_id, secid, side, entry_pos, CASE WHEN skip_reason = '' THEN 'pending' ELSE 'skipped' END AS status, skip_reason FROM sig")
def prepare_signals(s, d):
    return signals(s, d).select("event_id", "secid", "side", "entry_pos", "status", "skip_reason")


ENTRY = SIGNAL_SQL + """,
ent AS (SELECT s.event_id, s.secid, s.category, s.side, arg_min(g.pos, g.pos) AS entry_pos, arg_min(g.open, g.pos) AS raw
  FROM sig s JOIN grid g ON g.secid = s.secid AND g.pos BETWEEN s.entry_pos AND s.entry_pos + 3 AND g.open IS NOT NULL WHERE s.skip_reason = '' GROUP BY ALL),
ex AS (SELECT e.*, arg_min(g.pos, g.pos) AS exit_pos, arg_min(g.close, g.pos) AS xraw FROM ent e JOIN grid g ON g.secid = e.secid AND g.pos >= e.entry_pos + 10 AND g.close IS NOT NULL GROUP BY ALL)"""


@query("entry_fill", ENTRY + " SELECT event_id, entry_pos, raw AS entry_price_raw FROM ent")
def entry_fill(s, d):
    tries = signals(s, d).filter("status = 'pending'").withColumn("pos", F.explode(F.sequence(F.col("entry_pos"), F.least(F.col("entry_pos") + 3, F.col("end_pos")))))
    got = tries.join(board(s, d).select("secid", "pos", "open"), ["secid", "pos"]).filter("open IS NOT NULL")
    return got.groupBy("event_id").agg(F.min("pos").alias("entry_pos"), F.min_by("open", "pos").alias("entry_price_raw"))


@query("signal_trades", ENTRY + """ SELECT event_id, secid, category, side, entry_pos, exit_pos, raw AS entry_price_raw, xraw AS exit_price_raw, round(side * (xraw / raw - 1), 4) + 0.0 AS gross_ret,
  round(side * (xraw * (1 - side * 0.001) / (raw * (1 + side * 0.001)) - 1) - 0.0005 * (1 + xraw * (1 - side * 0.001) / (raw * (1 + side * 0.001))), 4) + 0.0 AS net_ret FROM ex""")
def signal_trades(s, d):
    x = bt.signal_trades(signals(s, d), board(s, d), CONFIG)
    return x.withColumn("gross_ret", r("gross_ret", 4)).withColumn("net_ret", r("net_ret", 4))


@query("skip_reasons")
def skip_reasons(s, d):
    return bt.outcomes_of(runs(s, d)).filter("status = 'skipped'").groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))


@query("backtest_trades")
def backtest_trades(s, d):
    return rounded(bt.trades_of(runs(s, d, outcomes=False)), 4)


@query("backtest_daily")
def backtest_daily(s, d):
    return rounded(bt.daily_of(runs(s, d, outcomes=False)), 4)


@query("backtest_metrics")
def backtest_metrics(s, d):
    x = staged(runs(s, d))
    return flat(bt.compute_metrics(bt.daily_of(x), bt.trades_of(x), CONFIG.initial_capital, bt.outcomes_of(x)))


@query("max_drawdown", "WITH " + GRID + " , e AS (SELECT secid AS run_id, pos, close AS equity FROM grid WHERE close IS NOT NULL) SELECT run_id, round(min(equity / m - 1), 6) + 0.0 AS max_drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY run_id ORDER BY pos) AS m FROM e) GROUP BY 1")
def max_drawdown(s, d):
    e = board(s, d).filter("close IS NOT NULL").select(F.col("secid").alias("run_id"), "pos", F.col("close").alias("equity"))
    return bt.drawdown(e).groupBy("run_id").agg(r(F.min("drawdown")).alias("max_drawdown"))


@query("walk_forward")
def walk_forward(s, d):
    return rounded(bt.walk_forward(market.events(s, d), market.prices(s, d), market.index(s, d), {"hold_days": [5, 10, 20]}, "1995-06-01", base=CONFIG), 4)


@query("walk_forward_table")
def walk_forward_table(s, d):
    w = walk_forward(s, d).filter("best")
    names = bt.KEY_METRICS
    return w.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', CAST(is_{n} AS DOUBLE), CAST(oos_{n} AS DOUBLE)" for n in names) + ") AS (metric, in_sample, out_of_sample)"))


#: As many as the reference runs.
PLACEBO_RUNS = 200


@query("placebo")
def placebo(s, d):
    x, b = staged(runs(s, d, outcomes=False)), staged(board(s, d))
    fake, configs = bt.placebo(bt.trades_of(x), bt.daily_of(x), market.prices(s, d), calendar(s, d), b, CONFIG, n_iter=PLACEBO_RUNS)
    y = staged(bt.run_backtests(fake, b, configs, outcomes=False))
    return rounded(bt.compute_metrics(bt.daily_of(y), bt.trades_of(y), CONFIG.initial_capital).select("run_id", "sharpe", "total_return", "n_trades"), 4)


@query("placebo_table")
def placebo_table(s, d):
    return rounded(bt.placebo_table(placebo(s, d), backtest_metrics(s, d)), 4)


# ---------------------------------------------------------------- parsers over landed payloads


def payloads(s, d):
    """Answers in the block form, one a security and year, made from the price table."""
    p = market.prices(s, d)
    row = F.array(F.col("date").cast("string"), "secid", *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume", "value", "numtrades")])
    names = F.array(*[F.lit(x) for x in ("TRADEDATE", "SECID", "OPEN", "HIGH", "LOW", "CLOSE", "VOLUME", "VALUE", "NUMTRADES")])
    g = p.groupBy("secid", F.year("date").alias("year")).agg(F.collect_list(row).alias("data"))
    return g.select("secid", F.to_json(F.struct(F.struct(names.alias("columns"), "data").alias("history"))).alias("payload"))


@query("json_block", "WITH " + market.PRICES_SQL + " SELECT secid, date AS tradedate, close FROM prices")
def json_block(s, d):
    return feeds.json_block(payloads(s, d), "history", {"SECID": "string", "TRADEDATE": "date", "CLOSE": "double"})


@query("history_to_prices", "WITH " + market.PRICES_SQL + " SELECT date, secid, open, high, low, close, volume, value, numtrades FROM prices")
def history_to_prices(s, d):
    return feeds.history_to_prices(payloads(s, d))


@query("prepare_prices", "WITH " + market.PRICES_SQL + " SELECT date, secid, close FROM prices")
def prepare_prices(s, d):
    p = market.prices(s, d)
    twice = p.withColumn("seq", F.lit(0)).unionByName(p.withColumn("close", F.lit(0.0)).withColumn("seq", F.lit(-1)))
    return panel.keep_one(twice, ["secid", "date"], [F.desc("seq")]).select("date", "secid", "close")


def in_pages(s, rows, columns, rows_a_page=100):
    """Answers of ``rows_a_page`` rows (list, page, payload), in order of date; every second list repeats its last page, as sites do beyond the end."""
    import uuid

    from tapeline.sources import paged

    at = F.row_number().over(W.partitionBy("list").orderBy("date")) - 1
    dealt = rows.withColumn("_at", at).withColumn("page", F.expr(f"_at div {rows_a_page}").cast("bigint"))
    row = F.array(*[F.col(c).cast("string") for c in columns.values()])
    data = F.transform(F.sort_array(F.collect_list(F.struct("_at", row.alias("r")))), lambda x: x["r"])
    pages = dealt.groupBy("list", "page").agg(F.to_json(F.struct(F.struct(F.array(*map(F.lit, columns)).alias("columns"), data.alias("data")).alias("history"))).alias("payload"))
    last = pages.groupBy("list").agg(F.max("page").alias("page"), F.max_by("payload", "page").alias("payload")).filter(F.crc32(F.col("list").cast("binary")) % 2 == 0).withColumn("page", F.col("page") + 1)
    path = f"{shared_dir(s)}/pages-{uuid.uuid4().hex}"
    pages.unionByName(last).write.partitionBy("list", "page").text(path)
    paged.register(s)
    return s.read.format("landed_pages").option("path", path).option("block", "history").option("limit", rows_a_page).load()


@query("paged_history", "WITH " + market.PRICES_SQL + " SELECT date, secid, open, high, low, close, volume, value, numtrades FROM prices")
def paged_history(s, d):
    """Histories landed page by page, read by the paged source until each list ends."""
    names = {"TRADEDATE": "date", "SECID": "secid", **{c.upper(): c for c in ("open", "high", "low", "close", "volume", "value", "numtrades")}}
    return feeds.history_to_prices(in_pages(s, market.prices(s, d).withColumn("list", F.col("secid")), names))


@query("paged_index", "WITH " + market.INDEX_SQL + " SELECT date, close FROM idx")
def paged_index(s, d):
    return feeds.index_history(in_pages(s, market.index(s, d).withColumn("list", F.lit("IDX")), {"TRADEDATE": "date", "CLOSE": "close"}))


@query("cached_answers", """WITH a AS (SELECT page_id % 7 AS key, (SELECT min(ts) FROM events) + page_id * INTERVAL 3 HOUR AS landed_at, page_id FROM pages WHERE page_id % 5 <> 0 AND length(html) > 0),
r AS (SELECT event_id, user_id % 7 AS key, ts AS asked_at FROM events)
SELECT event_id, CASE WHEN asked_at < landed_at + INTERVAL 24 HOUR THEN page_id END AS page_id FROM r ASOF LEFT JOIN a ON r.key = a.key AND r.asked_at >= a.landed_at""")
def cached_answers(s, d):
    """Pages that land every three hours under a few keys, every fifth of them a captcha, and requests at the events' times, with a day to live."""
    e, p = market.table(s, d, "events"), market.table(s, d, "pages")
    first = e.agg(F.min("ts").alias("first"))
    body = F.when(F.col("page_id") % 5 == 0, F.lit("<script src=captchaintgen>")).when(F.length("html") > 0, F.col("page_id").cast("string"))
    answers = p.join(F.broadcast(first)).select((F.col("page_id") % 7).alias("key"), F.expr("first + make_dt_interval(0, page_id * 3)").alias("landed_at"), body.alias("body"))
    requests = e.select("event_id", (F.col("user_id") % 7).alias("key"), F.col("ts").alias("asked_at"))
    return feeds.cached_answers(requests, answers, 24 * 3600).select("event_id", F.col("body").cast("bigint").alias("page_id"))


def grown_store(s, d):
    """A price store made of three appends, of which the later ones bring back-fill that is left out."""
    import uuid

    from tapeline.schema import PRICES
    from tapeline.sources.ranged import Store

    p, path = market.prices(s, d), f"{shared_dir(s)}/store-{uuid.uuid4().hex}"
    fresh = lambda: Store(s, path, PRICES)
    fresh().append(p.filter("date < DATE'1995-01-01'"))
    fresh().append(p.filter("date < DATE'1997-01-01'").withColumn("close", F.when(F.col("date") < "1995-01-01", -1.0).otherwise(F.col("close"))))
    fresh().append(p.filter("date >= DATE'1996-06-01'").withColumn("close", F.when(F.col("date") < "1997-01-01", -1.0).otherwise(F.col("close"))))
    return fresh()


#: A security without trades before a cut has its first row behind it: only rows behind its own mark count.
@query("incremental_store", "WITH " + market.PRICES_SQL + " SELECT date, secid, close, value FROM prices")
def incremental_store(s, d):
    return grown_store(s, d).scan().select("date", "secid", "close", "value")


@query("stored_marks", "WITH " + market.PRICES_SQL + " SELECT secid, max(date) AS last_date FROM prices GROUP BY 1")
def stored_marks(s, d):
    return grown_store(s, d).marks()


@query("stored_span", "WITH " + market.PRICES_SQL + " SELECT date, secid, close FROM prices WHERE date BETWEEN DATE '1994-12-01' AND DATE '1995-02-01'")
def stored_span(s, d):
    """Two months of all securities: files of other dates are not opened."""
    return grown_store(s, d).scan(start="1994-12-01", end="1995-02-01").select("date", "secid", "close")


@query("security_description", "SELECT 'S' || CAST(p_partkey AS VARCHAR) AS secid, p_name AS name, 'B' || CAST(p_size AS VARCHAR) AS primary_board FROM part")
def security_description(s, d):
    p = market.table(s, d, "part")
    text_ = F.concat(F.lit('{"description": {"columns": ["name", "title", "value"], "data": [["NAME", "t", "'), "p_name", F.lit('"]]}, "boards": {"columns": ["secid", "boardid", "is_primary"], "data": [["x", "ZZ", "0"], ["x", "B'), F.col("p_size").cast("string"), F.lit('", "1"]]}}'))
    x = feeds.security_description(p.select(F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("secid"), text_.alias("payload")))
    return x.select("secid", F.col("description")["NAME"].alias("name"), "primary_board")


#: A thousand ids a page: pages grow in number with the events, not in length.
PAGE = "event_id div 1000"


@query("parse_search_json", "SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id // 1000 % 3 < 2 THEN CAST(user_id AS BIGINT) END AS company_id, event_type, CASE event_id // 1000 % 3 WHEN 1 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS published_at, 'https://e-disclosure.ru/portal/event.aspx?EventId=' || event_id AS url FROM events")
def parse_search_json(s, d):
    """Answers in three shapes: under a known list, under a later one behind an empty list, and under a name nobody knows."""
    e, iso = market.table(s, d, "events"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    named = lambda **c: F.collect_list(F.struct(*[v.alias(k) for k, v in c.items()]))
    event, user, kind = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.concat(F.lit("<b>"), "event_type", F.lit("</b>"))
    g = e.groupBy(F.expr(PAGE).alias("page")).agg(named(EventGuid=event, companyID=user, eventName=kind, eventDate=iso).alias("foundEventsList"), named(guid=event, orgId=user, Title=kind, dt=F.date_format("ts", "dd.MM.yyyy HH:mm")).alias("items"), named(code=event, highlighted=kind, seen=iso).alias("unknown"))
    empty = F.array().cast("array<string>").alias("events")
    shape = F.when(F.col("page") % 3 == 0, F.to_json(F.struct("foundEventsList"))).when(F.col("page") % 3 == 1, F.to_json(F.struct(empty, "items"))).otherwise(F.to_json(F.struct("page", "unknown")))
    return feeds.search_json(g.select(shape.alias("payload"))).select("event_id", "company_id", "event_type", "published_at", "url")


def _lists(s, d):
    e = market.table(s, d, "events")
    row = F.concat(F.lit("<tr><td>"), F.date_format("ts", "dd.MM.yyyy HH:mm"), F.lit("</td><td><a href='/portal/company.aspx?id="), F.col("user_id").cast("string"), F.lit("'>К&nbsp;"), F.col("user_id").cast("string"), F.lit("</a></td><td><a href='/portal/event.aspx?EventId=e"), F.col("event_id").cast("string"), F.lit("'>"), "event_type", F.lit("</a></td></tr>"))
    return e.groupBy(F.expr(PAGE).alias("page")).agg(F.concat(F.lit("<html><body><table>"), F.concat_ws("", F.collect_list(row)), F.lit("</table></body></html>")).alias("html"))


@query("parse_message_list", "SELECT 'e' || CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS BIGINT) AS company_id, 'К ' || CAST(user_id AS VARCHAR) AS company_name, date_trunc('minute', ts) AS published_at, event_type FROM events")
def parse_message_list(s, d):
    return feeds.message_lists(_lists(s, d)).drop("url")


EVENT_SQL = """WITH p AS (SELECT *, p_partkey % 3 AS v, DATE '2020-01-01' + CAST(p_partkey % 1000 AS INTEGER) AS day FROM part)
SELECT p_partkey, 'E-' || p_partkey AS event_id, CASE WHEN v = 2 THEN 'x' ELSE p_name END AS title, CASE WHEN v < 2 THEN CAST(p_partkey AS BIGINT) END AS company_id, CASE v WHEN 0 THEN 'ПАО ' || p_brand WHEN 1 THEN 'АО ' || p_type ELSE 'ООО ' || p_brand END AS company_name,
  CASE v WHEN 2 THEN day::TIMESTAMP ELSE day::TIMESTAMP + INTERVAL 12 HOUR + INTERVAL 30 MINUTE END AS published_at, CASE v WHEN 1 THEN '' ELSE p_type END AS event_type FROM p"""


@query("parse_event_page", EVENT_SQL)
def parse_event_page(s, d):
    """Three kinds of pages: one with all fields named, one that says only when, one without links and headings."""
    p = market.table(s, d, "part").withColumn("day", F.date_format(F.expr("date_add(DATE'2020-01-01', CAST(p_partkey % 1000 AS INT))"), "dd.MM.yyyy"))
    k = F.col("p_partkey").cast("string")
    company = lambda name: F.concat(F.lit("<a href='/portal/company.aspx?id="), k, F.lit("'>"), name, F.lit("</a>"))
    event = F.concat(F.lit("<a href='/portal/event.aspx?EventId=E-"), k, F.lit("'>here</a>"))
    full = F.concat(F.lit("<html><head><title>x</title><script>var a='Тип события: нет';</script></head><body><h1>"), "p_name", F.lit("</h1>"), company(F.concat(F.lit("ПАО "), "p_brand")), event, F.lit("<div>Дата публикации: "), "day", F.lit(" 12:30<br>Тип сообщения: "), "p_type", F.lit("<br>Текст</div></body></html>"))
    bare = F.concat(F.lit("<body><nav>Тип события: меню</nav><h2>"), "p_name", F.lit("</h2>"), event, company(F.concat(F.lit("АО&nbsp;"), "p_type")), F.lit("<p>"), "day", F.lit("  12:30</p></body>"))
    said = F.concat(F.lit("<title>x</title><link rel='canonical' href='/portal/event.aspx?EventId=E-"), k, F.lit("'><body><form>Эмитент: поиск</form><div id='cont_wrap'>"), F.lit("слово " * 50), F.lit("<br>Эмитент: ООО "), "p_brand", F.lit("<br>Существенный факт: "), "p_type", F.lit("<br>Опубликовано: "), "day", F.lit("</div>Тип события: подвал</body>"))
    page = F.when(F.col("p_partkey") % 3 == 0, full).when(F.col("p_partkey") % 3 == 1, bare).otherwise(said)
    return feeds.event_pages(p.select("p_partkey", page.alias("html"))).select("p_partkey", *[f"event.{c}" for c in ("event_id", "title", "company_id", "company_name", "published_at", "event_type")])


@query("parse_company_page", "SELECT p_partkey, p_name AS name, lpad(CAST(p_partkey AS VARCHAR), 10, '7') AS inn, 'Москва' AS region FROM part")
def parse_company_page(s, d):
    p = market.table(s, d, "part")
    page = F.concat(F.lit("<html><body><h1>"), "p_name", F.lit("</h1><p>ИНН: "), F.lpad(F.col("p_partkey").cast("string"), 10, "7"), F.lit("</p>\n<p>Регион: Москва</p>\n</body></html>"))
    return feeds.company_pages(p.select("p_partkey", page.alias("html"))).select("p_partkey", "company.name", "company.inn", "company.region")


def stakes(s, d):
    """Four kinds of reports: numbered lines, one line of items, a controlled body, common shares only."""
    p = market.table(s, d, "part")
    n = lambda k: F.concat((F.col("p_partkey") * k % 50).cast("string"), F.lit(",5 %"))
    day = F.date_format(F.expr("date_add(DATE'2020-01-01', CAST(p_partkey % 1000 AS INT))"), "dd.MM.yyyy")
    join = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    name = F.col("p_name")
    lines = join("2.1. Фамилия, имя, отчество: ", name, ";\n2.2. Должность: член совета директоров\n2.3. Размер доли в уставном капитале эмитента до изменения: ", n(3), "\n2.4. Размер доли в уставном капитале эмитента после изменения: ", n(7), "\n2.5. Дата, в которую эмитент узнал об изменении: ", day)
    one = join("1. ФИО: ", name, "; 2. Доля до изменения: ", n(3), "; 3. Доля после изменения: ", n(7), "; 4. Дата получения уведомления: ", day, "; 5. Должность: директор")
    body = join("Ф. И. О.: ", name, "\nНаименование подконтрольной организации: ", F.col("p_brand"), "\nДоля в организации до изменения: ", n(3), "\nДоля в организации после изменения: ", n(7), "\nДата изменения: 31.02.2020")
    common = join("Должность: акционер\nДоля обыкновенных акций до изменения: ", n(3), "\nДоля обыкновенных акций после изменения: ", n(7), "\nДоля после изменения: не применимо\nУведомлен, дата: ", day)
    return p.select("p_partkey", F.element_at(F.array(lines, one, body, common), (F.col("p_partkey") % 4).cast("int") + 1).alias("body_text"))


STAKE_SQL = """WITH p AS (SELECT p_partkey, p_name, p_brand, p_partkey % 4 AS v, p_partkey * 3 % 50 + 0.5::DOUBLE AS a, p_partkey * 7 % 50 + 0.5::DOUBLE AS b, DATE '2020-01-01' + CAST(p_partkey % 1000 AS INTEGER) AS day FROM part)
SELECT p_partkey, CASE WHEN v < 3 THEN p_name END AS person, ['член совета директоров', 'директор', NULL, 'акционер'][v + 1] AS position, CASE WHEN v = 2 THEN p_brand END AS organization, v = 2 AS is_subsidiary,
  CASE WHEN v < 3 THEN a END AS share_before, CASE WHEN v < 3 THEN b END AS share_after, CASE WHEN v = 3 THEN a END AS common_before, CASE WHEN v = 3 THEN b END AS common_after,
  CASE WHEN v <> 2 THEN day END AS change_date, CAST(sign(b - a) AS INTEGER) AS direction, b - a AS delta_pp FROM p"""


@query("stake_changes", STAKE_SQL)
def stake_changes(s, d):
    return text.stake_changes(stakes(s, d)).select("p_partkey", "stake.*")


@query("split_clauses", "SELECT p_partkey, 1 + p_partkey % 6 + (p_partkey % 2) AS clauses FROM part")
def split_clauses(s, d):
    """Numbered items in one line, a date that is no item, and every other text a line more."""
    items = F.transform(F.expr("sequence(0, p_partkey % 6)"), lambda i: F.concat((i + 1).cast("string"), F.lit(". «Пункт» от 15.03. 2024 года")))
    body = F.concat(F.concat_ws(" ", items), F.when(F.col("p_partkey") % 2 == 1, "\r\n\n последняя строка ").otherwise(" "))
    return market.table(s, d, "part").select("p_partkey", F.size(text.split_clauses(body)).cast("bigint").alias("clauses"))


#: Texts of which only the first and the fifth report a change.
STAKE_LIKE = ["Доля ДО ИЗМЕНЕНИЯ 1, после изменения 2", "доля до изменения", "доля после изменения", "размер до изменения и после изменения", "дол\u0451, доли до изменения; после изменения", ""]


@query("is_stake_text", f"SELECT p_partkey, p_partkey % {len(STAKE_LIKE)} IN (0, 4) AS is_stake FROM part")
def is_stake_text(s, d):
    t = F.element_at(F.array(*[F.lit(x) for x in STAKE_LIKE]), (F.col("p_partkey") % len(STAKE_LIKE)).cast("int") + 1)
    return market.table(s, d, "part").select("p_partkey", text.is_stake_text(t).alias("is_stake"))


POSITIONS = [("Председатель совета директоров", "board_chair"), ("Генеральный директор", "ceo"), ("Вице-президент", "management_board"), ("Член Совета директоров", "board"), ("Заместитель генерального директора", "management_board"), ("акционер", "other"), ("", "unknown")]


@query("classify_role", f"SELECT p_partkey, ([{', '.join(repr(x[1]) for x in POSITIONS)}])[CAST(p_partkey % {len(POSITIONS)} AS INTEGER) + 1] AS role FROM part")
def classify_role(s, d):
    pos = F.element_at(F.array(*[F.lit(x[0]) for x in POSITIONS]), (F.col("p_partkey") % len(POSITIONS)).cast("int") + 1)
    return market.table(s, d, "part").select("p_partkey", text.classify_role(pos).alias("role"))


@query("clean_securities", "WITH " + market.SECURITIES_SQL + " SELECT secid, shortname, is_traded, emitent_inn, CAST(NULL AS BIGINT) AS emitent_id FROM securities")
def clean_securities(s, d):
    from tapeline.schema import SECURITIES, conform

    return conform(market.securities(s, d), SECURITIES).select("secid", "shortname", "is_traded", "emitent_inn", "emitent_id")


@query("universe", "WITH " + market.COMPANIES_SQL + ", " + market.SECURITIES_SQL + " SELECT s.emitent_inn AS inn, min(c.company_id) AS company_id FROM (SELECT DISTINCT emitent_inn FROM securities WHERE emitent_inn IS NOT NULL) s JOIN (SELECT company_id, regexp_replace(regexp_replace(inn, '\\.0+$', ''), '\\D', '', 'g') AS inn FROM companies) c ON c.inn = s.emitent_inn GROUP BY 1")
def universe(s, d):
    issuers = market.securities(s, d).select(text.normalize_inn(F.col("emitent_inn")).alias("inn")).filter("inn IS NOT NULL").distinct()
    c = market.companies(s, d).select("company_id", text.normalize_inn(F.col("inn")).alias("inn"))
    return issuers.join(c, "inn").groupBy("inn").agg(F.min("company_id").alias("company_id"))


@query("scan_event_json", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS title FROM events")
def scan_event_json(s, d):
    import uuid

    from tapeline.sources import sinks

    path = f"{shared_dir(s)}/events-json-{uuid.uuid4().hex}"
    sinks.save_events_json(market.table(s, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("title")), path)
    return feeds.scan_event_json(s, path).select("event_id", "title")


