"""Registered queries over the driver's tables, each with its statement in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions import stats, text
from tapeline.operators import eventstudy as es
from tapeline.operators import mapping, panel, timing
from tapeline.sources import market as m

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Driver prices are thin: thresholds of the registered study, far below the library's defaults.
STUDY = es.StudyConfig(windows=((0, 0), (0, 5), (0, 20), (-1, 1)), min_price_obs=5, min_turnover=5e4, min_est_obs=30, coverage=0.5)
N = 6


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def r(c: Column | str, n: int = N) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def rounded(df: DataFrame, n: int = N) -> DataFrame:
    return df.select(*[r(c, n).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- shared frames and their SQL


def calendar(s, d):
    return panel.trading_calendar(m.prices(s, d), m.index(s, d))


def grid(s, d):
    return panel.price_grid(m.prices(s, d), calendar(s, d))


def market(s, d):
    return panel.index_series(m.index(s, d), calendar(s, d))


def returns(s, d):
    return panel.market_adjusted(panel.with_returns(grid(s, d)), market(s, d))


# Studies read calendar, grid and returns as tables that are written once a session; the queries named after them derive them anew.
def kept_calendar(s, d):
    return m.derived(s, d, "calendar", calendar)


def kept_grid(s, d):
    return m.derived(s, d, "grid", grid)


def kept_returns(s, d):
    return m.derived(s, d, "returns", returns)


def used_events(s, d, config=STUDY):
    return es.with_drop_reason(m.events(s, d), kept_grid(s, d), kept_calendar(s, d), config).filter("drop_reason IS NULL")


def cars(s, d):
    return es.car_table(used_events(s, d), kept_returns(s, d), STUDY.windows, STUDY.coverage)


def gathered(s, d, start=-1, end=20):
    return es.event_ar(es.gather_window(used_events(s, d), kept_returns(s, d), start, end))


CAL = m.INDEX_SQL + """,
cal AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS pos FROM (SELECT date FROM prices UNION SELECT date FROM idx))"""
GRID = CAL + """,
grid AS (
  SELECT s.secid, c.pos, c.date, p.open, p.close, p.value
  FROM (SELECT DISTINCT secid FROM prices) s CROSS JOIN cal c LEFT JOIN prices p ON p.secid = s.secid AND p.date = c.date
)"""
MKT = """,
mk0 AS (SELECT c.pos, c.date, last_value(i.close IGNORE NULLS) OVER (ORDER BY c.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mkt_close FROM cal c LEFT JOIN idx i USING (date)),
mk AS (SELECT *, mkt_close / lag(mkt_close) OVER (ORDER BY pos) - 1 AS mkt FROM mk0)"""
RET = """,
rt0 AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY secid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_close FROM grid),
rt AS (SELECT r.*, r.close / r.prev_close - 1 AS ret, k.mkt, r.close / r.prev_close - 1 - k.mkt AS ar FROM rt0 r JOIN mk k USING (pos))"""


def session_sql(src: str, cutoff_seconds: int, name: str) -> str:
    """CTE <src>_s: events with <name>_pos, by an as-of look at the calendar."""
    return f""",
{src}_s AS (
  SELECT e.*, CASE WHEN o.pos IS NOT NULL AND extract(hour FROM e.published_at) * 3600 + extract(minute FROM e.published_at) * 60 + extract(second FROM e.published_at) < {cutoff_seconds} THEN o.pos
    ELSE (SELECT min(pos) FROM cal WHERE date > CAST(e.published_at AS DATE)) END AS {name}_pos
  FROM {src} e LEFT JOIN cal o ON o.date = CAST(e.published_at AS DATE)
)"""


T0 = "," + m.EVENTS_SQL + session_sql("events_d", timing.time_of_day(timing.CUTOFF), "t0")
HIST = f""",
hist AS (
  SELECT secid, pos, count(close) OVER w AS n_hist, quantile_cont(value, 0.5) OVER w AS med_value FROM grid
  WINDOW w AS (PARTITION BY secid ORDER BY pos ROWS BETWEEN {STUDY.lookback} PRECEDING AND 1 PRECEDING)
)"""
REASON = HIST + f""",
why AS (
  SELECT e.*, c.date AS t0, h.n_hist, h.med_value,
    CASE WHEN e.t0_pos IS NULL THEN 'no_t0' WHEN k.secid IS NULL THEN 'unknown_secid' WHEN coalesce(h.n_hist, 0) < {STUDY.min_price_obs} THEN 'short_history'
      WHEN NOT coalesce(h.med_value >= {STUDY.min_turnover}, false) THEN 'illiquid' END AS drop_reason
  FROM events_d_s e LEFT JOIN cal c ON c.pos = e.t0_pos LEFT JOIN hist h ON h.secid = e.secid AND h.pos = e.t0_pos
    LEFT JOIN (SELECT DISTINCT secid FROM prices) k ON k.secid = e.secid
)"""
STUDY_SQL = "WITH " + GRID + MKT + RET + T0 + REASON
GATHER = """,
gat AS (
  SELECT w.event_id, w.secid, w.category, w.direction, w.t0, w.t0_pos, k.k AS rel_day, rt.ret, rt.mkt, rt.ar, rt.ret - rt.mkt AS model_ar
  FROM (SELECT * FROM why WHERE drop_reason IS NULL) w CROSS JOIN (SELECT unnest(range(-1, 21)) AS k) k LEFT JOIN rt ON rt.secid = w.secid AND rt.pos = w.t0_pos + k.k
)"""
CAR = GATHER + """,
win(win_start, win_end) AS (VALUES (0, 0), (0, 5), (0, 20), (-1, 1)),
cells AS (
  SELECT event_id, secid, category, direction, t0, CAST(win_start AS INTEGER) AS win_start, CAST(win_end AS INTEGER) AS win_end,
    sum(model_ar) AS car, coalesce(product(CASE WHEN model_ar IS NOT NULL THEN 1 + ret END), 1) AS gr, coalesce(product(CASE WHEN model_ar IS NOT NULL THEN 1 + mkt END), 1) AS gm, count(model_ar) AS n_days
  FROM gat JOIN win ON rel_day BETWEEN win_start AND win_end GROUP BY ALL
),
cars AS (SELECT *, gr - gm AS bhar, gr - 1 AS raw_ret, gm - 1 AS mkt_ret, '[' || win_start || ',' || win_end || ']' AS "window" FROM cells WHERE n_days >= greatest(1, ceil(round(0.5 * (win_end - win_start + 1), 9))))"""
CARS = STUDY_SQL + CAR

# ---------------------------------------------------------------- scans


@query("scan_messages", "WITH " + m.MESSAGES_SQL + " SELECT * FROM messages")
def scan_messages(s, d):
    return m.messages(s, d)


@query("scan_prices", "WITH " + m.PRICES_SQL + " SELECT * FROM prices WHERE secid = 'N03'")
def scan_prices(s, d):
    return m.prices(s, d).filter("secid = 'N03'")


@query("price_panel", "WITH " + m.PRICES_SQL + " SELECT secid, date, close FROM prices")
def price_panel(s, d):
    return m.prices(s, d).select("secid", "date", "close")


@query("list_secids", "WITH " + m.PRICES_SQL + " SELECT DISTINCT secid FROM prices")
def list_secids(s, d):
    return m.prices(s, d).select("secid").distinct()


@query("scan_index", "WITH " + m.INDEX_SQL + " SELECT date, close FROM idx")
def scan_index(s, d):
    return m.index(s, d)


@query("last_date", "WITH " + m.PRICES_SQL + " SELECT secid, max(date) AS last_date FROM prices GROUP BY 1")
def last_date(s, d):
    return m.prices(s, d).groupBy("secid").agg(F.max("date").alias("last_date"))


@query("date_chunks", """WITH e AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events)
SELECT CAST(x AS DATE) AS chunk_from, CAST(least(CAST(x AS DATE) + 6, b) AS DATE) AS chunk_till FROM e, unnest(generate_series(a, b, INTERVAL 7 DAY)) t(x)""")
def date_chunks(s, d):
    from tapeline.sources.feeds import date_chunks as chunks

    return chunks(m.table(s, d, "events").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")), 7)


@query("messages_by_year", "WITH " + m.MESSAGES_SQL + " SELECT CAST(year(published_at) AS INTEGER) AS year, count(*) AS n FROM messages GROUP BY 1")
def messages_by_year(s, d):
    return m.messages(s, d).groupBy(F.year("published_at").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("request_cache_key", """SELECT page_id, sha1('POST ' || url || '?a=' || (page_id % 7) || '|x&page=' || page_id || '#q=' || (page_id % 3)) AS cache_key FROM pages""")
def request_cache_key(s, d):
    from tapeline.sources.feeds import cache_key

    text_of = lambda x: F.expr(x).cast("string")
    params = F.create_map(F.lit("page"), F.array(text_of("page_id")), F.lit("a"), F.array(text_of("page_id % 7"), F.lit("x")))
    return m.table(s, d, "pages").select("page_id", cache_key(F.lit("post"), F.col("url"), params, F.create_map(F.lit("q"), F.array(text_of("page_id % 3")))).alias("cache_key"))


#: What is put before every so many-th page: checks, captchas, and words that only sound like them.
MADE_PAGES = ["", "<script src=\"/SP_Rotated_captcha.js\"></script>", "<div id=\"id_spinner\"></div>", "a captcha, they say", "{\"is_captcha\": true}", "<i>spsc=1</i>", "<noscript>x</noscript><script></script>"]
LOW_HEAD = lambda n: f"lower(left(h, {n}))"


@query("page_class", f"""WITH p AS (SELECT page_id, ([{', '.join("'" + x + "'" for x in MADE_PAGES)}])[CAST(page_id % {len(MADE_PAGES)} AS INTEGER) + 1] || CASE WHEN page_id % 2 = 0 THEN '<meta http-equiv="refresh"><NOSCRIPT><script>' || replace(coalesce(html, ''), '<a ', '<b ') ELSE coalesce(html, '') END AS h FROM pages)
SELECT page_id, CASE WHEN regexp_matches({LOW_HEAD(60000)}, 'sp_rotated_captcha|captchaintgen|"is_captcha": ?true') THEN 'captcha'
  WHEN regexp_matches({LOW_HEAD(40000)}, 'id_captcha_frame_div|spinner-container|id_spinner|__sp_init|spsc=') THEN 'stub'
  WHEN NOT contains(lower(h), '<a ') AND contains({LOW_HEAD(40000)}, 'http-equiv="refresh"') AND contains({LOW_HEAD(40000)}, '<noscript>') AND contains({LOW_HEAD(40000)}, '<script') THEN 'stub' ELSE 'content' END AS page_class FROM p""")
def page_class(s, d):
    from tapeline.sources.feeds import page_class as of

    put = F.element_at(F.array(*[F.lit(x) for x in MADE_PAGES]), (F.col("page_id") % len(MADE_PAGES)).cast("int") + 1)
    html = F.coalesce("html", F.lit(""))
    rest = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<meta http-equiv="refresh"><NOSCRIPT><script>'), F.replace(html, F.lit("<a "), F.lit("<b ")))).otherwise(html)
    return m.table(s, d, "pages").select("page_id", of(F.concat(put, rest)).alias("page_class"))


@query("html_link_patterns", """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT regexp_replace(href, '[0-9]+', 'N', 'g') AS pattern, count(*) AS n FROM l GROUP BY 1""")
def html_link_patterns(s, d):
    from tapeline.sources.feeds import link_patterns

    return link_patterns(m.table(s, d, "pages"))


@query("all_shares", "WITH " + m.SECURITIES_SQL + " SELECT secid, shortname, is_traded, type FROM securities QUALIFY row_number() OVER (PARTITION BY secid ORDER BY is_traded DESC, seq) = 1")
def all_shares(s, d):
    x = m.securities(s, d)
    return mapping.all_shares(x.filter("is_traded = 1"), x.filter("is_traded = 0")).select("secid", "shortname", "is_traded", "type")


@query("synthetic_panel")
def synthetic_panel(s, d):
    from tapeline.sources.synthetic import prices as make

    return make(s, secids=10, days=120)


# ---------------------------------------------------------------- panel


@query("trading_calendar", "WITH " + CAL + " SELECT date, pos FROM cal")
def trading_calendar(s, d):
    return calendar(s, d)


@query("price_grid", "WITH " + GRID + " SELECT secid, pos, date, open, close, value FROM grid")
def price_grid(s, d):
    return grid(s, d)


@query("to_wide", "WITH " + GRID + " SELECT date, " + ", ".join(f"max(CASE WHEN secid = 'N{k:02d}' THEN close END) AS \"N{k:02d}\"" for k in range(25)) + " FROM grid GROUP BY 1")
def to_wide(s, d):
    return panel.to_wide(grid(s, d), sorted(x.secid for x in list_secids(s, d).collect()))


@query("dedup_prices", "WITH " + m.PRICES_SQL + ", t AS (SELECT *, 1 AS seq FROM prices UNION ALL SELECT secid, date, open, high, low, close + 1, volume, value, numtrades, 2 FROM prices WHERE day(date) <= 10) SELECT secid, date, close FROM t QUALIFY row_number() OVER (PARTITION BY secid, date ORDER BY seq DESC) = 1")
def dedup_prices(s, d):
    p = m.prices(s, d)
    both = p.withColumn("seq", F.lit(1)).unionByName(p.filter("day(date) <= 10").withColumn("close", F.col("close") + 1).withColumn("seq", F.lit(2)))
    return panel.keep_one(both, ["secid", "date"], [F.desc("seq")]).select("secid", "date", "close")


@query("drop_no_trade_days", "WITH " + GRID + " SELECT secid, date, close FROM grid WHERE close IS NOT NULL AND date IS NOT NULL")
def drop_no_trade_days(s, d):
    return grid(s, d).filter("close IS NOT NULL AND date IS NOT NULL").select("secid", "date", "close")


@query("index_series", "WITH " + CAL + MKT + " SELECT pos, date, mkt_close FROM mk")
def index_series(s, d):
    return market(s, d).select("pos", "date", "mkt_close")


@query("index_returns", "WITH " + CAL + MKT + " SELECT pos, date, round(mkt, 6) + 0.0 AS mkt FROM mk")
def index_returns(s, d):
    return rounded(market(s, d).select("pos", "date", "mkt"))


@query("simple_returns", "WITH " + GRID + MKT + RET + " SELECT secid, pos, round(ret, 6) + 0.0 AS ret FROM rt")
def simple_returns(s, d):
    return rounded(panel.with_returns(grid(s, d)).select("secid", "pos", "ret"))


@query("simple_returns_nofill", "WITH " + GRID + " SELECT secid, pos, round(close / lag(close) OVER (PARTITION BY secid ORDER BY pos) - 1, 6) + 0.0 AS ret FROM grid")
def simple_returns_nofill(s, d):
    return rounded(panel.with_returns(grid(s, d), fill_gaps=False).select("secid", "pos", "ret"))


@query("log_returns", "WITH " + GRID + MKT + RET + " SELECT secid, pos, round(ln(close / prev_close), 6) + 0.0 AS log_ret FROM rt")
def log_returns(s, d):
    return rounded(panel.log_returns(grid(s, d)).select("secid", "pos", "log_ret"))


@query("market_adjusted_ar", "WITH " + GRID + MKT + RET + " SELECT secid, pos, round(ar, 6) + 0.0 AS ar FROM rt")
def market_adjusted_ar(s, d):
    return rounded(returns(s, d).select("secid", "pos", "ar"))


@query("adv", "WITH " + GRID + " SELECT secid, pos, round(CASE WHEN count(value) OVER w >= 20 THEN quantile_cont(value, 0.5) OVER w END, 4) AS adv FROM grid WINDOW w AS (PARTITION BY secid ORDER BY pos ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)")
def adv(s, d):
    return rounded(panel.adv(grid(s, d)).select("secid", "pos", "adv"), 4)


@query("mark_prices", "WITH " + GRID + " SELECT secid, pos, last_value(close IGNORE NULLS) OVER (PARTITION BY secid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_close, max(CASE WHEN close IS NOT NULL THEN pos END) OVER (PARTITION BY secid) AS last_valid_pos FROM grid")
def mark_prices(s, d):
    return panel.mark_prices(grid(s, d)).select("secid", "pos", "last_close", "last_valid_pos")


@query("liquidity_stats", "WITH " + m.PRICES_SQL + """, e AS (SELECT secid, min(date) AS first_date, max(date) AS last_date FROM prices GROUP BY 1),
c AS (SELECT e.*, d.date, p.value FROM e LEFT JOIN (SELECT DISTINCT date FROM prices) d ON d.date > e.last_date - 60 AND d.date <= e.last_date LEFT JOIN prices p ON p.secid = e.secid AND p.date = d.date AND p.volume > 0)
SELECT secid, min(first_date) AS first_date, max(last_date) AS last_date, max(last_date) AS window_end, count(date) AS n_days, count(value) AS n_traded_days,
  round(quantile_cont(coalesce(value, 0), 0.5), 4) AS median_value, round(avg(coalesce(value, 0)), 4) AS mean_value, round(1 - count(value) / count(date), 4) AS zero_volume_share FROM c GROUP BY 1""")
def liquidity_stats(s, d):
    return rounded(panel.liquidity_stats(m.prices(s, d)), 4)


# ---------------------------------------------------------------- events and windows


@query("normalize_events", "WITH " + m.EVENTS_SQL + " SELECT event_id, secid, published_at, category, direction, size FROM events_d")
def normalize_events(s, d):
    return es.normalize_events(m.events(s, d))


@query("dedup_events", "WITH " + m.EVENTS_SQL + ", t AS (SELECT * FROM events_d UNION ALL SELECT event_id, secid, published_at + INTERVAL 1 DAY, category, direction, size FROM events_d WHERE direction = 1) SELECT event_id, secid, published_at FROM t QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY published_at) = 1")
def dedup_events(s, d):
    e = m.events(s, d)
    return es.dedup_events(e.unionByName(e.filter("direction = 1").withColumn("published_at", F.expr("published_at + INTERVAL 1 DAY")))).select("event_id", "secid", "published_at")


@query("filter_events", "WITH " + m.EVENTS_SQL + " SELECT event_id, category, direction FROM events_d WHERE category IN ('1-URGENT', '2-HIGH') AND direction IN (1)")
def filter_events(s, d):
    return m.events(s, d).filter(F.col("category").isin("1-URGENT", "2-HIGH") & F.col("direction").isin(1)).select("event_id", "category", "direction")


@query("assign_event_day", "WITH " + CAL + T0 + " SELECT event_id, t0_pos, date AS t0 FROM events_d_s LEFT JOIN cal ON pos = t0_pos")
def assign_event_day(s, d):
    return timing.assign_session(m.events(s, d), calendar(s, d)).select("event_id", "t0_pos", "t0")


@query("entry_day_next_open", "WITH " + CAL + "," + m.EVENTS_SQL + session_sql("events_d", 36000, "entry") + " SELECT event_id, entry_pos FROM events_d_s")
def entry_day_next_open(s, d):
    return timing.entry_session(m.events(s, d), calendar(s, d), "next_open").select("event_id", "entry_pos")


@query("entry_day_next_close", "WITH " + CAL + T0 + " SELECT event_id, CASE WHEN t0_pos < (SELECT max(pos) FROM cal) THEN t0_pos + 1 END AS entry_pos FROM events_d_s")
def entry_day_next_close(s, d):
    return timing.entry_session(m.events(s, d), calendar(s, d), "next_close").select("event_id", "entry_pos")


@query("history_filter", "WITH " + GRID + HIST + " SELECT secid, pos, n_hist, n_hist >= 5 AS enough FROM hist")
def history_filter(s, d):
    return es.history(grid(s, d), STUDY.lookback).select("secid", "pos", "n_hist", (F.col("n_hist") >= 5).alias("enough"))


@query("liquidity_filter", "WITH " + GRID + HIST + " SELECT secid, pos, round(med_value, 4) AS med_value, coalesce(med_value >= 50000, false) AS liquid FROM hist")
def liquidity_filter(s, d):
    return es.history(grid(s, d), STUDY.lookback).select("secid", "pos", r("med_value", 4).alias("med_value"), F.coalesce(F.col("med_value") >= 50000, F.lit(False)).alias("liquid"))


@query("event_filter_diagnostics", STUDY_SQL + " SELECT coalesce(drop_reason, 'used') AS reason, count(*) AS n FROM why GROUP BY 1")
def event_filter_diagnostics(s, d):
    ev = es.with_drop_reason(m.events(s, d), kept_grid(s, d), kept_calendar(s, d), STUDY)
    return ev.groupBy(F.coalesce("drop_reason", F.lit("used")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("gather_event_window", STUDY_SQL + GATHER + " SELECT event_id, CAST(rel_day AS INTEGER) AS rel_day, round(ret, 6) + 0.0 AS ret, round(mkt, 6) + 0.0 AS mkt, round(ar, 6) + 0.0 AS ar FROM gat")
def gather_event_window(s, d):
    return rounded(gathered(s, d).select("event_id", "rel_day", "ret", "mkt", "ar"))


@query("event_ar", STUDY_SQL + GATHER + " SELECT event_id, CAST(rel_day AS INTEGER) AS rel_day, round(model_ar, 6) + 0.0 AS model_ar, 'market_adjusted' AS model FROM gat")
def event_ar(s, d):
    return rounded(gathered(s, d).select("event_id", "rel_day", "model_ar", "model"))


@query("car_table", CARS + ' SELECT event_id, secid, category, direction, t0, "window", win_start, win_end, round(car, 4) + 0.0 AS car, round(bhar, 3) + 0.0 AS bhar, n_days, round(raw_ret, 3) + 0.0 AS raw_ret, round(mkt_ret, 3) + 0.0 AS mkt_ret FROM cars')
def car_table(s, d):
    c = cars(s, d)
    return c.select("event_id", "secid", "category", "direction", "t0", "window", "win_start", "win_end", r("car", 4).alias("car"), r("bhar", 3).alias("bhar"), "n_days", r("raw_ret", 3).alias("raw_ret"), r("mkt_ret", 3).alias("mkt_ret"))


@query("car_coverage", STUDY_SQL + CAR + " SELECT win_start, win_end, count(*) FILTER (n_days >= greatest(1, ceil(round(0.5 * (win_end - win_start + 1), 9)))) AS kept, count(*) FILTER (n_days < greatest(1, ceil(round(0.5 * (win_end - win_start + 1), 9)))) AS dropped FROM cells GROUP BY 1, 2")
def car_coverage(s, d):
    return es.car_coverage(used_events(s, d), kept_returns(s, d), STUDY.windows, STUDY.coverage)


@query("signed_car", CARS + ' SELECT event_id, "window", round(car * direction, 4) + 0.0 AS signed_car, round(bhar * direction, 3) + 0.0 AS signed_bhar FROM cars WHERE direction <> 0')
def signed_car(s, d):
    c = es.signed(cars(s, d))
    return c.select("event_id", "window", r("signed_car", 4).alias("signed_car"), r("signed_bhar", 3).alias("signed_bhar"))


def student_sql(t: str, df: str) -> str:
    """Two-sided p-value of whole degrees of freedom: the finite series, its coefficients by the logarithm of the gamma function."""
    th = f"atan(abs({t}) / sqrt({df}))"
    odd = f"list_sum(list_transform(range(0, CAST(({df} - 1) // 2 AS BIGINT)), lambda k: exp(k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * pow(cos({th}), 2 * k + 1)))"
    even = f"list_sum(list_transform(range(0, CAST({df} // 2 AS BIGINT)), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4)) * pow(cos({th}), 2 * k)))"
    return f"greatest(0, 1 - CASE WHEN {df} % 2 = 1 THEN 2 / pi() * ({th} + sin({th}) * coalesce({odd}, 0)) ELSE sin({th}) * {even} END)"


def normal_sql(z: str) -> str:
    """Two-sided p-value of a standard normal by the error function's series; beyond 4.2 it is 0 to four digits."""
    x = f"(abs({z}) / sqrt(2))"
    return f"CASE WHEN abs({z}) > 4.2 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda k: pow(-1, k) * pow({x}, 2 * k + 1) / (exp(lgamma(k + 1)) * (2 * k + 1)))) END"


SUMMARY = CARS + """,
summ AS (
  SELECT category, direction, "window", win_start, win_end, count(car) AS n, avg(car) AS mean_car, quantile_cont(car, 0.5) AS median_car, stddev_samp(car) AS std,
    avg(CASE WHEN car > 0 THEN 1.0 ELSE 0.0 END) AS share_positive, count(*) FILTER (car > 0) AS pos, count(*) FILTER (car <> 0) AS nz, avg(bhar) AS mean_bhar FROM cars GROUP BY ALL
)"""


def summary(s, d):
    return es.summarize(cars(s, d))


#: Exact two-sided binomial p-value at one half of k on the rarer side of n.
SIGN_P = "CASE WHEN n >= 2 AND {n} >= 1 THEN least(1, 2 * list_sum(list_transform(range(0, CAST({k} AS BIGINT) + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2))))) END"


@query("summarize", SUMMARY + ' SELECT category, direction, "window", n, round(mean_car, 4) + 0.0 AS mean_car, round(median_car, 4) + 0.0 AS median_car, round(std, 4) AS std, round(share_positive, 4) AS share_positive, round(CASE WHEN n >= 2 AND std > 0 THEN mean_car / (std / sqrt(n)) END, 4) + 0.0 AS t_stat, round(mean_bhar, 2) + 0.0 AS mean_bhar, round(CASE WHEN n >= 2 AND std > 0 THEN ' + student_sql("(mean_car / (std / sqrt(n)))", "(n - 1)") + ' END, 4) + 0.0 AS p_value, round(' + SIGN_P.format(n="nz", k="least(pos, nz - pos)") + ', 4) + 0.0 AS sign_test_p FROM summ')
def summarize(s, d):
    x = summary(s, d)
    return x.select("category", "direction", "window", "n", *[r(c, 2 if c == "mean_bhar" else 4).alias(c) for c in ("mean_car", "median_car", "std", "share_positive", "t_stat", "mean_bhar", "p_value", "sign_test_p")])


@query("sign_test", SUMMARY + """, b AS (SELECT category, direction, "window", CAST(pos AS BIGINT) AS positive, CAST(nz AS BIGINT) AS trials, least(pos, nz - pos) AS k FROM summ)
SELECT category, direction, "window", positive, trials, round(CASE WHEN trials >= 1 THEN least(1, 2 * (SELECT sum(exp(lgamma(trials + 1) - lgamma(i + 1) - lgamma(trials - i + 1) - trials * ln(2))) FROM unnest(range(0, k + 1)) t(i))) END, 6) AS sign_test_p FROM b""")
def sign_test(s, d):
    c = cars(s, d)
    g = c.groupBy("category", "direction", "window").agg(F.count_if(F.col("car") > 0).alias("positive"), F.count_if(F.col("car") != 0).alias("trials"))
    return g.withColumn("sign_test_p", r(stats.sign_test_p(F.col("positive"), F.col("trials"))))


@query("student_p_values", "WITH x AS (SELECT event_id, (event_id % 4001 - 2000) / 400.0 AS t, 1 + event_id % 97 AS df FROM events) SELECT event_id, round(" + student_sql("t", "df") + ", 6) + 0.0 AS p FROM x")
def student_p_values(s, d):
    t = m.table(s, d, "events").select("event_id", F.expr("(event_id % 4001 - 2000) / 400.0D").alias("t"), F.expr("1 + event_id % 97").alias("df"))
    return t.select("event_id", r(stats.student_p(F.col("t"), F.col("df"))).alias("p"))


P_VALUES = "CASE WHEN event_id % 11 <> 0 THEN ((event_id * 7919) % 10007 + 1) / 10008.0 END"


@query("bh_fdr", f"WITH x AS (SELECT event_id, {P_VALUES} AS p FROM events), k AS (SELECT event_id, CAST(p AS DOUBLE) AS p, row_number() OVER (ORDER BY p NULLS LAST, event_id) AS rk, count(p) OVER () AS m FROM x) SELECT event_id, round(CASE WHEN p IS NOT NULL THEN least(1, min(p * m / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END, 6) AS q_value FROM k")
def bh_fdr(s, d):
    return rounded(stats.bh_q(m.table(s, d, "events").select("event_id", F.expr(P_VALUES.replace("10008.0", "10008.0D")).alias("p_value"))).select("event_id", "q_value"))


SCREEN = SUMMARY + """, ps AS (SELECT *, CASE WHEN n >= 2 AND std > 0 THEN mean_car / (std / sqrt(n)) END AS t FROM summ WHERE "window" = '[0,5]' AND n >= 5),
pv AS (SELECT *, """ + student_sql("t", "(n - 1)") + """ AS p FROM ps WHERE t IS NOT NULL),
pr AS (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS tests FROM pv), pq AS (SELECT *, least(1, min(p * tests / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM pr)
SELECT category, direction, n, round(mean_car, 4) + 0.0 AS mean_car, round(t, 4) + 0.0 AS t_stat, round(p, 4) + 0.0 AS p_value, round(q, 4) + 0.0 AS q_value, q <= 0.05 AS significant,
  CAST(row_number() OVER (ORDER BY abs(t) DESC, category, direction) AS INTEGER) AS rank FROM pq"""


@query("screen_categories", SCREEN)
def screen_categories(s, d):
    return rounded(es.screen(summary(s, d), "[0,5]", min_n=5).select("category", "direction", "n", "mean_car", "t_stat", "p_value", "q_value", "significant", "rank"), 4)


def _bootstrap_sql(draws: int, seed: int) -> str:
    word = lambda of, k: f"CAST('0x' || substr({of}, {7 * k + 1}, 7) AS BIGINT)"
    weight = " ".join(f"WHEN u < {limit} THEN {k}" for k, limit in enumerate(stats.POISSON))
    return f""", named AS (SELECT category, direction, "window", car, {word("id", 0)} AS x, {word("id", 1)} AS y FROM (SELECT *, md5(concat_ws('|', category, CAST(direction AS VARCHAR), "window", event_id)) AS id FROM cars WHERE car IS NOT NULL)),
turns AS (SELECT draw, {word("id", 0)} AS a, {word("id", 1)} AS b, {word("id", 2)} AS c FROM (SELECT k AS draw, md5('{seed}|' || k) AS id FROM unnest(range(0, {draws})) t(k))),
words AS (SELECT category, direction, "window", car, draw, (a * x + b * y + c) % {stats.PRIME} AS u FROM named, turns),
weighed AS (SELECT *, CASE {weight} ELSE {len(stats.POISSON)} END AS w FROM words),
drawn AS (SELECT category, direction, "window", draw, sum(w * car) / sum(w) AS mean FROM weighed WHERE w > 0 GROUP BY ALL),
ends AS (SELECT category, direction, "window", quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM drawn GROUP BY ALL),
size AS (SELECT category, direction, "window", count(car) AS n FROM cars GROUP BY ALL)
SELECT s.category, s.direction, s."window", s.n, round(CASE WHEN s.n > 1 THEN low END, 4) + 0.0 AS ci_low, round(CASE WHEN s.n > 1 THEN high END, 4) + 0.0 AS ci_high
FROM size s LEFT JOIN ends e ON e.category = s.category AND e.direction = s.direction AND e."window" = s."window" WHERE s.n > 0"""


@query("bootstrap_ci", CARS + _bootstrap_sql(STUDY.bootstrap, STUDY.seed))
def bootstrap_ci(s, d):
    return rounded(es.bootstrap_ci(cars(s, d), draws=STUDY.bootstrap, seed=STUDY.seed), 4)


PATH = STUDY_SQL + GATHER + """, g AS (SELECT category, direction, rel_day, avg({v}) AS mean_ar, count({v}) AS n FROM gat {where} GROUP BY ALL)
SELECT category, direction, CAST(rel_day AS INTEGER) AS rel_day, n, round(mean_ar, 4) + 0.0 AS mean_ar, round(sum(coalesce(mean_ar, 0)) OVER (PARTITION BY category, direction ORDER BY rel_day), 4) + 0.0 AS mean_car FROM g"""


@query("average_ar_path", PATH.format(v="model_ar", where=""))
def average_ar_path(s, d):
    return rounded(es.average_path(gathered(s, d)), 4)


@query("average_ar_path_signed", PATH.format(v="model_ar * direction", where="WHERE direction <> 0"))
def average_ar_path_signed(s, d):
    return rounded(es.average_path(gathered(s, d), use_sign=True), 4)


MODEL = """,
mm AS (
  SELECT w.event_id, w.secid, w.category, w.direction, w.t0_pos, CAST(count(*) FILTER (rt.ret IS NOT NULL AND rt.mkt IS NOT NULL) AS INTEGER) AS n_obs,
    regr_slope(rt.ret, rt.mkt) AS b, regr_intercept(rt.ret, rt.mkt) AS a, var_pop(CASE WHEN rt.ret IS NOT NULL THEN rt.mkt END) AS v
  FROM (SELECT * FROM why WHERE drop_reason IS NULL) w LEFT JOIN rt ON rt.secid = w.secid AND rt.pos BETWEEN w.t0_pos - 250 AND w.t0_pos - 30 GROUP BY ALL
)"""


@query("market_model_params", STUDY_SQL + MODEL + " SELECT event_id, n_obs, coalesce(n_obs < 30 OR b IS NULL, true) AS fallback, round(CASE WHEN n_obs >= 30 AND b IS NOT NULL THEN a ELSE 0 END, 3) + 0.0 AS alpha, round(CASE WHEN n_obs >= 30 AND b IS NOT NULL THEN b ELSE 1 END, 3) + 0.0 AS beta FROM mm")
def market_model_params(s, d):
    x = es.market_model(used_events(s, d), kept_returns(s, d), STUDY.est_window, STUDY.min_est_obs)
    return x.select("event_id", "n_obs", "fallback", r("alpha", 3).alias("alpha"), r("beta", 3).alias("beta"))


@query("market_model_ar", STUDY_SQL + MODEL + ", q AS (SELECT *, n_obs >= 30 AND b IS NOT NULL AS good FROM mm) SELECT q.event_id, CAST(k AS INTEGER) AS rel_day, round(CASE WHEN good THEN rt.ret - (a + b * rt.mkt) ELSE rt.ret - rt.mkt END, 3) + 0.0 AS model_ar, CASE WHEN good THEN 'market_model' ELSE 'market_adjusted' END AS model FROM q CROSS JOIN unnest(range(0, 6)) t(k) LEFT JOIN rt ON rt.secid = q.secid AND rt.pos = q.t0_pos + k")
def market_model_ar(s, d):
    x = kept_returns(s, d)
    g = es.gather_window(es.market_model(used_events(s, d), x, STUDY.est_window, STUDY.min_est_obs), x, 0, 5)
    return es.event_ar(g, "market_model").select("event_id", "rel_day", r("model_ar", 3).alias("model_ar"), "model")


CTP = STUDY_SQL + """, mem AS (SELECT DISTINCT w.secid, w.t0_pos + k AS pos FROM why w CROSS JOIN unnest(range(1, 21)) t(k) WHERE drop_reason IS NULL AND direction = 1),
ctp AS (SELECT k.pos, k.date, avg(rt.ret) AS port_ret, count(rt.ret) AS n_stocks, max(k.mkt) AS mkt FROM mk k LEFT JOIN mem USING (pos) LEFT JOIN rt ON rt.secid = mem.secid AND rt.pos = k.pos GROUP BY ALL)"""


def ctp(s, d):
    return es.calendar_time(used_events(s, d).filter("direction = 1"), kept_returns(s, d))


@query("calendar_time_daily", CTP + " SELECT pos, date, round(port_ret, 6) + 0.0 AS port_ret, n_stocks FROM ctp")
def calendar_time_daily(s, d):
    return ctp(s, d).select("pos", "date", r("port_ret").alias("port_ret"), "n_stocks")


@query("calendar_time_alpha", CTP + """, x AS (SELECT pos, port_ret AS y, mkt AS x FROM ctp WHERE port_ret IS NOT NULL AND mkt IS NOT NULL), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, count(*) AS n, sum(x * x) - count(*) * avg(x) * avg(x) AS q FROM x),
u AS (SELECT pos, y - a - b * x AS u, (y - a - b * x) * (x - mx) AS g FROM x, f), l AS (SELECT u, g, lag(u, k) OVER (PARTITION BY k ORDER BY pos) AS ul, lag(g, k) OVER (PARTITION BY k ORDER BY pos) AS gl, k FROM u, unnest(range(0, 6)) t(k)),
s AS (SELECT sum(CASE WHEN k = 0 THEN g * g ELSE 2 * (1 - k / 6) * g * coalesce(gl, 0) END) AS gg, sum(CASE WHEN k = 0 THEN u * u ELSE 2 * (1 - k / 6) * u * coalesce(ul, 0) END) AS uu,
  sum(CASE WHEN k = 0 THEN u * g ELSE (1 - k / 6) * (u * coalesce(gl, 0) + g * coalesce(ul, 0)) END) AS ug, sum(u * u) FILTER (k = 0) AS rss FROM l),
o AS (SELECT f.*, s.*, a / sqrt(uu / (n * n) - 2 * mx * ug / (n * q) + mx * mx * gg / (q * q)) AS t, (SELECT sum((y - m) * (y - m)) FROM x, (SELECT avg(y) AS m FROM x)) AS tss FROM f, s)
SELECT n, round(a, 4) + 0.0 AS alpha, round(252 * a, 3) + 0.0 AS alpha_annual, round(t, 3) + 0.0 AS alpha_t, round(""" + normal_sql("t") + """, 4) + 0.0 AS alpha_p, round(b, 4) + 0.0 AS beta, round(b / sqrt(gg / (q * q)), 3) + 0.0 AS beta_t, round(1 - rss / tss, 4) + 0.0 AS r2 FROM o""")
def calendar_time_alpha(s, d):
    digits = {"alpha": 4, "alpha_annual": 3, "alpha_t": 3, "alpha_p": 4, "beta": 4, "beta_t": 3, "r2": 4}
    return stats.hac_regression(ctp(s, d), "port_ret", "mkt", "pos").select("n", *[r(c, k).alias(c) for c, k in digits.items()])


# ---------------------------------------------------------------- text and mapping

INN = """nullif(regexp_replace(regexp_replace(trim({c}), '^(\\d+)\\.0+$', '\\1'), '\\D', '', 'g'), '')"""
COMP = "WITH " + m.COMPANIES_SQL + ", " + m.SECURITIES_SQL + f""",
comp AS (SELECT company_id, name, CASE WHEN length({INN.format(c='inn')}) IN (10, 12) THEN {INN.format(c='inn')} END AS inn FROM companies),
sec AS (SELECT *, CASE WHEN length({INN.format(c='emitent_inn')}) IN (10, 12) THEN {INN.format(c='emitent_inn')} END AS inn, CASE type WHEN 'common_share' THEN 0 WHEN 'preferred_share' THEN 1 ELSE 2 END AS tr FROM securities),
s1 AS (SELECT * FROM sec WHERE inn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY inn, secid ORDER BY tr, is_traded DESC, length(secid), secid, seq) = 1),
prim AS (SELECT *, row_number() OVER (PARTITION BY inn ORDER BY tr, is_traded DESC, length(secid), secid) = 1 AS "primary" FROM s1)"""


def mapped(s, d):
    return mapping.primary_security(m.securities(s, d))


@query("normalize_inn", COMP + " SELECT company_id, inn FROM comp")
def normalize_inn(s, d):
    return m.companies(s, d).select("company_id", text.normalize_inn(F.col("inn")).alias("inn"))


@query("primary_security", COMP + ' SELECT inn, secid, is_traded, type, tr = 0 AS is_common, tr = 1 AS is_preferred, "primary" FROM prim')
def primary_security(s, d):
    return mapped(s, d).select("inn", "secid", "is_traded", "type", "is_common", "is_preferred", "primary")


@query("map_companies", COMP + ' SELECT company_id, c.inn, secid, "primary" FROM (SELECT DISTINCT company_id, inn FROM comp WHERE inn IS NOT NULL) c JOIN prim p ON p.inn = c.inn')
def map_companies(s, d):
    return mapping.map_companies(m.companies(s, d), mapped(s, d)).select("company_id", "inn", "secid", "primary")


@query("unmatched_companies", COMP + " SELECT company_id, name, inn, CASE WHEN inn IS NULL THEN 'no_inn' ELSE 'no_match' END AS reason FROM comp WHERE inn IS NULL OR inn NOT IN (SELECT inn FROM prim)")
def unmatched_companies(s, d):
    return mapping.unmatched_companies(m.companies(s, d), mapped(s, d))


@query("mapping_stats", COMP + " SELECT count(DISTINCT company_id) AS companies, count(DISTINCT CASE WHEN inn IN (SELECT inn FROM prim) THEN company_id END) AS matched, count(DISTINCT inn) AS inns FROM comp")
def mapping_stats(s, d):
    c = m.companies(s, d).select("company_id", text.normalize_inn(F.col("inn")).alias("inn"))
    known = mapped(s, d).select("inn").distinct().withColumn("k", F.lit(1))
    return c.join(known, "inn", "left").agg(F.countDistinct("company_id").alias("companies"), F.countDistinct(F.when(F.col("k") == 1, F.col("company_id"))).alias("matched"), F.countDistinct("inn").alias("inns"))


@query("todo_companies", "WITH " + m.MESSAGES_SQL + ", " + m.COMPANIES_SQL + " SELECT DISTINCT company_id FROM messages WHERE company_id NOT IN (SELECT company_id FROM companies WHERE company_id % 3 = 0)")
def todo_companies(s, d):
    known = m.companies(s, d).filter("company_id % 3 = 0")
    return m.messages(s, d).select("company_id").distinct().join(known, "company_id", "left_anti")


@query("mapped_messages", COMP + ", " + m.MESSAGES_SQL + " SELECT event_id, company_id FROM messages WHERE company_id IN (SELECT company_id FROM comp WHERE inn IN (SELECT inn FROM prim))")
def mapped_messages(s, d):
    return m.messages(s, d).join(mapping.map_companies(m.companies(s, d), mapped(s, d)), "company_id", "left_semi").select("event_id", "company_id")


def _case_sql(title: str) -> str:
    norm = f"lower(trim(regexp_replace(translate(coalesce({title}, ''), '{text.NBSP}ёЁ', ' еЕ'), '\\s+', ' ', 'g')))"
    cases = " ".join(f"WHEN regexp_matches(t, '{'|'.join(f'(?:{p})' for p in ps)}') THEN '{n}'" for n, _, ps in text.CATEGORIES if ps)
    return f"c AS (SELECT *, CASE {cases} ELSE 'other' END AS category FROM (SELECT *, {norm} AS t FROM messages))"


CLASSIFIED = m.MESSAGES_SQL + ", " + _case_sql("event_type")
DIRECTION = "CASE WHEN category = 'buyback' THEN 1 WHEN category = 'default_or_debt' THEN -1 ELSE 0 END"


@query("classify_messages", "WITH " + CLASSIFIED + " SELECT event_id, category FROM c")
def classify_messages(s, d):
    return mapping.classify_messages(m.messages(s, d)).select("event_id", "category")


@query("static_direction", "WITH " + CLASSIFIED + f" SELECT event_id, {DIRECTION} AS direction FROM c")
def static_direction(s, d):
    return mapping.classify_messages(m.messages(s, d)).select("event_id", "direction")


@query("resolve_types", "WITH " + CLASSIFIED + " SELECT DISTINCT event_type, category FROM c")
def resolve_types(s, d):
    return m.messages(s, d).select("event_type").distinct().withColumn("category", text.classify(F.col("event_type")))


CONF = "', '".join(mapping.CONFOUNDERS)


@query("flag_confounders", "WITH " + CLASSIFIED + f""", e AS (SELECT event_id, company_id AS secid, published_at, category FROM c),
f AS (SELECT * FROM e WHERE category IN ('{CONF}'))
SELECT e.event_id, EXISTS (SELECT 1 FROM f WHERE f.secid = e.secid AND f.event_id <> e.event_id AND abs(epoch_us(f.published_at) - epoch_us(e.published_at)) <= 432000000000) AS has_confounder FROM e""")
def flag_confounders(s, d):
    e = mapping.classify_messages(m.messages(s, d)).withColumnRenamed("company_id", "secid")
    return mapping.flag_confounders(e).select("event_id", "has_confounder")


@query("events_table", COMP + ", " + CLASSIFIED + f""", ids AS (SELECT DISTINCT c1.company_id, p.secid FROM comp c1 JOIN prim p ON p.inn = c1.inn AND p."primary"),
e AS (SELECT event_id, secid, published_at, category, CAST({DIRECTION} AS INTEGER) AS direction, c.company_id FROM c JOIN ids USING (company_id)), f AS (SELECT * FROM e WHERE category IN ('{CONF}'))
SELECT e.event_id, e.secid, e.published_at, e.category, e.direction, e.company_id, EXISTS (SELECT 1 FROM f WHERE f.secid = e.secid AND f.event_id <> e.event_id AND abs(epoch_us(f.published_at) - epoch_us(e.published_at)) <= 432000000000) AS has_confounder FROM e""")
def events_table(s, d):
    return mapping.events_table(m.messages(s, d), m.companies(s, d), mapped(s, d)).drop("size")


TOKENS = "list_distinct(list_filter(string_split_regex(replace(lower(coalesce({c}, '')), 'ё', 'е'), '[^0-9a-zа-я]+'), lambda x: x NOT IN ('', '" + "', '".join(text.LEGAL_FORMS) + "')))"


@query("name_tokens", "WITH " + m.COMPANIES_SQL + f" SELECT company_id, list_sort({TOKENS.format(c='name')}) AS tokens FROM companies")
def name_tokens(s, d):
    return m.companies(s, d).select("company_id", F.sort_array(text.name_tokens(F.col("name"))).alias("tokens"))


@query("jaccard", "WITH " + m.SECURITIES_SQL + f", t AS (SELECT seq, {TOKENS.format(c='name')} AS a, {TOKENS.format(c='shortname')} AS b FROM securities) SELECT seq, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS score FROM t")
def jaccard(s, d):
    return m.securities(s, d).select("seq", r(text.jaccard(text.name_tokens(F.col("name")), text.name_tokens(F.col("shortname")))).alias("score"))


@query("fuzzy_candidates", "WITH " + m.SECURITIES_SQL + f""", q AS (SELECT x AS query, {TOKENS.format(c='x')} AS q FROM (VALUES ('АО Brand#1 STANDARD'), ('ECONOMY Brand#23')) t(x)),
s AS (SELECT * FROM securities QUALIFY row_number() OVER (PARTITION BY secid ORDER BY seq) = 1), p AS (SELECT secid, {TOKENS.format(c='emitent_title')} AS a, {TOKENS.format(c='name')} AS b, {TOKENS.format(c='shortname')} AS c FROM s),
z AS (SELECT query, secid, list_max([CASE WHEN len(t) > 0 THEN len(list_intersect(q, t)) / len(list_distinct(list_concat(q, t))) ELSE 0 END FOR t IN [a, b, c]]) AS score FROM q CROSS JOIN p)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, secid) AS INTEGER) AS rank, secid, round(score, 6) AS score FROM z WHERE score > 0 QUALIFY rank <= 5""")
def fuzzy_candidates(s, d):
    q = s.createDataFrame([("АО Brand#1 STANDARD",), ("ECONOMY Brand#23",)], "query string")
    return mapping.fuzzy_candidates(q, m.securities(s, d)).select("query", "rank", "secid", r("score").alias("score"))


@query("parse_number", "WITH t AS (SELECT p_partkey, replace(CAST(p_retailprice AS VARCHAR), '.', ',') || ' %' AS x FROM part) SELECT p_partkey, TRY_CAST(replace(replace(regexp_extract(x, '([-+]?\\d[\\d\\s]*(?:[.,]\\d+)?)', 1), ' ', ''), ',', '.') AS DOUBLE) AS value FROM t")
def parse_number(s, d):
    t = m.table(s, d, "part").select("p_partkey", F.concat(F.regexp_replace(F.col("p_retailprice").cast("string"), r"\.", ","), F.lit(" %")).alias("x"))
    return t.select("p_partkey", text.parse_number(F.col("x")).alias("value"))


@query("parse_datetime", "SELECT event_id, date_trunc('minute', ts) AS at FROM events")
def parse_datetime(s, d):
    return m.table(s, d, "events").select("event_id", text.parse_datetime(F.concat(F.lit("от "), F.date_format("ts", "dd.MM.yyyy HH:mm"), F.lit(" мск"))).alias("at"))


# Pages of several shapes: long and short numbers, absent ones, an event by number, by path, by both, by none.
@query("extract_ids", """SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 12 END, '7') AS inn,
  CASE WHEN p_partkey % 3 > 0 THEN lpad(CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 3 = 1 THEN 13 ELSE 15 END, '1') END AS ogrn,
  CASE WHEN p_partkey % 5 > 0 THEN lpad(CAST(p_partkey AS VARCHAR), CAST(8 + p_partkey % 3 AS INTEGER), '4') END AS okpo, CAST(p_partkey AS BIGINT) AS company_id,
  CASE p_partkey % 4 WHEN 0 THEN 'Num_' || p_partkey WHEN 1 THEN 'path-' || p_partkey WHEN 2 THEN 'Num_' || p_partkey END AS event_id FROM part""")
def extract_ids(s, d):
    from tapeline.sources.feeds import extract_ids as ids

    html = """concat('<a href="/portal/company.aspx?id=', p_partkey, '">ИНН: ', lpad(string(p_partkey), if(p_partkey % 2 = 0, 10, 12), '7'), '</a>',
      if(p_partkey % 3 > 0, concat('<p>ОГРН эмитента - ', lpad(string(p_partkey), if(p_partkey % 3 = 1, 13, 15), '1'), '</p>'), '<p>ОГРН: нет</p>'),
      if(p_partkey % 5 > 0, concat('<p>ОКПО ', lpad(string(p_partkey), int(8 + p_partkey % 3), '4'), '</p>'), ''),
      if(p_partkey % 4 IN (1, 2), concat('<a href="/soobshheniya/path-', p_partkey, '?x=1">'), ''), if(p_partkey % 2 = 0, concat('<a href="/portal/event.aspx?eventid=Num_', p_partkey, '">'), ''))"""
    t = m.table(s, d, "part").select("p_partkey", F.expr(html).alias("html"))
    return t.select("p_partkey", *[c for c in ids(F.col("html"))])
