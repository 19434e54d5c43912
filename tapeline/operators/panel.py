"""Calendar-complete panel: trading calendar, grid, returns, turnover, liquidity.

The wide day x security matrix of the classic formulation is kept long: (secid, pos, date, ...), with pos the
dense ordinal of the trading day. Windows partition by secid, so one exchange on secid serves all of them. The
calendar has one row a trading day (some tens of thousands for centuries), so its broadcast does not follow the
data; everything price-sized stays distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def by_secid():
    """A security's sessions in order; made on call, as workers import this module without a session."""
    return W.partitionBy("secid").orderBy("pos")


def before():
    return by_secid().rowsBetween(W.unboundedPreceding, -1)


def upto():
    return by_secid().rowsBetween(W.unboundedPreceding, 0)


def finite(c: Column) -> Column:
    """NaN and infinities as NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def trading_calendar(prices: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(date, pos): sorted distinct dates of prices and index."""
    dates = prices.select(F.col("date").cast("date").alias("date"))
    if index is not None:
        dates = dates.union(index.select(F.col("date").cast("date").alias("date")))
    # One row a trading day: the only ordering over all of them, on a bounded table.
    return dates.filter("date IS NOT NULL").distinct().select("date", (F.row_number().over(W.orderBy("date")) - 1).cast("int").alias("pos"))


def price_grid(prices: DataFrame, calendar: DataFrame, columns: tuple[str, ...] = ("open", "close", "value")) -> DataFrame:
    """Every (secid, trading day) with the day's prices or NULL."""
    secids = prices.select("secid").distinct()
    days = secids.join(F.broadcast(calendar.agg(F.sort_array(F.collect_list(F.struct("pos", "date"))).alias("_days"))))
    cells = days.select("secid", F.explode("_days").alias("_d")).select("secid", F.col("_d.pos").alias("pos"), F.col("_d.date").alias("date"))
    have = prices.select("secid", "date", *[finite(F.col(c)).alias(c) if c in prices.columns else F.lit(None).cast("double").alias(c) for c in columns])
    return cells.join(have, ["secid", "date"], "left").select("secid", "pos", "date", *columns)


def index_series(index: DataFrame, calendar: DataFrame) -> DataFrame:
    """(pos, date, mkt_close, mkt): the benchmark on the calendar, filled forward, and its return; one row a day."""
    w = W.orderBy("pos")
    filled = calendar.join(index.select("date", finite(F.col("close")).alias("_c")), "date", "left").withColumn("mkt_close", F.last("_c", True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return filled.select("pos", "date", "mkt_close", (F.col("mkt_close") / F.lag("mkt_close").over(w) - 1).alias("mkt"))


def with_returns(grid: DataFrame, fill_gaps: bool = True) -> DataFrame:
    """Adds prev_close and ret: against the last price before (gaps bridged) or the day before."""
    prev = F.last("close", True).over(before()) if fill_gaps else F.lag("close").over(by_secid())
    return grid.withColumn("prev_close", prev).withColumn("ret", F.try_divide(F.col("close"), F.col("prev_close")) - 1)


def log_returns(grid: DataFrame) -> DataFrame:
    return with_returns(grid).withColumn("log_ret", F.when(F.col("ret") > -1, F.ln(F.col("close") / F.col("prev_close"))))


def market_adjusted(returns: DataFrame, market: DataFrame) -> DataFrame:
    """Adds mkt and ar = ret - mkt; the market is one row a day."""
    return returns.join(F.broadcast(market.select("pos", "mkt")), "pos", "left").withColumn("ar", F.col("ret") - F.col("mkt"))


def median_before(column: str, lookback: int, least: int = 1) -> Column:
    """Median of ``column`` over the ``lookback`` rows before a row, where at least ``least`` of them have one; else NULL.

    The frame's values are one array of doubles that is sorted as it is; a percentile over the frame counts its values in a hash map
    first, at two to three times the time.
    """
    values = F.sort_array(F.collect_list(column).over(by_secid().rowsBetween(-lookback, -1)))
    # One value or two in the middle: both places are the same where the count is odd.
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    return F.when(F.size(values) >= max(1, least), middle(values))


def adv(grid: DataFrame, lookback: int = 60) -> DataFrame:
    """Adds adv: median turnover of the ``lookback`` rows before the day, where at least max(5, lookback // 3) have one."""
    return grid.withColumn("adv", median_before("value", lookback, max(5, lookback // 3)))


def mark_prices(grid: DataFrame) -> DataFrame:
    """Adds last_close (filled forward) and last_valid_pos of the security."""
    return grid.withColumn("last_close", F.last("close", True).over(upto())).withColumn("last_valid_pos", F.max(F.when(F.col("close").isNotNull(), F.col("pos"))).over(W.partitionBy("secid")))


def liquidity_stats(prices: DataFrame, window_days: int = 60, as_of: str | None = None, calendar: DataFrame | None = None) -> DataFrame:
    """Liquidity over calendar days (end - window, end], by security; trading days without volume count as turnover 0."""
    p = prices.select("secid", F.col("date").cast("date").alias("date"), F.coalesce(F.expr("try_cast(volume AS double)"), F.lit(0.0)).alias("volume"), F.coalesce(finite(F.col("value")), F.lit(0.0)).alias("value"))
    ends = p.groupBy("secid").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    ends = ends.withColumn("window_end", F.lit(as_of).cast("date") if as_of else F.col("last_date"))
    traded = p.filter("volume > 0").groupBy("secid", "date").agg(F.sum("value").alias("value"))
    days = (calendar if calendar is not None else trading_calendar(p)).select("date")
    # The window's calendar days meet the trading days by equality; a window without any trading day keeps one empty row.
    spread = ends.withColumn("day", F.explode(F.sequence(F.date_sub("window_end", window_days - 1), F.col("window_end"))))
    cells = spread.join(F.broadcast(days.withColumnRenamed("date", "day").withColumn("date", F.col("day"))), "day", "left").drop("day")
    cells = cells.join(traded, ["secid", "date"], "left")
    known = F.col("date").isNotNull()
    n, t = F.count("date"), F.count_if(known & F.col("value").isNotNull())
    turnover = F.when(known, F.coalesce("value", F.lit(0.0)))
    return cells.groupBy("secid").agg(
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.max("window_end").alias("window_end"), n.alias("n_days"), t.alias("n_traded_days"),
        F.percentile(turnover, 0.5).alias("median_value"), F.avg(turnover).alias("mean_value"), (1 - F.try_divide(t, n)).alias("zero_volume_share"),
    )


#: Securities that a wide table has at most: each is a column of the plan.
MOST_WIDE = 2000


def to_wide(grid: DataFrame, secids: list[str], column: str = "close") -> DataFrame:
    """date x security for a named list of at most MOST_WIDE securities; more is an error, as the long grid serves any number."""
    if len(secids) > MOST_WIDE:
        raise ValueError(f"{len(secids)} securities are too many columns, {MOST_WIDE} at most")
    return grid.filter(F.col("secid").isin(secids)).groupBy("date").pivot("secid", secids).agg(F.max(column))
