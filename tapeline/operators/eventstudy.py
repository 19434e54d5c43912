"""Event study: filters, windows of abnormal returns, CAR and BHAR, market model, summaries, calendar-time portfolios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeline.functions import stats
from tapeline.operators import panel, timing
from tapeline.schema import require

#: Rows whose weights for all draws are made at once, and groups whose sums a task holds before it passes them on.
SLICE, HELD = 512, 256
WINDOWS = ((-1, 1), (0, 0), (0, 1), (0, 5), (0, 10), (0, 20), (1, 5), (1, 20))


@dataclass(frozen=True)
class StudyConfig:
    windows: tuple[tuple[int, int], ...] = WINDOWS
    model: str = "market_adjusted"
    cutoff: str = timing.CUTOFF
    min_price_obs: int = 20
    lookback: int = 60
    min_turnover: float | None = 5e6
    est_window: tuple[int, int] = (-250, -30)
    min_est_obs: int = 100
    coverage: float = 0.8
    bootstrap: int = 2000
    seed: int = 0

    def __post_init__(self):
        if self.model not in ("market_adjusted", "market_model"):
            raise ValueError(self.model)
        if any(a > b for a, b in (*self.windows, self.est_window)) or not 0 < self.coverage <= 1:
            raise ValueError("windows must rise and coverage lie in (0, 1]")


def normalize_events(events: DataFrame) -> DataFrame:
    """Required ids, category 'all' and direction 0 by default, types coerced; other columns pass."""
    require(events, "event_id", "secid", "published_at")
    core = ["event_id", "secid", "published_at", "category", "direction"]
    have = set(events.columns)
    category = F.coalesce(F.col("category").cast("string"), F.lit("all")) if "category" in have else F.lit("all")
    direction = F.coalesce(F.expr("try_cast(try_cast(direction AS double) AS int)"), F.lit(0)) if "direction" in have else F.lit(0)
    published = timing.mixed_datetime(F.col("published_at")) if dict(events.dtypes)["published_at"] == "string" else F.expr("try_cast(published_at AS timestamp_ntz)")
    return events.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("secid").cast("string").alias("secid"), published.alias("published_at"),
        category.alias("category"), direction.alias("direction"), *[F.col(f"`{c}`") for c in events.columns if c not in core],
    )


def dedup_events(events: DataFrame) -> DataFrame:
    """The first row of each event id, by publication and then by content: the order does not depend on the input's."""
    return panel.keep_one(events, ["event_id"], [F.col("published_at").asc_nulls_last(), F.col("secid"), F.col("category"), F.col("direction")])


def history(grid: DataFrame, lookback: int) -> DataFrame:
    """Adds n_hist and med_value: closes and the median turnover of the rows before each day."""
    w = panel.by_secid().rowsBetween(-lookback, -1)
    return grid.withColumn("n_hist", F.count("close").over(w)).withColumn("med_value", panel.median_before("value", lookback))


def with_drop_reason(events: DataFrame, grid: DataFrame, calendar: DataFrame, config: StudyConfig) -> DataFrame:
    """Events with t0 and the first reason, in fixed order, to leave them out (NULL: used)."""
    ev = normalize_events(events)
    missing = F.col("event_id").isNull() | F.col("secid").isNull() | F.col("published_at").isNull()
    ev = ev.withColumn("_rn", F.row_number().over(W.partitionBy("event_id", missing).orderBy(F.col("published_at").asc_nulls_last(), "secid", "category", "direction")))
    ev = timing.assign_session(ev, calendar, config.cutoff)
    h = history(grid, config.lookback).select("secid", F.col("pos").alias("t0_pos"), "n_hist", "med_value")
    known = grid.select("secid").distinct().withColumn("_known", F.lit(True))
    ev = ev.join(h, ["secid", "t0_pos"], "left").join(known, "secid", "left")
    reason = F.when(missing, "missing_fields").when(F.col("_rn") > 1, "duplicate").when(F.col("t0_pos").isNull(), "no_t0").when(F.col("_known").isNull(), "unknown_secid")
    reason = reason.when(F.coalesce("n_hist", F.lit(0)) < config.min_price_obs, "short_history")
    if config.min_turnover is not None:
        reason = reason.when(~F.coalesce(F.col("med_value") >= config.min_turnover, F.lit(False)), "illiquid")
    return ev.withColumn("drop_reason", reason).drop("_rn", "_known")


def gather_window(events: DataFrame, returns: DataFrame, start: int, end: int, columns: tuple[str, ...] = ("ret", "mkt", "ar")) -> DataFrame:
    """(event columns, rel_day, columns): the panel around t0, NULL beyond its ends; an equi-join after the explode."""
    rows = events.withColumn("rel_day", F.explode(F.sequence(F.lit(start), F.lit(end)))).withColumn("pos", F.col("t0_pos") + F.col("rel_day"))
    return rows.join(returns.select("secid", "pos", *columns), ["secid", "pos"], "left").drop("pos")


def market_model(events: DataFrame, returns: DataFrame, est: tuple[int, int] = (-250, -30), min_obs: int = 100) -> DataFrame:
    """alpha, beta, sigma, n_obs, fallback for each event, from prefix sums: one running window, two look-ups, O(n)."""
    ok = F.col("ret").isNotNull() & F.col("mkt").isNotNull()
    r, m = F.when(ok, F.col("ret")), F.when(ok, F.col("mkt"))
    terms = {"n": F.when(ok, 1.0), "r": r, "m": m, "mm": m * m, "rm": r * m, "rr": r * r}
    run = returns.select("secid", "pos", *[F.coalesce(F.sum(v).over(panel.upto()), F.lit(0.0)).alias(f"s_{k}") for k, v in terms.items()])
    last = returns.agg(F.max("pos").alias("_last"))  # one row
    ev = events.join(F.broadcast(last)).withColumn("_hi", F.least(F.col("t0_pos") + est[1], F.col("_last"))).withColumn("_lo", F.col("t0_pos") + est[0] - 1)
    side = lambda p: run.select(F.col("secid"), F.col("pos").alias(f"_{p}"), *[F.col(f"s_{k}").alias(f"{p}_{k}") for k in terms])
    ev = ev.join(side("hi"), ["secid", "_hi"], "left").join(side("lo"), ["secid", "_lo"], "left")
    d = {k: F.coalesce(F.col(f"hi_{k}"), F.lit(0.0)) - F.coalesce(F.col(f"lo_{k}"), F.lit(0.0)) for k in terms}
    n = F.round(d["n"]).cast("int")
    vm = d["mm"] - F.try_divide(d["m"] * d["m"], d["n"])
    beta = F.try_divide(d["rm"] - F.try_divide(d["m"] * d["r"], d["n"]), vm)
    alpha = F.try_divide(d["r"] - beta * d["m"], d["n"])
    rss = d["rr"] - F.try_divide(d["r"] * d["r"], d["n"]) - beta * (d["rm"] - F.try_divide(d["m"] * d["r"], d["n"]))
    good = (n >= min_obs) & (vm > 1e-14) & beta.isNotNull()
    sigma = F.when(good & (n > 2), F.sqrt(F.greatest(rss, F.lit(0.0)) / (n - 2)))
    keep = [c for c in events.columns]
    return ev.select(*keep, F.when(good, alpha).otherwise(0.0).alias("alpha"), F.when(good, beta).otherwise(1.0).alias("beta"), sigma.alias("sigma"), n.alias("n_obs"), F.coalesce(~good, F.lit(True)).alias("fallback"))


def event_ar(gathered: DataFrame, model: str = "market_adjusted") -> DataFrame:
    """Adds model_ar and model: by the market model where its parameters hold, else market-adjusted."""
    if model == "market_adjusted":
        return gathered.withColumn("model_ar", F.col("ret") - F.col("mkt")).withColumn("model", F.lit("market_adjusted"))
    plain = F.col("fallback")
    return gathered.withColumn("model_ar", F.when(plain, F.col("ret") - F.col("mkt")).otherwise(F.col("ret") - (F.col("alpha") + F.col("beta") * F.col("mkt")))).withColumn("model", F.when(plain, "market_adjusted").otherwise("market_model"))


#: What a window needs of its days: how many are valid, sums of returns and of their logarithms, and total losses (a factor of nothing).
TERMS = ("n", "ret", "mkt", "log_ret", "log_mkt", "lost_ret", "lost_mkt")


def running_sums(returns: DataFrame) -> DataFrame:
    """(secid, pos, s): sums from a security's first session up to each one, over days that have both returns."""
    ok = F.col("ret").isNotNull() & F.col("mkt").isNotNull()
    lost = lambda c: (F.col(c) <= -1).cast("double")
    value = {"n": F.lit(1.0), "ret": F.col("ret"), "mkt": F.col("mkt"), "log_ret": F.ln(1 + F.col("ret")), "log_mkt": F.ln(1 + F.col("mkt")), "lost_ret": lost("ret"), "lost_mkt": lost("mkt")}
    run = [F.coalesce(F.sum(F.when(ok, value[k])).over(panel.upto()), F.lit(0.0)).alias(k) for k in TERMS]
    return returns.select("secid", "pos", F.struct(*run).alias("s"))


def window_sums(returns: DataFrame, windows: tuple[tuple[int, int], ...]) -> DataFrame:
    """(secid, pos, n0, ret0, ..., n1, ...): what each window around each session sums to, as differences of two running sums.

    The grid is complete, so the session some days off is a row some rows off: the look-ups share the running sums' partitioning and order.
    """
    nothing = F.struct(*[F.lit(0.0).alias(k) for k in TERMS])
    w = panel.by_secid()
    whole = F.last("s").over(w.rowsBetween(0, W.unboundedFollowing))
    at = lambda k: F.col("s") if k == 0 else F.coalesce(F.lead("s", k).over(w), F.col("whole")) if k > 0 else F.coalesce(F.lag("s", -k).over(w), nothing)
    offsets = sorted({k for a, b in windows for k in (a - 1, b)})
    run = running_sums(returns).withColumn("whole", whole).select("secid", "pos", *[at(k).alias(f"at{k}") for k in offsets])
    return run.select("secid", "pos", *[(F.col(f"`at{b}`")[t] - F.col(f"`at{a - 1}`")[t]).alias(f"{t}{i}") for i, (a, b) in enumerate(windows) for t in TERMS])


def car_cells(events: DataFrame, returns: DataFrame, windows: tuple[tuple[int, int], ...], model: str = "market_adjusted") -> DataFrame:
    """One row an event and window: car, bhar, n_days, raw_ret, mkt_ret over its valid days; two look-ups in running sums each.

    ``events`` have t0_pos and, for the market model, alpha, beta and fallback. No day of a window becomes a row.
    """
    keys = ["event_id", "secid", "category", "direction", "t0"]
    plain = F.col("fallback") if model == "market_model" else F.lit(True)
    alpha, beta = (F.when(plain, F.lit(x)).otherwise(F.col(c)) if model == "market_model" else F.lit(x) for x, c in ((0.0, "alpha"), (1.0, "beta")))
    ev = events.select(*keys, F.col("t0_pos").alias("pos"), alpha.alias("_alpha"), beta.alias("_beta"), F.when(plain, "market_adjusted").otherwise("market_model").alias("model"))
    wide = ev.join(window_sums(returns, windows), ["secid", "pos"], "left")
    # One struct a window; the few windows of an event become rows, never their days.
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *[F.col(f"{t}{i}").alias(t) for t in TERMS]) for i, (a, b) in enumerate(windows)])
    long = wide.select(*keys, "_alpha", "_beta", "model", F.explode(cells).alias("_s"))
    s = lambda t: F.coalesce(F.col(f"_s.{t}"), F.lit(0.0))
    gross = lambda c: F.when(F.round(s(f"lost_{c}")) > 0, 0.0).otherwise(F.exp(s(f"log_{c}")))
    n = F.round(s("n")).cast("bigint")
    return long.select(
        *keys, F.col("_s.a").alias("win_start"), F.col("_s.b").alias("win_end"), F.when(n > 0, s("ret") - n * F.col("_alpha") - F.col("_beta") * s("mkt")).alias("car"), (gross("ret") - gross("mkt")).alias("bhar"), n.alias("n_days"),
        (gross("ret") - 1).alias("raw_ret"), (gross("mkt") - 1).alias("mkt_ret"), "model",
    ).withColumn("window", F.format_string("[%d,%d]", "win_start", "win_end"))


def enough(coverage: float) -> Column:
    length = F.col("win_end") - F.col("win_start") + 1
    return F.col("n_days") >= F.greatest(F.lit(1), F.ceil(F.round(F.lit(coverage) * length, 9)))


def car_table(events: DataFrame, returns: DataFrame, windows: tuple[tuple[int, int], ...], coverage: float = 0.8, model: str = "market_adjusted") -> DataFrame:
    return car_cells(events, returns, windows, model).filter(enough(coverage))


def car_coverage(events: DataFrame, returns: DataFrame, windows: tuple[tuple[int, int], ...], coverage: float = 0.8, model: str = "market_adjusted") -> DataFrame:
    """Events kept and left out by window."""
    return car_cells(events, returns, windows, model).groupBy("win_start", "win_end").agg(F.count_if(enough(coverage)).alias("kept"), F.count_if(~enough(coverage)).alias("dropped"))


def signed(cars: DataFrame, drop_neutral: bool = True) -> DataFrame:
    """Adds signed_car, signed_bhar, signed_raw_ret: times the direction; neutral events go or get NULL."""
    d = F.when(F.col("direction") != 0, F.col("direction"))
    out = cars
    for c in ("car", "bhar", "raw_ret"):
        out = out.withColumn(f"signed_{c}", F.col(c) * d)
    return out.filter("direction <> 0") if drop_neutral else out


def summarize(cars: DataFrame, by: tuple[str, ...] = ("category", "direction"), value: str = "car", bhar: str = "bhar") -> DataFrame:
    """n, mean, median, standard deviation, t and p, share above zero, sign test, mean BHAR, by keys and window."""
    g = cars.groupBy(*by, "window", "win_start", "win_end").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean_car"), F.percentile(value, 0.5).alias("median_car"), F.stddev_samp(value).alias("std"),
        F.avg(F.when(F.col(value).isNotNull(), (F.col(value) > 0).cast("double"))).alias("share_positive"), F.count_if(F.col(value) > 0).alias("_pos"), F.count_if(F.col(value) != 0).alias("_nz"), F.avg(bhar).alias("mean_bhar"),
    )
    t = F.when((F.col("n") >= 2) & (F.col("std") > 0), F.col("mean_car") / (F.col("std") / F.sqrt(F.col("n").cast("double"))))
    g = g.withColumn("t_stat", t)
    return g.withColumn("p_value", F.when(F.col("t_stat").isNotNull(), stats.student_p(F.col("t_stat"), F.col("n") - 1))).withColumn("sign_test_p", F.when(F.col("n") >= 2, stats.sign_test_p(F.col("_pos"), F.col("_nz")))).drop("_pos", "_nz")


def screen(summary: DataFrame, window: str, min_n: int = 10, alpha: float = 0.05) -> DataFrame:
    """Categories of one window with enough events, with q-values, ranked by |t|."""
    kept = stats.bh_q(summary.filter((F.col("window") == window) & (F.col("n") >= min_n) & F.col("p_value").isNotNull()))
    rank = F.row_number().over(W.orderBy(F.desc(F.abs("t_stat")), "category", "direction"))  # a table of results
    return kept.withColumn("significant", F.col("q_value") <= alpha).withColumn("rank", rank)


def average_path(gathered: DataFrame, use_sign: bool = False, value: str = "model_ar") -> DataFrame:
    """Mean abnormal return by category, direction and relative day, and its running sum (an empty day counts 0)."""
    v = F.col(value) * F.col("direction") if use_sign else F.col(value)
    src = gathered.filter("direction <> 0") if use_sign else gathered
    g = src.groupBy("category", "direction", "rel_day").agg(F.avg(v).alias("mean_ar"), F.count(v).alias("n"))
    w = W.partitionBy("category", "direction").orderBy("rel_day").rowsBetween(W.unboundedPreceding, 0)
    return g.withColumn("mean_car", F.sum(F.coalesce("mean_ar", F.lit(0.0))).over(w))


def bootstrap_ci(cars: DataFrame, by: tuple[str, ...] = ("category", "direction", "window"), value: str = "car", draws: int = 2000, seed: int = 0, row: str = "event_id") -> DataFrame:
    """Percentile interval of the mean by group, from ``draws`` resamples with Poisson weights; NULL bounds for a group of one row.

    A weight follows from (seed, group, ``row``, draw) alone, by a hash that is linear in the row with factors of the draw (weights of different
    rows are independent in pairs, so the spread of a mean is the true one). No row needs to know how many others there are: sums of weight
    and of weight x value by group and draw merge in any order and before any exchange, reruns agree, and groups do not depend on each other.
    Rows of a group with the same ``row`` are drawn together. A draw that takes no row (likely in groups of a few rows only) does not count.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in by], F.col(row).cast("string")))
    rows = cars.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), stats.hex_word(digest, 0).alias("_x"), stats.hex_word(digest, 1).alias("_y"))
    words, limits, kinds = stats.draw_words(draws, seed), stats.POISSON, dict(cars.dtypes)
    ddl = ", ".join([f"`{k}` {kinds[k]}" for k in by] + ["_n array<bigint>", "_s array<double>"])

    def partial(batches):
        import numpy as np
        import pandas as pd

        a, b, c = (np.array(x, "int64") for x in words)
        held: dict = {}
        table = lambda: pd.DataFrame([[*key, n, s] for key, (n, s) in held.items()], columns=[*by, "_n", "_s"])
        for pdf in batches:
            for key, part in pdf.groupby(list(by), dropna=False, sort=False):
                n, s = held.setdefault(key, (np.zeros(draws + 1, "int64"), np.zeros(draws + 1)))
                # The last place takes every row once: it counts the group.
                n[-1] += len(part)
                for lo in range(0, len(part), SLICE):
                    x, y, v = (part[k].to_numpy()[lo : lo + SLICE] for k in ("_x", "_y", "_v"))
                    weight = np.searchsorted(limits, (np.outer(x, a) + np.outer(y, b) + c) % stats.PRIME, side="right")
                    n[:-1] += weight.sum(0)
                    s[:-1] += v @ weight
            if len(held) >= HELD:
                yield table()
                held.clear()
        if held:
            yield table()

    each = rows.mapInPandas(partial, ddl).select(*by, F.posexplode(F.arrays_zip("_n", "_s")).alias("_draw", "_e"))
    sums = each.groupBy(*by, "_draw").agg(F.sum("_e._n").alias("_n"), F.sum("_e._s").alias("_s"))
    real = F.col("_draw") < draws
    out = sums.groupBy(*by).agg(F.max(F.when(~real, F.col("_n"))).alias("n"), F.percentile(F.when(real & (F.col("_n") > 0), F.try_divide("_s", "_n")), [0.025, 0.975]).alias("_ends"))
    return out.select(*by, "n", *[F.when(F.col("n") > 1, F.get("_ends", F.lit(i))).alias(c) for i, c in enumerate(("ci_low", "ci_high"))])


def calendar_time(events: DataFrame, returns: DataFrame, lag: int = 1, hold: int = 20) -> DataFrame:
    """Equal-weighted daily return of the securities within ``hold`` sessions of an event; every session has a row."""
    member = events.withColumn("pos", F.explode(F.sequence(F.col("t0_pos") + lag, F.col("t0_pos") + lag + hold - 1))).select("secid", "pos").distinct()
    held = member.join(returns.select("secid", "pos", "ret"), ["secid", "pos"]).filter("ret IS NOT NULL")
    days = returns.select("pos", "date", "mkt").distinct()
    return days.join(held.groupBy("pos").agg(F.avg("ret").alias("port_ret"), F.count(F.lit(1)).alias("n_stocks")), "pos", "left").select("pos", "date", "port_ret", F.coalesce("n_stocks", F.lit(0)).alias("n_stocks"), "mkt")
