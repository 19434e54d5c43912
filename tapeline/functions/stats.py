"""Statistics as column expressions: Student t, exact sign test, Newey-West regression."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeline.sources.scratch import staged

#: Rows of a range of p-values.
ROWS_A_RANGE = 200_000


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value for whole degrees of freedom, by the finite trigonometric series; NULL where df < 1."""
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    cos2 = F.cos(theta) * F.cos(theta)
    odd = df % 2 == 1
    # Terms of the series: each is the one before times cos^2 (2k - 1)/(2k), with the roles swapped for odd df.
    terms = F.when(odd, F.floor((df - 3) / 2)).otherwise(F.floor((df - 2) / 2)).cast("int")
    ratio = lambda k: F.when(odd, (2 * k) / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    step = lambda a, k: F.struct((a["term"] * cos2 * ratio(k)).alias("term"), (a["sum"] + a["term"] * cos2 * ratio(k)).alias("sum"))
    steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(steps, zero, step, lambda a: a["sum"])
    even_a = F.sin(theta) * series
    odd_a = F.lit(2 / math.pi) * (theta + F.when(df > 1, F.sin(theta) * F.cos(theta) * series).otherwise(F.lit(0.0)))
    return F.when(df >= 1, F.greatest(F.lit(0.0), 1 - F.when(odd, odd_a).otherwise(even_a)))


def sign_test_p(positive: Column, n: Column) -> Column:
    """Exact two-sided binomial p-value at one half; NULL without a trial."""
    k = F.least(positive, n - positive).cast("int")
    zero = F.struct((-n * F.lit(math.log(2))).alias("log"), F.exp(-n * F.lit(math.log(2))).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        log = a["log"] + F.ln((n - i + 1) / i)
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.when(n >= 1, F.least(F.lit(1.0), 2 * F.aggregate(steps, zero, step, lambda a: a["sum"])))


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal, by the complementary error function's continued fraction and series."""
    x = F.abs(z) / math.sqrt(2)
    series_step = lambda a, k: F.struct((a["term"] * -(x * x) / k).alias("term"), (a["sum"] + a["term"] * -(x * x) / k / (2 * k + 1)).alias("sum"))
    erf = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("term"), x.alias("sum")), series_step, lambda a: a["sum"] * (2 / math.sqrt(math.pi)))
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda a, k: x + (k / 2) / a)
    tail = F.exp(-x * x) / math.sqrt(math.pi) / fraction
    return F.when(x < 2.5, 1 - erf).otherwise(tail)


def bh_q(df: DataFrame, p: str = "p_value", out: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg q-values; NULL p stay NULL.

    A scan over ranges of p: rows are dealt by range (ties by a number of their own, so many equal p are no range of their own) and written once;
    counts by range give each row its rank, and the running minimum from the largest p down is that of the row's range and of the least
    of the ranges behind it. Only one row a range is ordered in one task.
    """
    tested = staged(df.withColumn("_tie", F.monotonically_increasing_id()))
    total = tested.agg(F.count(p)).first()[0]
    ranges = max(1, -(-total // ROWS_A_RANGE))
    some = tested.filter(F.col(p).isNotNull()).repartitionByRange(ranges, p, "_tie").sortWithinPartitions(p, "_tie")
    # monotonically_increasing_id: the partition in the upper bits, the place in it in the lower 33.
    held = staged(some.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33).cast("int")))
    counts = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_first"))
    place = F.col("_first") + F.col("_at") - F.shiftleft(F.col("_range").cast("long"), 33) + 1
    ranked = held.join(F.broadcast(first), "_range").withColumn("_raw", F.col(p) * F.lit(total) / place)
    behind = W.orderBy("_range").rowsBetween(1, W.unboundedFollowing)
    ahead = ranked.groupBy("_range").agg(F.min("_raw").alias("_least")).select("_range", F.min("_least").over(behind).alias("_behind"))
    least = F.least(F.min("_raw").over(W.partitionBy("_range").orderBy(F.desc("_at"))), F.col("_behind"))
    scored = ranked.join(F.broadcast(ahead), "_range").withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), least)))
    columns = [F.col(f"`{c}`") for c in df.columns if c != out]
    return scored.select(*columns, out).unionByName(tested.filter(F.col(p).isNull()).select(*columns, F.lit(None).cast("double").alias(out)))


#: Words that decide weights are taken modulo this prime, so their products stay below 2^63.
PRIME = 2**31 - 1
#: Below which word a Poisson weight of mean 1 is 0, 1, 2, ...; beyond the last one it is their number.
POISSON = [round(PRIME * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(12)]


def hex_word(digest: Column, k: int) -> Column:
    """The ``k``-th word of seven digits of a digest in hex: below PRIME."""
    return F.conv(F.substring(digest, 7 * k + 1, 7), 16, 10).cast("bigint")


def draw_words(draws: int, seed: int) -> list[list[int]]:
    """Three lists, a word a draw: the first seven, the next and the next seven hex digits of the digest of seed and draw."""
    digests = [hashlib.md5(f"{seed}|{d}".encode()).hexdigest() for d in range(draws)]
    return [[int(x[7 * k : 7 * k + 7], 16) for x in digests] for k in range(3)]


def hac_regression(df: DataFrame, y: str, x: str, order: str, lags: int = 5, periods: int = 252, keys: tuple[str, ...] = ()) -> DataFrame:
    """alpha, beta, their Newey-West (Bartlett, z) t-values and R^2 of y on x, by keys; NULL with fewer than max(10, lags + 3) + 1 rows.

    Sums and lagged sums only: two aggregations and one window over the ordered series.
    """
    by = W.partitionBy(*keys)
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(order).alias("_o"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    fit = rows.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_mx", F.avg("_x").over(by)).withColumn("_my", F.avg("_y").over(by))
    sxx = F.sum((F.col("_x") - F.col("_mx")) * (F.col("_x") - F.col("_mx"))).over(by)
    sxy = F.sum((F.col("_x") - F.col("_mx")) * (F.col("_y") - F.col("_my"))).over(by)
    fit = fit.withColumn("_sxx", sxx).withColumn("_beta", F.try_divide(sxy, sxx)).withColumn("_alpha", F.col("_my") - F.col("_beta") * F.col("_mx"))
    fit = fit.withColumn("_u", F.col("_y") - F.col("_alpha") - F.col("_beta") * F.col("_x"))
    # With x centred the design is orthogonal; scores are u and u (x - mean).
    fit = fit.withColumn("_g", F.col("_u") * (F.col("_x") - F.col("_mx")))
    w = W.partitionBy(*keys).orderBy("_o")
    uu, ug, gg = F.sum(F.col("_u") * F.col("_u")), F.sum(F.col("_u") * F.col("_g")), F.sum(F.col("_g") * F.col("_g"))
    for lag in range(1, lags + 1):
        fit = fit.withColumn(f"_u{lag}", F.lag("_u", lag).over(w)).withColumn(f"_g{lag}", F.lag("_g", lag).over(w))
    for lag in range(1, lags + 1):
        k = 1 - lag / (lags + 1)
        ul, gl = F.coalesce(F.col(f"_u{lag}"), F.lit(0.0)), F.coalesce(F.col(f"_g{lag}"), F.lit(0.0))
        uu = uu + 2 * k * F.sum(F.col("_u") * ul)
        gg = gg + 2 * k * F.sum(F.col("_g") * gl)
        ug = ug + k * F.sum(F.col("_u") * gl + F.col("_g") * ul)
    s = fit.groupBy(*keys).agg(
        F.max("_n").alias("n"), F.max("_alpha").alias("alpha"), F.max("_beta").alias("beta"), F.max("_sxx").alias("_sxx"), F.max("_mx").alias("_mx"),
        uu.alias("_suu"), ug.alias("_sug"), gg.alias("_sgg"), F.sum(F.col("_u") * F.col("_u")).alias("_rss"), F.sum((F.col("_y") - F.col("_my")) * (F.col("_y") - F.col("_my"))).alias("_tss"),
    )
    n, m, q = F.col("n"), F.col("_mx"), F.col("_sxx")
    var_beta = F.col("_sgg") / (q * q)
    var_alpha = F.col("_suu") / (n * n) - 2 * m * F.col("_sug") / (n * q) + m * m * var_beta
    ok = (n > max(10, lags + 3)) & (q > 0)
    val = lambda c: F.when(ok, c)
    out = s.select(
        *keys, "n", val(F.col("alpha")).alias("alpha"), val(F.col("alpha") * periods).alias("alpha_annual"), val(F.try_divide(F.col("alpha"), F.sqrt(var_alpha))).alias("alpha_t"),
        val(F.col("beta")).alias("beta"), val(F.try_divide(F.col("beta"), F.sqrt(var_beta))).alias("beta_t"), val(1 - F.try_divide(F.col("_rss"), F.col("_tss"))).alias("r2"),
    )
    return out.withColumn("alpha_p", normal_p(F.col("alpha_t")))
