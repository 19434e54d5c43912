"""Closed-form statistics against published and brute-force values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.functions import stats
from tapeline.operators import eventstudy as es


def test_student(spark):
    rows = spark.createDataFrame([(2.0, 1), (2.0, 2), (1.5, 7), (0.0, 5), (3.0, 30)], "t double, df int").select("t", "df", stats.student_p(F.col("t"), F.col("df")).alias("p")).collect()

    def brute(t, df):
        x = np.linspace(0, abs(t), 200_001)
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        y = c * (1 + x * x / df) ** (-(df + 1) / 2)
        return 1 - 2 * float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())

    for r in rows:
        assert r.p == pytest.approx(brute(r.t, r.df), abs=1e-7)


def test_sign_test(spark):
    rows = spark.createDataFrame([(5, 5), (3, 10), (0, 1), (1, 1), (7, 14), (0, 0)], "k int, n int").select("k", "n", stats.sign_test_p(F.col("k"), F.col("n")).alias("p")).collect()
    for r in rows:
        want = None if r.n < 1 else min(1, 2 * sum(math.comb(r.n, i) for i in range(min(r.k, r.n - r.k) + 1)) / 2**r.n)
        assert r.p == (None if want is None else pytest.approx(want))


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5), (5, None)], "k int, p_value double")
    got = [r.q_value for r in stats.bh_q(df).orderBy("k").collect()]
    assert got[:4] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5]) and got[4] is None


def test_hac_against_sandwich(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    u = np.convolve(rng.normal(size=205), np.ones(6), "valid")
    y = 0.2 + 1.5 * x + u
    got = stats.hac_regression(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i int, x double, y double"), "y", "x", "i").first()
    d = np.c_[np.ones(200), x]
    bread = np.linalg.inv(d.T @ d)
    beta = bread @ d.T @ y
    s = (y - d @ beta)[:, None] * d
    meat = s.T @ s
    for lag in range(1, 6):
        g = s[lag:].T @ s[:-lag]
        meat += (1 - lag / 6) * (g + g.T)
    se = np.sqrt(np.diag(bread @ meat @ bread))
    assert (got.alpha, got.beta, got.alpha_t, got.beta_t) == pytest.approx((*beta, *(beta / se)))
    assert got.alpha_p == pytest.approx(math.erfc(abs(got.alpha_t) / math.sqrt(2)), abs=1e-9)


def _drawn(rows, draws, seed):
    """Intervals by the definition: a weight a row and draw from the digests, means, percentiles."""
    import bisect
    import hashlib

    word = lambda text, k: int(hashlib.md5(text.encode()).hexdigest()[7 * k : 7 * k + 7], 16)
    groups: dict = {}
    for event, *key, v in rows:
        if v is not None:
            groups.setdefault(tuple(key), []).append((word("|".join([*map(str, (k for k in key if k is not None)), event]), 0), word("|".join([*map(str, (k for k in key if k is not None)), event]), 1), v))
    out = {}
    for key, members in groups.items():
        means = []
        for d in range(draws):
            a, b, c = (word(f"{seed}|{d}", k) for k in range(3))
            w = [bisect.bisect_right(stats.POISSON, (a * x + b * y + c) % stats.PRIME) for x, y, _ in members]
            if sum(w):
                means.append(sum(k * m[2] for k, m in zip(w, members, strict=True)) / sum(w))
        ends = np.percentile(means, [2.5, 97.5]) if len(members) > 1 else (None, None)
        out[key] = (len(members), *ends)
    return out


def test_bootstrap_by_definition(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"e{i}", ["a", "b", None][i % 3], i % 2, "[0,1]", float(rng.normal())) for i in range(120)]
    rows += [("x", "lone", 0, "w", 1.0), ("y", "none", 0, "w", None), ("z", "two", 1, "w", 1.0), ("z", "two", 1, "w", 5.0)]
    cars = spark.createDataFrame(rows, "event_id string, category string, direction int, window string, car double")
    monkeypatch.setattr(es, "HELD", 1)
    got = {(r.category, r.direction, r.window): (r.n, r.ci_low, r.ci_high) for r in es.bootstrap_ci(cars.repartition(3), draws=60, seed=5).collect()}
    want = _drawn(rows, 60, 5)
    assert set(got) == set(want)
    for key, (n, low, high) in want.items():
        assert got[key][0] == n and got[key][1:] == ((None, None) if low is None else pytest.approx((low, high)))
    assert es.bootstrap_ci(cars.limit(0)).count() == 0


def test_bootstrap_is_near_the_multinomial(spark):
    rng = np.random.default_rng(4)
    values = rng.exponential(size=400)
    cars = spark.createDataFrame([(str(i), "a", 1, "w", float(v)) for i, v in enumerate(values)], "event_id string, category string, direction int, window string, car double")
    got = es.bootstrap_ci(cars).first()
    means = rng.multinomial(400, np.full(400, 1 / 400), size=20_000) @ values / 400
    low, high = np.percentile(means, [2.5, 97.5])
    assert got.n == 400 and abs(got.ci_low - low) < 0.1 * (high - low) and abs(got.ci_high - high) < 0.1 * (high - low)


def test_median_before_is_that_of_the_frame(spark):
    rng = np.random.default_rng(5)
    rows = [(s, i, None if rng.random() < 0.4 else float(round(rng.normal(), 2))) for s in "ab" for i in range(90)]
    grid = spark.createDataFrame(rows, "secid string, pos int, value double")
    from tapeline.operators import panel

    got = {(r.secid, r.pos): (r.m, r.adv) for r in panel.adv(grid, 12).withColumn("m", panel.median_before("value", 12)).collect()}
    for s in "ab":
        v = [x for k, _, x in rows if k == s]
        for i in range(90):
            frame = [x for x in v[max(0, i - 12) : i] if x is not None]
            want = float(np.median(frame)) if frame else None
            m, adv = got[s, i]
            assert m == (None if want is None else pytest.approx(want)) and adv == (pytest.approx(want) if len(frame) >= 5 else None)
