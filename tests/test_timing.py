"""Publication times to sessions: cut-off, opening, holidays, ends of the calendar."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapeline.operators import panel, timing


@pytest.fixture(scope="module")
def calendar(spark):
    days = [date(2022, 1, 3) + timedelta(k) for k in range(362)]
    days = [d for d in days if d.weekday() < 5 and d != date(2022, 3, 8)]
    return panel.trading_calendar(spark.createDataFrame([(d, "A", 1.0) for d in days], "date date, secid string, close double"))


def sessions(spark, calendar, times, **kw):
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(times)], "event_id string, published_at timestamp_ntz")
    out = timing.assign_session(df, calendar, **kw) if "cutoff" in kw else timing.entry_session(df, calendar, **kw)
    col = "t0" if "t0" in out.columns else "entry"
    return [r[col] for r in out.orderBy(F.col("event_id").cast("int")).select(col).collect()]


def test_cutoff(spark, calendar):
    t = lambda *a: datetime(2022, *a)
    got = sessions(spark, calendar, [t(3, 1, 12), t(3, 1, 18, 39, 59), t(3, 1, 18, 40), t(3, 1, 21, 15), t(3, 4, 19), t(3, 5, 11), t(3, 8, 12), t(3, 7, 19), t(12, 30, 19), None], cutoff="18:40")
    assert got == [date(2022, 3, 1), date(2022, 3, 1), date(2022, 3, 2), date(2022, 3, 2), date(2022, 3, 7), date(2022, 3, 7), date(2022, 3, 9), date(2022, 3, 9), None, None]


def test_next_open(spark, calendar):
    t = lambda *a: datetime(2022, *a)
    got = sessions(spark, calendar, [t(3, 1, 9, 30), t(3, 1, 10), t(3, 1, 12), t(3, 4, 12), t(3, 5, 9), t(3, 7, 12)], mode="next_open")
    assert got == [date(2022, 3, 1), date(2022, 3, 2), date(2022, 3, 2), date(2022, 3, 7), date(2022, 3, 7), date(2022, 3, 9)]


def test_before_the_calendar_and_bad_times(spark, calendar):
    assert sessions(spark, calendar, [datetime(2019, 5, 1, 12)], cutoff="18:40") == [date(2022, 1, 3)]
    for bad in ("25:00", "noon", "1840"):
        with pytest.raises(ValueError):
            timing.time_of_day(bad)


def test_mixed_datetimes(spark):
    from datetime import datetime

    from tapeline.operators import eventstudy as es

    cases = {
        "2024-03-05T10:11:12": datetime(2024, 3, 5, 10, 11, 12), "2024-03-05": datetime(2024, 3, 5), "13.02.2024 9:05": datetime(2024, 2, 13, 9, 5), "03/04/2024 10:11": datetime(2024, 3, 4, 10, 11),
        "2024/03/05 01:02:03": datetime(2024, 3, 5, 1, 2, 3), "20240305": datetime(2024, 3, 5), " 31-12-2023 ": datetime(2023, 12, 31), "32.01.2024": None, "soon": None, "": None, None: None,
    }
    df = spark.createDataFrame([(str(k), "S", v) for k, v in enumerate(cases)], "event_id string, secid string, published_at string")
    got = {r.event_id: r.published_at for r in es.normalize_events(df).collect()}
    assert got == {str(k): v for k, v in enumerate(cases.values())}
