import bisect
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketweave.functions.rates import number, rate_date
from marketweave.operators import alignment as A
from marketweave.operators import rates as R
from marketweave.operators.dedup import keep_one, keyword_trail, not_done


@pytest.mark.parametrize("text, want", [
    ("15.250,00", 15250.0), ("15,250.00", 15250.0), ("15.250", 15250.0), ("15,250", 15250.0), ("15,25", 15.25), ("15.25", 15.25), ("Rp 16.470", 16470.0),
    ("1,234,567", 1234567.0), ("-", None), ("", None), (None, None), ("-5.5", -5.5), ("1.2.3", None), ("abc", None),
])
def test_number(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(number(F.col("t")).alias("x")).first().x == want


@pytest.mark.parametrize("text, day_first, want", [
    ("2021-9-1", True, date(2021, 9, 1)), ("1 September 2021", True, date(2021, 9, 1)), ("18-MEI-2026", True, date(2026, 5, 18)), ("9/1/2021", True, date(2021, 1, 9)),
    ("9/1/2021", False, date(2021, 9, 1)), ("9/13/2021", True, date(2021, 9, 13)), ("31-2-2021", True, None), ("31 Februari 2021", True, None), ("x", True, None), (None, True, None),
])
def test_date(spark, text, day_first, want):
    assert spark.createDataFrame([(text,)], "t string").select(rate_date(F.col("t"), day_first).alias("x")).first().x == want


def test_rates(spark):
    raw = [("3 September 2021", "15.300", 1), ("02/09/2021", "15.100", 2), ("02/09/2021", "15,200.00", 3), ("1 September 2021", "15.000,00", 4), ("31 Agustus 2021", "14.000", 5), ("4 September 2021", "900", 6)]
    got = R.clean_rates(spark.createDataFrame(raw, "tanggal string, kurs string, seq long")).orderBy("date").collect()
    assert [(r.date.day, r.kurs, r.gap_days, r.direction) for r in got] == [(1, 15000.0, None, "flat"), (2, 15200.0, 1, "up"), (3, 15300.0, 1, "up")]
    assert got[0].delta is None and got[2].delta == 100.0


def test_alignment_against_bisection(spark):
    days = [date(2024, 1, d) for d in (2, 3, 4, 5, 8, 9, 15)]
    first = datetime(2023, 12, 28)
    times = [first + timedelta(hours=5 * i, minutes=i) for i in range(100)] + [datetime(2024, 1, 3, 0, 59, 59), datetime(2024, 1, 3, 1, 0), None]
    news = spark.createDataFrame(list(enumerate(times)), "i int, published_utc timestamp_ntz")
    rates = spark.createDataFrame([(d,) for d in days], "date date")
    got = {r.i: r for r in A.align(news, rates).collect()}
    assert len(got) == len(times)
    for i, t in enumerate(times):
        if t is None:
            assert got[i].target_date is None and got[i].is_offhours is False
            continue
        wib = t + timedelta(hours=7)
        candidate = wib.date() + timedelta(days=wib.hour >= 8)
        at = bisect.bisect_left(days, candidate)
        assert got[i].target_date == (days[at] if at < len(days) else None)
        assert got[i].target_date_lag1 == (days[at + 1] if at + 1 < len(days) else None)
        assert got[i].is_offhours == (wib.weekday() >= 5 or wib.hour >= 8)
        if at < len(days):
            assert abs(got[i].hours_to_fixing - (datetime.combine(days[at], datetime.min.time()) + timedelta(hours=8) - wib).total_seconds() / 3600) < 1e-9


@pytest.mark.parametrize("text, want", [
    ("2026-05-21T12:45:38+0000", datetime(2026, 5, 21, 12, 45, 38)), ("2026-05-21T12:45:38+07:00", datetime(2026, 5, 21, 5, 45, 38)), ("2026-05-21 12:45", datetime(2026, 5, 21, 12, 45)),
    ("2026-05-21", datetime(2026, 5, 21)), ("2026-05-21T12:45:38.25Z", datetime(2026, 5, 21, 12, 45, 38, 250000)), ("2026-13-21T12:45:38Z", None), ("junk", None), (None, None),
])
def test_iso(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(A.iso_utc(F.col("t")).alias("x")).first().x == want


def test_ordered_dedup(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), (None, 3, "z"), (None, 4, "w")], "k string, seq int, v string")
    assert sorted(r.v for r in keep_one(df, ["k"], "seq").collect()) == ["x", "z"]
    assert sorted(r.v for r in keep_one(df, ["k"], "seq", last=True).collect()) == ["w", "y"]
    trail = keyword_trail(df, "k", {"vs": "v"}, "v").filter("k = 'a'").first()
    assert (trail.vs, trail.n_keyword_hits) == ("x|y", 2)
    assert {r.v for r in not_done(df, df.filter("k = 'a'"), "k").collect()} == {"z", "w"}
    assert keep_one(df.limit(0), ["k"], "seq").count() == 0


def test_dates_of_all_notations(spark):
    cases = {
        "18 May 2026": "2026-05-18", "1 August 2021": "2021-08-01", "Sep 1, 2021": "2021-09-01", "2021/09/01": "2021-09-01", "24/08/26": "2026-08-24", "2021-09-01xyz": None,
        "2021-09-01 10:30:00": "2021-09-01", "1 Agu 2021": "2021-08-01", "17-Okt-2022": "2022-10-17", "08/24/26": "2026-08-24", "31/12/1999": "1999-12-31", "12/31/99": "1999-12-31",
        "2021-02-30": None, "5 Foo 2021": None, "": None, "2021-9-1": "2021-09-01", "September 30 2024": "2024-09-30", "9/1/2021": "2021-01-09", "9/13/2021": "2021-09-13", "x" * 10_000: None,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "tanggal string, want string")
    from marketweave.functions.rates import rate_date

    for r in df.select("tanggal", "want", rate_date(F.col("tanggal")).cast("string").alias("got")).collect():
        assert r.got == r.want, r.tanggal
