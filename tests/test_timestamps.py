from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from marketweave.functions.timestamps import parse
from marketweave.operators.timestamp_mixture import normalise_timestamps

HABITS = "source string, tz string, day_first boolean"


def us(*parts, offset=0.0):
    d = datetime(*parts, tzinfo=timezone.utc) - timedelta(hours=offset)
    return (d - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


@pytest.mark.parametrize("text, zone, want", [
    ("2021-09-03T20:04:11+0000", None, us(2021, 9, 3, 20, 4, 11)),
    ("2021-09-03T20:04:11.5Z", None, us(2021, 9, 3, 20, 4, 11, 500000)),
    ("2021-09-04T08:53", "Asia/Jakarta", us(2021, 9, 4, 8, 53, offset=7)),
    ("20210914T054520Z", "Asia/Jakarta", us(2021, 9, 14, 5, 45, 20)),
    ("1633036493005", None, 1633036493005000),
    ("1636720248", None, 1636720248000000),
    ("Sat, 04 Sep 2021 16:17:12 GMT", "Asia/Jakarta", us(2021, 9, 4, 16, 17, 12)),
    ("Kamis, 18 Agustus 2022 13.08 WIB", "Asia/Jakarta", us(2022, 8, 18, 13, 8, offset=7)),
    ("24. August 2023, 09:49 Uhr", "Europe/Berlin", us(2023, 8, 24, 9, 49, offset=2)),
    ("15 de noviembre de 2021, 19:01", "Europe/Madrid", us(2021, 11, 15, 19, 1, offset=1)),
    ("September 18, 2021 at 2:58 AM", "America/New_York", us(2021, 9, 18, 2, 58, offset=-4)),
    ("Mar 18, 2025 10:50 AM AEDT", "Australia/Sydney", us(2025, 3, 18, 10, 50, offset=11)),
    ("2021-09-15T16:23:49[Europe/Madrid]", "America/New_York", us(2021, 9, 15, 16, 23, 49, offset=2)),
    ("2022-04-12T08:01:26-04:00[America/New_York]", None, us(2022, 4, 12, 8, 1, 26, offset=-4)),
    ("2022-03-13T02:30:00", "America/New_York", us(2022, 3, 13, 2, 30, offset=-5)),  # skipped: the offset before
    ("2021-11-07T01:30:00", "America/New_York", us(2021, 11, 7, 1, 30, offset=-4)),  # twice: the earlier
    ("12:30", "UTC", None), ("2022-02-10", "UTC", None), ("n/a", "UTC", None), ("", "UTC", None), (None, "UTC", None),
    ("0000-00-00 00:00:00", "UTC", None), ("2024-02-30T10:15:00+0000", None, None), ("2021-09-27T25:61:00+0000", None, None),
    ("10/18/2021 13:19 PM", "UTC", None), ("2021-09-04T08:53", "Mars/Base", None), ("2021-09-04T08:53", None, None),
    ("2021-09-04T08:53+25:00", None, None), ("5 Foo 2021, 10:00", "UTC", None),
])
def test_parse(text, zone, want):
    assert parse(text, zone)[1] == want


@given(st.text(max_size=60))
def test_parse_takes_anything(text):
    assert len(parse(text, "Europe/Berlin")) == 3


@given(st.datetimes(min_value=datetime(1971, 1, 1), max_value=datetime(2100, 1, 1)))
def test_iso_round_trip(d):
    assert parse(d.isoformat() + "Z", None)[1] == us(d.year, d.month, d.day, d.hour, d.minute, d.second, d.microsecond)


def test_mixture(spark):
    rows = [(1, "us", "03/04/2022 10:00"), (2, "eu", "03/04/2022 10:00"), (3, "new", "25/12/2022 10:00"), (4, "new", "03/04/2022 10:00"),
            (5, "tie", "03/04/2022 10:00"), (6, "us", "25/12/2022 10:00"), (7, None, "2022-01-01T00:00:00Z"), (8, "us", None)]
    rows += [(100 + i, "new", "28/11/2022 09:00") for i in range(60)]
    habits = spark.createDataFrame([("us", "UTC", False), ("eu", "UTC", True), ("new", "UTC", None), ("tie", "UTC", None)], HABITS)
    df = spark.createDataFrame(rows, "id int, source string, value string").selectExpr("*", "id as tz", "id as family")
    got = {r.id: (r.utc_us, r.reading_status) for r in normalise_timestamps(df, "value", "source", habits).collect()}
    assert got[1] == (us(2022, 3, 4, 10), "resolved")
    assert got[2] == (us(2022, 4, 3, 10), "resolved")
    assert got[3] == (us(2022, 12, 25, 10), "resolved")
    assert got[4] == (us(2022, 4, 3, 10), "resolved")  # the source's other values show its order
    assert got[5] == (None, "ambiguous")
    assert got[6] == (None, "no_instant")  # no calendar shows it in this source's order
    assert got[7] == (us(2022, 1, 1), "resolved")
    assert got[8] == (None, "no_instant")
    assert len(got) == len(rows)


def test_empty(spark):
    habits = spark.createDataFrame([], HABITS)
    df = spark.createDataFrame([], "id int, source string, value string")
    assert normalise_timestamps(df, "value", "source", habits).count() == 0


def test_order_without_habit_and_against_it(spark):
    """The order is learnt from values that only one order reads, and from how near the readings are to what is expected."""
    rows = [("a", f"{d:02d}/{m:02d}/2023 08:00", us(2023, m, d)) for m in range(1, 13) for d in (3, 9, 14, 27)]
    rows += [("b", f"{m:02d}/{d:02d}/2023 08:00", us(2023, m, d)) for m in range(1, 13) for d in (2, 7, 11)]  # both orders read all of them
    rows += [("c", f"{m:02d}/{d:02d}/2023 08:00", us(2023, m, d)) for m in range(1, 13) for d in range(14, 20)]  # told to be day first
    rows += [("d", f"{m:02d}/{m + 1:02d}/2023 08:00", None) for m in range(1, 10)]
    df = spark.createDataFrame([(*r, r[2] and r[2] + 3_600_000_000 * 30) for r in rows], "source string, value string, want long, near long").withColumn("day", F.col("want"))
    habits = spark.createDataFrame([("a", "UTC", None), ("b", "UTC", None), ("c", "UTC", True), ("d", "UTC", None)], HABITS)
    got = normalise_timestamps(df, "value", "source", habits, expected_us=F.col("near")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.source == "d":
            assert (r.utc_us, r.reading_status) == (None, "ambiguous")
        else:
            assert r.utc_us == r.want + 8 * 3_600_000_000, (r.source, r.value)
