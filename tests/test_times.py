import pytest

from newsflow.functions import times
from newsflow.operators import parse
from tests.helpers import one, ts


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Mon Jan 01 10:00:00 UTC 2024", "2024-01-01T10:00:00"),
        ("Mon Jan 01 10:00:00 GMT 2024", "2024-01-01T10:00:00"),
        ("Mon Jan 01 10:00:00 PST 2024", "2024-01-01T18:00:00"),
        ("Mon Jan 01 10:00:00 CET 2024", "2024-01-01T09:00:00"),
        ("Mon Jan 1 10:00:00 UTC 2024", "2024-01-01T10:00:00"),
        ("mon jan 01 10:00:00 utc 2024", "2024-01-01T10:00:00"),
        ("", None),
        ("null", None),
        (None, None),
        ("Mon Jan 32 10:00:00 UTC 2024", None),
        ("Mon Jan 01 10:00:00 UTC 2024 junk", None),
    ],
)
def test_parse_published(spark, text, expected):
    got = one(spark, text, times.parse_published)
    assert got == (ts(expected) if expected else None)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Mon, 01 Jan 2024 10:00:00 GMT", "2024-01-01T10:00:00"),
        ("Mon, 1 Jan 2024 10:00:00 +0200", "2024-01-01T08:00:00"),
        ("1 Jan 2024 10:00:00 GMT", "2024-01-01T10:00:00"),
        ("yesterday", None),
    ],
)
def test_parse_feed_date(spark, text, expected):
    got = one(spark, text, times.parse_feed_date)
    assert got == (ts(expected) if expected else None)


def test_event_time_drops_what_does_not_parse(spark):
    rows = [("2024-01-01T10:00:00.000Z",), ("n/a",), (None,), ("2024-01-01T12:00:00+02:00",)]
    got = parse.parse_event_time(spark.createDataFrame(rows, "published string")).collect()
    assert [r.published_ts for r in got] == [ts("2024-01-01T10:00:00")] * 2


def test_event_time_keeps_a_time(spark):
    df = spark.createDataFrame([(ts("2024-01-01T10:00:00"),)], "published timestamp_ntz")
    assert parse.parse_event_time(df).first().published_ts == ts("2024-01-01T10:00:00")


def test_durations():
    assert times.seconds("20 minutes") == 1200
    assert times.seconds("1 day") == 86400
    for bad in ("20", "0 minutes", "one hour", "-5 minutes"):
        with pytest.raises(ValueError):
            times.seconds(bad)


def test_utc_wall_clock_whatever_the_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.sql("SELECT timestamp_seconds(1704103200) AS v")
            assert df.select(times.to_utc_ntz(df.v)).first()[0] == ts("2024-01-01T10:00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
