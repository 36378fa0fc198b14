from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from newsflow.operators import trends, windows
from newsflow.plans import breaking as breaking_plans
from newsflow.plans import trends as plans
from tests.helpers import ts

START = ts("2024-01-01T09:57:13")


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (f"t{n}", "abc"[n % 3], "xy"[n % 2], START + timedelta(seconds=37 * (n % 90) + n))
        for n in range(600)
    ]
    return spark.createDataFrame(
        rows, "title string, category string, keyword string, published_ts timestamp_ntz"
    ).cache()


def direct(events, keys, duration, slide):
    counts = events.groupBy(F.window("published_ts", duration, slide), *keys).count()
    return {
        (r.window.start, r.window.end, *[r[k] for k in keys], r["count"])
        for r in counts.collect()
    }


@pytest.mark.parametrize(
    "duration, slide",
    [
        ("20 minutes", "5 minutes"),
        ("5 minutes", "1 minute"),
        ("10 minutes", "10 minutes"),
        ("10 minutes", "4 minutes"),
        ("25 minutes", "10 minutes"),
    ],
)
def test_sliding_counts_equal_window(events, duration, slide):
    got = windows.sliding_counts(events, ["category"], duration, slide)
    assert {tuple(r) for r in got.collect()} == direct(events, ["category"], duration, slide)


def test_slides_multiply_rows(events):
    total = windows.sliding_counts(events, ["category"], "20 minutes", "5 minutes")
    assert total.agg(F.sum("n")).first()[0] == 4 * events.count()


@pytest.mark.parametrize(
    "duration, slide, recent",
    [
        ("20 minutes", "10 minutes", "10 minutes"),
        ("20 minutes", "5 minutes", "10 minutes"),
        ("20 minutes", "10 minutes", "7 minutes"),
        ("20 minutes", "8 minutes", "8 minutes"),
    ],
)
def test_position_counts_equal_the_two_stage_form(events, duration, slide, recent):
    one = windows.position_counts(events, trends.KEYWORD_KEYS, duration, slide, recent)
    two = trends.pivot_positions(trends.counts_by_position(events, duration, slide, recent))
    assert set(one.columns) == set(two.columns)
    rows = {tuple(r) for r in one.collect()}
    assert rows == {tuple(r) for r in two.select(*one.columns).collect()}
    assert rows


def test_positions_counted_at_once_equal_those_by_slot(events):
    by_slot = windows.position_counts(events, trends.KEYWORD_KEYS, "20 minutes", "10 minutes", "10 minutes")
    at_once = windows.position_counts(
        events, trends.KEYWORD_KEYS, "20 minutes", "10 minutes", "10 minutes", by_slot=False
    )
    assert at_once.dtypes == by_slot.dtypes
    assert sorted(map(str, at_once.collect())) == sorted(map(str, by_slot.collect()))


def test_plans_agree(events):
    one = plans.trends_of_events(events, min_support=1)
    two = plans.trends_in_two_stages(events, min_support=1)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()}


@pytest.mark.parametrize(
    "current, previous, level",
    [
        (10, 0, "BREAKING"),
        (9, 0, "HOT"),
        (5, 0, "HOT"),
        (4, 0, "WARM"),
        (3, 1, "WARM"),
        (3, 2, "NORMAL"),
        (80, 9, "BREAKING"),
        (79, 9, "HOT"),
    ],
)
def test_trend_levels(spark, current, previous, level):
    df = spark.createDataFrame(
        [(current, previous)], "current_count bigint, previous_count bigint"
    )
    row = trends.score_trends(df).first()
    assert row.trend_score == current / (previous + 1)
    assert row.trend_level == level


def test_support_is_a_minimum(spark):
    df = spark.createDataFrame([(2, 0), (3, 0)], "current_count bigint, previous_count bigint")
    assert trends.score_trends(df).count() == 1


@pytest.mark.parametrize("n, level", [(1, "NORMAL"), (3, "ACTIVE"), (4, "ACTIVE"), (5, "SPIKE")])
def test_activity_levels(spark, n, level):
    df = spark.createDataFrame([(n,)], "category_count bigint")
    assert trends.label_activity(df).first().activity_level == level


def test_keyword_explode_and_filter(spark):
    df = spark.createDataFrame(
        [(1, [" Quake ", "news", "war"]), (2, []), (3, None), (4, ["City"])],
        "id int, keywords array<string>",
    )
    kept = trends.filter_keywords(trends.explode_keywords(df))
    assert {tuple(r) for r in kept.collect()} == {(1, "quake"), (4, "city")}


def test_unknown_categories_are_dropped(spark):
    df = spark.createDataFrame([("tech",), ("other",), (None,)], "category string")
    assert [r.category for r in trends.known_categories(df).collect()] == ["tech"]


CLOCK_CHANGES = ("2024-03-10 12:00:00", "2024-11-03 12:00:00")


@pytest.mark.parametrize("around", CLOCK_CHANGES)
@pytest.mark.parametrize(
    "duration, slide", [("1 day", "6 hours"), ("3 days", "1 day"), ("20 minutes", "10 minutes")]
)
def test_windows_are_elapsed_time_over_clock_changes(spark, around, duration, slide):
    """In a zone with summer time, batch counts equal those of ``window()``."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.range(200).selectExpr(
            f"timestamp_micros(unix_micros(TIMESTAMP '{around}') + (id - 100) * 1500000000) AS published_ts",
            "concat('k', id % 3) AS keyword",
            "'c' AS category",
        )
        window = F.window("published_ts", duration, slide)
        want = df.groupBy(window, "category", "keyword").count()
        epochs = [F.unix_seconds(F.col(f"window.{e}")) for e in ("start", "end")]
        want = {tuple(r) for r in want.select(*epochs, "category", "keyword", "count").collect()}
        got = windows.sliding_counts(df, trends.KEYWORD_KEYS, duration, slide)
        ends = [F.unix_seconds(c) for c in ("window_start", "window_end")]
        assert {tuple(r) for r in got.select(*ends, "category", "keyword", "n").collect()} == want
        recent = slide
        one = windows.position_counts(df, trends.KEYWORD_KEYS, duration, slide, recent)
        two = trends.pivot_positions(trends.counts_by_position(df, duration, slide, recent))
        assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.select(*one.columns).collect()}
        titled = df.withColumns({"title": F.lit("t"), "link": F.lit("l")})
        alerts = breaking_plans.alerts_of_events(titled, "exact", 1, duration, slide)
        found = alerts.select(*ends, "category", "keyword", "exact_count")
        assert {tuple(r) for r in found.collect()} == want
        assert alerts.filter("size(sample_titles) <> 1").isEmpty()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
