"""The scripted bursts, from raw JSON to every result."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from newsflow.operators.parse import to_json_value
from newsflow.plans.articles import cleaned_articles
from newsflow.plans.breaking import breaking_alerts
from newsflow.plans.sentiment import article_sentiment
from newsflow.plans.trends import category_activity, keyword_trends
from tests.helpers import burst_articles, ts

WORLD = "earthquake emergency rescue breaking casualties city coastal crisis".split()
BUSINESS = "bitcoin market inflation surge bank bullish continues crypto".split()
SPORTS = "goal match league celebrate fans football game late".split()


@pytest.fixture(scope="module")
def articles(spark):
    raw = spark.createDataFrame(
        list(burst_articles()),
        "source string, title string, content string, link string, published string",
    )
    return cleaned_articles(to_json_value(raw)).cache()


def test_articles(articles):
    rows = articles.collect()
    assert len(rows) == 57
    expected = {
        "Injected World News": (35, 22, WORLD, "other"),
        "Injected Business Desk": (18, 26, BUSINESS, "sports"),
        "Injected Sports": (4, 20, SPORTS, "sports"),
    }
    for source, (count, words, keywords, category) in expected.items():
        mine = [r for r in rows if r.source_normalized == source]
        assert len(mine) == count
        assert {r.word_count for r in mine} == {words}
        assert {tuple(r.keywords) for r in mine} == {tuple(keywords)}
        assert {r.category for r in mine} == {category}


def test_sentiment(articles):
    got = article_sentiment(articles).groupBy(
        "source_normalized", "positive_count", "negative_count", "sentiment_score", "sentiment"
    ).count()
    assert {tuple(r) for r in got.collect()} == {
        ("Injected World News", 1, 9, -8, "Negative", 35),
        ("Injected Business Desk", 3, 2, 1, "Positive", 18),
        ("Injected Sports", 2, 0, 2, "Positive", 4),
    }


def test_trends(articles):
    rows = keyword_trends(articles).collect()
    assert {(r.window_start, r.window_end) for r in rows} == {
        (ts("2024-01-01T09:50:00"), ts("2024-01-01T10:10:00"))
    }
    got = {(r.keyword, r.current_count, r.previous_count, r.trend_score, r.trend_level) for r in rows}
    expected = {(k, 35, 0, 35.0, "BREAKING") for k in WORLD}
    expected |= {(k, 18, 0, 18.0, "BREAKING") for k in BUSINESS}
    expected |= {(k, 4, 0, 4.0, "WARM") for k in SPORTS}
    assert got == expected


def test_activity(articles):
    rows = category_activity(articles).collect()
    assert {(r.window_start.strftime("%H:%M"), r.category, r.category_count, r.activity_level) for r in rows} == {
        (start, "sports", 22, "SPIKE") for start in ("09:45", "09:50", "09:55", "10:00")
    }


def starts(first, counts):
    begin = ts(f"2024-01-01T{first}:00")
    return [(begin + timedelta(minutes=n), c) for n, c in enumerate(counts)]


EXACT = {
    "earthquake": starts("09:56", [25, 35, 35, 35, 35, 10]),
    "bitcoin": starts("09:57", [18, 18, 18, 18, 18]),
    "goal": starts("09:57", [1, 4, 4, 4, 4, 3]),
}


def alerts(articles, mode, keyword, column):
    found = breaking_alerts(articles, mode=mode).filter(F.col("keyword") == keyword)
    return [tuple(r) for r in found.orderBy("window_start").select("window_start", column).collect()]


@pytest.mark.parametrize("keyword", EXACT)
def test_exact_alerts(articles, keyword):
    expected = [(w, c) for w, c in EXACT[keyword] if c >= 15]
    assert alerts(articles, "exact", keyword, "exact_count") == expected


@pytest.mark.parametrize("keyword", EXACT)
def test_running_alerts(articles, keyword):
    total, expected = 0, []
    for window, count in EXACT[keyword]:
        total += count
        if total >= 15:
            expected.append((window, total))
    assert alerts(articles, "running", keyword, "approx_count") == expected


def test_evidence(articles):
    first = breaking_alerts(articles, mode="exact").filter("keyword = 'bitcoin'").first()
    assert first.sample_titles == sorted(
        f"bitcoin market surge continues {n} as investors react to inflation data"
        for n in range(1, 19)
    )[:3]
    assert len(first.sample_links) == 3
