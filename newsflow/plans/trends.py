"""Keyword trends and category activity over cleaned articles."""

from pyspark.sql import DataFrame

from newsflow.lexicons import NO_TOPIC, NOISE_WORDS
from newsflow.operators.dedup import dedup_events
from newsflow.operators.parse import parse_event_time
from newsflow.operators.trends import (
    KEYWORD_KEYS,
    counts_by_position,
    explode_keywords,
    filter_keywords,
    known_categories,
    label_activity,
    pivot_positions,
    score_trends,
)
from newsflow.operators.windows import position_counts, sliding_counts
from newsflow.schemas import ACTIVITY_COLUMNS, TREND_COLUMNS


def with_delay(events: DataFrame, delay: str | None) -> DataFrame:
    """Watermark on streaming events; none where ``delay`` is None, which is for events
    that have one already."""
    if events.isStreaming and delay is not None:
        return events.withWatermark("published_ts", delay)
    return events


def keyword_events(
    articles: DataFrame,
    extra=(),
    noise_words=NOISE_WORDS,
    bounded_state: bool | None = None,
    delay: str = "5 minutes",
    unique_titles: bool = False,
    split: int = 1,
) -> DataFrame:
    """(title, category, keyword, published_ts, *extra), one row per first three.

    Streams say what the state of that may hold: every key ever seen, or, with
    ``bounded_state``, those within the watermark, which ``delay`` then sets ahead of it.
    ``split`` reduces the copies of a key in so many places first.
    Batch articles whose titles are unique and whose keywords differ within the row, as the
    clean plan writes them, need no de-duplication: ``unique_titles`` leaves it out.
    """
    narrow = parse_event_time(articles).select(
        "published_ts", "title", "category", *extra, "keywords"
    )
    events = filter_keywords(explode_keywords(narrow), noise_words)
    if unique_titles and not events.isStreaming:
        return events
    events = with_delay(events, delay if bounded_state else None)
    return dedup_events(events, bounded_state, split)


def trends_of_events(
    events: DataFrame,
    duration: str = "20 minutes",
    slide: str = "10 minutes",
    recent: str = "10 minutes",
    min_support: int = 3,
    delay: str | None = "5 minutes",
    late_rows: bool = False,
    by_slot: bool = True,
) -> DataFrame:
    """Trend rows of (published_ts, category, keyword) events. ``late_rows`` is for streams,
    ``by_slot`` for batches, see :mod:`newsflow.operators.windows`."""
    events = with_delay(events, delay)
    counts = position_counts(
        events, KEYWORD_KEYS, duration, slide, recent, late_rows=late_rows, by_slot=by_slot
    )
    return score_trends(counts, min_support).select(*TREND_COLUMNS)


def trends_in_two_stages(
    events: DataFrame,
    duration: str = "20 minutes",
    slide: str = "10 minutes",
    recent: str = "10 minutes",
    min_support: int = 3,
) -> DataFrame:
    """Same rows by counting per position and pivoting the counts; needs one shuffle
    more than :func:`trends_of_events` on streams."""
    counts = pivot_positions(counts_by_position(events, duration, slide, recent))
    return score_trends(counts, min_support).select(*TREND_COLUMNS)


def keyword_trends(
    articles: DataFrame,
    noise_words=NOISE_WORDS,
    delay: str = "5 minutes",
    bounded_state: bool | None = None,
    unique_titles: bool = False,
    split: int = 1,
    **windows,
) -> DataFrame:
    """Trending keywords of cleaned articles; the options are those of
    :func:`keyword_events` and :func:`trends_of_events`."""
    events = keyword_events(
        articles, (), noise_words, bounded_state, delay, unique_titles, split
    )
    return trends_of_events(events, delay=None if bounded_state else delay, **windows)


def activity_of_events(
    events: DataFrame,
    duration: str = "20 minutes",
    slide: str = "5 minutes",
    delay: str | None = "10 minutes",
    late_rows: bool = False,
) -> DataFrame:
    """Activity rows of (published_ts, category) events; ``late_rows`` as for trends."""
    events = with_delay(events, delay)
    counts = sliding_counts(
        events, ["category"], duration, slide, name="category_count", late_rows=late_rows
    )
    return label_activity(counts).select(*ACTIVITY_COLUMNS)


def category_activity(articles: DataFrame, excluded: str = NO_TOPIC, **options) -> DataFrame:
    """Activity per category of cleaned articles; articles are not de-duplicated."""
    timed = parse_event_time(known_categories(articles, excluded))
    return activity_of_events(timed.select("published_ts", "category"), **options)
