"""Job assembly.

Each ``start_*`` takes streaming rows of its topic (``value``), the two places it
writes to, and a checkpoint folder of its own, and returns the running query. Output
is append: a window appears once, after the watermark has passed its end.
"""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from newsflow.functions.times import to_utc_ntz
from newsflow.operators.parse import parse_json
from newsflow.operators.trends import stamp
from newsflow.plans.articles import cleaned_articles
from newsflow.plans.breaking import THRESHOLD, alerts_of_windows, windowed_titles
from newsflow.plans.feeds import feed_records
from newsflow.plans.sentiment import article_sentiment
from newsflow.plans.trends import category_activity, keyword_events, keyword_trends
from newsflow.schemas import CLEANED_ARTICLE
from newsflow.sinks.batch import Target
from newsflow.sinks.stream import fan_out, write_collection


def start_feeds(
    feeds: DataFrame,
    topic: Target,
    checkpoint: str,
    *,
    bounded_state: bool,
    delay: str = "10 minutes",
    within: str | None = None,
    split: int = 1,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Feed texts (``xml``) to the raw topic: items escaped, one per link.

    The first item of a link that arrives is sent at once. With ``within`` the earliest is
    sent instead, when ``delay`` has shown that no earlier one comes.
    """
    records = feed_records(
        feeds, delay=delay, within=within, bounded_state=bounded_state, split=split
    )
    return write_collection(records, topic, checkpoint, trigger)


def start_cleaning(
    records: DataFrame,
    collection: Target,
    topic: Target,
    checkpoint: str,
    delay: str = "1 minute",
    *,
    bounded_state: bool,
    split: int = 1,
    within: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Raw records to the collection of cleaned articles and the cleaned topic, which
    carries no key. One query feeds both, so articles are de-duplicated once. The first copy of
    a title that arrives is kept; with ``within`` the earliest, see :func:`dedup_titles`."""
    articles = cleaned_articles(records, delay, bounded_state, split, within)
    return fan_out(articles, collection, topic, checkpoint, key=None, trigger=trigger)


def _cleaned(records: DataFrame, *fields: str) -> DataFrame:
    """Cleaned articles with only the fields a job uses, so only those are parsed."""
    return parse_json(records, CLEANED_ARTICLE, fields=fields)


def nested_window(rows: DataFrame) -> DataFrame:
    """``window`` (start, end) in place of the two columns, at the front."""
    ends = ("window_start", "window_end")
    window = F.struct(F.col(ends[0]).alias("start"), F.col(ends[1]).alias("end"))
    return rows.select(window.alias("window"), *[c for c in rows.columns if c not in ends])


def start_trends(
    records: DataFrame,
    collection: Target,
    topic: Target,
    checkpoint: str,
    *,
    bounded_state: bool,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """The collection keeps the window as one column, the messages its two ends."""
    articles = _cleaned(records, "title", "category", "published", "keywords")
    trends = stamp(keyword_trends(articles, bounded_state=bounded_state, **options))
    return fan_out(trends, collection, topic, checkpoint, stored=nested_window, trigger=trigger)


def start_activity(
    records: DataFrame,
    collection: Target,
    topic: Target,
    checkpoint: str,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    articles = _cleaned(records, "category", "published")
    activity = stamp(category_activity(articles, **options))
    return fan_out(activity, collection, topic, checkpoint, trigger=trigger)


def start_breaking(
    records: DataFrame,
    collection: Target,
    topic: Target,
    checkpoint: str,
    mode: str = "running",
    threshold: int = THRESHOLD,
    duration: str = "5 minutes",
    slide: str = "1 minute",
    delay: str = "5 minutes",
    *,
    bounded_state: bool,
    split: int = 1,
    reset: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """The sketch lives for one micro-batch, or with ``reset`` shorter. Titles and links of
    open windows are state, once per window that covers an event; without ``bounded_state``, of
    a window's keyword only those that each micro-batch may add to its evidence. ``split``
    reduces the copies of a hot event in so many places first."""
    articles = _cleaned(records, "title", "category", "published", "keywords", "link")
    events = keyword_events(
        articles, ["link"], bounded_state=bounded_state, delay=delay, split=split
    )
    titles = windowed_titles(events, duration, slide, None if bounded_state else delay)

    def alerts(batch: DataFrame) -> DataFrame:
        found = alerts_of_windows(batch, mode, threshold, duration, reset=reset)
        now = to_utc_ntz(F.current_timestamp())
        return found.withColumn("detected_at", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))

    return fan_out(titles, collection, topic, checkpoint, prepare=alerts, trigger=trigger)


def start_sentiment(
    records: DataFrame,
    collection: Target,
    topic: Target,
    checkpoint: str,
    trigger: dict | None = None,
    **lexicons,
) -> StreamingQuery:
    articles = _cleaned(
        records,
        "source_normalized",
        "category",
        "title",
        "content",
        "link",
        "published",
        "keywords",
    )
    sentiment = stamp(article_sentiment(articles, **lexicons))
    return fan_out(sentiment, collection, topic, checkpoint, trigger=trigger)
