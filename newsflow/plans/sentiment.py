"""Article sentiment."""

from pyspark.sql import DataFrame

from newsflow.operators.clean import published_from_ts
from newsflow.operators.parse import parse_event_time
from newsflow.operators.sentiment import add_sentiment, fill_for_sentiment
from newsflow.schemas import SENTIMENT_COLUMNS


def article_sentiment(articles: DataFrame, **lexicons) -> DataFrame:
    """Sentiment rows of cleaned articles."""
    timed = published_from_ts(parse_event_time(fill_for_sentiment(articles)))
    return add_sentiment(timed, **lexicons).select(*SENTIMENT_COLUMNS)
