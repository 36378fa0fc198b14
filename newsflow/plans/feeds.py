"""Feeds to raw records."""

from pyspark.sql import DataFrame, functions as F

from newsflow.functions.times import parse_published
from newsflow.operators.clean import escape_fields
from newsflow.operators.dedup import dedup_links
from newsflow.operators.parse import to_json_value
from newsflow.schemas import RAW_ARTICLE
from newsflow.sources.feeds import parse_feeds


def feed_records(
    feeds: DataFrame,
    column: str = "xml",
    order_by=("published", "title", "content", "source"),
    delay: str = "10 minutes",
    within: str | None = None,
    bounded_state: bool = False,
    split: int = 1,
) -> DataFrame:
    """Feed texts to raw JSON records (``value``): items are escaped, and of those that
    share a link the first is kept; items without a link are dropped.

    The last four are for streams, see :func:`dedup_links`. With ``within`` or
    ``bounded_state`` an item without a time of publication counts as published when it is
    read, for the watermark alone.
    """
    items = escape_fields(parse_feeds(feeds, column))
    if not feeds.isStreaming:
        kept = dedup_links(items, order_by=order_by)
    else:
        timed = items
        if within is not None or bounded_state:
            at = F.coalesce(parse_published(F.col("published")), F.current_timestamp())
            timed = items.withColumn("published_ts", at)
        kept = dedup_links(
            timed,
            order_by=order_by,
            delay=delay,
            within=within,
            bounded_state=bounded_state,
            split=split,
        )
    return to_json_value(kept.select(*RAW_ARTICLE.names))
