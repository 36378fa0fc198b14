"""Raw records to cleaned, de-duplicated, enriched articles."""

from pyspark.sql import DataFrame

from newsflow.operators.clean import clean_fields, fill_nulls, published_from_ts
from newsflow.operators.dedup import dedup_titles
from newsflow.operators.enrich import enrich
from newsflow.operators.parse import parse_json, parse_published_time
from newsflow.schemas import CLEANED_COLUMNS, RAW_ARTICLE


def timed_articles(raw: DataFrame) -> DataFrame:
    """Raw fields to clean fields with ``published_ts``; rows without a time dropped."""
    return parse_published_time(clean_fields(fill_nulls(raw)))


def cleaned_articles(
    records: DataFrame,
    delay: str = "1 minute",
    bounded_state: bool | None = None,
    split: int = 1,
    within: str | None = None,
    enrich_first: bool = True,
) -> DataFrame:
    """JSON records (``value``) to cleaned articles in the written column order.

    Streams drop repeated titles first and enrich what is left; ``bounded_state``,
    ``split`` and ``within`` are those of :func:`dedup_titles`. Batch input is enriched first by default:
    the enrichment is row-local, and the shuffle on the title then leaves the text behind
    whenever the caller does not use it. Without ``enrich_first`` only the rows that are
    kept are enriched, which pays where titles have many copies or the text is used.
    """
    timed = timed_articles(parse_json(records, RAW_ARTICLE))
    if enrich_first and not records.isStreaming:
        articles = dedup_titles(enrich(timed))
    else:
        kept = dedup_titles(
            timed, delay=delay, bounded_state=bounded_state, split=split, within=within
        )
        articles = enrich(kept)
    return published_from_ts(articles).select(*CLEANED_COLUMNS)
