"""Field cleaning of raw articles."""

from pyspark.sql import DataFrame, functions as F

from newsflow.functions.text import (
    clean_link,
    clean_text,
    collapse_space,
    escape_text,
    strip_breaks,
    strip_symbols,
    strip_tags,
)
from newsflow.schemas import RAW_ARTICLE

TEXT_FIELDS = ("source", "title", "content")
LINK_FIELDS = TEXT_FIELDS + ("link",)


def _map_columns(df: DataFrame, columns, fn) -> DataFrame:
    return df.withColumns({c: fn(F.col(c)) for c in columns})


def fill_nulls(df: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """Null text to a default per column; the raw fields default to empty text."""
    if defaults is None:
        defaults = dict.fromkeys(RAW_ARTICLE.names, "")
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def lower_fields(df: DataFrame, columns=LINK_FIELDS) -> DataFrame:
    return _map_columns(df, columns, F.lower)


def strip_tag_fields(df: DataFrame, columns=TEXT_FIELDS) -> DataFrame:
    return _map_columns(df, columns, strip_tags)


def strip_symbol_fields(df: DataFrame, columns=TEXT_FIELDS) -> DataFrame:
    return _map_columns(df, columns, strip_symbols)


def strip_break_fields(df: DataFrame, columns=TEXT_FIELDS) -> DataFrame:
    return _map_columns(df, columns, strip_breaks)


def collapse_fields(df: DataFrame, columns=LINK_FIELDS) -> DataFrame:
    return _map_columns(df, columns, collapse_space)


def clean_fields(df: DataFrame) -> DataFrame:
    """All of the steps above, each field cleaned in one pass."""
    cleaned = {c: clean_text(F.col(c)) for c in TEXT_FIELDS if c in df.columns}
    if "link" in df.columns:
        cleaned["link"] = clean_link(F.col("link"))
    return df.withColumns(cleaned)


def escape_fields(df: DataFrame, columns=TEXT_FIELDS) -> DataFrame:
    """Quotes and line breaks out of raw fields before they are serialised."""
    return _map_columns(df, columns, escape_text)


def published_from_ts(df: DataFrame) -> DataFrame:
    """Put the parsed time in place of its text."""
    return df.drop("published").withColumnRenamed("published_ts", "published")
