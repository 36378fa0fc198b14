"""Declared schemas; nothing in the package infers one."""

from pyspark.sql import types as T

RAW_ARTICLE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("source", "title", "content", "link", "published")
    ]
)

# Order in which the clean job writes its columns.
CLEANED_COLUMNS = (
    "source",
    "title",
    "content",
    "link",
    "published",
    "word_count",
    "keywords",
    "source_normalized",
    "category",
)

# How the four analyses read a cleaned article back: the time is text again.
CLEANED_ARTICLE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("source_normalized", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("published", T.StringType()),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("category", T.StringType()),
    ]
)

# Items of RSS 2.0 (``pubDate``) and RDF (``date``) feeds, entries of Atom ones.
FEED_ITEM = T.ArrayType(
    T.StructType(
        [
            T.StructField(name, T.StringType())
            for name in ("title", "description", "link", "pubDate", "date")
        ]
    )
)
FEED_LINK = T.StructType([T.StructField(name, T.StringType()) for name in ("_href", "_rel")])
FEED_ENTRY = T.ArrayType(
    T.StructType(
        [
            T.StructField("title", T.StringType()),
            T.StructField("summary", T.StringType()),
            T.StructField("content", T.StringType()),
            T.StructField("link", T.ArrayType(FEED_LINK)),
            T.StructField("published", T.StringType()),
            T.StructField("updated", T.StringType()),
        ]
    )
)

# What stands below the root: a channel with or beside its items, or entries. A lone
# <channel> has its title and items there itself.
FEED = T.StructType(
    [
        T.StructField(
            "channel",
            T.StructType([T.StructField("title", T.StringType()), T.StructField("item", FEED_ITEM)]),
        ),
        T.StructField("item", FEED_ITEM),
        T.StructField("title", T.StringType()),
        T.StructField("entry", FEED_ENTRY),
    ]
)

TREND_COLUMNS = (
    "window_start",
    "window_end",
    "category",
    "keyword",
    "current_count",
    "previous_count",
    "trend_score",
    "trend_level",
)
ACTIVITY_COLUMNS = (
    "window_start",
    "window_end",
    "category",
    "category_count",
    "activity_level",
)
ALERT_COLUMNS = (
    "window_start",
    "window_end",
    "category",
    "keyword",
    "exact_count",
    "approx_count",
    "sample_titles",
    "sample_links",
    "status",
)
SENTIMENT_COLUMNS = (
    "published",
    "source_normalized",
    "category",
    "title",
    "link",
    "keywords",
    "positive_count",
    "negative_count",
    "sentiment_score",
    "sentiment",
)
