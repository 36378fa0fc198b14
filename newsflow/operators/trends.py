"""Keyword events, keyword trends and category activity."""

from pyspark.sql import DataFrame, functions as F

from newsflow.functions.levels import activity_level, trend_level, trend_score
from newsflow.lexicons import NO_TOPIC, NOISE_WORDS
from newsflow.operators.rows import explode_present
from newsflow.operators.windows import flatten_window, window_positions

KEYWORD_KEYS = ("category", "keyword")


def explode_keywords(df: DataFrame) -> DataFrame:
    """One row per keyword, lower-cased and trimmed; rows without keywords vanish."""
    exploded = explode_present(df, F.col("keywords"), "keyword").drop("keywords")
    return exploded.withColumn("keyword", F.lower(F.trim("keyword")))


def filter_keywords(df: DataFrame, noise_words=NOISE_WORDS, min_len: int = 4) -> DataFrame:
    """Keywords of at least ``min_len`` characters that are not noise words."""
    kept = df.filter(F.length("keyword") >= min_len)
    return kept.filter(~F.col("keyword").isin(*noise_words)) if noise_words else kept


def counts_by_position(
    df: DataFrame,
    duration: str = "20 minutes",
    slide: str = "10 minutes",
    recent: str = "10 minutes",
) -> DataFrame:
    """(window, category, keyword, window_position, n): first of two aggregations."""
    placed = window_positions(df, duration, slide, recent)
    return placed.groupBy("window", *KEYWORD_KEYS, "window_position").agg(
        F.count(F.lit(1)).alias("n")
    )


def pivot_positions(df: DataFrame) -> DataFrame:
    """Second of two aggregations: one row per window with both counts."""
    position = F.col("window_position")

    def total(which: str):
        return F.sum(F.when(position == which, F.col("n")).otherwise(0))

    pivoted = df.groupBy("window", *KEYWORD_KEYS).agg(
        total("current").alias("current_count"), total("previous").alias("previous_count")
    )
    return flatten_window(pivoted, KEYWORD_KEYS, "current_count", "previous_count")


def score_trends(df: DataFrame, min_support: int = 3) -> DataFrame:
    """Rows with enough current events, with their score and level."""
    current = F.col("current_count")
    supported = df.filter(current >= min_support)
    scored = supported.withColumn("trend_score", trend_score(current, F.col("previous_count")))
    return scored.withColumn("trend_level", trend_level(F.col("trend_score"), current))


def known_categories(df: DataFrame, excluded: str = NO_TOPIC) -> DataFrame:
    """Rows with a category other than ``excluded``; null counts as excluded."""
    return df.filter(F.coalesce("category", F.lit(excluded)) != excluded)


def label_activity(df: DataFrame) -> DataFrame:
    return df.withColumn("activity_level", activity_level(F.col("category_count")))


def stamp(df: DataFrame, column: str = "created_at") -> DataFrame:
    """Processing time; one value per batch."""
    return df.withColumn(column, F.current_timestamp())
