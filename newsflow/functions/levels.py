"""Labels derived from counts and scores."""

from pyspark.sql import Column, functions as F

# Fixed values: (level, least score, least current count), first match wins.
TREND_LEVELS = (("BREAKING", 8, 10), ("HOT", 4, 5), ("WARM", 1.5, 0))
# Fixed values: (level, least count), first match wins.
ACTIVITY_LEVELS = (("SPIKE", 5), ("ACTIVE", 3))
NORMAL = "NORMAL"


def trend_score(current: Column, previous: Column) -> Column:
    """Growth against the previous period, DOUBLE."""
    return current / (previous + F.lit(1))


def trend_level(score: Column, current: Column, levels=TREND_LEVELS) -> Column:
    chain = F
    for name, least_score, least_count in levels:
        chain = chain.when((score >= least_score) & (current >= least_count), name)
    return chain.otherwise(NORMAL)


def activity_level(count: Column, levels=ACTIVITY_LEVELS) -> Column:
    chain = F
    for name, least_count in levels:
        chain = chain.when(count >= least_count, name)
    return chain.otherwise(NORMAL)


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0, "Positive").when(score < 0, "Negative").otherwise("Neutral")
