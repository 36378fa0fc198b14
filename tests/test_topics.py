import pytest
from pyspark.sql import functions as F

from newsflow.functions.topics import choose_category, normalise_source, topic_flag
from newsflow.operators.enrich import add_category, add_topic_scores
from tests.helpers import one


@pytest.mark.parametrize(
    "link, source, expected",
    [
        ("http://microsoft.com/x", "x", "Financial Times"),
        ("https://www.wired.com/a", "x", "Wired"),
        ("https://www.engadget.com/a", "x", "Engadget"),
        ("https://www.aljazeera.com/a", "x", "Al Jazeera"),
        ("https://bbc.co.uk/a", "x", "BBC"),
        ("https://bbc.com/a", "x", "BBC"),
        ("http://a", "", "Unknown"),
        ("http://a", "- lead", ""),
        ("http://a", "the verge | tech", "The Verge"),
        ("http://a", "bbc news — world", "Bbc News"),
        ("http://a", "sky news-uk", "Sky News"),
    ],
)
def test_source_names(spark, link, source, expected):
    df = spark.createDataFrame([(link, source)], "link string, source string")
    assert df.select(normalise_source(F.col("link"), F.col("source"))).first()[0] == expected


def category(spark, title, keywords=(), **options):
    df = spark.createDataFrame(
        [(title, "", list(keywords))], "title string, content string, keywords array<string>"
    )
    return add_category(df, **options).first().category


@pytest.mark.parametrize(
    "title, expected",
    [
        ("inflation", "sports"),
        ("he said so", "tech"),
        ("new software", "politics"),
        ("stock pricing", "business"),
        ("vaccine", "science"),
        ("nothing here", "other"),
        ("bank sanction", "politics"),
        ("", "other"),
    ],
)
def test_category_matches_substrings(spark, title, expected):
    assert category(spark, title) == expected


@pytest.mark.parametrize(
    "title, expected",
    [
        ("inflation", "business"),
        ("he said so", "other"),
        ("new software", "tech"),
        ("the war.", "politics"),
        ("stocks", "business"),
        ("éwar", "other"),
    ],
)
def test_category_with_whole_words(spark, title, expected):
    assert category(spark, title, word_boundary=True) == expected


def test_scores_and_bonus(spark):
    df = spark.createDataFrame(
        [("war", "ai", ["war", "ai"])], "title string, content string, keywords array<string>"
    )
    row = add_topic_scores(df).first()
    assert (row.politics_score, row.tech_score, row.sports_score) == (4, 4, 0)


def test_ties_go_to_the_earlier_topic_and_thresholds_hold(spark):
    scores = {"a": F.lit(2), "b": F.lit(2), "c": F.lit(1)}
    limits = {"a": 3, "b": 2, "c": 1}
    df = spark.range(1)
    # The first topic wins the tie on points but misses its own threshold.
    assert df.select(choose_category(scores, limits)).first()[0] == "b"
    assert df.select(choose_category(scores, {**limits, "a": 2})).first()[0] == "a"
    assert df.select(choose_category({"a": F.lit(0)}, {"a": 1})).first()[0] == "other"


def test_optional_last_letter(spark):
    assert one(spark, "two shares", lambda c: topic_flag(c, ["shares?"])) is True
    assert one(spark, "one share", lambda c: topic_flag(c, ["shares?"])) is True
    assert one(spark, "sharing", lambda c: topic_flag(c, ["shares?"])) is False
