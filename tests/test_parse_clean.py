import json

import pytest

from newsflow.operators import clean, parse
from newsflow.schemas import RAW_ARTICLE


@pytest.mark.parametrize(
    "value",
    [None, "", "not json", '{"title": "t\\x"}', '{"title": "a\rb"}', '[{"title": "a"}]', "[1, 2]"],
)
def test_malformed_records_become_null_rows(spark, value):
    df = spark.createDataFrame([(value,)], "value string")
    assert parse.parse_json(df, RAW_ARTICLE).first().asDict() == dict.fromkeys(RAW_ARTICLE.names)


def test_values_under_text_fields_are_kept_as_text(spark):
    df = spark.createDataFrame([('{"source": 1, "title": {"a": 1}}',)], "value string")
    row = parse.parse_json(df, RAW_ARTICLE).first()
    assert (row.source, row.title, row.link) == ("1", '{"a":1}', None)


def test_parse_some_fields_of_binary_values(spark):
    df = spark.createDataFrame([(bytearray(b'{"title": "a", "link": "b"}'),)], "value binary")
    assert parse.parse_json(df, RAW_ARTICLE, fields=["link"]).first().asDict() == {"link": "b"}


def test_json_values(spark):
    df = spark.sql(
        "SELECT 'tech' AS category, CAST(NULL AS STRING) AS none, 2.0D AS score,"
        " TIMESTAMP '2024-01-01 10:00:00Z' AS at, array('a', 'b') AS list"
    )
    row = parse.to_json_value(df, key="category").first()
    assert row.key == "tech"
    assert json.loads(row.value) == {
        "category": "tech",
        "score": 2.0,
        "at": "2024-01-01T10:00:00.000Z",
        "list": ["a", "b"],
    }


def test_escaped_fields_survive_serialisation(spark):
    tricky = 'a "quoted" \\ back\tslash\r\nline'
    df = spark.createDataFrame([("s", tricky, None)], "source string, title string, content string")
    escaped = clean.escape_fields(df)
    back = parse.parse_json(parse.to_json_value(escaped), RAW_ARTICLE).first()
    assert back.title == "a 'quoted' \\ back\tslash  line"
    assert back.content == ""


def test_fill_and_reorder(spark):
    df = spark.createDataFrame([(None, "t")], "category string, title string")
    assert clean.fill_nulls(df, {"category": "other"}).first() == ("other", "t")
    timed = spark.sql("SELECT 'x' AS published, TIMESTAMP '2024-01-01 00:00:00' AS published_ts")
    assert clean.published_from_ts(timed).dtypes == [("published", "timestamp")]
