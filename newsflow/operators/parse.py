"""JSON in, JSON out, and event time."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from newsflow.functions.times import parse_iso, parse_published

# Output must not depend on the session zone.
_JSON_OPTIONS = {"timeZone": "UTC"}


def parse_json(
    df: DataFrame, schema: StructType, column: str = "value", fields=None
) -> DataFrame:
    """One row per record with the schema's columns, or just ``fields`` of them; a
    malformed record gives an all-null row, which the time filter then drops.

    The record is unpacked by a generator: a later filter on a field then stays above
    the parser, where a plain projection would have it parse every record twice.
    """
    if fields is not None:
        schema = StructType([schema[name] for name in fields])
    record = F.from_json(F.col(column).cast("string"), schema)
    return df.select(F.inline(F.array(record)))


def parse_published_time(df: DataFrame) -> DataFrame:
    """``published`` text of a raw article to ``published_ts``, invalid times dropped."""
    return valid_time(df.withColumn("published_ts", parse_published(F.col("published"))))


def parse_event_time(df: DataFrame) -> DataFrame:
    """``published`` of a cleaned article to ``published_ts``, invalid times dropped.
    Text is parsed as ISO-8601; a column that is a time already is kept."""
    published = F.col("published")
    if df.schema["published"].dataType.typeName() == "string":
        published = parse_iso(published)
    return valid_time(df.withColumn("published_ts", published))


def valid_time(df: DataFrame, column: str = "published_ts") -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def to_json_value(df: DataFrame, columns=None, key: str | None = None) -> DataFrame:
    """``value``: the chosen columns as JSON, null fields left out; with ``key`` also
    that column as text."""
    fields = F.struct(*[F.col(c) for c in (columns or df.columns)])
    out = [F.to_json(fields, _JSON_OPTIONS).alias("value")]
    if key is not None:
        out.insert(0, F.col(key).cast("string").alias("key"))
    return df.select(*out)
