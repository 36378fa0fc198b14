"""Views that read the test tables as articles and keyword events."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FIRST_MINUTE = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minute(n: Column) -> Column:
    """The ``n``-th minute of the article timeline, without a zone."""
    start = F.lit(FIRST_MINUTE).cast("timestamp_ntz")
    return start + F.make_dt_interval(mins=n.cast("int"))


def article_view(documents: DataFrame) -> DataFrame:
    """doc_id, source, title (first line), content (the rest), link, published_ts."""
    title = F.substring_index("text", "\n", 1)
    return documents.select(
        "doc_id",
        "source",
        title.alias("title"),
        F.substr("text", F.length(title) + 2).alias("content"),
        F.concat(F.lit("http://"), "source", F.lit(".example.com/"), "doc_id").alias("link"),
        minute(F.col("doc_id")).alias("published_ts"),
    )


def published_text(ts: Column, zone: str = "UTC") -> Column:
    """A zone-free time in the layout raw articles carry."""
    return F.concat(
        F.date_format(ts, "EEE MMM dd HH:mm:ss"), F.lit(f" {zone} "), F.date_format(ts, "yyyy")
    )


def raw_records(documents: DataFrame) -> DataFrame:
    """``value``: the documents as raw article JSON."""
    articles = article_view(documents).withColumn(
        "published", published_text(F.col("published_ts"))
    )
    fields = F.struct("source", "title", "content", "link", "published")
    return articles.select(F.to_json(fields).alias("value"))


def event_view(events: DataFrame) -> DataFrame:
    """event_id, published_ts, keyword (event type), category (of 4)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "event_id",
        F.col("ts").alias("published_ts"),
        F.col("event_type").alias("keyword"),
        (k % 4).cast("string").alias("category"),
    )
