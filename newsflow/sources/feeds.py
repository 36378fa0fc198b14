"""Feeds as item rows: (source, title, content, link, published).

RSS 2.0, RSS 1.0 (RDF) and Atom are read by one schema: namespaces are ignored, and what a
dialect does not have is null.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsflow.functions.times import parse_feed_date
from newsflow.schemas import FEED, FEED_ENTRY, FEED_ITEM, RAW_ARTICLE

# Layout of the raw article's publication time.
PUBLISHED_FORMAT = "EEE MMM dd HH:mm:ss 'UTC' yyyy"

XML_OPTIONS = {"ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE"}


def _entry_link(links):
    """The page an Atom entry is about: its first link without a relation or with that of
    an alternate, else its first link."""
    page = F.filter(links, lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
    return F.coalesce(F.get(page, F.lit(0))["_href"], F.get(links, F.lit(0))["_href"])


def _items(feeds: DataFrame) -> DataFrame:
    """One row per item of parsed feeds."""

    def items(array):
        return F.coalesce(array, F.array().cast(FEED_ITEM))

    entries = F.transform(
        F.coalesce("entry", F.array().cast(FEED_ENTRY)),
        lambda e: F.struct(
            e["title"].alias("title"),
            F.coalesce(e["summary"], e["content"]).alias("description"),
            _entry_link(e["link"]).alias("link"),
            F.coalesce(e["published"], e["updated"]).alias("pubDate"),
            F.lit(None).cast("string").alias("date"),
        ),
    )
    every = F.concat(items(F.col("channel.item")), items(F.col("item")), entries)
    rows = feeds.select(
        F.coalesce("channel.title", "title").alias("feed_title"), F.explode(every).alias("i")
    )
    pub = parse_feed_date(F.coalesce("i.pubDate", "i.date"))
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), pub.cast("timestamp_ntz"))
    return rows.select(
        F.coalesce("feed_title", F.lit("")).alias("source"),
        F.coalesce("i.title", F.lit("")).alias("title"),
        F.coalesce("i.description", F.lit("")).alias("content"),
        F.col("i.link").alias("link"),
        F.date_format(utc, PUBLISHED_FORMAT).alias("published"),
    ).select(*RAW_ARTICLE.names)


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """Items of the saved feed files under ``path``, one feed a file."""
    return parse_feeds(spark.read.text(path, wholetext=True), "value")


def read_feed_stream(
    spark: SparkSession, path: str, options: dict[str, str] | None = None
) -> DataFrame:
    """The feed files that arrive in the folder ``path``, each as a whole in ``xml``. ``options``
    may limit a micro-batch (``maxFilesPerTrigger``)."""
    reader = spark.readStream.format("text").options(wholetext="true", **(options or {}))
    return reader.load(path).withColumnRenamed("value", "xml")


def parse_feeds(df: DataFrame, column: str = "xml") -> DataFrame:
    """Items of the feeds held as text in ``column``, whatever their dialect; a lone
    <channel> is read too. A document that is not well-formed gives no items."""
    feed = F.from_xml(F.col(column), FEED, XML_OPTIONS)
    return _items(df.select(feed.alias("f")).select("f.*"))
