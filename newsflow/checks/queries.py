"""One query per operator or analysis, each over whole tables.

Arrays are returned joined with ``|`` and times without a zone, so that any engine can
give the same values.
"""

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsflow.functions.text import drop_words, lexicon_hits, tokenize, top_terms
from newsflow.functions.text import word_count as count_words
from newsflow.functions.times import to_utc_ntz
from newsflow.lexicons import NEGATIVE_WORDS, POSITIVE_WORDS, TOPIC_TERMS
from newsflow.operators import breaking, clean, dedup, enrich, parse, windows
from newsflow.operators import trends as trend_operators
from newsflow.operators.rows import explode_present
from newsflow.operators.sentiment import add_sentiment, lexicon_totals
from newsflow.plans import articles as article_plans
from newsflow.plans import breaking as breaking_plans
from newsflow.plans import trends as trend_plans
from newsflow.plans.sentiment import article_sentiment
from newsflow.schemas import RAW_ARTICLE
from newsflow.sinks.batch import Target, write_batch
from newsflow.sinks.stream import run_available, write_collection, write_topic
from newsflow.plans.feeds import feed_records
from newsflow.sources.feeds import parse_feeds
from newsflow.sources.tables import (
    article_view,
    event_view,
    minute,
    published_text,
    raw_records,
    table,
)
from newsflow.sources.segments import FORMAT
from newsflow.sources.topics import read_cleaned_topic, read_table_stream, read_topic
from newsflow.streaming import jobs

# Words common in the test tables, whose text is invented.
FREQUENT_POSITIVE = ("the", "and", "les", "los", "und")
FREQUENT_NEGATIVE = ("with", "that", "que", "der", "des")

# The same as topic terms, and keywords that earn a topic its bonus point.
FREQUENT_TERMS = {
    "politics": ("und", "der"),
    "tech": ("les", "des"),
    "sports": ("onder", "ofthe"),
    "business": ("que", "los"),
    "science": ("thent",),
}
FREQUENT_BONUS = {"politics": ("und", 1), "tech": ("les", 1)}

# Zone written for each event type; the unknown one makes its times invalid.
EVENT_ZONES = {"click": "UTC", "view": "PST", "purchase": "CET", "signup": "GMT"}
UNKNOWN_ZONE = "nowhere"

WIDE = {"duration": "4 hours", "slide": "2 hours", "recent": "2 hours"}
BURSTS = {"duration": "1 day", "slide": "6 hours"}
BURST_THRESHOLD = 15
RUNNING_THRESHOLD, TABLE_THRESHOLD = 40, 280

# Articles whose terms one task counts.
ARTICLES_PER_PART = 5_000


def _documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents")


def _articles(spark, sf) -> DataFrame:
    """Clean articles with a zone-free ``published_ts``."""
    return clean.clean_fields(article_view(_documents(spark, sf)))


def _pages(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", F.col("url").alias("link"), F.col("html").alias("content")
    )


def _conversations(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations")


def _events(spark, sf) -> DataFrame:
    return event_view(table(spark, sf, "events"))


def _titled_events(spark, sf) -> DataFrame:
    """Events with a title (one per user) and a link (one per ``k``)."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select(
        F.col("ts").alias("published_ts"),
        F.col("event_type").alias("keyword"),
        (k.cast("int") % 4).cast("string").alias("category"),
        F.concat(F.lit("user "), "user_id").alias("title"),
        F.concat(F.lit("http://events.example.com/"), k).alias("link"),
    )


def _joined(*columns: str):
    return [F.array_join(c, "|").alias(c) for c in columns]


def _bigints(*columns: str):
    return [F.col(c).cast("bigint").alias(c) for c in columns]


def _utc(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: to_utc_ntz(F.col(c)) for c in columns})


# --- parsing, cleaning, validation -------------------------------------------------


def _mixed_records(spark, sf) -> DataFrame:
    """JSON records for user turns, plain text (malformed) for the others."""
    record = F.to_json(
        F.struct(
            F.col("role").alias("source"),
            F.col("text").alias("title"),
            F.col("conv_id").alias("content"),
            F.struct("turn").alias("link"),
        )
    )
    value = F.when(F.col("role") == "user", record).otherwise(F.col("text"))
    return _conversations(spark, sf).select(value.alias("value"))


def json_parse(spark, sf):
    return parse.parse_json(_mixed_records(spark, sf), RAW_ARTICLE)


def null_fill(spark, sf):
    return clean.fill_nulls(json_parse(spark, sf))


def json_roundtrip(spark, sf):
    fields = article_view(_documents(spark, sf)).select("source", "title", "content", "link")
    return parse.parse_json(parse.to_json_value(fields), RAW_ARTICLE).drop("published")


def keyed_json(spark, sf):
    rows = article_view(_documents(spark, sf))
    columns = ["doc_id", "source", "link", "title", "content"]
    return parse.to_json_value(rows, columns, key="source")


def escape_raw(spark, sf):
    articles = article_view(_documents(spark, sf))
    return clean.escape_fields(articles).select("doc_id", "source", "title", "content")


def lower_fields(spark, sf):
    return clean.lower_fields(_pages(spark, sf), ["link", "content"])


def strip_tags(spark, sf):
    return clean.strip_tag_fields(_pages(spark, sf), ["content"])


def strip_symbols(spark, sf):
    return clean.strip_symbol_fields(_pages(spark, sf), ["content"])


def strip_breaks(spark, sf):
    return clean.strip_break_fields(_pages(spark, sf), ["content"])


def collapse_space(spark, sf):
    return clean.collapse_fields(_pages(spark, sf), ["link", "content"])


def clean_pages(spark, sf):
    return clean.clean_fields(_pages(spark, sf))


def clean_text(spark, sf):
    return _articles(spark, sf)


def parse_published(spark, sf):
    zone = F.lit(UNKNOWN_ZONE)
    for kind, name in EVENT_ZONES.items():
        zone = F.when(F.col("event_type") == kind, name).otherwise(zone)
    ts = F.col("ts")
    text = F.concat(
        F.date_format(ts, "EEE MMM dd HH:mm:ss "), zone, F.date_format(ts, " yyyy")
    )
    raw = table(spark, sf, "events").select("event_id", text.alias("published"))
    return parse.parse_published_time(raw).select(
        "event_id", F.unix_seconds("published_ts").alias("published_second")
    )


def event_time(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    text = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(iso)
    cleaned = table(spark, sf, "events").select("event_id", text.alias("published"))
    return parse.parse_event_time(cleaned).select(
        "event_id", F.unix_millis("published_ts").alias("published_milli")
    )


def dedup_link(spark, sf):
    """Every page link in four spellings, one of them blank."""
    spelling = F.array(
        F.col("url"), F.upper("url"), F.concat(F.lit("  "), "url", F.lit(" ")), F.lit("  ")
    )
    links = table(spark, sf, "pages").select(
        "page_id", F.posexplode(spelling).alias("spelling", "link")
    )
    return dedup.dedup_links(links, order_by=("page_id", "spelling"))


def dedup_title(spark, sf):
    """Whole texts as titles."""
    titled = table(spark, sf, "documents").select(
        "doc_id", minute(F.col("doc_id")).alias("published_ts"), F.col("text").alias("title")
    )
    return dedup.dedup_titles(titled, order_by=("published_ts", "doc_id"))


# --- enrichment --------------------------------------------------------------------


def word_count(spark, sf):
    return enrich.add_word_count(_articles(spark, sf)).select("doc_id", "word_count")


def tokens(spark, sf):
    kept = enrich.add_tokens(_articles(spark, sf), stop_words=())
    return kept.select("doc_id", *_joined("tokens"))


def tokens_without_stop_words(spark, sf):
    return enrich.add_tokens(_articles(spark, sf)).select("doc_id", *_joined("tokens"))


def conversation_words(spark, sf):
    text = F.lower("text")
    words = drop_words(tokenize(text, 3))
    return _conversations(spark, sf).select(
        "conv_id",
        "turn",
        count_words(text).alias("word_count"),
        F.size(words).alias("n_tokens"),
        F.array_join(top_terms(words), "|").alias("keywords"),
    )


def term_freq(spark, sf):
    return enrich.explode_terms(enrich.add_tokens(_articles(spark, sf)), "doc_id")


def term_freq_map(spark, sf):
    counted = enrich.add_term_frequency(enrich.add_tokens(_articles(spark, sf)))
    entries = F.transform(
        F.sort_array(F.map_entries("term_freq")),
        lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")),
    )
    return counted.select("doc_id", F.array_join(entries, "|").alias("term_freq"))


def keywords(spark, sf):
    return enrich.add_keywords(_articles(spark, sf)).select("doc_id", *_joined("keywords"))


def source_norm(spark, sf):
    named = enrich.add_source(_articles(spark, sf))
    return named.select("doc_id", "source", "source_normalized")


def source_rules(spark, sf):
    """Page links moved to hosts the rules know; the source is the first path part."""
    link = F.col("link")
    for suffix, host in (("com", "wired.com"), ("net", "aljazeera.com")):
        link = F.replace(link, F.lit(f"example.{suffix}"), F.lit(host))
    source = F.regexp_extract("link", r"^https?://[^/]+/([a-z]*)", 1)
    pages = _pages(spark, sf).select("page_id", source.alias("source"), link.alias("link"))
    return enrich.add_source(clean.clean_fields(pages))


def topic_flags(spark, sf):
    flagged = enrich.add_topic_flags(_articles(spark, sf))
    return flagged.select("doc_id", *[f"{t}_hit" for t in TOPIC_TERMS])


def topic_scores(spark, sf):
    scored = enrich.add_topic_scores(enrich.add_keywords(_articles(spark, sf)))
    return scored.select("doc_id", *[f"{t}_score" for t in TOPIC_TERMS])


def category(spark, sf):
    chosen = enrich.add_category(enrich.add_keywords(_articles(spark, sf)))
    return chosen.select("doc_id", "category")


def category_whole_words(spark, sf):
    keyed = enrich.add_keywords(_articles(spark, sf))
    return enrich.add_category(keyed, word_boundary=True).select("doc_id", "category")


def category_frequent(spark, sf):
    """Categories by words common in the tables, so that every topic wins somewhere."""
    keyed = enrich.add_keywords(_articles(spark, sf))
    return enrich.add_category(keyed, FREQUENT_TERMS, FREQUENT_BONUS).select("doc_id", "category")


def cleaned_articles(spark, sf):
    """Raw JSON records to written articles."""
    articles = article_plans.cleaned_articles(raw_records(_documents(spark, sf)))
    joined = articles.withColumn("keywords", F.array_join("keywords", "|"))
    return _utc(joined, "published")


# --- sentiment ---------------------------------------------------------------------


def sentiment(spark, sf):
    scored = article_sentiment(
        article_plans.cleaned_articles(raw_records(_documents(spark, sf)))
    )
    return _utc(scored.withColumn("keywords", F.array_join("keywords", "|")), "published")


def sentiment_frequent(spark, sf):
    scored = add_sentiment(_articles(spark, sf), FREQUENT_POSITIVE, FREQUENT_NEGATIVE)
    return scored.select(
        "doc_id", "positive_count", "negative_count", "sentiment_score", "sentiment"
    )


def lexicon_counts(spark, sf):
    """Lexicon hits over conversation turns."""
    words = tokenize(F.lower(F.trim("text")), 2)
    return _conversations(spark, sf).select(
        "conv_id",
        "turn",
        lexicon_hits(words, POSITIVE_WORDS + FREQUENT_POSITIVE).alias("positive_count"),
        lexicon_hits(words, NEGATIVE_WORDS + FREQUENT_NEGATIVE).alias("negative_count"),
    )


def lexicon_table(spark, sf):
    """The same hits by a lexicon that is a table of weighted words, and their weight."""
    words = [
        *((w, "positive", 1) for w in POSITIVE_WORDS + FREQUENT_POSITIVE),
        *((w, "negative", -2) for w in NEGATIVE_WORDS + FREQUENT_NEGATIVE),
    ]
    lexicon = spark.createDataFrame(sorted(set(words)), "word string, side string, weight int")
    turns = _conversations(spark, sf).select(
        "conv_id", "turn", tokenize(F.lower(F.trim("text")), 2).alias("tokens")
    )
    return lexicon_totals(turns, lexicon, ["conv_id", "turn"], sides=("positive", "negative"))


# --- keyword trends and category activity ------------------------------------------


def _categorised(spark, sf) -> DataFrame:
    keyed = enrich.add_keywords(_articles(spark, sf))
    return enrich.add_category(keyed).withColumnRenamed("published_ts", "published")


def keyword_events(spark, sf):
    return trend_plans.keyword_events(_categorised(spark, sf))


def window_positions(spark, sf):
    placed = windows.window_positions(_events(spark, sf), **WIDE)
    return windows.flatten_window(placed, "event_id", "window_position")


def counts_by_position(spark, sf):
    counts = trend_operators.counts_by_position(_events(spark, sf), **WIDE)
    return windows.flatten_window(counts, "category", "keyword", "window_position", "n")


def trends(spark, sf):
    return trend_plans.trends_of_events(_events(spark, sf))


def trends_wide(spark, sf):
    return trend_plans.trends_of_events(_events(spark, sf), **WIDE)


def trend_two_stage(spark, sf):
    return trend_plans.trends_in_two_stages(_events(spark, sf), **WIDE)


def article_trends(spark, sf):
    """Raw JSON records to keyword trends: the whole batch path."""
    articles = article_plans.cleaned_articles(raw_records(_documents(spark, sf)))
    found = trend_plans.keyword_trends(articles, unique_titles=True)
    return _utc(found, "window_start", "window_end")


def article_trends_wide(spark, sf):
    """The same over hours, in which the invented words come back: several levels occur."""
    articles = article_plans.cleaned_articles(raw_records(_documents(spark, sf)))
    found = trend_plans.keyword_trends(articles, unique_titles=True, **WIDE)
    return _utc(found, "window_start", "window_end")


def _dealt_by_time(articles: DataFrame) -> DataFrame:
    """The same articles in parts of neighbours in time, as many as their number asks for: a
    task that counts their terms holds no more of them however large the files are."""
    parts = 1 + articles.count() // ARTICLES_PER_PART
    return articles.repartitionByRange(parts, "published_ts", "doc_id")


def term_trends(spark, sf):
    """Trends of every term of every article: those of the first hours are all new."""
    terms = F.array_distinct("tokens")
    articles = clean.clean_fields(_dealt_by_time(article_view(_documents(spark, sf))))
    found = explode_present(enrich.add_tokens(articles), terms, "keyword")
    events = found.select("published_ts", F.lit("all").alias("category"), "keyword")
    return trend_plans.trends_of_events(events, by_slot=False, **WIDE)


def category_activity(spark, sf):
    events = _events(spark, sf).select("published_ts", F.col("keyword").alias("category"))
    known = trend_operators.known_categories(events, excluded="error")
    return trend_plans.activity_of_events(known)


def article_activity(spark, sf):
    articles = article_plans.cleaned_articles(raw_records(_documents(spark, sf)))
    return _utc(trend_plans.category_activity(articles), "window_start", "window_end")


# --- breaking bursts ---------------------------------------------------------------


def _burst_counts(spark, sf) -> DataFrame:
    return breaking_plans.burst_counts(_events(spark, sf), **BURSTS)


def burst_counts(spark, sf):
    return _burst_counts(spark, sf)


def sketch_cells(spark, sf):
    terms = enrich.explode_terms(enrich.add_tokens(_articles(spark, sf)), "doc_id")
    return breaking.build_sketch(terms, "term", "n")


def sketch_estimate(spark, sf):
    """Whole-table estimates of every term next to its exact count."""
    terms = enrich.explode_terms(enrich.add_tokens(_articles(spark, sf)), "doc_id")
    exact = terms.groupBy("term").agg(F.sum("n").alias("exact_count"))
    sketch = breaking.build_sketch(exact, "term", "exact_count")
    return breaking.estimate(exact, sketch, "term")


def sketch_merge(spark, sf):
    """Sketch of article titles merged with one of article bodies."""
    articles = _articles(spark, sf)

    def part(column: str) -> DataFrame:
        terms = explode_present(articles.select(column), tokenize(F.col(column), 3), "term")
        return breaking.build_sketch(terms.select("term", F.lit(1).alias("n")), "term", "n")

    return breaking.merge_sketches(part("title"), part("content"))


def running_estimates(spark, sf):
    return breaking.running_estimates(_burst_counts(spark, sf))


def _alerts(spark, sf, mode: str, threshold: int, reset: str | None = None) -> DataFrame:
    alerts = breaking_plans.alerts_of_events(
        _titled_events(spark, sf), mode, threshold, reset=reset, **BURSTS
    )
    joined = {c: F.array_join(c, "|") for c in ("sample_titles", "sample_links")}
    return alerts.withColumns(joined)


def breaking_running(spark, sf):
    """A sketch for every window: a keyword's estimate grows over the categories."""
    return _alerts(spark, sf, "running", RUNNING_THRESHOLD, "window")


def breaking_table(spark, sf):
    """A sketch for every day."""
    return _alerts(spark, sf, "table", TABLE_THRESHOLD, "day")


def breaking_exact(spark, sf):
    return _alerts(spark, sf, "exact", BURST_THRESHOLD)


def article_breaking(spark, sf):
    """Raw JSON records to alerts, with a threshold the test tables can reach."""
    articles = article_plans.cleaned_articles(raw_records(_documents(spark, sf)))
    alerts = breaking_plans.breaking_alerts(
        articles, unique_titles=True, threshold=2, reset="window"
    )
    joined = {c: F.array_join(c, "|") for c in ("sample_titles", "sample_links")}
    return _utc(alerts.withColumns(joined), "window_start", "window_end")


# --- feeds -------------------------------------------------------------------------


def _element(name: str, value):
    text = value
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>"))


def _feed(source, items, dialect: str):
    """A feed of one source in one of three dialects."""
    title = _element("title", source)
    if dialect == "rss":
        head, tail = "<rss version='2.0'><channel>", "</channel></rss>"
        return F.concat(F.lit(head), title, items, F.lit(tail))
    if dialect == "rdf":
        head = (
            "<rdf:RDF xmlns='http://purl.org/rss/1.0/' xmlns:dc='http://purl.org/dc/elements/1.1/'"
            " xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#'><channel>"
        )
        return F.concat(F.lit(head), title, F.lit("</channel>"), items, F.lit("</rdf:RDF>"))
    head = "<feed xmlns='http://www.w3.org/2005/Atom'>"
    return F.concat(F.lit(head), title, items, F.lit("</feed>"))


def _item(title, content, link, ts, dialect: str):
    if dialect == "atom":
        href = F.replace(link, F.lit("&"), F.lit("&amp;"))
        parts = [
            _element("title", title),
            F.concat(F.lit('<link rel="alternate" href="'), href, F.lit('"/>')),
            _element("summary", content),
            _element("published", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        ]
        return F.concat(F.lit("<entry>"), *parts, F.lit("</entry>"))
    if dialect == "rdf":
        when = _element("dc:date", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    else:
        when = _element("pubDate", F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss 'GMT'"))
    parts = [_element("title", title), _element("description", content), _element("link", link)]
    return F.concat(F.lit("<item>"), *parts, when, F.lit("</item>"))


def _feeds(spark, sf, documents: DataFrame | None = None) -> DataFrame:
    """Every document as a feed of two items with one link, in three dialects by turns."""
    articles = article_view(_documents(spark, sf) if documents is None else documents)
    text = F.concat("title", F.lit("\n"), "content")
    xml = F.lit(None).cast("string")
    for n, dialect in enumerate(("rss", "rdf", "atom")):
        fields = (text, F.col("link"), F.col("published_ts"), dialect)
        first = _item(F.concat(F.lit("No. "), "doc_id"), *fields)
        later = (text, F.upper("link"), F.col("published_ts") + F.expr("INTERVAL 1 SECOND"), dialect)
        again = _item(F.concat(F.lit("Again "), "doc_id"), *later)
        feed = _feed(F.col("source"), F.concat(first, again), dialect)
        xml = F.when(F.col("doc_id") % 3 == n, feed).otherwise(xml)
    return articles.select(xml.alias("xml"))


def feed_items(spark, sf):
    """Both items of every feed, with whole texts."""
    return parse_feeds(_feeds(spark, sf))


def feed_to_raw(spark, sf):
    """Feeds to raw records: items escaped, one per link."""
    return feed_records(_feeds(spark, sf))


# --- streams -----------------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that the session names. A local folder will do, where
    none is named, only if all tasks run in this process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="newsflow-")
    return f"{shared.rstrip('/')}/run-{uuid.uuid4().hex}"


NOW = {"availableNow": True}

TREND_ROWS = (
    "window_start timestamp, window_end timestamp, category string, keyword string,"
    " current_count bigint, previous_count bigint, trend_score double, trend_level string"
)
ACTIVITY_ROWS = (
    "window_start timestamp, window_end timestamp, category string, category_count bigint,"
    " activity_level string"
)
ALERT_ROWS = (
    "window_start timestamp, window_end timestamp, category string, keyword string,"
    " exact_count bigint, approx_count bigint, sample_titles array<string>,"
    " sample_links array<string>, status string"
)
SENTIMENT_ROWS = (
    "published timestamp, source_normalized string, category string, title string, link string,"
    " keywords array<string>, positive_count int, negative_count int, sentiment_score int,"
    " sentiment string"
)
ARTICLE_ROWS = "title string, word_count int, keywords array<string>, category string"


def _written(spark: SparkSession, target: Target, schema: str) -> DataFrame:
    """Rows of a target; none where a job had nothing to write."""
    empty = spark.createDataFrame([], schema)
    try:
        found = spark.read.schema(empty.schema).format(target.fmt).load(target.path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    return found.select(*empty.columns)


def _run(spark, start, records: DataFrame, schema: str, **options) -> tuple[DataFrame, DataFrame]:
    """Run a job over all records there are now; its collection and its messages."""
    base = _scratch(spark)
    collection = Target("parquet", f"{base}/collection")
    topic = Target("json", f"{base}/topic")
    run_available(
        start(records, collection, topic, f"{base}/checkpoint", trigger=NOW, **options)
    )
    messages = _written(spark, topic, "key string, value string")
    return _written(spark, collection, schema), messages


def _event_records(spark, sf, events: DataFrame | None = None) -> DataFrame:
    """Streaming cleaned-article records: one per event, its type as only keyword."""
    if events is None:
        events = read_table_stream(spark, sf, "events.parquet")
    k = F.get_json_object("props", "$.k")
    fields = F.struct(
        F.concat(F.lit("event "), "event_id").alias("title"),
        F.col("event_type").alias("content"),
        F.concat(F.lit("http://events.example.com/"), k).alias("link"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("published"),
        F.array(F.col("event_type"), F.lit("news")).alias("keywords"),
        (k.cast("int") % 4).cast("string").alias("category"),
    )
    return events.select(F.to_json(fields).alias("value"))


def stream_cleaning(spark, sf):
    """Whole texts as titles, so that what is kept does not depend on arrival."""
    documents = read_table_stream(spark, sf, "documents.parquet")
    published = published_text(minute(F.col("doc_id")))
    fields = F.struct(F.col("text").alias("title"), published.alias("published"))
    records = documents.select(F.to_json(fields).alias("value"))
    cleaned, _ = _run(
        spark, jobs.start_cleaning, records, ARTICLE_ROWS, bounded_state=False, split=4
    )
    return cleaned.select("title", "word_count", *_joined("keywords"), "category")


def stream_trends(spark, sf):
    rows = f"window struct<start: timestamp, end: timestamp>, {TREND_ROWS.split(', ', 2)[2]}"
    records = _event_records(spark, sf)
    out, _ = _run(spark, jobs.start_trends, records, rows, bounded_state=False, **WIDE)
    return _utc(windows.flatten_window(out, out.columns[1:]), "window_start", "window_end")


def stream_activity(spark, sf):
    out, _ = _run(spark, jobs.start_activity, _event_records(spark, sf), ACTIVITY_ROWS)
    return _utc(out, "window_start", "window_end")


def stream_trend_messages(spark, sf):
    """What the trend job sends to its topic, unpacked again."""
    records = _event_records(spark, sf)
    _, messages = _run(
        spark, jobs.start_trends, records, TREND_ROWS, bounded_state=False, **WIDE
    )
    out = messages.select("key", F.from_json("value", TREND_ROWS).alias("v"))
    out = out.select("key", "v.*")
    return _utc(out, "window_start", "window_end")


def stream_late(spark, sf):
    """Activity of a table that comes in three parts, all over the same time, each in a run of
    its own on one checkpoint. When a part comes, the parts before have closed their windows:
    of the later parts only rows of windows that are still open count."""
    base = _scratch(spark)
    collection, topic = Target("parquet", f"{base}/collection"), Target("json", f"{base}/topic")
    events = table(spark, sf, "events")
    for n in range(3):
        part = events.where(F.col("event_id") % 3 == n)
        part.write.mode("append").parquet(f"{base}/late.parquet")
        records = _event_records(spark, sf, read_table_stream(spark, base, "late.parquet"))
        run_available(
            jobs.start_activity(
                records, collection, topic, f"{base}/checkpoint", trigger=NOW, late_rows=True
            )
        )
    return _utc(_written(spark, collection, ACTIVITY_ROWS), "window_start", "window_end")


def _stream_alerts(spark, sf, **options) -> DataFrame:
    records = _event_records(spark, sf)
    out, _ = _run(
        spark, jobs.start_breaking, records, ALERT_ROWS, bounded_state=False, **options, **BURSTS
    )
    joined = {c: F.array_join(c, "|") for c in ("sample_titles", "sample_links")}
    return _utc(out.withColumns(joined), "window_start", "window_end")


def stream_breaking(spark, sf):
    return _stream_alerts(spark, sf, mode="exact")


def stream_breaking_running(spark, sf):
    """A sketch for every window, so that micro-batches do not matter."""
    return _stream_alerts(spark, sf, threshold=RUNNING_THRESHOLD, reset="window")


def stream_sentiment(spark, sf):
    out, _ = _run(spark, jobs.start_sentiment, _event_records(spark, sf), SENTIMENT_ROWS)
    return _utc(out.withColumn("keywords", F.array_join("keywords", "|")), "published")


def topic_roundtrip(spark, sf):
    """Documents to a topic, and from the topic to a collection."""
    base = _scratch(spark)
    topic = Target("json", f"{base}/topic")
    articles = article_view(read_table_stream(spark, sf, "documents.parquet"))
    sent = articles.select("doc_id", "source", "title", "content", "link")
    run_available(write_topic(sent, topic, f"{base}/sending", NOW))
    received = parse.parse_json(read_topic(spark, "json", path=topic.path), sent.schema)
    collection = Target("parquet", f"{base}/collection")
    run_available(write_collection(received, collection, f"{base}/receiving", NOW))
    return spark.read.parquet(collection.path)


def stream_feeds(spark, sf):
    """Feeds to a raw topic: of the items of a link the earliest, once no earlier can come."""
    base = _scratch(spark)
    feeds = _feeds(spark, sf, read_table_stream(spark, sf, "documents.parquet"))
    topic = Target("json", f"{base}/raw")
    options = {"bounded_state": True, "within": "1 hour", "delay": "10 minutes"}
    run_available(
        jobs.start_feeds(feeds, topic, f"{base}/checkpoint", trigger=NOW, **options)
    )
    return _written(spark, topic, "value string")


def _event_links(events: DataFrame) -> DataFrame:
    """A third of all events share a link; others have that of their key, written in two ways."""
    k = F.concat(F.lit("http://events.example.com/"), F.get_json_object("props", "$.k"))
    link = F.when(F.col("event_id") % 3 == 0, "http://events.example.com/hot")
    link = link.otherwise(F.when(F.col("event_id") % 2 == 0, k).otherwise(F.concat(F.lit(" "), F.upper(k))))
    at = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
    return events.select(link.alias("link"), "event_id", at.alias("published_ts"))


def stream_links(spark, sf):
    """Links of a stream, each once whatever its case: copies of the hot one are reduced in
    eight places, and links behind the watermark are forgotten."""
    base = _scratch(spark)
    rows = _event_links(read_table_stream(spark, sf, "events.parquet"))
    kept = dedup.dedup_links(rows, delay="400 days", bounded_state=True, split=8)
    found = Target("parquet", f"{base}/links")
    run_available(write_collection(kept, found, f"{base}/checkpoint", NOW))
    written = _written(spark, found, "link string")
    return written.select(F.lower(F.trim("link")).alias("link_key"))


def stream_earliest(spark, sf):
    """Of the events of a link, the earliest of those that follow each other within ten
    minutes, whatever their order of arrival."""
    base = _scratch(spark)
    rows = _event_links(read_table_stream(spark, sf, "events.parquet"))
    kept = dedup.dedup_links(
        rows, delay="5 minutes", within="10 minutes", order_by=("published_ts", "event_id")
    )
    found = Target("parquet", f"{base}/links")
    run_available(write_collection(kept, found, f"{base}/checkpoint", NOW))
    return _utc(_written(spark, found, "link string, event_id bigint, published_ts timestamp"), "published_ts")


def topic_latest(spark, sf):
    """A reader of cleaned records that starts when half of them are in the topic gets the
    other half; the collection is committed batch by batch."""
    base = _scratch(spark)
    articles = article_view(_documents(spark, sf)).select("doc_id", "source", "title", "link")
    for half in range(2):
        message = parse.to_json_value(articles.where(F.col("doc_id") % 2 == half))
        if half:
            records = read_cleaned_topic(spark, base, "cleaned", fmt=FORMAT)
            rows = parse.parse_json(records, articles.schema)
            collection = Target(FORMAT, f"{base}/collection")
            query = write_collection(rows, collection, f"{base}/checkpoint")
            query.processAllAvailable()
        write_batch(message, Target(FORMAT, f"{base}/cleaned"), "sending", half)
    query.processAllAvailable()
    query.stop()
    found = spark.read.format(FORMAT).load(f"{base}/collection")
    return found.select(*articles.columns)


QUERIES = {
    f.__name__: f
    for f in (
        json_parse,
        null_fill,
        json_roundtrip,
        keyed_json,
        escape_raw,
        lower_fields,
        strip_tags,
        strip_symbols,
        strip_breaks,
        collapse_space,
        clean_pages,
        clean_text,
        parse_published,
        event_time,
        dedup_link,
        dedup_title,
        word_count,
        tokens,
        tokens_without_stop_words,
        conversation_words,
        term_freq,
        term_freq_map,
        keywords,
        source_norm,
        source_rules,
        topic_flags,
        topic_scores,
        category,
        category_whole_words,
        category_frequent,
        cleaned_articles,
        sentiment,
        sentiment_frequent,
        lexicon_counts,
        lexicon_table,
        keyword_events,
        window_positions,
        counts_by_position,
        trends,
        trends_wide,
        trend_two_stage,
        article_trends,
        article_trends_wide,
        term_trends,
        category_activity,
        article_activity,
        burst_counts,
        sketch_cells,
        sketch_estimate,
        sketch_merge,
        running_estimates,
        breaking_running,
        breaking_table,
        breaking_exact,
        article_breaking,
        feed_items,
        feed_to_raw,
        stream_cleaning,
        stream_trends,
        stream_trend_messages,
        stream_activity,
        stream_late,
        stream_breaking,
        stream_breaking_running,
        stream_sentiment,
        topic_roundtrip,
        topic_latest,
        stream_feeds,
        stream_links,
        stream_earliest,
    )
}
