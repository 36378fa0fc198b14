import json

import pytest

from newsflow.operators.dedup import dedup_links
from newsflow.operators.parse import parse_published_time
from newsflow.plans.feeds import feed_records
from newsflow.sources.feeds import parse_feeds, read_feed_files
from tests.helpers import ts

FEED = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0"><channel><title>World News</title><link>http://w</link>
<item><title>One &amp; two</title><link>http://w/1</link><description><![CDATA[<p>Hi</p>]]></description>
<pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title>No text</title><link>http://w/2</link><pubDate>Mon, 1 Jan 2024 11:00:00 +0100</pubDate></item>
<item><title>No link</title><description>x</description><pubDate>soon</pubDate></item>
</channel></rss>"""

EXPECTED = {
    ("World News", "One & two", "<p>Hi</p>", "http://w/1", "Mon Jan 01 10:00:00 UTC 2024"),
    ("World News", "No text", "", "http://w/2", "Mon Jan 01 10:00:00 UTC 2024"),
    ("World News", "No link", "x", None, None),
}


def test_feed_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(FEED)
    (tmp_path / "b.xml").write_text(FEED.replace("World", "Local").replace("http://w", "http://l"))
    items = read_feed_files(spark, str(tmp_path))
    assert {tuple(r) for r in items.filter("source = 'World News'").collect()} == EXPECTED
    assert items.count() == 6


def test_feed_text(spark):
    channel = FEED[FEED.index("<channel>") : FEED.index("</rss>")]
    df = spark.createDataFrame([(channel,), ("<channel>",), (None,)], "xml string")
    assert {tuple(r) for r in parse_feeds(df).collect()} == EXPECTED


def test_items_go_on_as_raw_articles(spark):
    channel = FEED[FEED.index("<channel>") : FEED.index("</rss>")]
    items = parse_feeds(spark.createDataFrame([(channel,), (channel,)], "xml string"))
    timed = parse_published_time(items)
    assert {r.published_ts for r in timed.collect()} == {ts("2024-01-01T10:00:00")}
    assert dedup_links(timed).count() == 2


RDF = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"
 xmlns:dc="http://purl.org/dc/elements/1.1/">
<channel rdf:about="http://w"><title>World News</title><link>http://w</link></channel>
<item rdf:about="http://w/1"><title>One &amp; two</title><link>http://w/1</link>
<description>&lt;p&gt;Hi&lt;/p&gt;</description><dc:date>2024-01-01T11:00:00+01:00</dc:date></item>
<item rdf:about="http://w/2"><title>No text</title><link>http://w/2</link>
<dc:date>2024-01-01T10:00:00Z</dc:date></item>
<item><title>No link</title><description>x</description></item></rdf:RDF>"""

ATOM = """<?xml version="1.0" encoding="utf-8"?>
<feed xmlns="http://www.w3.org/2005/Atom"><title type="text">World News</title>
<link href="http://w"/>
<entry><title>One &amp; two</title><link rel="self" href="http://w/self"/>
<link rel="alternate" href="http://w/1"/><summary type="html">&lt;p&gt;Hi&lt;/p&gt;</summary>
<published>2024-01-01T10:00:00Z</published><updated>2024-02-01T10:00:00Z</updated></entry>
<entry><title>No text</title><link href="http://w/2"/><updated>2024-01-01T10:00:00Z</updated></entry>
<entry><title>No link</title><content>x</content><updated>soon</updated></entry></feed>"""


@pytest.mark.parametrize("feed", [FEED, RDF, ATOM], ids=["rss", "rdf", "atom"])
def test_dialects_give_the_same_items(spark, tmp_path, feed):
    (tmp_path / "feed.xml").write_text(feed)
    assert {tuple(r) for r in read_feed_files(spark, str(tmp_path)).collect()} == EXPECTED


def test_feeds_to_raw_records(spark):
    quoted = FEED.replace("One", 'A "quoted"\nline')
    df = spark.createDataFrame([(quoted,), (ATOM,), (None,), ("<junk",)], "xml string")
    got = sorted(json.loads(r.value)["title"] for r in feed_records(df).collect())
    # one record per link, the smallest by time and title; none without a link
    assert got == ["A 'quoted' line & two", "No text"]
