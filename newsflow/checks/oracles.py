"""SQL, for an independent engine, that gives the same rows as the registered queries."""

from newsflow.checks.queries import (
    BURST_THRESHOLD,
    EVENT_ZONES,
    FREQUENT_BONUS,
    FREQUENT_NEGATIVE,
    FREQUENT_POSITIVE,
    FREQUENT_TERMS,
    RUNNING_THRESHOLD,
    TABLE_THRESHOLD,
)
from newsflow.lexicons import (
    NEGATIVE_WORDS,
    NOISE_WORDS,
    POSITIVE_WORDS,
    STOP_WORDS,
    TOPIC_TERMS,
    TOPIC_THRESHOLDS,
)

ORIGIN = "TIMESTAMP '1970-01-01 00:00:00'"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


# --- text --------------------------------------------------------------------------


# What the XML reader takes off either end of a text: all up to the space.
_SPACES = " || ".join(f"chr({n})" for n in range(1, 33))


def _tags(c: str) -> str:
    return rf"regexp_replace({c}, '<[^>]*>', ' ', 'g')"


def _symbols(c: str) -> str:
    return rf"regexp_replace({c}, '[^\p{{L}}\p{{N}}\p{{P}}\p{{Z}}]', ' ', 'g')"


def _breaks(c: str) -> str:
    return rf"regexp_replace({c}, '[\r\n\t]+', ' ', 'g')"


def _collapse(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def _clean(c: str) -> str:
    return _collapse(_breaks(_symbols(_tags(f"lower({c})"))))


def _tokens(text: str, min_len: int, drop=()) -> str:
    keep = rf"length(x) >= {min_len} AND NOT regexp_matches(x, '^[0-9]+$')"
    if drop:
        keep += f" AND x NOT IN {_in(drop)}"
    split = rf"trim(regexp_replace({text}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return rf"list_filter(string_split_regex({split}, '\s+'), lambda x: {keep})"


def _word_count(text: str) -> str:
    split = rf"string_split_regex(trim({text}), '\s+')"
    return f"len(list_filter({split}, lambda x: length(x) > 0))::INTEGER"


def _hits(tokens: str, words) -> str:
    return f"len(list_filter({tokens}, lambda x: x IN {_in(words)}))::INTEGER"


ART = """art AS (
  SELECT doc_id, source, split_part(text, chr(10), 1) AS title,
    substr(text, length(split_part(text, chr(10), 1)) + 2) AS content,
    'http://' || source || '.example.com/' || doc_id AS link,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS published_ts
  FROM documents)"""

CLEAN = f"""{ART}, cl AS (
  SELECT doc_id, {_clean('source')} AS source, {_clean('title')} AS title,
    {_clean('content')} AS content, {_collapse('lower(link)')} AS link, published_ts
  FROM art)"""

TEXT = "title || ' ' || content"


def _top_keywords(source: str, key: str, tokens: str) -> str:
    """kw(key, kws LIST, keywords): the eight most frequent tokens."""
    return f"""tf AS (
  SELECT {key}, term, count(*) AS n
  FROM (SELECT {key}, unnest({tokens}) AS term FROM {source}) GROUP BY {key}, term),
rk AS (
  SELECT {key}, term, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, term) AS r
  FROM tf),
kw AS (
  SELECT {key}, list(term ORDER BY r) AS kws, string_agg(term, '|' ORDER BY r) AS keywords
  FROM rk WHERE r <= 8 GROUP BY {key})"""


def _topic_regex(topic: str) -> str:
    return "|".join(TOPIC_TERMS[topic])


def _topic_hit(topic: str) -> str:
    return f"regexp_matches(lower({TEXT}), '{_topic_regex(topic)}')"


def _whole_hit(topic: str) -> str:
    edge = r"[^\p{L}\p{N}_]"
    return f"regexp_matches(' ' || lower({TEXT}) || ' ', '{edge}(?:{_topic_regex(topic)}){edge}')"


def _first_topic(hit) -> str:
    cases = " ".join(f"WHEN {hit(t)} THEN '{t}'" for t in TOPIC_TERMS)
    return f"CASE {cases} ELSE 'other' END"


def _source_name(link: str, source: str) -> str:
    lead = rf"trim(regexp_extract({source}, '^[^-—|]+', 0))"
    return f"""CASE WHEN contains({link}, 'ft.com') THEN 'Financial Times'
    WHEN contains({link}, 'wired.com') THEN 'Wired'
    WHEN contains({link}, 'engadget.com') THEN 'Engadget'
    WHEN contains({link}, 'aljazeera.com') THEN 'Al Jazeera'
    WHEN contains({link}, 'bbc.co') THEN 'BBC'
    WHEN {source} = '' THEN 'Unknown'
    ELSE upper(substr({lead}, 1, 1)) || lower(substr({lead}, 2)) END"""


# The first row per title, by time, with everything the clean job writes.
ARTICLES = f"""{CLEAN}, dd AS (
  SELECT * FROM cl
  QUALIFY row_number() OVER (PARTITION BY title ORDER BY published_ts, link) = 1),
{_top_keywords('dd', 'doc_id', _tokens(TEXT, 3, STOP_WORDS))},
ca AS (
  SELECT dd.*, {_word_count(TEXT)} AS word_count, coalesce(kws, []) AS kws,
    coalesce(keywords, '') AS keywords, {_source_name('link', 'source')} AS source_normalized,
    {_first_topic(_topic_hit)} AS category
  FROM dd LEFT JOIN kw USING (doc_id))"""

# The same without removing repeated titles.
CATEGORISED = f"""{CLEAN},
{_top_keywords('cl', 'doc_id', _tokens(TEXT, 3, STOP_WORDS))},
ca AS (
  SELECT cl.*, coalesce(kws, []) AS kws, coalesce(keywords, '') AS keywords,
    {_first_topic(_topic_hit)} AS category
  FROM cl LEFT JOIN kw USING (doc_id))"""

# Keyword events of ca, the earliest per (title, category, keyword).
KEYWORD_EVENTS = f"""ke AS (
  SELECT title, category, keyword, min(published_ts) AS published_ts,
    arg_min(link, (published_ts, link)) AS link
  FROM (SELECT title, category, lower(trim(unnest(kws))) AS keyword, published_ts, link FROM ca)
  WHERE length(keyword) > 3 AND keyword NOT IN {_in(NOISE_WORDS)}
  GROUP BY title, category, keyword)"""

EVENTS = """ev AS (
  SELECT event_id, ts AS published_ts, event_type AS keyword,
    ((props->>'$.k')::INTEGER % 4)::VARCHAR AS category,
    'user ' || user_id AS title, 'http://events.example.com/' || (props->>'$.k') AS link
  FROM events)"""

LAST_WATERMARK = "(SELECT max(ts) FROM events) - INTERVAL '{delay} minutes'"


# --- windows -----------------------------------------------------------------------


def _windows(source: str, duration: int, slide: int) -> str:
    """w: the rows of ``source`` once per covering window; times in minutes."""
    return f"""w AS (
  SELECT *, window_start + INTERVAL '{duration} minutes' AS window_end
  FROM (
    SELECT *, time_bucket(INTERVAL '{slide} minutes', published_ts, {ORIGIN})
      - INTERVAL '{slide} minutes' * unnest(range({duration // slide})) AS window_start
    FROM {source}))"""


def _trends(
    source: str, duration: int, slide: int, where: str = "true", extra: str = ""
) -> str:
    return f"""{_windows(source, duration, slide)}, tr AS (
  SELECT window_start, window_end, category, keyword,
    count(*) FILTER (published_ts >= window_end - INTERVAL '{slide} minutes') AS current_count,
    count(*) FILTER (published_ts < window_end - INTERVAL '{slide} minutes') AS previous_count
  FROM w GROUP BY ALL HAVING current_count >= 3)
SELECT {extra}*, CASE WHEN trend_score >= 8 AND current_count >= 10 THEN 'BREAKING'
  WHEN trend_score >= 4 AND current_count >= 5 THEN 'HOT'
  WHEN trend_score >= 1.5 THEN 'WARM' ELSE 'NORMAL' END AS trend_level
FROM (SELECT *, current_count::DOUBLE / (previous_count + 1) AS trend_score FROM tr)
WHERE {where}"""


def _activity(source: str, where: str = "true") -> str:
    return f"""{_windows(source, 20, 5)}
SELECT window_start, window_end, category, count(*) AS category_count,
  CASE WHEN count(*) >= 5 THEN 'SPIKE' WHEN count(*) >= 3 THEN 'ACTIVE' ELSE 'NORMAL' END
    AS activity_level
FROM w WHERE {where} GROUP BY window_start, window_end, category"""


def _counts(source: str, duration: int, slide: int) -> str:
    return f"""{_windows(source, duration, slide)}, bc AS (
  SELECT window_start, window_end, category, keyword, count(*) AS exact_count,
    array_to_string(list_sort(list(DISTINCT title))[1:3], '|') AS sample_titles,
    array_to_string(list_sort(list(DISTINCT link))[1:3], '|') AS sample_links
  FROM w GROUP BY ALL)"""


def _bucket(key: str) -> str:
    digits = f"substr(md5((i // 4) || ':' || {key}), (i % 4 * 8 + 1)::INTEGER, 8)"
    return f"('0x' || {digits})::BIGINT % 1000"


def _running(reset: str = "0") -> str:
    """rn: estimates after each row's own add, from a sketch for each ``reset``."""
    return f"""rn AS (
  SELECT window_start, category, keyword, min(so_far)::BIGINT AS approx_count
  FROM (
    SELECT *, sum(exact_count) OVER (PARTITION BY {reset}, i, b
      ORDER BY window_start, category, keyword ROWS UNBOUNDED PRECEDING) AS so_far
    FROM (SELECT *, {_bucket('keyword')} AS b FROM bc, range(5) r(i)))
  GROUP BY window_start, category, keyword)"""


def _table(reset: str = "0") -> str:
    """es: estimates of every keyword from the sketch of all of bc in one ``reset``."""
    return f"""pl AS (
  SELECT {reset} AS z, keyword, exact_count, i, {_bucket('keyword')} AS b FROM bc, range(5) r(i)),
ce AS (SELECT z, i, b, sum(exact_count) AS cell FROM pl GROUP BY z, i, b),
es AS (
  SELECT z, keyword, min(cell)::BIGINT AS approx_count FROM pl JOIN ce USING (z, i, b)
  GROUP BY z, keyword)"""


RUNNING, TABLE = _running(), _table()

ALERT = """window_start, window_end, category, keyword, exact_count, approx_count,
  sample_titles, sample_links, 'BREAKING' AS status"""

BURSTS = _counts("ev", 24 * 60, 6 * 60)


def _sketch(terms: str) -> str:
    """(sketch_row, bucket, cell) of the relation ``terms(term, n)``."""
    return f"""SELECT i::INTEGER AS sketch_row, {_bucket('term')} AS bucket, sum(n)::BIGINT AS cell
FROM {terms}, range(5) r(i) GROUP BY i, bucket"""


TERMS = f"""{CLEAN}, tt AS (
  SELECT doc_id, term, count(*) AS n
  FROM (SELECT doc_id, unnest({_tokens(TEXT, 3, STOP_WORDS)}) AS term FROM cl)
  GROUP BY doc_id, term)"""


def _pages(link: str, content: str) -> str:
    return f"SELECT page_id, {link} AS link, {content} AS content FROM pages"


def _sentiment(tokens: str, positive, negative) -> str:
    """The four sentiment columns, from a relation with ``tokens``."""
    pos, neg = _hits(tokens, positive), _hits(tokens, negative)
    return f"""{pos} AS positive_count, {neg} AS negative_count,
  {pos} - {neg} AS sentiment_score,
  CASE WHEN {pos} > {neg} THEN 'Positive' WHEN {pos} < {neg} THEN 'Negative'
    ELSE 'Neutral' END AS sentiment"""


ANALYSIS_TOKENS = _tokens("lower(trim(title || ' ' || content))", 2)


def _zone_offset() -> str:
    seconds = {"UTC": 0, "PST": 8 * 3600, "CET": -3600, "GMT": 0}
    cases = " ".join(f"WHEN '{k}' THEN {seconds[z]}" for k, z in EVENT_ZONES.items())
    return f"CASE event_type {cases} END"


def _frequent_category() -> str:
    def score(topic: str) -> str:
        hit = f"regexp_matches(lower({TEXT}), '{'|'.join(FREQUENT_TERMS[topic])}')"
        word, points = FREQUENT_BONUS.get(topic, ("", 0))
        return f"(CASE WHEN {hit} THEN 3 ELSE 0 END + {points} * list_contains(kws, '{word}')::INT)"

    names = list(FREQUENT_TERMS)
    cases = " ".join(
        f"WHEN {t} >= {TOPIC_THRESHOLDS[t]} AND {t} >= greatest({', '.join([*names[n + 1:], '0'])})"
        f" THEN '{t}'"
        for n, t in enumerate(names)
    )
    return f"""WITH {CATEGORISED}
SELECT doc_id, CASE {cases} ELSE 'other' END AS category
FROM (SELECT doc_id, {', '.join(f'{score(t)} AS {t}' for t in names)} FROM ca)"""


FEED_ROWS = f"""{ART}, feed AS (
  SELECT source, 'No. ' || doc_id AS title, trim(title || chr(10) || content, {_SPACES}) AS content,
    link, published_ts FROM art
  UNION ALL
  SELECT source, 'Again ' || doc_id, trim(title || chr(10) || content, {_SPACES}), upper(link),
    published_ts + INTERVAL 1 SECOND FROM art)"""
FEED_TIME = "strftime(published_ts, '%a %b %d %H:%M:%S UTC %Y') AS published"

EVENT_LINKS = """el AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'http://events.example.com/hot'
      WHEN event_id % 2 = 0 THEN 'http://events.example.com/' || (props ->> '$.k')
      ELSE ' ' || upper('http://events.example.com/' || (props ->> '$.k')) END AS link,
    event_id, ts AS published_ts
  FROM events)"""


def _sessions(source: str, gap: int, delay: int, order: str) -> str:
    """first_of: the first row of each session of a link that the watermark has passed; gap and
    delay in minutes."""
    return f"""gaps AS (
  SELECT *, published_ts >= lag(published_ts) OVER (
      PARTITION BY lower(trim(link)) ORDER BY published_ts) + INTERVAL '{gap} minutes' AS fresh
  FROM {source} WHERE trim(link) <> ''),
numbered AS (
  SELECT *, count(*) FILTER (fresh) OVER (
      PARTITION BY lower(trim(link)) ORDER BY published_ts RANGE UNBOUNDED PRECEDING) AS session
  FROM gaps),
first_of AS (
  SELECT * FROM numbered QUALIFY row_number() OVER (
      PARTITION BY lower(trim(link)), session ORDER BY {order}) = 1
    AND max(published_ts) OVER (PARTITION BY lower(trim(link)), session) + INTERVAL '{gap} minutes'
      <= (SELECT max(published_ts) FROM {source}) - INTERVAL '{delay} minutes')"""


ORACLES = {
    "json_parse": """SELECT CASE WHEN role = 'user' THEN role END AS source,
  CASE WHEN role = 'user' THEN text END AS title,
  CASE WHEN role = 'user' THEN conv_id::VARCHAR END AS content,
  CASE WHEN role = 'user' THEN '{"turn":' || turn || '}' END AS link,
  NULL::VARCHAR AS published
FROM conversations""",
    "null_fill": """SELECT CASE WHEN role = 'user' THEN role ELSE '' END AS source,
  CASE WHEN role = 'user' THEN text ELSE '' END AS title,
  CASE WHEN role = 'user' THEN conv_id::VARCHAR ELSE '' END AS content,
  CASE WHEN role = 'user' THEN '{"turn":' || turn || '}' ELSE '' END AS link,
  '' AS published
FROM conversations""",
    "json_roundtrip": f"WITH {ART} SELECT source, title, content, link FROM art",
    "keyed_json": f"""WITH {ART} SELECT source AS key, to_json(struct_pack(
  doc_id := doc_id, source := source, link := link, title := title, content := content))::VARCHAR
  AS value
FROM art""",
    "escape_raw": f"""WITH {ART} SELECT doc_id,
  translate(source, '"' || chr(10) || chr(13), '''  ') AS source,
  translate(title, '"' || chr(10) || chr(13), '''  ') AS title,
  translate(content, '"' || chr(10) || chr(13), '''  ') AS content
FROM art""",
    "lower_fields": _pages("lower(url)", "lower(html)"),
    "strip_tags": _pages("url", _tags("html")),
    "strip_symbols": _pages("url", _symbols("html")),
    "strip_breaks": _pages("url", _breaks("html")),
    "collapse_space": _pages(_collapse("url"), _collapse("html")),
    "clean_pages": _pages(_collapse("lower(url)"), _clean("html")),
    "clean_text": f"WITH {CLEAN} SELECT * FROM cl",
    "parse_published": f"""SELECT event_id,
  epoch(date_trunc('second', ts))::BIGINT + {_zone_offset()} AS published_second
FROM events WHERE event_type IN {_in(EVENT_ZONES)}""",
    "event_time": """SELECT event_id, epoch_us(ts) // 1000 AS published_milli
FROM events WHERE event_type <> 'error'""",
    "dedup_link": """SELECT * FROM (
  SELECT page_id, spelling::INTEGER AS spelling,
    CASE spelling WHEN 0 THEN url WHEN 1 THEN upper(url) WHEN 2 THEN '  ' || url || ' '
      ELSE '  ' END AS link
  FROM pages, range(4) r(spelling))
WHERE trim(link) <> ''
QUALIFY row_number() OVER (PARTITION BY lower(trim(link)) ORDER BY page_id, spelling) = 1""",
    "dedup_title": """SELECT doc_id,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS published_ts, text AS title
FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    "word_count": f"WITH {CLEAN} SELECT doc_id, {_word_count(TEXT)} AS word_count FROM cl",
    "tokens": f"""WITH {CLEAN}
SELECT doc_id, array_to_string({_tokens(TEXT, 3)}, '|') AS tokens FROM cl""",
    "tokens_without_stop_words": f"""WITH {CLEAN}
SELECT doc_id, array_to_string({_tokens(TEXT, 3, STOP_WORDS)}, '|') AS tokens FROM cl""",
    "conversation_words": f"""WITH cv AS (SELECT conv_id * 100000 + turn AS id, * FROM conversations),
{_top_keywords('cv', 'id', _tokens('lower(text)', 3, STOP_WORDS))}
SELECT conv_id, turn, {_word_count('lower(text)')} AS word_count,
  len({_tokens('lower(text)', 3, STOP_WORDS)})::INTEGER AS n_tokens,
  coalesce(keywords, '') AS keywords
FROM cv LEFT JOIN kw USING (id)""",
    "term_freq": f"WITH {TERMS} SELECT doc_id, term, n::INTEGER AS n FROM tt",
    "term_freq_map": f"""WITH {TERMS}
SELECT doc_id, coalesce(string_agg(term || ':' || n, '|' ORDER BY term), '') AS term_freq
FROM cl LEFT JOIN tt USING (doc_id) GROUP BY doc_id""",
    "keywords": f"WITH {CATEGORISED} SELECT doc_id, keywords FROM ca",
    "source_norm": f"""WITH {CLEAN}
SELECT doc_id, source, {_source_name('link', 'source')} AS source_normalized FROM cl""",
    "source_rules": f"""WITH p AS (
  SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]*)', 1) AS source,
    lower(replace(replace(url, 'example.com', 'wired.com'), 'example.net', 'aljazeera.com'))
      AS link
  FROM pages)
SELECT *, {_source_name('link', 'source')} AS source_normalized FROM p""",
    "topic_flags": f"""WITH {CLEAN}
SELECT doc_id, {', '.join(f'{_topic_hit(t)} AS {t}_hit' for t in TOPIC_TERMS)} FROM cl""",
    "topic_scores": f"""WITH {CATEGORISED}
SELECT doc_id, {', '.join(
    f"(CASE WHEN {_topic_hit(t)} THEN 3 ELSE 0 END"
    + {"politics": " + list_contains(kws, 'war')::INTEGER",
       "tech": " + list_contains(kws, 'ai')::INTEGER"}.get(t, "")
    + f")::INTEGER AS {t}_score"
    for t in TOPIC_TERMS)}
FROM ca""",
    "category": f"WITH {CLEAN} SELECT doc_id, {_first_topic(_topic_hit)} AS category FROM cl",
    "category_whole_words": f"""WITH {CLEAN}
SELECT doc_id, {_first_topic(_whole_hit)} AS category FROM cl""",
    "category_frequent": _frequent_category(),
    "cleaned_articles": f"""WITH {ARTICLES}
SELECT source, title, content, link, published_ts AS published, word_count, keywords,
  source_normalized, category
FROM ca""",
    "sentiment": f"""WITH {ARTICLES}
SELECT published_ts AS published, source_normalized, category, title, link, keywords,
  {_sentiment(ANALYSIS_TOKENS, POSITIVE_WORDS, NEGATIVE_WORDS)}
FROM ca""",
    "sentiment_frequent": f"""WITH {CLEAN}
SELECT doc_id, {_sentiment(ANALYSIS_TOKENS, FREQUENT_POSITIVE, FREQUENT_NEGATIVE)} FROM cl""",
    "lexicon_counts": f"""SELECT conv_id, turn,
  {_hits(_tokens('lower(trim(text))', 2), POSITIVE_WORDS + FREQUENT_POSITIVE)} AS positive_count,
  {_hits(_tokens('lower(trim(text))', 2), NEGATIVE_WORDS + FREQUENT_NEGATIVE)} AS negative_count
FROM conversations""",
    "lexicon_table": f"""WITH h AS (SELECT conv_id, turn,
  {_hits(_tokens('lower(trim(text))', 2), POSITIVE_WORDS + FREQUENT_POSITIVE)}::BIGINT AS positive_count,
  {_hits(_tokens('lower(trim(text))', 2), NEGATIVE_WORDS + FREQUENT_NEGATIVE)}::BIGINT AS negative_count
FROM conversations)
SELECT *, positive_count - 2 * negative_count AS weight FROM h""",
    "keyword_events": f"""WITH {CATEGORISED}, {KEYWORD_EVENTS}
SELECT title, category, keyword, published_ts FROM ke""",
    "window_positions": f"""WITH {EVENTS}, {_windows('ev', 240, 120)}
SELECT window_start, window_end, event_id,
  CASE WHEN published_ts >= window_end - INTERVAL '120 minutes' THEN 'current'
    ELSE 'previous' END AS window_position
FROM w""",
    "counts_by_position": f"""WITH {EVENTS}, {_windows('ev', 240, 120)}
SELECT window_start, window_end, category, keyword,
  CASE WHEN published_ts >= window_end - INTERVAL '120 minutes' THEN 'current'
    ELSE 'previous' END AS window_position, count(*) AS n
FROM w GROUP BY ALL""",
    "trends": f"WITH {EVENTS}, {_trends('ev', 20, 10)}",
    "trends_wide": f"WITH {EVENTS}, {_trends('ev', 240, 120)}",
    "trend_two_stage": f"WITH {EVENTS}, {_trends('ev', 240, 120)}",
    "article_trends": f"WITH {ARTICLES}, {KEYWORD_EVENTS}, {_trends('ke', 20, 10)}",
    "article_trends_wide": f"WITH {ARTICLES}, {KEYWORD_EVENTS}, {_trends('ke', 240, 120)}",
    "term_trends": f"""WITH {CLEAN}, tk AS (
  SELECT published_ts, 'all' AS category,
    unnest(list_distinct({_tokens(TEXT, 3, STOP_WORDS)})) AS keyword FROM cl),
{_trends('tk', 240, 120)}""",
    "category_activity": f"""WITH ev AS (
  SELECT ts AS published_ts, event_type AS category FROM events WHERE event_type <> 'error'),
{_activity('ev')}""",
    "article_activity": f"""WITH {ARTICLES},
kn AS (SELECT published_ts, category FROM ca WHERE category <> 'other'),
{_activity('kn')}""",
    "burst_counts": f"""WITH {EVENTS}, {BURSTS}
SELECT window_start, window_end, category, keyword, exact_count FROM bc""",
    "sketch_cells": f"WITH {TERMS} {_sketch('tt')}",
    "sketch_estimate": f"""WITH {TERMS},
bc AS (SELECT term AS keyword, sum(n)::BIGINT AS exact_count FROM tt GROUP BY term), {TABLE}
SELECT keyword AS term, exact_count, approx_count FROM bc JOIN es USING (keyword)""",
    "sketch_merge": f"""WITH {CLEAN}, al AS (
  SELECT unnest({_tokens('title', 3)}) AS term, 1 AS n FROM cl
  UNION ALL SELECT unnest({_tokens('content', 3)}) AS term, 1 AS n FROM cl)
{_sketch('al')}""",
    "running_estimates": f"""WITH {EVENTS}, {BURSTS}, {RUNNING}
SELECT window_start, category, keyword, exact_count, approx_count
FROM bc JOIN rn USING (window_start, category, keyword)""",
    "breaking_running": f"""WITH {EVENTS}, {BURSTS}, {_running('window_start')}
SELECT {ALERT} FROM bc JOIN rn USING (window_start, category, keyword)
WHERE approx_count >= {RUNNING_THRESHOLD}""",
    "breaking_table": f"""WITH {EVENTS}, {BURSTS}, {_table("date_trunc('day', window_start)")},
ex AS (SELECT bc.*, date_trunc('day', window_start) AS z FROM bc)
SELECT {ALERT} FROM ex JOIN es USING (keyword, z) WHERE approx_count >= {TABLE_THRESHOLD}""",
    "breaking_exact": f"""WITH {EVENTS}, {BURSTS},
ex AS (SELECT *, exact_count AS approx_count FROM bc)
SELECT {ALERT} FROM ex WHERE approx_count >= {BURST_THRESHOLD}""",
    "article_breaking": f"""WITH {ARTICLES}, {KEYWORD_EVENTS}, {_counts('ke', 5, 1)},
{_running('window_start')}
SELECT {ALERT} FROM bc JOIN rn USING (window_start, category, keyword)
WHERE approx_count >= 2""",
    "feed_items": f"WITH {FEED_ROWS} SELECT source, title, content, link, {FEED_TIME} FROM feed",
    "feed_to_raw": f"""WITH {FEED_ROWS}, f AS (
  SELECT translate(source, '"' || chr(10) || chr(13), '''  ') AS source,
    translate(title, '"' || chr(10) || chr(13), '''  ') AS title,
    translate(content, '"' || chr(10) || chr(13), '''  ') AS content, link, {FEED_TIME} FROM feed),
one AS (
  SELECT * FROM f QUALIFY row_number() OVER (
    PARTITION BY lower(trim(link)) ORDER BY published, title, content, source) = 1)
SELECT to_json(struct_pack(source := source, title := title, content := content, link := link,
  published := published))::VARCHAR AS value
FROM one""",
    "stream_feeds": f"""WITH {FEED_ROWS}, f AS (
  SELECT translate(source, '"' || chr(10) || chr(13), '''  ') AS source,
    translate(title, '"' || chr(10) || chr(13), '''  ') AS title,
    translate(content, '"' || chr(10) || chr(13), '''  ') AS content, link, published_ts, {FEED_TIME}
  FROM feed),
{_sessions('f', 60, 10, 'published, title, content, source')}
SELECT to_json(struct_pack(source := source, title := title, content := content, link := link,
  published := published))::VARCHAR AS value
FROM first_of""",
    "stream_links": f"WITH {EVENT_LINKS} SELECT DISTINCT lower(trim(link)) AS link_key FROM el",
    "stream_earliest": f"""WITH {EVENT_LINKS}, {_sessions('el', 10, 5, 'published_ts, event_id')}
SELECT link, event_id, published_ts FROM first_of""",
    "topic_latest": f"WITH {ART} SELECT doc_id, source, title, link FROM art WHERE doc_id % 2 = 1",
    "stream_cleaning": f"""WITH cl AS (
  SELECT DISTINCT {_clean('text')} AS title, '' AS content FROM documents),
{_top_keywords('cl', 'title', _tokens(TEXT, 3, STOP_WORDS))}
SELECT title, {_word_count(TEXT)} AS word_count, coalesce(keywords, '') AS keywords,
  {_first_topic(_topic_hit)} AS category
FROM cl LEFT JOIN kw USING (title)""",
    "stream_trends": f"""WITH {EVENTS},
{_trends('ev', 240, 120, 'window_end <= ' + LAST_WATERMARK.format(delay=5))}""",
    "stream_trend_messages": f"""WITH {EVENTS},
{_trends('ev', 240, 120, 'window_end <= ' + LAST_WATERMARK.format(delay=5), 'category AS key, ')}""",
    "topic_roundtrip": f"WITH {ART} SELECT doc_id, source, title, content, link FROM art",
    "stream_activity": f"""WITH {EVENTS},
{_activity('ev', 'window_end <= ' + LAST_WATERMARK.format(delay=10))}""",
    "stream_late": f"""WITH {EVENTS}, mark AS (
  SELECT max(ts) FILTER (event_id % 3 = 0) - INTERVAL '10 minutes' AS first_mark,
    max(ts) FILTER (event_id % 3 < 2) - INTERVAL '10 minutes' AS second_mark FROM events),
{_windows('ev', 20, 5)}
SELECT window_start, window_end, category, count(*) AS category_count,
  CASE WHEN count(*) >= 5 THEN 'SPIKE' WHEN count(*) >= 3 THEN 'ACTIVE' ELSE 'NORMAL' END
    AS activity_level
FROM w, mark WHERE window_end <= {LAST_WATERMARK.format(delay=10)}
  AND (event_id % 3 <> 1 OR window_end > first_mark)
  AND (event_id % 3 <> 2 OR window_end > second_mark)
GROUP BY window_start, window_end, category""",
    "stream_breaking": f"""WITH ev AS (
  SELECT ts AS published_ts, event_type AS keyword,
    ((props->>'$.k')::INTEGER % 4)::VARCHAR AS category,
    'event ' || event_id AS title, 'http://events.example.com/' || (props->>'$.k') AS link
  FROM events), {BURSTS}, ex AS (SELECT *, exact_count AS approx_count FROM bc)
SELECT {ALERT} FROM ex
WHERE approx_count >= 15 AND window_end <= {LAST_WATERMARK.format(delay=5)}""",
    "stream_breaking_running": f"""WITH ev AS (
  SELECT ts AS published_ts, event_type AS keyword,
    ((props->>'$.k')::INTEGER % 4)::VARCHAR AS category,
    'event ' || event_id AS title, 'http://events.example.com/' || (props->>'$.k') AS link
  FROM events), {BURSTS}, {_running('window_start')}
SELECT {ALERT} FROM bc JOIN rn USING (window_start, category, keyword)
WHERE approx_count >= {RUNNING_THRESHOLD}
  AND window_end <= {LAST_WATERMARK.format(delay=5)}""",
    "stream_sentiment": f"""WITH ev AS (
  SELECT date_trunc('millisecond', ts) AS published, 'Unknown' AS source_normalized,
    ((props->>'$.k')::INTEGER % 4)::VARCHAR AS category, 'event ' || event_id AS title,
    event_type AS content, 'http://events.example.com/' || (props->>'$.k') AS link,
    event_type || '|news' AS keywords
  FROM events)
SELECT published, source_normalized, category, title, link, keywords,
  {_sentiment(ANALYSIS_TOKENS, POSITIVE_WORDS, NEGATIVE_WORDS)}
FROM ev""",
}
