"""Exact duplicate removal.

Batch input keeps the first row of each key in a stated order, so results are
repeatable. ``row_number() = 1`` is planned with a group limit below the shuffle: a map
task sends one row per key however many copies it holds, so a key with a third of all
rows costs no more than any other. Streams keep the first arrival, in a state store, or, with
``within``, the first row in the stated order: copies that follow each other within that time
are one session, whose first row leaves when the watermark has passed the session's end. Its
state ends there, too.
"""

from pyspark.sql import DataFrame, Window, functions as F


def _keep_first(df: DataFrame, keys, order_by) -> DataFrame:
    first = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def keep_earliest(df: DataFrame, keys, ts: str, within: str, delay: str, order_by) -> DataFrame:
    """The first row, by ``order_by``, of every session of a key on a stream: rows of which each
    is less than ``within`` after the one before. Copies are folded in each task before they
    are sent; the state holds one row per open session."""
    session = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    df.sparkSession.conf.set(session, "true")
    others = [c for c in df.columns if c not in (*keys, *order_by)]
    row = F.struct(*order_by, *others)
    sessions = df.withWatermark(ts, delay).groupBy(F.session_window(ts, within), *keys)
    first = sessions.agg(F.min(row).alias("_first"))
    return first.select(*keys, "_first.*").select(*df.columns)


def _split(df: DataFrame, state, keys, place, split: int) -> DataFrame:
    """``state(df, keys)``, with ``split`` above 1 by way of that many places per key, so that the
    copies of one key do not all meet in one task."""
    if split > 1:
        placed = df.withColumn("_place", F.pmod(F.xxhash64(*place), F.lit(split)))
        df = state(placed, [*keys, "_place"]).drop("_place")
    return state(df, keys)


def dedup_links(
    df: DataFrame,
    link: str = "link",
    order_by=("published_ts", "link"),
    ts: str = "published_ts",
    delay: str | None = None,
    bounded_state: bool = False,
    split: int = 1,
    within: str | None = None,
) -> DataFrame:
    """One row per ``lower(trim(link))``; rows without a link are dropped.

    Streams remember every link ever seen, or, with ``bounded_state``, links that the watermark
    (``delay`` behind ``ts``; None where there is one already) has not passed. With ``split``
    above 1 the copies of a link are first reduced in that many places by their other columns.
    ``within`` keeps the first row by ``order_by`` instead of the first that arrives, of copies
    that follow each other in that time.
    """
    keyed = df.withColumn("_key", F.lower(F.trim(link))).filter("_key <> ''")
    if not df.isStreaming:
        return _keep_first(keyed, ["_key"], order_by).drop("_key")
    if within is not None:
        return keep_earliest(keyed, ["_key"], ts, within, delay or "0 seconds", order_by).drop("_key")
    if bounded_state and delay is not None:
        keyed = keyed.withWatermark(ts, delay)
    return _split(keyed, _state(bounded_state), ["_key"], df.columns, split).drop("_key")


def dedup_titles(
    df: DataFrame,
    ts: str = "published_ts",
    delay: str = "1 minute",
    order_by=None,
    bounded_state: bool | None = None,
    split: int = 1,
    within: str | None = None,
) -> DataFrame:
    """One row per title; empty titles count as one title.

    Streams set a watermark first and so lose rows older than ``delay``. Their caller says
    what the state may hold: every title ever seen, or, with ``bounded_state``, only titles
    the watermark has not passed. With ``split`` above 1 the copies of a title are first
    reduced in that many places by their link, so that a title (or the blank one) with very
    many copies does not meet in one task; each title is then kept twice. ``within`` keeps the
    earliest copy instead of the first that arrives, as batch input does, of copies that follow
    each other in that time; its state is bounded.

    Batch input orders copies by ``order_by`` (time and link) and then by a hash of all other
    columns, which stay out of the shuffle unless the caller uses them.
    """
    first = list(order_by or (ts, "link"))
    if df.isStreaming and within is not None:
        return keep_earliest(df, ["title"], ts, within, delay, first)
    if df.isStreaming:
        state = _state(bounded_state)
        return _split(df.withWatermark(ts, delay), state, ["title"], ["link", ts], split)
    others = [c for c in df.columns if c not in (*first, "title")]
    if not others:
        return _keep_first(df, ["title"], first)
    tied = df.withColumn("_tie", F.xxhash64(*others))
    return _keep_first(tied, ["title"], [*first, "_tie"]).drop("_tie")


def _state(bounded: bool | None):
    """How a stream drops repeats; the choice has no default, as one of the two never
    forgets and the other keeps a repeat that comes late."""
    if bounded is None:
        raise ValueError("streams need bounded_state=True or bounded_state=False")
    if bounded:
        return lambda df, keys: df.dropDuplicatesWithinWatermark(keys)
    return lambda df, keys: df.dropDuplicates(keys)


def dedup_events(df: DataFrame, bounded_state: bool | None = None, split: int = 1) -> DataFrame:
    """One keyword event per (title, category, keyword), the earliest; on streams the first that
    arrives, with ``split`` as for titles.

    Batch input is aggregated rather than ranked: the partial aggregate shrinks repeats
    before the shuffle and needs no sort when only the time is kept.
    """
    keys = ["title", "category", "keyword"]
    if df.isStreaming:
        return _split(df, _state(bounded_state), keys, df.columns, split)
    kept = [c for c in df.columns if c not in keys]
    if kept == ["published_ts"]:
        return df.groupBy(*keys).agg(F.min("published_ts").alias("published_ts"))
    kept.sort(key=lambda c: c != "published_ts")
    first = df.groupBy(*keys).agg(F.min(F.struct(*kept)).alias("_first"))
    return first.select(*keys, "_first.*")
