"""Breaking-news alerts over cleaned articles."""

from pyspark.sql import DataFrame, functions as F

from newsflow.functions.sketch import DEPTH, WIDTH
from newsflow.functions.times import seconds, shift
from newsflow.lexicons import NOISE_WORDS
from newsflow.operators.breaking import (
    ALERT_KEYS,
    build_sketch,
    collect_evidence,
    estimate,
    fold_evidence,
    join_on_keys,
    reset_key,
    running_estimates,
    smallest_values,
    tally,
    totals,
    window_evidence,
)
from newsflow.operators.trends import KEYWORD_KEYS
from newsflow.operators.windows import flatten_window, sliding_counts, windows_of_slots
from newsflow.plans.trends import keyword_events, with_delay
from newsflow.schemas import ALERT_COLUMNS

# Fixed value: estimated events that make a burst.
THRESHOLD = 15

MODES = ("running", "table", "exact")


def burst_counts(
    events: DataFrame,
    duration: str = "5 minutes",
    slide: str = "1 minute",
    delay: str | None = "5 minutes",
    late_rows: bool = False,
) -> DataFrame:
    """(window_start, window_end, category, keyword, exact_count)."""
    events = with_delay(events, delay)
    return sliding_counts(
        events, KEYWORD_KEYS, duration, slide, name="exact_count", late_rows=late_rows
    )


def estimated_counts(
    counts: DataFrame,
    mode: str = "running",
    depth: int = DEPTH,
    width: int = WIDTH,
    reset: str | None = None,
) -> DataFrame:
    """Adds ``approx_count`` to (window_start, category, keyword, exact_count).

    ``running``  estimate after each row's own add, in row order; accumulates over the
                 windows and categories of a keyword
    ``table``    estimate from the sketch of all rows
    ``exact``    the exact count itself

    With ``reset`` there is a sketch for every window (``window``) or unit of time (``day``).
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if mode == "exact":
        return counts.withColumn("approx_count", F.col("exact_count"))
    if mode == "running":
        return running_estimates(counts, "exact_count", depth, width, reset=reset)
    if reset is None:
        sketch = build_sketch(counts, "keyword", "exact_count", depth, width)
        return estimate(counts, sketch, "keyword", depth, width)
    keyed, by = counts.withColumn("_reset", reset_key(reset)), ["_reset"]
    sketch = build_sketch(keyed, "keyword", "exact_count", depth, width, by)
    return estimate(keyed, sketch, "keyword", depth, width, by).drop("_reset")


def label_alerts(alerts: DataFrame, duration: str) -> DataFrame:
    """Alert columns; an alert whose titles or links are all null has empty samples."""
    empty = F.array().cast("array<string>")
    added = {c: F.coalesce(c, empty) for c in ("sample_titles", "sample_links")}
    added["window_end"] = shift(F.col("window_start"), seconds(duration))
    added["status"] = F.lit("BREAKING")
    return alerts.withColumns(added).select(*ALERT_COLUMNS)


def alerts_of_events(
    events: DataFrame,
    mode: str = "running",
    threshold: int = THRESHOLD,
    duration: str = "5 minutes",
    slide: str = "1 minute",
    depth: int = DEPTH,
    width: int = WIDTH,
    reset: str | None = None,
) -> DataFrame:
    """Alert rows of batch (title, category, keyword, published_ts, link) events.

    Events are read and shuffled once, folded per slot, title and link; counts and evidence
    are both made of that. The window must be a whole number of slides.
    """
    d, s = seconds(duration), seconds(slide)
    if d % s:
        raise ValueError("the window must be a whole number of slides")
    slot_keys = ["slot", *KEYWORD_KEYS]
    slot = F.window("published_ts", f"{s} seconds")["start"].alias("slot")
    slotted = tally(events.select(slot, *KEYWORD_KEYS, "title", "link"), slot_keys)
    windowed = windows_of_slots(totals(slotted, slot_keys), KEYWORD_KEYS, d, s, "exact_count")
    counts = windowed.select(*ALERT_KEYS, "exact_count")
    alerts = estimated_counts(counts, mode, depth, width, reset).filter(
        F.col("approx_count") >= threshold
    )
    # every alert; asking for its count keeps what is below the same as for the estimates
    wanted = alerts.filter(F.col("exact_count") > 0)
    evidence = window_evidence(smallest_values(slotted, slot_keys), wanted, duration, slide)
    return label_alerts(join_on_keys(alerts, evidence, ALERT_KEYS, "left"), duration)


def breaking_alerts(
    articles: DataFrame, noise_words=NOISE_WORDS, unique_titles: bool = False, **options
) -> DataFrame:
    """Breaking keywords of cleaned articles."""
    events = keyword_events(articles, ["link"], noise_words, unique_titles=unique_titles)
    return alerts_of_events(events, **options)


def windowed_titles(
    events: DataFrame,
    duration: str = "5 minutes",
    slide: str = "1 minute",
    delay: str | None = "5 minutes",
) -> DataFrame:
    """(window_start, window_end, category, keyword, title, link, n) of streaming events.

    Each micro-batch is folded before its rows are multiplied by their windows: state holds, of
    a window's keyword, the few titles and links of each micro-batch that may become evidence.
    The rows of a window leave together and :func:`alerts_of_windows` does the rest.

    Events that have a watermark already (``delay`` is None) would lose it: they are not folded,
    and state, which is bounded then, is kept per title.
    """
    columns = [*KEYWORD_KEYS, "title", "link"]
    window = F.window("published_ts", f"{seconds(duration)} seconds", f"{seconds(slide)} seconds")
    if delay is None:
        counted = events.withColumn("n", F.lit(1).cast("bigint"))
    else:
        counted = with_delay(fold_evidence(events, duration, slide), delay)
    counts = counted.groupBy(window, *columns).agg(F.sum("n").alias("n"))
    return flatten_window(counts, columns, "n")


def alerts_of_windows(
    titles: DataFrame,
    mode: str = "running",
    threshold: int = THRESHOLD,
    duration: str = "5 minutes",
    depth: int = DEPTH,
    width: int = WIDTH,
    reset: str | None = None,
) -> DataFrame:
    """Alert rows of one micro-batch of :func:`windowed_titles`; the sketch starts empty
    with each micro-batch, and with ``reset`` more often."""
    tallied = tally(titles, ALERT_KEYS, "n")
    counts = totals(tallied, ALERT_KEYS, "exact_count")
    alerts = estimated_counts(counts, mode, depth, width, reset).filter(
        F.col("approx_count") >= threshold
    )
    evidence = collect_evidence(smallest_values(tallied, ALERT_KEYS), ALERT_KEYS)
    return label_alerts(join_on_keys(alerts, evidence, ALERT_KEYS, "left"), duration)
