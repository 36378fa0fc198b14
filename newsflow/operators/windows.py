"""Counts over sliding windows.

A count is taken once per slide-wide slot and the slots are then summed into the windows
that cover them: events are aggregated before they are multiplied, so the large shuffle
carries each (slot, key) once instead of once per window. Streams do the same in two
stateful aggregations, the second over the event time of the slots that the first has
closed: of open slots they keep one row per key, not one for every covering window.

A stream counts every row within its watermark. A row behind it is lost with its slot;
``late_rows=True`` counts it in those of its windows that are still open, at the price of one
aggregation that keeps a row for every window.
"""

from pyspark.sql import DataFrame, functions as F

from newsflow.functions.times import seconds, shift


def _window(ts, duration: int, slide: int):
    return F.window(ts, f"{duration} seconds", f"{slide} seconds")


def slot_counts(df: DataFrame, keys, slide: str, ts: str = "published_ts") -> DataFrame:
    """(slot, keys, n): rows per slide-wide slot."""
    s = seconds(slide)
    return (
        df.select(_window(ts, s, s)["start"].alias("slot"), *keys)
        .groupBy("slot", *keys)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def covering_starts(slot, duration: int, slide: int):
    """Starts of the windows that cover a slot, the latest first."""
    return F.array(*[shift(slot, -back) for back in range(0, duration, slide)])


def sliding_counts(
    df: DataFrame,
    keys,
    duration: str,
    slide: str,
    ts: str = "published_ts",
    name: str = "n",
    late_rows: bool = False,
) -> DataFrame:
    """(window_start, window_end, keys, ``name``): rows per sliding window."""
    d, s = seconds(duration), seconds(slide)
    if df.isStreaming and not late_rows and d % s == 0 and d > s:
        slots = closed_slots(df, keys, d, s, ts)
        counts = slots.groupBy("window", *keys).agg(F.sum("n").alias(name))
        return flatten_window(counts, keys, name)
    if df.isStreaming or d % s:
        counts = df.groupBy(_window(ts, d, s), *keys).agg(F.count(F.lit(1)).alias(name))
        return flatten_window(counts, keys, name)
    return windows_of_slots(slot_counts(df, keys, slide, ts), keys, d, s, name)


def closed_slots(df: DataFrame, keys, duration: int, slide: int, ts: str) -> DataFrame:
    """(window, slot, keys, n): rows per slide-wide slot of a stream, once for each window that
    covers it, as soon as the watermark has passed the slot."""
    counts = df.groupBy(_window(ts, slide, slide).alias("slots"), *keys)
    counts = counts.agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        _window(F.window_time("slots"), duration, slide).alias("window"),
        F.col("slots.start").alias("slot"),
        *keys,
        "n",
    )


def windows_of_slots(slots: DataFrame, keys, duration: int, slide: int, name: str) -> DataFrame:
    """(window_start, window_end, keys, ``name``) of (slot, keys, n)."""
    starts = slots.select(
        F.explode(covering_starts(F.col("slot"), duration, slide)).alias("window_start"),
        *keys,
        "n",
    )
    counts = starts.groupBy("window_start", *keys).agg(F.sum("n").alias(name))
    end = shift(F.col("window_start"), duration).alias("window_end")
    return counts.select("window_start", end, *keys, name)


def flatten_window(df: DataFrame, *columns) -> DataFrame:
    """``window_start`` and ``window_end`` in place of the nested window."""
    names = [c for group in columns for c in ([group] if isinstance(group, str) else group)]
    return df.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *names,
    )


def window_positions(
    df: DataFrame, duration: str, slide: str, recent: str, ts: str = "published_ts"
) -> DataFrame:
    """Each event once per covering ``window``, with ``window_position``: ``current`` in
    the last ``recent`` part of the window, else ``previous``."""
    windowed = df.withColumn("window", _window(ts, seconds(duration), seconds(slide)))
    boundary = shift(F.col("window.end"), -seconds(recent))
    return windowed.withColumn(
        "window_position", F.when(F.col(ts) >= boundary, "current").otherwise("previous")
    )


def position_counts(
    df: DataFrame,
    keys,
    duration: str,
    slide: str,
    recent: str,
    ts: str = "published_ts",
    late_rows: bool = False,
    by_slot: bool = True,
) -> DataFrame:
    """(window_start, window_end, keys, current_count, previous_count).

    Without ``by_slot`` batch events are counted in their windows at once. Keys that hardly
    repeat in a slot are not made fewer by counting slots first, which then only keeps each
    task's keys in memory twice and shuffles them once more.
    """
    d, s, r = seconds(duration), seconds(slide), seconds(recent)
    if df.isStreaming and not late_rows and not (d % s or r % s) and d > s:
        is_current = F.col("slot") >= shift(F.col("window.end"), -r)
        counts = closed_slots(df, keys, d, s, ts).groupBy("window", *keys).agg(
            F.sum(F.when(is_current, F.col("n")).otherwise(0)).alias("current_count"),
            F.sum(F.when(is_current, 0).otherwise(F.col("n"))).alias("previous_count"),
        )
        return flatten_window(counts, keys, "current_count", "previous_count")
    if df.isStreaming or d % s or r % s or not by_slot:
        placed = window_positions(df, duration, slide, recent, ts)
        position = F.col("window_position")
        counts = placed.groupBy("window", *keys).agg(
            F.count_if(position == "current").alias("current_count"),
            F.count_if(position == "previous").alias("previous_count"),
        )
        return flatten_window(counts, keys, "current_count", "previous_count")
    slots = slot_counts(df, keys, slide, ts)
    # The latest window comes first, so the position is the slot's place within the window.
    placed = slots.select(
        F.posexplode(covering_starts(F.col("slot"), d, s)).alias(
            "_place", "window_start"
        ),
        *keys,
        "n",
    )
    is_current = F.col("_place") >= F.lit((d - r) // s)
    counts = placed.groupBy("window_start", *keys).agg(
        F.sum(F.when(is_current, F.col("n")).otherwise(0)).alias("current_count"),
        F.sum(F.when(is_current, 0).otherwise(F.col("n"))).alias("previous_count"),
    )
    return counts.select(
        "window_start",
        shift(F.col("window_start"), d).alias("window_end"),
        *keys,
        "current_count",
        "previous_count",
    )
