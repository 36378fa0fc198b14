"""Burst counts, the count-min sketch as a relation, and alert evidence."""

import math

from pyspark.sql import DataFrame, Window, functions as F

from newsflow.functions.sketch import DEPTH, WIDTH, add_buckets, place_keys
from newsflow.functions.times import seconds, shift

# A sketch has at most depth * width cells; above this many it is not broadcast.
MAX_BROADCAST_CELLS = 1_000_000

ALERT_KEYS = ("window_start", "category", "keyword")


def join_on_keys(left: DataFrame, right: DataFrame, keys, how: str) -> DataFrame:
    """Join on keys that may be null; keeps the left copy of the keys."""
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = left.alias("l").join(right.alias("r"), same, how)
    return joined.select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys])


def reset_key(reset: str | None):
    """What a sketch starts anew for: every ``window``, or every unit of time (``hour``,
    ``day``, ...) that windows start in. None: it never does."""
    if reset is None:
        return F.lit(0)
    return F.col("window_start") if reset == "window" else F.date_trunc(reset, "window_start")


def build_sketch(
    df: DataFrame,
    key: str = "keyword",
    n: str = "n",
    depth: int = DEPTH,
    width: int = WIDTH,
    by=(),
) -> DataFrame:
    """(by, sketch_row, bucket, cell). The partial aggregate leaves at most depth * width
    rows per task and ``by`` before the shuffle."""
    placed = place_keys(df, key, [*by, n], depth, width)
    return placed.groupBy(*by, "sketch_row", "bucket").agg(F.sum(n).alias("cell"))


def merge_sketches(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Sketch of the union of the inputs, given sketches of equal depth and width."""
    merged = first
    for other in others:
        merged = merged.unionByName(other)
    return merged.groupBy("sketch_row", "bucket").agg(F.sum("cell").alias("cell"))


def estimate(
    df: DataFrame,
    sketch: DataFrame,
    key: str = "keyword",
    depth: int = DEPTH,
    width: int = WIDTH,
    by=(),
) -> DataFrame:
    """``df`` with ``approx_count``: the smallest of the cells its key meets, 0 for a key
    that meets an empty one.

    Each sketch row is a lookup of its own in the row, so nothing is multiplied or folded.
    Cells are looked up by one number for sketch row and bucket: all lookups read the same
    relation, so the sketch is built once and its broadcast or shuffle is shared. One sketch
    is broadcast, up to a size that depends on its parameters alone; sketches by ``by`` grow
    with the data, and how they are joined is left to the optimizer.
    """
    buckets, cells = [f"_b{r}" for r in range(depth)], [f"_c{r}" for r in range(depth)]
    out = add_buckets(df, key, buckets, width)
    place = F.col("sketch_row") * F.lit(width).cast("bigint") + F.col("bucket")
    for row, (bucket, cell) in enumerate(zip(buckets, cells)):
        part = sketch.select(*by, place.alias(bucket), F.col("cell").alias(cell))
        if not by and depth * width <= MAX_BROADCAST_CELLS:
            part = F.broadcast(part)
        out = out.withColumn(bucket, F.col(bucket) + row * width).join(part, [*by, bucket], "left")
    found = [F.coalesce(c, F.lit(0).cast("bigint")) for c in cells]
    least = F.least(*found) if depth > 1 else found[0]
    return out.select(*df.columns, least.alias("approx_count"))


def running_estimates(
    counts: DataFrame,
    n: str = "exact_count",
    depth: int = DEPTH,
    width: int = WIDTH,
    chunk: str = "hour",
    reset: str | None = None,
) -> DataFrame:
    """Adds ``approx_count``: the sketch estimate of the row's keyword after all rows up
    to and including it have been added, in (window_start, category, keyword) order. The
    sketch is empty again at each new :func:`reset_key`; without one, a long history fills
    it and estimates say little.

    The estimate is the least of the running sums in the row's cells. One cell may see a large
    share of the rows, so each cell is cut into ``chunk``-long pieces of time, which start from
    the sum of the pieces before. These sums travel along as rows of their own, ahead of the
    piece. Rows pass one window for each sketch row: they are never multiplied, and joined
    with nothing. A reset that is no coarser than ``chunk`` needs no pieces.
    """
    buckets = [f"_b{r}" for r in range(depth)]
    running = [f"_r{r}" for r in range(depth)]
    cut = reset is None or not _within(reset, chunk)
    piece = F.date_trunc(chunk, "window_start") if cut else F.lit(None).cast("timestamp_ntz")
    columns = {"_reset": reset_key(reset), "_chunk": piece, "_own": F.lit(None).cast("int")}
    rows = add_buckets(counts.select(*ALERT_KEYS, n).withColumns(columns), "keyword", buckets, width)
    if cut:
        before = _sums_before(rows, n, buckets)
        rows = rows.unionByName(before, allowMissingColumns=True)
    for row, (bucket, so_far) in enumerate(zip(buckets, running)):
        in_order = (
            Window.partitionBy("_reset", bucket, "_chunk")
            # the sum of the pieces before comes first
            .orderBy(F.col("_own").asc_nulls_last(), *ALERT_KEYS)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        counted = F.when(F.coalesce(F.col("_own"), F.lit(row)) == row, F.col(n)).otherwise(0)
        rows = rows.withColumn(so_far, F.sum(counted).over(in_order))
    least = F.least(*running) if depth > 1 else F.col(running[0])
    return rows.filter("_own IS NULL").select(*ALERT_KEYS, n, least.alias("approx_count"))


_UNITS = ("microsecond", "millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year")


def _within(reset: str, chunk: str) -> bool:
    """Whether the resets of a cell cut it at least as finely as ``chunk`` does."""
    if reset == "window":
        return True
    units = [u.lower() for u in (reset, chunk)]
    return all(u in _UNITS for u in units) and _UNITS.index(units[0]) <= _UNITS.index(units[1])


def _sums_before(rows: DataFrame, n: str, buckets) -> DataFrame:
    """For each piece of a cell (``_own`` is its sketch row) what all pieces before it hold, as
    a row with only that cell's bucket. Aggregated before anything is shuffled."""
    cells = F.inline(
        F.array(*[F.struct(F.lit(r).alias("_own"), F.col(b).alias("_b")) for r, b in enumerate(buckets)])
    )
    cell = ["_reset", "_own", "_b"]
    pieces = rows.select("_reset", "_chunk", n, cells).groupBy(*cell, "_chunk")
    pieces = pieces.agg(F.sum(n).alias("_total"))
    earlier = Window.partitionBy(*cell).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.select(*cell, "_chunk", F.sum("_total").over(earlier).alias(n))
    before = before.filter(F.col(n).isNotNull())
    # spread where it is not counted
    place = F.xxhash64("_b", "_chunk")
    columns = [F.when(F.col("_own") == r, F.col("_b")).otherwise(place).alias(b) for r, b in enumerate(buckets)]
    return before.select("_reset", "_chunk", "_own", n, *columns)


def tally(rows: DataFrame, keys, n: str | None = None) -> DataFrame:
    """(keys, kind, val, n): how often each title and each link (``kind``) occurs per key.

    One pass for counts and evidence: a key's rows are spread by their titles and links, and
    copies are folded before the shuffle, so a hot key stays in no one place.
    """
    values = F.stack(F.lit(2), F.lit("title"), F.col("title"), F.lit("link"), F.col("link"))
    counted = rows.select(
        *keys, values.alias("kind", "val"), (F.col(n) if n else F.lit(1)).alias("n")
    )
    return counted.groupBy(*keys, "kind", "val").agg(F.sum("n").alias("n"))


def totals(tallied: DataFrame, keys, name: str = "n") -> DataFrame:
    """(keys, ``name``): rows per key; each has one title, which may be null."""
    # not a filter, which would be moved below the tally and keep its shuffle from being shared
    of_title = F.when(F.col("kind") == "title", F.col("n")).otherwise(F.lit(0))
    return tallied.groupBy(*keys).agg(F.sum(of_title).alias(name))


def smallest_values(tallied: DataFrame, keys, k: int = 3) -> DataFrame:
    """(keys, kind, val): the ``k`` smallest distinct titles and links per key. Each map
    task sends at most ``k`` values per key into the shuffle; a null value ranks last."""
    by_value = Window.partitionBy(*keys, "kind").orderBy(F.col("val").asc_nulls_last())
    # all tallied rows; asking for their count keeps the tally the same as for the totals
    counted = tallied.filter(F.col("n") > 0).select(*keys, "kind", "val")
    ranked = counted.withColumn("_n", F.row_number().over(by_value))
    return ranked.filter(F.col("_n") <= k).drop("_n")


def collect_evidence(values: DataFrame, keys, k: int = 3) -> DataFrame:
    """(keys, sample_titles, sample_links) of :func:`smallest_values`: at most ``k`` of
    each kind per key, so the collected sets are bounded."""

    def sample(kind: str):
        values_of = F.collect_set(F.when(F.col("kind") == kind, F.col("val")))
        return F.slice(F.sort_array(values_of), 1, k)

    return values.groupBy(*keys).agg(
        sample("title").alias("sample_titles"), sample("link").alias("sample_links")
    )


def window_evidence(
    values: DataFrame, alerts: DataFrame, duration: str, slide: str, k: int = 3
) -> DataFrame:
    """(alert keys, sample_titles, sample_links): the ``k`` smallest distinct titles and
    links of each alert's window, from the ``k`` smallest of its slots."""
    d, s = seconds(duration), seconds(slide)
    slot_keys = ["slot", "category", "keyword"]
    slots = F.array(*[shift(F.col("window_start"), ahead) for ahead in range(0, d, s)])
    wanted = alerts.select(*ALERT_KEYS, F.explode(slots).alias("slot"))
    samples = collect_evidence(values, slot_keys, k)

    def merged(column: str):
        found = F.array_distinct(F.flatten(F.collect_list(column)))
        return F.slice(F.sort_array(found), 1, k).alias(column)

    return (
        join_on_keys(wanted, samples, slot_keys, "left")
        .groupBy(*ALERT_KEYS)
        .agg(merged("sample_titles"), merged("sample_links"))
    )


# Rows that a task folds at a time.
FOLDED_ROWS = 100_000


def _folding(k: int = 3, at_once: int = FOLDED_ROWS):
    """What :func:`fold_evidence` runs in each task. Nested, so that it is sent as it is and
    executors need not have this package."""

    def fold(parts):
        import pandas as pd

        rows = pd.concat(parts, ignore_index=True)
        groups = rows.groupby(["slot", "category", "keyword"], dropna=False, sort=False)
        group = groups.ngroup()
        kept = set()
        for column in ("title", "link"):
            values = rows[[column]].assign(group=group).dropna().drop_duplicates()
            values = values.sort_values(["group", column])
            kept.update(values.index[values.groupby("group").cumcount() < k])
        # a group without titles and links still counts
        bare = ~group.isin(group[list(kept)])
        kept.update(rows.index[bare & ~group.duplicated()])
        kept = sorted(kept)
        folded = rows.loc[kept].assign(micros=groups["micros"].transform("max").loc[kept])
        others = rows["n"].where(~rows.index.isin(kept), 0).groupby(group).sum()
        first = ~group.loc[kept].duplicated()
        folded["n"] += group.loc[kept].map(others).where(first, 0)
        return folded

    def fold_task(parts):
        held, n = [], 0
        for part in parts:
            held.append(part)
            n += len(part)
            if n >= at_once:
                held = [fold(held)]
                n = len(held[0])
                if n >= at_once // 2:
                    yield held.pop()
                    n = 0
        if n:
            yield fold(held)

    return fold_task


def fold_evidence(events: DataFrame, duration: str, slide: str) -> DataFrame:
    """(published_ts, category, keyword, title, link, n) of each micro-batch, folded: of all
    events of a keyword that lie in the same windows, those with the three smallest distinct
    titles or links. Their ``n`` add up to that of all. They are folded in their tasks first, so
    a hot keyword sends a few rows of each task to its place; a task holds a bounded number of
    rows. Events without a time, which have no window, are dropped.

    A watermark is not kept: set it on what this returns, which has the latest time of all
    events that were folded.
    """
    span = math.gcd(seconds(duration), seconds(slide)) * 1_000_000
    micros = F.unix_micros(F.col("published_ts").cast("timestamp"))
    rows = events.filter(F.col("published_ts").isNotNull()).select(
        (micros - F.pmod(micros, F.lit(span))).alias("slot"),
        "category",
        "keyword",
        "title",
        "link",
        micros.alias("micros"),
        F.lit(1).cast("bigint").alias("n"),
    )
    columns = (
        "slot bigint, category string, keyword string, title string, link string, micros bigint,"
        " n bigint"
    )
    fold = _folding()
    folded = rows.mapInPandas(fold, columns)
    folded = folded.repartition("slot", "category", "keyword").mapInPandas(fold, columns)
    published = F.timestamp_micros("micros").alias("published_ts")
    return folded.select(published, "category", "keyword", "title", "link", "n")
