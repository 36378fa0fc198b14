"""Benchmark decontamination with an FM-index per training shard.

Benchmark items become windows of words. Each shard (a run of texts in a task) turns its
words into numbers; words and word pairs that no window holds cannot be part of a match and
are left out of the index. The rest is indexed: suffix array by prefix doubling, Burrows-
Wheeler transform, wavelet matrix for ranks and a sample of suffix positions. All windows
are searched backward at once, their rows walked to sampled positions, and the spans found
merged per text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from newsflow.llm.common import (
    BYTE_VALUES,
    buffers,
    by_batches,
    chunks,
    cut,
    drop_cut,
    free_name,
    prefix_sums,
    quoted,
    ranges,
    ship,
    span_hash,
)

WINDOW = 10
#: Bytes of benchmark text that are searched for at once, and that a worker holds in one pass.
BLOCK_BYTES, PASS_BYTES = 4 << 20, 8 << 20
#: Bytes of training text in a shard, or one longer text.
SHARD_BYTES = 1 << 21
#: Every so many suffix positions are kept.
SAMPLE = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word bytes after lower-casing: digits, a to z, and all beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends and hashes of all words, and how many each text has."""
    lower = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[lower]
    starts_text = np.zeros(len(data) + 1, bool)
    starts_text[offsets[:-1]] = True
    body = inside[1:-1]
    starts = np.flatnonzero(body & (~inside[:-2] | starts_text[:-1]))
    ends = np.flatnonzero(body & (~inside[2:] | starts_text[1:])) + 1
    hashes = span_hash(prefix_sums(BYTE_VALUES[lower]), starts, ends)
    return starts, ends, hashes, np.diff(np.searchsorted(starts, offsets))


# FM-index


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix order of numbers, by prefix doubling over the suffixes still tied."""
    n = len(seq)
    _, rank = np.unique(seq, return_inverse=True)
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    h = 1
    while True:
        sorted_rank = rank[order]
        new_group = np.ones(n, bool)
        new_group[1:] = sorted_rank[1:] != sorted_rank[:-1]
        # a group's number is the place of its first member, so that untied ones stay
        first = np.maximum.accumulate(np.where(new_group, np.arange(n), 0))
        rank[order] = first
        alone = new_group & np.append(new_group[1:], True)
        if alone.all():
            return order
        tied = np.flatnonzero(~alone)
        members = order[tied]
        after = members + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        inner = np.lexsort((second, first[tied]))
        order[tied] = members[inner]
        key = second[inner]
        group = first[tied]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        places = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[order[tied]] = places
        h *= 2


class Wavelet:
    """A wavelet matrix: ranks and symbols of a sequence, for arrays of places."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs ahead of its place."""
        start = np.zeros(len(symbol), np.int64)
        place = place.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.bits - 1 - k)) & 1 == 1
            start, place = (
                np.where(bit, zeros + ones[p], p - ones[p]) for p in (start, place)
            )
        return place - start

    def access(self, place: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(place), np.int64)
        place = place.astype(np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[place + 1] - ones[place]
            symbol = symbol * 2 + bit
            place = np.where(bit == 1, zeros + ones[place], place - ones[place])
        return symbol


class FMIndex:
    """Over numbers from 1; 0 separates stretches."""

    def __init__(self, seq: np.ndarray, symbols: int):
        # an end mark of its own, smaller than all, makes the rotation order the suffix order
        seq = np.append(seq + 1, 0)
        order = suffix_array(seq)
        self.wavelet = Wavelet(seq[order - 1], symbols + 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols + 1))])
        marked = order % SAMPLE == 0
        self.kept = np.append(0, np.cumsum(marked))
        self.marked, self.positions = marked, order[marked]
        self.size = len(seq)

    def search(self, patterns: np.ndarray, lengths: np.ndarray):
        """The rows of each pattern, as [low, high). Patterns are padded on the right."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero((k < lengths) & (low < high))
            symbol = patterns[live, k] + 1
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each row's suffix."""
        steps = np.zeros(len(rows), np.int64)
        rows = rows.copy()
        walking = np.flatnonzero(~self.marked[rows])
        while len(walking):
            at = rows[walking]
            symbol = self.wavelet.access(at)
            rows[walking] = self.before[symbol] + self.wavelet.rank(symbol, at)
            steps[walking] += 1
            walking = walking[~self.marked[rows[walking]]]
        return self.positions[self.kept[rows]] + steps


# Benchmark windows


@dataclass
class Windows:
    """The distinct windows of a block of items, their words numbered from 1."""

    vocabulary: np.ndarray  # sorted hashes
    patterns: np.ndarray
    lengths: np.ndarray
    items: np.ndarray  # of each (window, item) pair
    first: np.ndarray  # of each window, its first pair
    pairs: np.ndarray  # sorted keys of adjacent words
    singles: np.ndarray  # words that are windows of their own
    shortest: int


def windows_of(items: list[tuple[str, str]], size: int = WINDOW) -> Windows | None:
    """Of (id, text); an item shorter than ``size`` words is one window."""
    texts = pa.array([t or "" for _, t in items], pa.string())
    data, offsets = buffers(texts)
    _, _, hashes, counts = words(data, offsets)
    if not len(hashes):
        return None
    vocabulary, numbers = np.unique(hashes, return_inverse=True)
    numbers = numbers + 1
    per = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    starts = ranges(np.cumsum(counts) - counts, per)
    item = np.repeat(np.arange(len(items)), per)
    length = np.minimum(np.repeat(counts, per), size)
    grid = starts[:, None] + np.arange(size)
    padded = np.append(numbers, np.zeros(size, np.int64))[grid]
    padded[np.arange(size) >= length[:, None]] = 0
    patterns, which = np.unique(padded, axis=0, return_inverse=True)
    which = which.reshape(-1)
    owner = np.unique(np.stack([which, item], 1), axis=0)
    lengths = (patterns > 0).sum(1)
    left, right = patterns[:, :-1], patterns[:, 1:]
    both = right > 0
    return Windows(
        vocabulary,
        patterns,
        lengths,
        owner[:, 1],
        np.searchsorted(owner[:, 0], np.arange(len(patterns) + 1)),
        np.unique(left[both] * (len(vocabulary) + 1) + right[both]),
        np.unique(patterns[lengths == 1, 0]),
        int(lengths.min()),
    )


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def find(hashes: np.ndarray, counts: np.ndarray, w: Windows):
    """(first word, words, window) of every occurrence in the words of a shard."""
    n = len(hashes)
    nothing = np.zeros(0, np.int64)
    if not n:
        return nothing, nothing, nothing
    at = np.minimum(np.searchsorted(w.vocabulary, hashes), len(w.vocabulary) - 1)
    number = np.where(w.vocabulary[at] == hashes, at + 1, 0)
    joined = (number[:-1] > 0) & (number[1:] > 0)
    ends = np.cumsum(counts)
    inner = ends[(ends > 0) & (ends < n)]
    joined[inner - 1] = False
    places = np.flatnonzero(joined)
    key = number[places] * (len(w.vocabulary) + 1) + number[places + 1]
    joined[places] = _among(key, w.pairs)
    # stretches of joined words; one word alone only matters if it is a window
    breaks = np.flatnonzero(~joined) + 1
    first = np.concatenate([[0], breaks])
    size = np.diff(np.append(first, n))
    keep = size >= max(w.shortest, 2)
    if len(w.singles):
        keep |= (size == 1) & _among(number[first], w.singles) | (size > 1)
    first, size = first[keep], size[keep]
    if not len(first):
        return nothing, nothing, nothing
    # a separator after each stretch
    source = ranges(first, size + 1)
    seq = np.append(number, 0)[source]
    seq[np.cumsum(size + 1) - 1] = 0
    index = FMIndex(seq, len(w.vocabulary) + 1)
    low, high = index.search(w.patterns, w.lengths)
    found = np.repeat(np.arange(len(low)), high - low)
    position = index.locate(ranges(low, high - low))
    return source[position], w.lengths[found], found


def scan(texts: pa.Array, blocks: list[tuple[list[str], Windows]], known=None):
    """Per text: words, hit words, the items found, the byte spans to remove, and the runs of
    hit words. ``known`` has the runs and items that were found in each text before."""
    data, offsets = buffers(texts)
    for i, j in chunks(offsets, SHARD_BYTES):
        part = data[offsets[i] : offsets[j]]
        at = offsets[i : j + 1] - offsets[i]
        starts, ends, hashes, counts = words(part, at)
        edges = np.append(0, np.cumsum(counts))
        hit = np.zeros(len(hashes) + 1, np.int64)
        names: dict[int, set] = {}
        for t, (runs, items) in enumerate(known[i:j] if known else ()):
            for a, b in runs:
                hit[edges[t] + a] += 1
                hit[edges[t] + b] -= 1
            if items:
                names[t] = set(items)
        for ids, w in blocks:
            first, size, window = find(hashes, counts, w)
            np.add.at(hit, first, 1)
            np.add.at(hit, first + size, -1)
            text = np.searchsorted(edges, first, side="right") - 1
            pair = np.unique(text * len(w.lengths) + window)
            text, window = pair // len(w.lengths), pair % len(w.lengths)
            n = w.first[window + 1] - w.first[window]
            item = w.items[ranges(w.first[window], n)]
            for t, k in np.unique(np.stack([np.repeat(text, n), item], 1), axis=0).tolist():
                names.setdefault(t, set()).add(ids[k])
        covered = np.cumsum(hit)[:-1] > 0
        sums = np.append(0, np.cumsum(covered))
        # maximal runs of hit words, cut at text borders
        new = covered.copy()
        new[1:] &= ~covered[:-1]
        border = edges[(edges < len(covered))]
        new[border] = covered[border]
        run = np.flatnonzero(new)
        last = np.ones(len(covered), bool)
        last[:-1] = ~covered[1:] | new[1:]
        run_end = np.flatnonzero(covered & last)
        of = np.searchsorted(edges, run, side="right") - 1
        spans: dict[int, list] = {}
        of_words: dict[int, list] = {}
        for t, a, b, c, d in zip(
            of.tolist(), starts[run].tolist(), ends[run_end].tolist(), run.tolist(), run_end.tolist()
        ):
            spans.setdefault(t, []).append((a - int(at[t]), b - int(at[t])))
            of_words.setdefault(t, []).append((c - int(edges[t]), d + 1 - int(edges[t])))
        for t in range(j - i):
            yield (
                int(counts[t]),
                int(sums[edges[t + 1]] - sums[edges[t]]),
                sorted(names.get(t, ())),
                spans.get(t, []),
                of_words.get(t, []),
            )


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
                )
            ),
        ),
    ]
)


def benchmark_passes(benchmark: DataFrame, item_id: str, text: str, size: int):
    """The windows of the items in blocks of bounded text, as many as a pass holds, and
    whether the pass is the last one."""
    items = benchmark.select(
        quoted(item_id).cast("string").alias("id"), F.coalesce(quoted(text), F.lit("")).alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    each = max(1, PASS_BYTES // BLOCK_BYTES)
    for first in range(0, n, each):
        blocks = []
        for k in range(first, min(first + each, n)):
            block = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()
            block = sorted((r.id or "", r.text) for r in block)
            if found := windows_of(block, size):
                blocks.append(([i for i, _ in block], found))
        yield blocks, first + each >= n


SO_FAR = T.ArrayType(T.StructType().add("first", "long").add("end", "long"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    remove: bool = False,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``
    and ``spans`` (byte ranges of the runs of hit words). With ``remove`` the spans are
    taken out of the text.

    Words are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII. A
    window is ``window`` consecutive words of an item, or all words of a shorter one. Null
    and empty texts have no words and are not contaminated, items without words give no
    window, a null item id counts as the empty string, and equal items are all reported.
    Rows are independent of each other. Columns of ``docs`` named like a result are
    replaced.

    The driver and each worker hold ``PASS_BYTES`` of the benchmark at a time, or one longer
    item. A larger one takes several passes over ``docs``, and what the passes before have
    found travels with the rows. Words are known by a 64-bit hash.
    """
    spark = docs.sparkSession
    ship(spark)
    rest = [c for c in docs.columns if c.lower() not in {f.name for f in RESULT}]
    hidden, runs, items = (
        free_name(docs, n) for n in ("text_searched", "runs_so_far", "items_so_far")
    )
    current = docs.select(*[quoted(c) for c in rest], quoted(doc_text).alias(hidden))
    kept, spent = [docs.schema[c] for c in rest], None
    for found, last in benchmark_passes(benchmark, item_id, item_text, window):
        held = spark.sparkContext.broadcast(found)
        if last:
            return _finished(current, held, kept, doc_text, remove, hidden, runs, items)
        noted = T.StructType([*kept, T.StructField(hidden, T.StringType())])
        noted = noted.add(runs, SO_FAR).add(items, T.ArrayType(T.StringType()))
        passed = cut(_searched(current, held, noted, hidden, runs, items), "decontaminate")
        held.unpersist()
        if spent is not None:
            drop_cut(spent)
        current = spent = passed


def _known(batch, runs: str, items: str):
    """What the passes before have found, if there were any."""
    if runs not in batch.schema.names:
        return None
    columns = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (runs, items))
    return [([(r["first"], r["end"]) for r in a], b) for a, b in zip(*columns)]


def _searched(source: DataFrame, blocks, schema: T.StructType, hidden, runs, items) -> DataFrame:
    """A pass that notes what it finds."""
    kept = [n for n in schema.names if n not in (runs, items)]
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(hidden))
            found = list(scan(texts, blocks.value, _known(batch, runs, items)))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns.append(pa.array([[{"first": a, "end": b} for a, b in f[4]] for f in found], kind))
            columns.append(pa.array([f[2] for f in found], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(by_batches("decontaminate", run), schema)


def _finished(source, blocks, fields, doc_text, remove, hidden, runs, items) -> DataFrame:
    """The last pass, with the result."""
    rest = [f.name for f in fields]
    fields = [f for f in fields if not (remove and f.name == doc_text)]
    keep = [f.name for f in fields]
    schema = T.StructType([*fields, *RESULT])
    if remove:
        schema = T.StructType([*fields, T.StructField(doc_text, T.StringType()), *RESULT])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(hidden))
            found = list(scan(texts, blocks.value, _known(batch, runs, items)))
            ids = [",".join(f[2]) for f in found]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            if remove:
                columns.append(pa.array(without(texts, [f[3] for f in found]), pa.string()))
            columns += [
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([f[1] for f in found], pa.int64()),
                pa.array([len(f[2]) for f in found], pa.int64()),
                pa.array([hashlib.sha256(s.encode()).hexdigest() for s in ids], pa.string()),
                pa.array([f[1] > 0 for f in found], pa.bool_()),
                pa.array([[{"start": a, "end": b} for a, b in f[3]] for f in found], span),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    found = source.mapInArrow(by_batches("decontaminate", run), schema)
    return found.select(*[quoted(c) for c in [*rest, *RESULT.names]])


def without(texts: pa.Array, spans: list[list[tuple[int, int]]]) -> list[str | None]:
    """Each text without its byte spans."""
    out = texts.to_pylist()
    for k, cuts in enumerate(spans):
        if cuts:
            raw, kept, last = out[k].encode(), [], 0
            for a, b in cuts:
                kept.append(raw[last:a])
                last = b
            out[k] = b"".join([*kept, raw[last:]]).decode()
    return out
