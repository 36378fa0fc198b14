"""Packing pieces of documents into sequences by vector best-fit.

A piece takes of a sequence its tokens, one document, and an attention cost (its tokens
squared); a sequence has a capacity for each. Pieces are placed from the longest to the
shortest. Of the open sequences that have room in every dimension, the best is the one with
the least weighted norm of what is left after placing the piece, or the greatest weighted
dot product of the piece and what is left before.

What a piece takes depends on its length alone. So lengths are counted first; the packing is
worked out on the counts, for many equal sequences at a time; and pieces, numbered among those
of their length, look up their place in it. The counts and the packing are bounded by the
capacity, whatever the number of pieces. The numbers come from one shuffle of rows without
tokens, in which pieces of a common length are dealt to many groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from newsflow.llm.common import by_batches, cut, quoted, ranges, ship
from newsflow.llm.token_files import encode_batch, with_end

TOKENS = 1024
#: Pieces of one length that are numbered together.
GROUP = 10_000


@dataclass(frozen=True)
class Limits:
    """What a sequence holds. ``documents`` and ``attention`` (the sum of squared lengths) are
    by default as much as ``tokens`` allows."""

    tokens: int = TOKENS
    documents: int | None = None
    attention: int | None = None

    @property
    def capacity(self) -> np.ndarray:
        documents = self.tokens if self.documents is None else self.documents
        attention = self.tokens**2 if self.attention is None else self.attention
        return np.array([self.tokens, documents, attention], np.int64)

    @property
    def longest(self) -> int:
        """The longest piece that fits an empty sequence."""
        tokens, documents, attention = self.capacity.tolist()
        longest = min(tokens, math.isqrt(max(attention, 0))) if documents > 0 else 0
        if longest < 1:
            raise ValueError("no piece fits a sequence of these limits")
        return longest


@dataclass
class Plan:
    """Where the pieces of each length go. A segment takes the pieces of ``length`` numbered
    from ``first``, ``each`` to a sequence, from sequence ``sequence`` and offset ``offset`` on."""

    sequences: int = 0
    segments: list[tuple[int, int, int, int, int]] = field(default_factory=list)


def takes(length: int) -> np.ndarray:
    return np.array([length, 1, length * length], np.int64)


def plan(counts: dict[int, int], limits: Limits, weights=(1.0, 1.0, 1.0), rule: str = "norm") -> Plan:
    """Best-fit of ``counts`` pieces of each length. ``rule`` is ``norm`` or ``dot``."""
    capacity, weight = limits.capacity, np.array(weights, float)
    out = Plan()
    # runs of equal open sequences: the first one's number, how many, what each has left
    start, many, left = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.int64)

    def score(rows: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The lower, the better."""
        if rule == "dot":
            return -((rows / capacity) * (need / capacity) * weight).sum(-1)
        return (((rows - need) / capacity) ** 2 * weight).sum(-1)

    for length in sorted(counts, reverse=True):
        need, count, first = takes(length), counts[length], 0
        while count:
            fits = np.flatnonzero((left >= need).all(1))
            if len(fits):
                k = int(fits[np.argmin(score(left[fits], need))])
                state, available, base = left[k], int(many[k]), int(start[k])
            else:
                k, state, available, base = -1, capacity, count, out.sequences
            # the next piece stays with this sequence while that is still the best one
            each, after = 1, state - need
            others = score(left[fits], need).min() if len(fits) else np.inf
            if rule == "norm":
                each = int((state // need).min())
                after = state - each * need
            elif k < 0:
                while (after >= need).all() and score(after, need) < others and each < count:
                    each, after = each + 1, after - need
            if each > count:
                each, after = count, state - count * need
            used = min(available, count // each)
            out.segments.append((length, first, each, base, int(capacity[0] - state[0])))
            first, count = first + used * each, count - used * each
            if k < 0:
                out.sequences += used
            else:
                start[k], many[k] = base + used, available - used
                if not many[k]:
                    start, many, left = (np.delete(x, k, 0) for x in (start, many, left))
            if (after >= 1).all():
                start, many = np.append(start, base), np.append(many, used)
                left = np.concatenate([left, after[None]])
    return out


#: Ways to weigh what is left that are tried; the one with the fewest sequences is used.
TRIED = (("norm", (1.0, 1.0, 1.0)), ("norm", (1.0, 0.0, 0.0)), ("dot", (1.0, 0.0, 1.0)))


def best_plan(counts: dict[int, int], limits: Limits, tried=TRIED) -> Plan:
    return min((plan(counts, limits, w, rule) for rule, w in tried), key=lambda p: p.sequences)


def cut_pieces(
    docs: DataFrame,
    path: str,
    end: int = 2,
    longest: int = TOKENS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id``, ``piece`` (from 0), ``start`` (ids of the document before it), ``length`` and
    ``ids`` (little-endian, 32 bits each) of the pieces of every whole text, encoded without
    special tokens and followed by ``end``.

    Texts of more than ``longest`` ids are cut into pieces of that many; the first piece may be
    shorter. A null or empty text is the end id alone. Rows are independent of each other.
    """
    ship(docs.sparkSession)
    source = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    schema = T.StructType([source.schema["doc_id"]]).add("piece", "integer").add("start", "long")
    schema = schema.add("length", "long").add("ids", "binary")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for counts, ids in encode_batch(batch.column(1), path):
                counts, ids = with_end(counts, ids, end)
                per = -(-counts // longest)
                head = counts - (per - 1) * longest
                owner = np.repeat(np.arange(len(counts)), per)
                piece = ranges(np.zeros(len(per), np.int64), per)
                length = np.where(piece == 0, head[owner], longest)
                start = np.where(piece == 0, 0, head[owner] + (piece - 1) * longest)
                edges = pa.array(np.append(0, np.cumsum(length) * 4).astype(np.int64))
                raw = pa.py_buffer(ids.astype("<u4").tobytes())
                whole = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(length), [None, edges.buffers()[1], raw]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owner + row)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(length),
                        whole.cast(pa.binary()),
                    ],
                    schema.names,
                )
                row += len(counts)

    return source.mapInArrow(by_batches("packing", run), schema)


def place(
    pieces: DataFrame, limits: Limits | None = None, length: str = "length", tried=TRIED
) -> DataFrame:
    """``pieces`` with ``sequence_id`` (from 0) and ``offset``; columns of these names are
    replaced. Offsets of a sequence have no gaps; no limit is exceeded.

    Each pair of rule and weights in ``tried`` is worked out, and the one with the fewest
    sequences used. Rows whose length is null, below 1 or beyond what an empty sequence
    holds get null for both. Repeated rows are pieces of their own. An empty table gives no
    rows. Rows without tokens are better placed than rows with: all columns are shuffled once.
    """
    spark = pieces.sparkSession
    ship(spark)
    limits = limits or Limits()
    longest = limits.longest
    rest = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    names = [f"c{i}" for i in range(len(rest))]
    source = pieces.select(
        *[quoted(c).alias(n) for c, n in zip(rest, names)],
        quoted(length).cast("long").alias("length"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = cut(source, "pieces")
    fits = F.coalesce(F.col("length").between(1, longest), F.lit(False))
    found = rows.where(fits).groupBy("length").count().collect()
    counts = {r[0]: r[1] for r in found}
    made = best_plan(counts, limits, tried)

    # a common length is numbered in several groups, group after group; what fits nowhere has
    # size 0. There are at most as many sizes as tokens in a sequence
    spread = [(size, -(-n // GROUP)) for size, n in counts.items()]
    spread = spark.createDataFrame(spread, "size long, groups long")
    size = F.when(fits, F.col("length")).otherwise(0).alias("size")
    share = F.pmod(F.xxhash64("row"), F.coalesce("groups", F.lit(GROUP))).alias("share")
    placed = rows.select("*", size).join(F.broadcast(spread), "size", "left")
    placed = placed.select(*names, "size", "row", share)
    before = Window.partitionBy("size").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("size", "share").agg(F.count("*").alias("n"))
    bases = bases.select("size", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("size", "share").orderBy("row")) - 1
    met = placed.withColumn("number", number).join(bases, ["size", "share"])
    met = met.select(*names, "size", (F.col("base") + F.col("number")).alias("number"))

    # segments in the order of (length, first): one search finds a piece's
    segments = np.array(sorted(made.segments), np.int64).reshape(-1, 5)
    top = max(counts.values(), default=0) + 1
    keys = [int(s[0]) * top + int(s[1]) for s in segments]
    keys = np.array(keys, np.int64 if top * (longest + 1) < 1 << 62 else object)
    schema = T.StructType([T.StructField(n, pieces.schema[c].dataType) for n, c in zip(names, rest)])
    schema = schema.add("sequence_id", "long").add("offset", "long")

    def run(batches):
        for batch in batches:
            size, number = (c.to_numpy().astype(np.int64) for c in batch.columns[len(names) :])
            known = size > 0
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            if known.any():
                at = np.searchsorted(keys, (size * top + number)[known].astype(keys.dtype), "right") - 1
                length, first, each, base, used = segments[at].T
                place = number[known] - first
                sequence[known] = base + place // each
                offset[known] = used + place % each * length
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(names)],
                    pa.array(sequence, mask=~known),
                    pa.array(offset, mask=~known),
                ],
                schema.names,
            )

    out = met.mapInArrow(by_batches("packing", run), schema)
    return out.select(
        *[F.col(n).alias(c) for n, c in zip(names, rest)], "sequence_id", "offset"
    )


def sequences(placed: DataFrame, ids: str = "ids") -> DataFrame:
    """``sequence_id``, ``n_tokens``, ``n_pieces``, ``ids`` of the whole sequence and ``lengths``
    of its pieces in order, from placed pieces with their ids. A group is one sequence."""
    piece = F.struct("offset", F.col("length").alias("length"), quoted(ids).alias("ids"))
    rows = placed.where("sequence_id is not null").groupBy("sequence_id")
    found = rows.agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    joined = F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return found.select(
        "sequence_id",
        (F.octet_length(joined) / 4).cast("int").alias("n_tokens"),
        F.size("pieces").alias("n_pieces"),
        joined.alias("ids"),
        F.transform("pieces", lambda p: p["length"]).alias("lengths"),
    )
