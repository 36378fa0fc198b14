"""Vector codes of few bytes: a codebook for each part of the vectors, by ball k-means.

The parts that an entry holds form its ball. What a round needs of the entries is worked
out once, before it: an entry's neighbours are those near enough to take a part out of its
ball, half-way points being within the ball's radius. A part of a ball is then in the stable
core, where no neighbour is near enough, and is left alone, or in one of the rings around
it: in ring r only the r nearest neighbours can hold it, and only they are compared. All
tests are on whole numbers and let ties through, so the result is that of comparing all.

Rounds are passes over a table in the shared folder that holds the parts and their codes;
each pass assigns by the entries so far and sends home sums per entry, from which the next
entries come. Nothing is shuffled but these sums.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from newsflow.llm.common import by_batches, cut, drop_cut, quoted, ship
from newsflow.llm.vectors import (
    column_sums,
    common_size,
    from_limbs,
    limbs,
    pack,
    roomy,
    unpack,
    whole,
)

SCALE = 4096.0
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Limbs of a sum: numbers of 53 bits, over as many rows as there can be.
LIMBS = 4
#: Bytes of labels and their sums that are broadcast; beyond, rows meet them in places that
#: share a label.
MAX_BROADCAST = 8 << 20
DEALT = 16


def neighbours(book: list[list[int]], radius: list[int] | None) -> list[tuple[list[int], list[int]]]:
    """For each entry the others that can hold a part of its ball, nearest first, and their
    squared distances. Without radii balls have no end."""
    out = []
    for a, mine in enumerate(book):
        others = sorted(
            (sum((x - y) ** 2 for x, y in zip(mine, other)), j) for j, other in enumerate(book) if j != a
        )
        if radius is not None:
            others = [o for o in others if o[0] <= 4 * radius[a] ** 2]
        out.append(([j for _, j in others], [gap for gap, _ in others]))
    return out


def settle(parts: np.ndarray, at: np.ndarray, book: np.ndarray, near) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each part (of equals the first), its squared distance, and how many
    distances were computed. ``at`` is where each part was."""
    best = ((parts - book[at]) ** 2).sum(1)
    own, found, computed = best.copy(), at.copy(), len(parts)
    for a in np.unique(at).tolist():
        others, gaps = near[a]
        rows = np.flatnonzero(at == a)
        # a neighbour can hold a part only from half-way on
        ring = np.searchsorted(np.array(gaps, own.dtype), 4 * own[rows], side="right")
        for r in range(int(ring.max(initial=0))):
            some, j = rows[ring > r], others[r]
            distance = ((parts[some] - book[j]) ** 2).sum(1)
            computed += len(some)
            closer = (distance < best[some]) | ((distance == best[some]) & (j < found[some]))
            best[some[closer]], found[some[closer]] = distance[closer], j
    return found, best, computed


def next_book(book, counts, sums) -> list[list[int]]:
    """Entries moved to the floor of their parts' means; unused ones stay."""
    return [[s // n for s in total] if n else list(e) for e, n, total in zip(book, counts, sums)]


def moved_radius(old, new, radius) -> list[int]:
    """Bounds of the balls around moved entries: the old ones and the way moved."""
    way = [sum((x - y) ** 2 for x, y in zip(a, b)) for a, b in zip(old, new)]
    return [r + math.isqrt(w) + 1 for r, w in zip(radius, way)]


def prepared(docs: DataFrame, vector: str, keep: dict[str, str]) -> DataFrame:
    """The columns of ``keep`` (old to new name), ``size`` and packed ``parts`` of the rows
    whose vector can be used."""
    source = docs.select(*[quoted(c).alias(n) for c, n in keep.items()], quoted(vector).alias("parts_of"))
    schema = T.StructType(source.schema.fields[:-1]).add("size", "integer").add("parts", "binary")

    def run(batches):
        for batch in batches:
            rows, size, values = whole(batch.column(batch.num_columns - 1), SCALE)
            kept = [c.take(pa.array(rows)) for c in batch.columns[:-1]]
            columns = [*kept, pa.array(size.astype(np.int32)), pack(size, values)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(by_batches("vector codes", run), schema)


SUMS = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("part", "entry", "place")]
    + [T.StructField(n, T.LongType()) for n in ("held", "radius", *(f"limb{k}" for k in range(LIMBS)))]
)


def assign(state: DataFrame, size: int, books, near) -> DataFrame:
    """A round: ``state`` with new ``codes`` (a byte for each part) and ``error`` (null beyond
    a long), followed by rows that hold nothing but ``sums`` over each task."""
    width = size // len(books)
    # so many bits of a number let the squared distances of a row fit 64 bits
    safe = (60 - size.bit_length()) // 2
    kept = [f for f in state.schema.fields if f.name not in ("codes", "error", "sums")]
    names = [f.name for f in kept]
    at_parts = names.index("parts")
    first = "codes" not in state.columns
    source = state.select(*names, *([] if first else ["codes"]))
    schema = T.StructType(kept).add("codes", "binary").add("error", "long").add("sums", SUMS)

    def run(batches):
        held = [np.zeros(len(b), np.int64) for b in books]
        radius = [[0] * len(b) for b in books]
        sums = [[[0] * width for _ in b] for b in books]
        kinds = None
        for batch in batches:
            n = batch.num_rows
            kinds = [c.type for c in batch.columns[: len(names)]]
            rows = unpack(batch.column(at_parts), size)
            before = np.zeros((n, len(books)), np.uint8)
            if not first:
                before = np.frombuffer(b"".join(batch.column(len(names)).to_pylist()), np.uint8)
                before = before.reshape(n, len(books))
            after, total = before.copy(), np.zeros(n, np.int64)
            for p, book in enumerate(books):
                mine = rows[:, p * width : (p + 1) * width]
                both = roomy(np.concatenate([mine, np.array(book, np.int64).reshape(-1, width)]), safe)
                mine, entries = both[:n], both[n:]
                found, distance, _ = settle(mine, before[:, p].astype(np.int64), entries, near[p])
                after[:, p] = found
                total = total + distance
                for j in np.unique(found).tolist():
                    ball = found == j
                    held[p][j] += int(ball.sum())
                    furthest = math.isqrt(int(distance[ball].max())) + 1
                    radius[p][j] = max(radius[p][j], furthest)
                    sums[p][j] = [a + b for a, b in zip(sums[p][j], column_sums(mine[ball]))]
            raw = after.tobytes()
            codes = [raw[i : i + len(books)] for i in range(0, len(raw), len(books))]
            if total.dtype == object:
                total = [int(t) if t < 1 << 63 else None for t in total]
            columns = [
                *batch.columns[: len(names)],
                pa.array(codes, pa.binary()),
                pa.array(total, pa.int64()),
                pa.nulls(n, kind_of_sums),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)
        if kinds:
            keys = [(p, j, x) for p, b in enumerate(books) for j in range(len(b)) for x in range(width)]
            n = len(keys)
            struct = pa.StructArray.from_arrays(
                [
                    *(pa.array(k, pa.int32()) for k in zip(*keys)),
                    pa.array([int(held[p][j]) for p, j, _ in keys], pa.int64()),
                    pa.array([radius[p][j] for p, j, _ in keys], pa.int64()),
                    *limbs([sums[p][j][x] for p, j, x in keys], LIMBS),
                ],
                fields=list(kind_of_sums),
            ) if n else pa.nulls(0, kind_of_sums)
            empty = [pa.nulls(n, t) for t in kinds]
            yield pa.RecordBatch.from_arrays(
                [*empty, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), struct], schema.names
            )

    kind_of_sums = pa.struct(
        [pa.field(f.name, pa.int32() if f.dataType == T.IntegerType() else pa.int64()) for f in SUMS]
    )
    return source.mapInArrow(by_batches("vector codes", run), schema)


def gathered(state: DataFrame, books) -> tuple[list, list, list]:
    """Counts, radii and sums per part and entry, from the rows that hold sums."""
    rows = state.where("sums is not null").select("sums.*").groupBy("part", "entry", "place")
    found = rows.agg(
        F.sum("held").alias("held"),
        F.max("radius").alias("radius"),
        *[F.sum(f"limb{k}").alias(f"limb{k}") for k in range(LIMBS)],
    ).collect()
    width = len(books[0][0]) if books and books[0] else 0
    counts = [[0] * len(b) for b in books]
    radius = [[0] * len(b) for b in books]
    sums = [[[0] * width for _ in b] for b in books]
    for r in found:
        counts[r.part][r.entry], radius[r.part][r.entry] = r.held, r.radius
        sums[r.part][r.entry][r.place] = from_limbs(r[f"limb{k}"] for k in range(LIMBS))
    return counts, radius, sums


def compress(
    docs: DataFrame,
    vector: str = "embedding",
    vec_id: str = "vec_id",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``vec_id``, ``code`` (two hex digits for each part), ``error`` (squared distances to the
    entries, summed over the parts), ``label_error`` (``error`` summed over rows of the same
    label, nulls together) and ``codebooks_sha256`` for every row with a usable vector.

    Rows whose vector is null or holds null or non-finite entries are left out, as are those
    whose vector is not as long as most are (the longer, where as many). An entry x counts as
    floor(4096 x), at most 2 to the 52. The first entries are the parts of the rows of smallest
    ``vec_id``, null ids last, rows of one id in the order of their packed numbers; fewer rows
    make fewer entries. Repeated rows each count. Sums beyond a long are null. An empty table
    gives no rows. ``parts`` must divide the vectors' length, ``entries`` be at most 256.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes are bytes: there can be 1 to 256 entries")
    spark = docs.sparkSession
    ship(spark)
    keep = {vec_id: "vec_id", label: "label"}
    state = spent = cut(prepared(docs, vector, keep), "vectors")
    size = common_size(state) or 0
    if size % parts:
        raise ValueError(f"vectors of {size} entries cannot be cut into {parts} equal parts")
    state = state.where(F.col("size") == size)
    # ordered by their bytes: any order does, as long as it is always the same
    first = state.orderBy(F.asc_nulls_last("vec_id"), "parts").limit(entries).select("parts").collect()
    seed = unpack(pa.array([bytes(r.parts) for r in first], pa.binary()), size)
    width = size // parts
    books = [seed[:, p * width : (p + 1) * width].tolist() for p in range(parts)]
    radius: list = [None] * parts
    for turn in range(rounds + 1):
        near = [neighbours(b, r) for b, r in zip(books, radius)]
        state = cut(assign(state, size, books, near), "codes")
        drop_cut(spent)
        spent = state
        if turn < rounds:
            counts, radii, sums = gathered(state, books)
            moved = [next_book(*x) for x in zip(books, counts, sums)]
            radius = [moved_radius(*x) for x in zip(books, moved, radii)]
            books = moved
        state = state.where("sums is null")
    numbers = ",".join(str(x) for b in books for e in b for x in e)
    coded = state.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error")
    return with_label_errors(coded).withColumn(
        "codebooks_sha256", F.lit(hashlib.sha256(numbers.encode()).hexdigest())
    )


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``vec_id``, ``code``, ``error`` and ``label_error``. Labels are summed before anything
    is shuffled. Few sums are broadcast; many meet the rows in places that share a label."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = (F.count("error") == F.count("*")) & (total <= F.lit((1 << 63) - 1).cast("decimal(38,0)"))
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.when(fits, total).cast("long").alias("label_error"))
    sums = cut(sums, "label-errors")
    each = F.coalesce(F.octet_length(F.col("of").cast("string")), F.lit(0)) + 16
    if (sums.agg(F.sum(each)).first()[0] or 0) <= MAX_BROADCAST:
        met = rows.join(F.broadcast(sums), rows.label.eqNullSafe(sums.of))
    else:
        place = F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(DEALT))
        every = F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)).cast("array<bigint>"))
        left, right = rows.withColumn("place", place), sums.withColumn("spot", every).hint("merge")
        met = left.join(right, left.label.eqNullSafe(right.of) & (left.place == right.spot))
    return met.select("vec_id", "code", "error", "label_error")
