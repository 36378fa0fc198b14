"""Whitening of embeddings by their polarisation covariance.

Entries become whole numbers, so that everything up to the covariance matrix is exact. The
fit list is each distinct vector once. Two passes over it: one for the sums of every
dimension, one for the sums of squares, centred at the whole number next to each mean, of every
dimension and of the sum of every two. Differences of the variances,

    cov(i, j) = (var(i + j) - var(i) - var(j)) / 2,

are all cross-covariances. They are put together on the driver, which holds as many numbers
as the matrix, and decomposed there.

With y = x - c for the centre c nearest the mean, r = sum(y) and n vectors,
n * sum(y^2) - r^2 is n^2 times the variance: what centring at a whole number leaves is
taken off exactly, and no number is larger than it must be.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from newsflow.llm.common import by_batches, cut, quoted, ship
from newsflow.llm.vectors import column_sums, common_size, from_limbs, limbs, pack, roomy, unpack, whole

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 16
LIMBS = 5
#: Rows whose pairs are summed at once.
ROWS = 2048


@dataclass
class Fit:
    """What whitening needs of the fit list. Numbers here are without SHIFT, which changes no
    difference."""

    n: int
    sums: list[int]
    centre: list[int]
    values: np.ndarray  # of the components, falling
    axes: np.ndarray  # a column for each component
    trace: float

    @property
    def rest(self) -> list[int]:
        return [s - self.n * c for s, c in zip(self.sums, self.centre)]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers on the components, in units of their deviations."""
        y = (x - np.array(self.centre, np.int64)).astype(float)
        y -= np.array([r / self.n for r in self.rest])
        return (y @ self.axes) / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """sum((n x - S)^2) of each row, exact; null beyond a long."""
        y = x - np.array(self.centre, np.int64)
        top = self.n * (int(np.abs(y).max(initial=0)) + 1)
        room = top * top * max(1, x.shape[1]) < 1 << 63
        kind = np.int64 if room else object
        total = ((y.astype(kind) * self.n - np.array(self.rest, kind)) ** 2).sum(1)
        return [t if t < 1 << 63 else None for t in total.tolist()]


def prepared(docs: DataFrame, vector: str, keep: list[str], names: list[str]) -> DataFrame:
    """The columns of ``keep``, then ``size`` and packed ``x`` of rows with a usable vector."""
    source = docs.select(*[quoted(c).alias(n) for c, n in zip(keep, names)], quoted(vector).alias("x_of"))
    schema = T.StructType(source.schema.fields[:-1]).add("size", "integer").add("x", "binary")

    def run(batches):
        for batch in batches:
            rows, size, values = whole(batch.column(batch.num_columns - 1), SCALE)
            kept = [c.take(pa.array(rows)) for c in batch.columns[:-1]]
            columns = [*kept, pa.array(size.astype(np.int32)), pack(size, values)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(by_batches("whitening", run), schema)


def pair_squares(y: np.ndarray) -> list[int]:
    """Exact sums over the rows of (y_i + y_j)^2 for every i <= j; those of i = j are of y_i^2."""
    size = y.shape[1]
    y = roomy(y, 25)  # then a sum's square has 52 bits, and ROWS of them 63
    out = []
    for i in range(size):
        both = y[:, i:] + y[:, i : i + 1]
        both[:, 0] = y[:, i]
        both *= both
        # no square is negative: sums of ROWS fit
        out += both.sum(0).tolist() if len(both) else [0] * (size - i)
    return out


def column_totals(fit_list: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and sums of every dimension."""

    def run(batches):
        n, sums = 0, [0] * size
        for batch in batches:
            n += batch.num_rows
            sums = [a + b for a, b in zip(sums, column_sums(unpack(batch.column(0), size)))]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, size), pa.int32()), *limbs([n, *sums], LIMBS)],
                ["place", *(f"limb{k}" for k in range(LIMBS))],
            )

    found = _added(fit_list, run)
    return found.get(-1, 0), [found.get(i, 0) for i in range(size)]


def _added(fit_list: DataFrame, run) -> dict[int, int]:
    """The numbers that tasks send home in limbs, added per place."""
    names = [f"limb{k}" for k in range(LIMBS)]
    schema = "place int, " + ", ".join(f"{n} long" for n in names)
    parts = fit_list.select("x").mapInArrow(by_batches("whitening", run), schema)
    rows = parts.groupBy("place").agg(*[F.sum(n).alias(n) for n in names]).collect()
    return {r.place: from_limbs(r[n] for n in names) for r in rows}


def polarised(fit_list: DataFrame, size: int, n: int, sums: list[int]) -> tuple[list[int], np.ndarray]:
    """Centres, and the covariance matrix by polarisation."""
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    pairs = size * (size + 1) // 2

    def run(batches):
        total, any_row = [0] * pairs, False
        for batch in batches:
            x = unpack(batch.column(0), size) - np.array(centre, np.int64)
            for i in range(0, len(x), ROWS):
                any_row = True
                total = [a + b for a, b in zip(total, pair_squares(x[i : i + ROWS]))]
        if any_row:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(pairs), pa.int32()), *limbs(total, LIMBS)],
                ["place", *(f"limb{k}" for k in range(LIMBS))],
            )

    found = _added(fit_list, run)
    variance = np.zeros((size, size), object)
    place = 0
    for i in range(size):
        for j in range(i, size):
            left = rest[i] if i == j else rest[i] + rest[j]
            variance[i, j] = n * found.get(place, 0) - left * left  # n^2 times a variance
            place += 1
    out = np.zeros((size, size))
    for i in range(size):
        out[i, i] = variance[i, i] / (n * n)
        for j in range(i + 1, size):
            # a quotient of whole numbers, rounded once
            out[i, j] = out[j, i] = (variance[i, j] - variance[i, i] - variance[j, j]) / (2 * n * n)
    return centre, out


def decompose(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, the largest entry of each
    positive. Those without variance are left out."""
    size = len(covariance)
    if not size:
        return np.zeros(0), np.zeros((0, 0))
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = values > max(values[0], 0.0) * size * np.finfo(float).eps * 4
    values, vectors = values[some][:components], vectors[:, some][:, :components]
    largest = np.abs(vectors).argmax(0)
    return values, vectors * np.sign(vectors[largest, np.arange(len(values))])


def identity_error(fit_list: DataFrame, size: int, fit: Fit) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(fit.values)
    if not k:
        return 0.0

    def run(batches):
        n, total, square = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = fit.whiten(unpack(batch.column(0), size))
            n += len(z)
            total += z.sum(0)
            square += z.T @ z
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(k + k * k), pa.int32()),
                    pa.array(np.append(total, square.reshape(-1))),
                ],
                ["place", "total"],
            )

    parts = fit_list.select("x").mapInArrow(by_batches("whitening", run), "place int, total double")
    found = {r[0]: r[1] for r in parts.groupBy("place").agg(F.sum("total")).collect()}
    mean = np.array([found[i] for i in range(k)]) / fit.n
    square = np.array([found[k + i] for i in range(k * k)]).reshape(k, k) / fit.n
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def fitted(fit_list: DataFrame, size: int, components: int) -> Fit:
    n, sums = column_totals(fit_list, size)
    centre, covariance = polarised(fit_list, size, n, sums)
    values, axes = decompose(covariance, components)
    return Fit(n, sums, centre, values, axes, float(np.trace(covariance)))


def whiten(
    docs: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS
) -> DataFrame:
    """For every row with a usable vector and each component: ``vec_id``, ``component`` (from
    1, by falling variance), ``n`` (distinct vectors), ``deviation`` (squared distance of n x
    from the sums, exact; null beyond a long), ``whitened`` (the centred vector on the
    component, in deviations), ``explained`` (the component's share of all variance) and
    ``identity_error``.

    Rows whose vector is null or holds null or non-finite entries are left out, as are those
    whose vector is not as long as most distinct ones are (the longer, where as many). An entry
    c counts as floor(64 c) + 1,000,000, floor(64 c) as at most 2 to the 52. Components whose
    variance is nil are not returned: where all vectors are equal, or the table is empty,
    there are no rows. Repeated rows and null ids are returned like others.
    """
    spark = docs.sparkSession
    ship(spark)
    # distinct vectors: copies are merged before the shuffle
    fit_list = cut(prepared(docs, vector, [], []).distinct(), "fit-list")
    size = common_size(fit_list) or 0
    fit_list = fit_list.where(F.col("size") == size)
    rows = prepared(docs, vector, [vec_id], ["vec_id"]).where(F.col("size") == size).select("vec_id", "x")
    kind = rows.schema["vec_id"].dataType
    schema = T.StructType().add("vec_id", kind).add("component", "integer").add("n", "long")
    schema = schema.add("deviation", "long").add("whitened", "double")
    schema = schema.add("explained", "double").add("identity_error", "double")
    fit = fitted(fit_list, size, components)
    error = identity_error(fit_list, size, fit)
    k = len(fit.values)
    share = fit.values / fit.trace if k else fit.values

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows if k else 0, ROWS):
                part = batch.slice(i, ROWS)
                x, each = unpack(part.column(1), size), np.repeat(np.arange(part.num_rows), k)
                m = len(each)
                deviation = pa.array(fit.deviation(x), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)),
                        pa.array(np.full(m, fit.n, np.int64)),
                        deviation.take(pa.array(each)),
                        pa.array(fit.whiten(x).reshape(-1)),
                        pa.array(np.tile(share, part.num_rows)),
                        pa.array(np.full(m, error)),
                    ],
                    schema.names,
                )

    return rows.mapInArrow(by_batches("whitening", run), schema)
