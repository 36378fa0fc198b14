"""Embedding columns as exact whole numbers, packed into as few bytes as a row needs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsflow.llm.common import ranges

#: Whole numbers stop here, far beyond any embedding.
FURTHEST = 1 << 52
WIDTHS = (2, 4, 8)
LIMB = 1 << 32


def whole(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * entry) of a list column: the rows whose vector is there and holds only
    finite entries, the length of each, and all their entries one after another."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    there = vectors.is_valid().to_numpy(zero_copy_only=False)
    edges = vectors.offsets.to_numpy().astype(np.int64)
    entries = vectors.values.cast(pa.float64())
    value = entries.to_numpy(zero_copy_only=False)  # null becomes NaN
    bad = np.append(0, np.cumsum(~np.isfinite(value)))
    rows = np.flatnonzero(there & (bad[edges[1:]] == bad[edges[:-1]]))
    size = (edges[1:] - edges[:-1])[rows]
    value = np.floor(scale * value[ranges(edges[:-1][rows], size)])
    return rows, size, np.clip(value, -FURTHEST, FURTHEST).astype(np.int64)


def pack(size: np.ndarray, values: np.ndarray) -> pa.Array:
    """Rows as little-endian numbers of 2, 4 or 8 bytes: the least that holds the whole row,
    so that equal rows have equal bytes."""
    ends = np.cumsum(size)
    out = np.empty(len(size), object)
    top = np.zeros(len(size), np.int64)
    some = np.flatnonzero(size)
    if len(some):
        top[some] = np.maximum.reduceat(np.maximum(values, -(values + 1)), (ends - size)[some])
    for k, width in enumerate(WIDTHS):
        low = 1 << (8 * WIDTHS[k - 1] - 1) if k else 0
        chosen = np.flatnonzero((top >= low) & ((width == 8) | (top < 1 << (8 * width - 1))))
        if not len(chosen):
            continue
        raw = values[ranges((ends - size)[chosen], size[chosen])].astype(f"<i{width}").tobytes()
        at = np.append(0, np.cumsum(size[chosen] * width)).tolist()
        out[chosen] = [raw[a:b] for a, b in zip(at, at[1:])]
    return pa.array(out, pa.binary())


def unpack(packed: pa.Array, size: int) -> np.ndarray:
    """A matrix of the packed rows, which all hold ``size`` numbers."""
    rows = packed.to_pylist()
    out = np.zeros((len(rows), size), np.int64)
    if size:
        width = np.fromiter(map(len, rows), np.int64, len(rows)) // size
        for w in np.unique(width).tolist():
            chosen = np.flatnonzero(width == w)
            raw = b"".join([rows[i] for i in chosen])
            out[chosen] = np.frombuffer(raw, f"<i{w}").reshape(len(chosen), size)
    return out


def common_size(rows: DataFrame, size: str = "size") -> int | None:
    """The commonest value of ``size``, the greater of equals; None without rows."""
    counts = rows.groupBy(size).agg(F.count("*").alias("rows_of_size"))
    first = counts.orderBy(F.desc("rows_of_size"), F.desc(size)).first()
    return first[size] if first else None


def roomy(values: np.ndarray, bits: int) -> np.ndarray:
    """``values`` as 64-bit numbers where all are below 2 to ``bits``, else as Python's, which
    take any size."""
    if not values.size or max(int(values.max()), -int(values.min())) < 1 << bits:
        return values.astype(np.int64)
    return values.astype(object)


def column_sums(values: np.ndarray) -> list[int]:
    """Exact sums over the rows of a matrix of whole numbers."""
    if values.dtype == object:
        return [int(x) for x in values.sum(0)] if len(values) else [0] * values.shape[1]
    high, low = (values >> 32).sum(0), (values & (LIMB - 1)).sum(0)
    return [(int(h) << 32) + int(v) for h, v in zip(high, low)]


def limbs(numbers: list[int], count: int) -> list[pa.Array]:
    """Numbers as ``count`` columns of 32 bits each, lowest first, the last with the sign:
    columns may be summed one by one and put together by ``from_limbs``."""
    out = []
    for k in range(count):
        last = k == count - 1
        out.append(pa.array([n if last else n % LIMB for n in numbers], pa.int64()))
        numbers = [n >> 32 for n in numbers]
    return out


def from_limbs(parts) -> int:
    return sum(int(p) << (32 * k) for k, p in enumerate(parts))
