"""Helpers shared by the operators: scratch folders, Arrow buffers and rolling hashes."""

from __future__ import annotations

import ctypes
import functools
import gc
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Elements that a vectorised step holds at once; a single longer text is held whole.
CHUNK = 1 << 19
ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when they do not see its folder."""
    roots = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if str(ROOT) in [os.path.realpath(r) for r in roots if r]:
        return
    context = spark.sparkContext
    if getattr(context, "_newsflow_shipped", False):
        return
    package = Path(tempfile.mkdtemp()) / "newsflow.zip"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted((ROOT / "newsflow").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    package.write_bytes(data.getvalue())
    context.addPyFile(str(package))
    context._newsflow_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors see. It is set here only
    where the session has none, which is right for a single machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(spark.sparkContext, "_newsflow_shared", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not folder:
        folder = Path(tempfile.mkdtemp(prefix="newsflow-")).as_uri()
        spark.sparkContext._newsflow_shared = folder
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Has Spark delete the shuffle files of a query once the query is over.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which ends its lineage. The shuffle
    files of the writing query are deleted with its end."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._newsflow_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df`` (its own result), once nothing will read it again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._newsflow_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def put(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with these columns; columns of the same names (in any case) are replaced."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in columns}]).select(
        "*", *[c.alias(n) for n, c in columns.items()]
    )


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def pieces(spark: SparkSession, total: int, each: int) -> int:
    """How many groups of about ``each`` hold ``total``; at least one per shuffle partition."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // each), 1)


# Python workers are used again by later tasks, so what one leaves behind stays in memory

_CACHES: list = []
_WORKING_FOR: list[str] = []


def worker_cache(make: Callable) -> Callable:
    """Keeps the last result of ``make`` until the worker turns to another operator."""
    kept = functools.lru_cache(maxsize=1)(make)
    _CACHES.append(kept)
    return kept


def trim() -> None:
    """Give memory that is not in use back to the system, where it can be done."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def _turn_to(operator: str) -> None:
    if _WORKING_FOR != [operator]:
        _WORKING_FOR[:] = [operator]
        for cache in _CACHES:
            cache.cache_clear()
        gc.collect()


def by_batches(operator: str, run: Callable) -> Callable:
    """``run``, a function from batches to batches, as a task of ``operator``."""

    def task(batches):
        _turn_to(operator)
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def by_group(operator: str, run: Callable) -> Callable:
    """``run``, a function from a group's table to a table, as a task of ``operator``."""

    def task(table: pa.Table) -> pa.Table:
        _turn_to(operator)
        try:
            return run(table)
        finally:
            trim()

    return task


def by_two_groups(operator: str, run: Callable) -> Callable:
    """The same for a function of the tables of two groups."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        _turn_to(operator)
        try:
            return run(left, right)
        finally:
            trim()

    return task


# Arrow


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and its offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    kind = pa.large_string() if pa.types.is_string(texts.type) else texts.type
    kind = pa.large_binary() if pa.types.is_binary(texts.type) else kind
    texts = texts.cast(kind)
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_large_string(kind) else b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return (
        np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]),
        offsets - offsets[0],
    )


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``limit`` elements, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes as code points, with offsets counted in code points."""
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, lead[offsets]


def split_rows(flat: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for ``count`` elements of each start, one after another."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.repeat(np.asarray(starts, np.int64) - first, counts) + np.arange(total)


# Rolling hashes: sums of mixed values times powers of an odd base, modulo 2 to the 64

BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@worker_cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for b in (BASE, inverse):
        p = np.full(n, b, U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK + 1024
    while size < n:
        size *= 2
    up, down = _powers(size)
    return up[:n], down[:n]


BYTE_VALUES = mix(np.arange(1, 257, dtype=U))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """One longer than ``values``; feed to ``span_hash``."""
    sums = np.zeros(len(values) + 1, U)
    up, _ = powers(len(values) + 1)
    np.cumsum(values * up[: len(values)], dtype=U, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: of its values and its length."""
    _, down = powers(len(sums))
    return mix(
        (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93)
    )
