"""Token ids as flat unsigned integer files with 64-bit document offsets.

A shard is three files in the shared folder: ``.ids`` (all ids of its documents, 16 or 32
bits each, little-endian), ``.offsets`` (64-bit, one more than documents, counted in ids
from the start of the shard) and ``.docs`` (64-bit document ids, then a byte for each that
is 0 where the id was null). The bases of the shards are prefix sums over their sizes.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsflow.llm.common import (
    buffers,
    by_batches,
    chunks,
    code_points,
    quoted,
    ranges,
    scratch,
    ship,
    worker_cache,
)
from newsflow.llm.pretokens import ByteLevel, Store, apply, has_any

MANIFEST = "shard int, n_docs long, n_ids long, width int, path string"


@worker_cache
def _encoder(path: str) -> tuple[ByteLevel, Store]:
    model = ByteLevel(path)
    return model, Store(model.encode)


def encode_batch(texts: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids per text, all ids) of successive runs of texts; null is empty. Each distinct
    pre-token is encoded once per worker; texts with strings of added tokens go whole."""
    model, store = _encoder(path)
    data, offsets = buffers(texts)
    special = has_any(texts, model.added) if model.splits else np.ones(len(texts), bool)
    for i, j in chunks(offsets):
        edges = [i, *(i + np.flatnonzero(np.diff(special[i:j])) + 1).tolist(), j]
        for a, b in zip(edges, edges[1:]):
            if special[a]:
                yield model.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
                continue
            points, at = code_points(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            place, n = apply(points, at, store)
            counts = store.count.data[place]
            sums = np.append(0, np.cumsum(counts))
            ends = np.cumsum(n)
            ids = store.ids.data[ranges(store.first.data[place], counts)]
            yield sums[ends] - sums[ends - n], ids


def with_end(counts: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``end`` after the ids of each text."""
    ends = np.cumsum(counts)
    return counts + 1, np.insert(ids, ends, end)


def _filesystem(uri: str):
    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_shards(
    docs: DataFrame, folder: str, path: str, end: int, doc_id: str = "doc_id", text: str = "text"
) -> list:
    """Encode ``docs`` in ascending ``doc_id`` order into shards in ``folder``; the manifest
    rows in order. Ties are ordered by a hash of the text; null ids come first."""
    ship(docs.sparkSession)
    source = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    tie = F.xxhash64("text")
    ordered = (
        source.withColumn("tie", tie)
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
        .select("doc_id", "text")
    )

    def run(batches):
        context = TaskContext.get()
        width = 2 if max(_encoder(path)[0].tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        files, folder_path = _filesystem(folder)
        files.create_dir(folder_path, recursive=True)
        # named after the attempt: only the one that succeeds reports its name
        name = f"{folder_path}/shard-{context.partitionId():06d}-{context.taskAttemptId()}"
        sizes, keys, valid, total = [np.zeros(1, np.int64)], [], [], 0
        with files.open_output_stream(f"{name}.ids") as out:
            for batch in batches:
                keys.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                valid.append(batch.column(0).is_valid().to_numpy(zero_copy_only=False))
                for counts, ids in encode_batch(batch.column(1), path):
                    counts, ids = with_end(counts, ids, end)
                    sizes.append(total + np.cumsum(counts))
                    total += int(counts.sum())
                    out.write(ids.astype(f"<u{width}").tobytes())
        with files.open_output_stream(f"{name}.offsets") as out:
            out.write(np.concatenate(sizes).astype("<i8").tobytes())
        with files.open_output_stream(f"{name}.docs") as out:
            out.write(b"".join(k.astype("<i8").tobytes() for k in keys))
            out.write(b"".join(v.astype("u1").tobytes() for v in valid))
        row = [context.partitionId()], [sum(map(len, keys))], [total], [width], [name]
        types = pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(row, types)],
            names=[f.split()[0] for f in MANIFEST.split(", ")],
        )

    written = ordered.mapInArrow(by_batches("token files", run), MANIFEST)
    return sorted(written.collect(), key=lambda r: r.shard)


def read_shards(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids_crc32``
    (of the ids as little-endian 32-bit integers), from the memory-mapped files."""
    ship(spark)
    shards, base = [], 0
    for row in manifest:
        shards.append((*row, base))
        base += row.n_ids
    schema = f"{MANIFEST}, base long"

    def run(batches):
        files, _ = _filesystem(folder)
        local = isinstance(files, pyarrow.fs.LocalFileSystem)

        def mapped(name, dtype):
            if local and os.path.getsize(name):
                return np.memmap(name, dtype, "r")
            with files.open_input_stream(name) as f:
                return np.frombuffer(f.read(), dtype)

        for batch in batches:
            for r in batch.to_pylist():
                if not r["n_docs"]:
                    continue
                ids = mapped(r["path"] + ".ids", f"<u{r['width']}")
                offsets = mapped(r["path"] + ".offsets", "<i8")
                raw = mapped(r["path"] + ".docs", "u1")
                keys, valid = raw[: 8 * r["n_docs"]].view("<i8"), raw[8 * r["n_docs"] :]
                for i, j in chunks(offsets):
                    part = ids[offsets[i] : offsets[j]].astype("<u4").view("u1").data
                    edges = ((offsets[i : j + 1] - offsets[i]) * 4).tolist()
                    crc = [zlib.crc32(part[a:b]) for a, b in zip(edges, edges[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.array(keys[i:j]), mask=valid[i:j] == 0),
                            pa.array(r["base"] + offsets[i:j]),
                            pa.array(np.diff(offsets[i : j + 1])),
                            pa.array(crc, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    frame = spark.createDataFrame(shards, schema).repartition(max(1, len(shards)))
    return frame.mapInArrow(
        by_batches("token files", run),
        "doc_id long, start long, n_tokens long, ids_crc32 long",
    )


def token_files(
    docs: DataFrame, path: str, end: int = 2, folder: str | None = None, **columns: str
) -> DataFrame:
    """Write the ids of every whole text, each followed by ``end``, as shards in ``folder``
    (default: a new one in ``spark.checkpoint.dir``) and read them back per document.

    Null and empty texts are the end id alone. Null ids come first; rows of one id are in
    the order of a hash of their text. An empty table gives no rows. Only the manifest, a
    row per shard, passes through the driver. A retried task writes files of its own name.
    Pre-tokens are known by a 64-bit hash.
    """
    folder = folder or scratch(docs.sparkSession, "token-files")
    return read_shards(docs.sparkSession, folder, write_shards(docs, folder, path, end, **columns))
