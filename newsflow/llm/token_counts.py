"""Token counts: whole-token shortcut.

The driver proves once which vocabulary strings encode alone as one token. Workers split
texts into pre-tokens, count those strings directly and let the library merge only the
rest, each distinct pre-token once per worker.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsflow.llm.common import (
    buffers,
    by_batches,
    chunks,
    code_points,
    free_name,
    put,
    quoted,
    ship,
    worker_cache,
)
from newsflow.llm.pretokens import ByteLevel, Store, apply, has_any

LIMIT = 1024


@worker_cache
def _counter(path: str) -> tuple[ByteLevel, Store]:
    model = ByteLevel(path)
    return model, Store(model.encode, counts_only=True)


def count_batch(texts: pa.Array, path: str, whole: np.ndarray) -> np.ndarray:
    """Tokens of each text; null has none."""
    model, store = _counter(path)
    if not len(store) and len(whole):
        store.add(whole, np.ones(len(whole), np.int64), np.zeros(0, np.int32))
    data, offsets = buffers(texts)
    out = np.zeros(len(texts), np.int64)
    special = has_any(texts, model.added) if model.splits else np.ones(len(texts), bool)
    for i, j in chunks(offsets):
        if not model.splits:
            break
        points, at = code_points(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        place, n = apply(points, at, store)
        sums = np.append(0, np.cumsum(store.count.data[place]))
        ends = np.cumsum(n)
        out[i:j] = sums[ends] - sums[ends - n]
    rows = np.flatnonzero(special)
    for i in range(0, len(rows), 256):
        part = rows[i : i + 256]
        out[part] = model.encode([t or "" for t in texts.take(pa.array(part)).to_pylist()])[0]
    return out


def token_counts(
    docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than
    ``limit`` tokens) of the column ``text``; of these names, columns of ``docs`` are
    replaced.

    Counts equal the tokenizers library's for the file at ``path``, without added tokens;
    strings of special tokens inside a text count as the library counts them by default.
    A null or empty text has 0 bytes and 0 tokens. Rows are independent: repeated rows,
    null ids and an empty table need nothing special. Files whose split is not the
    byte-level one are counted by encoding whole texts. Pre-tokens are known by a 64-bit hash,
    which two of a million mistake for each other with a chance of 3 in 100 million.
    """
    ship(docs.sparkSession)
    whole = ByteLevel(path).whole_tokens()
    rest = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    count = free_name(docs, "n_tokens_counted")
    source = docs.select(*[quoted(c) for c in dict.fromkeys([*rest, text])])
    schema = source.drop(text).schema if text not in rest else source.schema
    schema = type(schema)([*schema.fields]).add("n_bytes", "long").add(count, "long")
    keep = [f.name for f in schema.fields[:-2]]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            size = np.diff(buffers(texts)[1])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            counts = count_batch(texts, path, whole)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(size), pa.array(counts)], [*keep, "n_bytes", count]
            )

    found = source.mapInArrow(by_batches("token counts", run), schema)
    return put(
        found, n_tokens=quoted(count), over_limit=F.coalesce(quoted(count) > limit, F.lit(False))
    ).drop(count)
