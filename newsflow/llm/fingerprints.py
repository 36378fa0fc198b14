"""Document fingerprints: a digest of bucket quartiles.

Byte triplets taken from a window that slides over the text are hashed into buckets. The
digest holds a code for the length, two quartile ratios, and for every bucket which quarter
of the counts it falls in. Digests are compared by a bounded difference.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsflow.llm.common import (
    buffers,
    by_batches,
    chunks,
    free_name,
    mix,
    quoted,
    ship,
    worker_cache,
)

BUCKETS = 256
#: Offsets of the bytes of each triplet in the window.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
#: Weight of a step in the length code or a quartile ratio, and how many steps count.
HEADER_WEIGHT, HEADER_STEPS = 4, 16
#: A bucket two quarters apart counts 2, three quarters apart 6.
STEP = np.array([0, 1, 2, 6], np.int64)
#: The largest difference that still gives a likeness above 0.
BOUND = BUCKETS * 2


@worker_cache
def _bucket_table() -> np.ndarray:
    """The bucket of a triplet is its entry for two bytes, mixed with that of the third."""
    return (mix(np.arange(len(TRIPLETS) << 16, dtype=np.uint64)) >> np.uint64(40)).astype(np.uint32)


def bucket_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Triplets of each text in each bucket. Triplets never cross texts."""
    n = len(offsets) - 1
    out = np.zeros(n * BUCKETS, np.int64)
    if not len(data):
        return out.reshape(n, BUCKETS)
    table = _bucket_table()
    base = np.repeat(np.arange(n, dtype=np.int32) * BUCKETS, np.diff(offsets))
    wide = data.astype(np.uint32)
    for k, (a, b, c) in enumerate(TRIPLETS):
        m = len(data) - c
        if m <= 0:
            continue
        pair = (wide[a : a + m] << np.uint32(8)) | wide[b : b + m]
        hashed = (table[pair + np.uint32(k << 16)] + wide[c:]) * np.uint32(0x9E3779B1)
        key = base[:m] + (hashed >> np.uint32(24)).astype(np.int32)
        inside = base[:m] == base[c:]
        out += np.bincount(key[inside], minlength=n * BUCKETS)
    return out.reshape(n, BUCKETS)


def digests(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Hex digests: length code, two ratios, then two bits per bucket."""
    out = []
    for i, j in chunks(offsets):
        sizes = np.diff(offsets[i : j + 1])
        counts = bucket_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        ordered = np.sort(counts, axis=1)
        q1, q2, q3 = (ordered[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3))
        code = sum((counts > q[:, None]).astype(np.uint8) for q in (q1, q2, q3))
        body = (code[:, 0::4] << 6) | (code[:, 1::4] << 4) | (code[:, 2::4] << 2) | code[:, 3::4]
        # the length in steps of an eighth of a doubling, ratios in 255ths
        header = np.zeros((j - i, 3), np.uint8)
        header[:, 0] = np.minimum(255, np.round(8 * np.log2(sizes + 1)))
        safe = np.maximum(q3, 1)
        header[:, 1], header[:, 2] = q1 * 255 // safe, q2 * 255 // safe
        whole = np.concatenate([header, body.astype(np.uint8)], axis=1)
        out += [row.tobytes().hex() for row in whole]
    return out


def differences(a: list[str], b: list[str]) -> np.ndarray:
    """Between digests of two lists, place by place."""
    width = 3 + BUCKETS // 4
    x, y = (
        np.frombuffer(bytes.fromhex("".join(v)), np.uint8).reshape(-1, width).astype(np.int64)
        for v in (a, b)
    )
    gap = np.abs(x[:, :3] - y[:, :3])
    gap[:, 1:] //= 16
    score = HEADER_WEIGHT * np.minimum(gap, HEADER_STEPS).sum(1)
    for shift in (6, 4, 2, 0):
        score += STEP[np.abs(((x[:, 3:] >> shift) & 3) - ((y[:, 3:] >> shift) & 3))].sum(1)
    return score


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """1 for equal digests, falling with their difference to 0 at ``BOUND``."""
    if not a:
        return np.zeros(0)
    return 1.0 - np.minimum(differences(a, b), BOUND) / BOUND


def fingerprints_of(texts: pa.Array) -> list[str]:
    return digests(*buffers(texts))


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """``docs`` with the digest of each whole text in the column ``to`` (replaced if there).

    Null counts as empty; texts shorter than a triplet have empty buckets; equal texts have
    equal digests. Rows are independent of each other.
    """
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c.lower() != to.lower()]
    hidden = free_name(docs, "text_digested")
    source = docs.select(*[quoted(c) for c in rest], quoted(text).alias(hidden))
    schema = source.drop(hidden).schema.add(to, "string")

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(hidden))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(fingerprints_of(texts), pa.string())], schema.names
            )

    return source.mapInArrow(by_batches("fingerprints", run), schema)


# Each document next to the one that follows it


def _edited(own: list[str], following: list[str]) -> list[str]:
    """Texts whose last quarter gives way to the start of the following text."""
    out = []
    for a, b in zip(own, following):
        k = len(a) // 4
        out.append(a[: len(a) - k] + b[:k])
    return out


def neighbour_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many
    (or all) of the next row's text, in ascending id order and, for equal ids, by a hash of
    the text; null ids come first and the last row is followed by the first. A single row
    follows itself. Null texts count as empty.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(
        quoted(doc_id).cast("long").alias("doc_id"),
        F.coalesce(quoted(text), F.lit("")).alias("text"),
    ).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    # null ids count as 0 that is not known, so that keys of rows can be compared anywhere
    key = F.struct(
        F.col("doc_id").isNotNull().alias("known"),
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"),
        F.col("tie"),
    )
    cuts = _cuts(source, key)
    group = _group_of(key, cuts)
    keyed = source.withColumn("group", group)
    # the first row of each group also goes to the group before it; a row per group
    firsts = sorted(
        keyed.groupBy("group").agg(F.min(key).alias("first")).collect(), key=lambda r: r[0]
    )
    before = [
        (r.group, r.first.doc_id if r.first.known else None, r.first.tie, firsts[i - 1].group)
        for i, r in enumerate(firsts)
    ]
    leading = spark.createDataFrame(before, "group long, doc_id long, tie long, guest_of long")
    same = (
        (keyed.group == leading.group)
        & keyed.doc_id.eqNullSafe(leading.doc_id)
        & (keyed.tie == leading.tie)
    )
    joined = keyed.join(F.broadcast(leading), same, "left").select(
        keyed.doc_id, keyed.text, keyed.tie, keyed.group, leading.guest_of
    )
    places = F.when(
        F.col("guest_of").isNull(),
        F.array(F.struct(F.col("group").alias("at"), F.lit(False).alias("guest"))),
    ).otherwise(
        F.array(
            F.struct(F.col("group").alias("at"), F.lit(False).alias("guest")),
            F.struct(F.col("guest_of").alias("at"), F.lit(True).alias("guest")),
        )
    )
    placed = joined.select("doc_id", "text", "tie", F.explode(places).alias("p")).select(
        F.col("p.at").alias("at"), F.col("p.guest").alias("guest"), "doc_id", "tie", "text"
    )
    sorted_rows = placed.repartition("at").sortWithinPartitions("at", "guest", *order)
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    names = [f.split()[0] for f in schema.split(", ")]

    def emit(ids, texts, prints, following, following_prints):
        edited = _edited(texts, following)
        edited_prints = fingerprints_of(pa.array(edited, pa.string()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(prints),
                pa.array(edited_prints),
                pa.array(likeness(prints, edited_prints)),
                pa.array(likeness(prints, following_prints)),
            ],
            names=names,
        )

    def run(batches):
        held = None  # the last row so far: its follower comes next
        for batch in batches:
            for i, j in chunks(buffers(batch.column(4))[1]):
                part = batch.slice(i, j - i)
                at, guest, ids = (part.column(k).to_pylist() for k in (0, 1, 2))
                texts = part.column(4).to_pylist()
                rows = list(zip(at, guest, ids, texts, fingerprints_of(part.column(4))))
                if held:
                    rows = [held, *rows]
                pairs = [
                    (a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]
                ]
                held = rows[-1]
                if pairs:
                    own, after = zip(*pairs)
                    yield emit(
                        [r[2] for r in own],
                        [r[3] for r in own],
                        [r[4] for r in own],
                        [r[3] for r in after],
                        [r[4] for r in after],
                    )

    return sorted_rows.mapInArrow(by_batches("fingerprints", run), schema)


#: Rows that are looked at to cut the table into groups, for each group.
LOOKED_AT = 64


def _cuts(rows: DataFrame, key: Column) -> list:
    """Keys that cut the rows into about as many groups as there are shuffle partitions, from
    about ``LOOKED_AT`` rows for each, whatever the number of rows. They only say where groups
    end: of many rows with one id, each goes to a group by its tie."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, parts * LOOKED_AT / max(rows.count(), 1))
    seen = rows.where(F.rand(7) < share).select(key.alias("key")).collect()
    seen = sorted(tuple(r.key) for r in seen)
    return sorted({seen[len(seen) * i // parts] for i in range(1, parts)}) if seen else []


def _group_of(key: Column, cuts: list, step: int = 256) -> Column:
    """How many cuts are at or below the key. Every 256th cut is compared first, then those up
    to the next of these."""
    if not cuts:
        return F.lit(0).cast("long")

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c <= key))

    def literal(cut) -> Column:
        if not isinstance(cut, tuple):
            return F.lit(cut).cast("long")
        known, doc_id, tie = cut
        return F.struct(
            F.lit(known).alias("known"),
            F.lit(doc_id).cast("long").alias("doc_id"),
            F.lit(tie).cast("long").alias("tie"),
        )

    def array(values: list) -> Column:
        return F.array(*map(literal, values))

    skip = F.greatest(below(array(cuts[::step])) - 1, F.lit(0)) * step
    return F.coalesce(skip + below(F.slice(array(cuts), skip + 1, step)), F.lit(0)).cast("long")
