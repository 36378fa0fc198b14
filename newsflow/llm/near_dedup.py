"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Texts become sets of word shingles weighted by term frequency times inverse document
frequency. Document frequencies are counted in a fixed number of hashed cells, once over all
texts and once over the different word sequences: many exact copies make their own shingles
common, and near copies of them would be lost by the first weights alone. Each text is sampled
consistently (equal samples with the probability of the weighted Jaccard similarity), samples
are banded into buckets, and links are verified by the weighted Jaccard similarity itself, by
either weights. Classes are the connected components.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from newsflow.llm.common import (
    CHUNK,
    buffers,
    by_batches,
    by_group,
    chunks,
    cut,
    drop_cut,
    free_name,
    mix,
    prefix_sums,
    quoted,
    ranges,
    ship,
    span_hash,
)
from newsflow.llm.components import beside, components
from newsflow.llm.decontaminate import words

SHINGLE = 5
SIMILARITY = 0.8
#: 12 bands of 3 samples: a pair of similarity 0.8 shares a bucket with chance 0.9997.
BANDS, ROWS = 12, 3
#: Document frequencies are kept for so many hashed cells, whatever the number of texts.
CELL_BITS = 18
SLICES = 32
#: Texts that lose a larger share of their weight to copies are sampled by both weights.
LOSS = 0.02
#: Members of a bucket, and bytes of their shingles, that one comparison block holds.
BLOCK, BLOCK_BYTES = 2048, 4 << 20
#: Bytes that name a shingle: two shingles of a pair of texts of 1,000 words are mistaken for
#: each other once in a million pairs.
NAME_BYTES = 5
_DROPPED_BITS = 64 - 8 * NAME_BYTES
_U = np.uint64


@dataclass
class Shingles:
    """Distinct shingles of a run of texts, sorted by text and hash."""

    first: np.ndarray  # where each text's shingles start, one more than texts
    hashes: np.ndarray
    counts: np.ndarray


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> Shingles:
    """A text of fewer words than ``size``, but not none, is one shingle."""
    n = len(offsets) - 1
    _, _, word, n_words = words(data, offsets)
    ends = np.cumsum(n_words)
    starts = ends - n_words
    sums = prefix_sums(word)
    per = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    owner = np.repeat(np.arange(n), per)
    at = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + starts[owner]
    value = span_hash(sums, at, at + np.minimum(n_words[owner], size))
    value &= ~_U((1 << _DROPPED_BITS) - 1)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(value)))
    first = np.searchsorted(owner[at], np.arange(n + 1))
    return Shingles(first, value[at], counts)


def sequence_keys(data: np.ndarray, offsets: np.ndarray):
    """Two hashes of each text's word sequence, and whether it has words."""
    _, _, word, n_words = words(data, offsets)
    ends = np.cumsum(n_words)
    starts = ends - n_words
    each = (prefix_sums(w) for w in (word, mix(word ^ _U(0x5851F42D4C957F2D))))
    return *(span_hash(sums, starts, ends) for sums in each), n_words > 0


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - CELL_BITS)).astype(np.int64)


def runs(texts: pa.Array):
    """(rows from, rows to, shingles) of successive runs of texts."""
    data, offsets = buffers(texts)
    for i, j in chunks(offsets):
        yield i, j, shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def pack(s: Shingles) -> tuple[pa.Array, pa.Array]:
    """The names of each text's shingles, and (place, count) of those found more than once,
    null where there are none."""
    raw = (s.hashes >> _U(_DROPPED_BITS)).astype("<u8").view(np.uint8).reshape(-1, 8)
    edges = pa.array(s.first.astype(np.int64) * NAME_BYTES)
    names = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(),
        len(s.first) - 1,
        [None, edges.buffers()[1], pa.py_buffer(raw[:, :NAME_BYTES].tobytes())],
    )
    more: list[bytes | None] = [None] * (len(s.first) - 1)
    again = np.flatnonzero(s.counts > 1)
    owner = np.searchsorted(s.first, again, "right") - 1
    pairs = np.stack([again - s.first[owner], np.minimum(s.counts[again], 0xFFFFFFFF)], 1).astype("<u4")
    texts, at = np.unique(owner, return_index=True)
    for text, a, b in zip(texts.tolist(), at.tolist(), [*at[1:].tolist(), len(again)]):
        more[text] = pairs[a:b].tobytes()
    return names.cast(pa.binary()), pa.array(more, pa.binary())


def unpack(names: pa.Array, more: pa.Array) -> Shingles:
    data, offsets = buffers(names)
    raw = np.zeros((len(data) // NAME_BYTES, 8), np.uint8)
    raw[:, :NAME_BYTES] = data.reshape(-1, NAME_BYTES)
    first = offsets // NAME_BYTES
    counts = np.ones(len(raw), np.int64)
    pairs, edges = buffers(more)
    pairs = np.frombuffer(pairs.tobytes(), "<u4").reshape(-1, 2)
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges) // 8)
    counts[first[owner] + pairs[:, 0]] = pairs[:, 1]
    return Shingles(first, raw.view("<u8").reshape(-1) << _U(_DROPPED_BITS), counts)


def unpacked_runs(names: pa.Array, more: pa.Array):
    """(rows from, rows to, shingles) of successive runs of packed texts."""
    _, offsets = buffers(names)
    for i, j in chunks(offsets, CHUNK * NAME_BYTES):
        yield i, j, unpack(names.slice(i, j - i), more.slice(i, j - i))


def frequencies(df: DataFrame, counted) -> list[np.ndarray]:
    """For each weighing that ``counted(batch)`` yields (cells and their counts, then how many
    texts they are of), ln(1 + texts / frequency) of every cell."""
    size = 1 << CELL_BITS
    width = size // SLICES

    def count(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for kind, found, n in counted(batch):
                one = total.setdefault(kind, [np.zeros(size, np.int64), 0])
                one[0] += found
                one[1] += n
        for kind, (found, n) in total.items():
            parts = [found[k * width : (k + 1) * width].astype("<i8").tobytes() for k in range(SLICES)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([kind] * SLICES, pa.int32()),
                    pa.array(range(SLICES), pa.int32()),
                    pa.array(parts, pa.binary()),
                    pa.array([n] + [0] * (SLICES - 1), pa.int64()),
                ],
                names=["kind", "slice", "counts", "n"],
            )

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for part in table.column("counts").to_pylist():
            total += np.frombuffer(part, "<i8")
        first = table.slice(0, 1)
        n = pa.array([sum(table.column("n").to_pylist())], pa.int64())
        return pa.table(
            {
                "kind": first["kind"],
                "slice": first["slice"],
                "counts": pa.array([total.tobytes()], pa.binary()),
                "n": n,
            }
        )

    schema = "kind int, slice int, counts binary, n long"
    parts = df.mapInArrow(by_batches("near dedup", count), schema).groupBy("kind", "slice")
    rows = sorted(parts.applyInArrow(by_group("near dedup", add), schema).collect())
    out = []
    for kind in sorted({r.kind for r in rows}):
        mine = [r for r in rows if r.kind == kind]
        df_ = np.concatenate([np.frombuffer(r.counts, "<i8") for r in mine])
        out.append(np.log1p(sum(r.n for r in mine) / np.maximum(df_, 1)).astype(np.float32))
    return out


def idf_table(docs: DataFrame, text: str) -> np.ndarray:
    """ln(1 + texts / frequency) for each cell, counted over all rows of ``docs``."""

    def counted(batch):
        found = np.zeros(1 << CELL_BITS, np.int64)
        for _, _, s in runs(batch.column(0)):
            found += np.bincount(cells(s.hashes), minlength=1 << CELL_BITS)
        yield 0, found, batch.num_rows

    found = frequencies(docs.select(quoted(text)), counted)
    return found[0] if found else np.ones(1 << CELL_BITS, np.float32)


def idf_tables(unique: DataFrame) -> list[np.ndarray]:
    """The same over all rows, and, where rows repeat a text, over the different texts as well;
    from the different word sequences, ``copies`` of each and their packed shingles. The row
    of the texts without words counts as rows, and as no text."""

    def counted(batch):
        copies = batch.column(0).to_numpy()
        yield 0, 0, int(copies.sum())
        for i, j, s in unpacked_runs(batch.column(1), batch.column(2)):
            per, cell = np.diff(s.first), cells(s.hashes)
            # weights are whole numbers far below 2 to the 53
            rows = np.bincount(cell, np.repeat(copies[i:j], per), 1 << CELL_BITS)
            yield 0, rows.astype(np.int64), 0
            yield 1, np.bincount(cell, minlength=1 << CELL_BITS), int((per > 0).sum())

    repeated = F.coalesce(F.sum((F.col("copies") > 1).cast("long")), F.lit(0))
    some = unique.where("k1 is not null").agg(repeated).first()[0]
    found = frequencies(unique.select("copies", "names", "more"), counted)
    return found[: 2 if some else 1] or [np.ones(1 << CELL_BITS, np.float32)]


def sample(s: Shingles, idf: np.ndarray, samples: int) -> np.ndarray:
    """One row of consistent samples per text; texts without shingles have zeros.

    For each shingle and sample: r and c from Gamma(2, 1), b uniform, all from a hash;
    t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r. The shingle with the
    smallest a, together with its t, is the sample.
    """
    n = len(s.first) - 1
    out = np.zeros((n, samples), _U)
    filled = np.flatnonzero(np.diff(s.first))
    unit = np.float32(2.0**-21)
    mask = _U((1 << 21) - 1)
    i = 0
    while i < len(filled):
        # texts of about 32,000 shingles together, which fit a cache
        j = int(np.searchsorted(s.first[filled], s.first[filled[i]] + 32_768))
        j = max(j, i + 1)
        texts = filled[i:j]
        i = j
        a, b = s.first[texts[0]], s.first[texts[-1] + 1]
        h, edge = s.hashes[a:b], s.first[texts] - a
        weight = s.counts[a:b].astype(np.float32) * idf[cells(h)]
        log_weight = np.log(weight)
        per = np.diff(np.append(edge, b - a))
        for k in range(samples):
            x = (h ^ mix(np.array([k + 1], _U))) * _U(0xFF51AFD7ED558CCD)
            x ^= x >> _U(33)
            x *= _U(0xC4CEB9FE1A85EC53)
            x ^= x >> _U(29)
            y = x * _U(0x9FB21C651E98DF25)
            y ^= y >> _U(32)
            u = [
                ((v & mask).astype(np.float32) + np.float32(0.5)) * unit
                for v in (x >> _U(43), x >> _U(22), y >> _U(43), y >> _U(22), y)
            ]
            r = -np.log(u[0] * u[1])
            t = np.floor(log_weight / r + u[4])
            value = np.log(-np.log(u[2] * u[3])) - r * (t - u[4]) - r
            least = np.minimum.reduceat(value, edge)
            hit = np.flatnonzero(value == np.repeat(least, per))
            where = np.searchsorted(hit, edge)
            chosen = hit[where]
            out[texts, k] = mix(h[chosen] ^ mix(t[chosen].astype(np.int64).view(_U)))
    return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A bucket number per text and band; bands have buckets of their own."""
    grid = samples.reshape(-1, bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=_U), grid.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) + grid[:, :, k])
    return key


def weighted_jaccard(a, b, idf: np.ndarray) -> float:
    """Of two (hashes, counts)."""
    (ha, ca), (hb, cb) = a, b
    wa, wb = ca * idf[cells(ha)], cb * idf[cells(hb)]
    _, x, y = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    shared = float(np.minimum(wa[x], wb[y]).sum())
    total = float(wa.sum() + wb.sum()) - shared
    return shared / total if total else 0.0


def lighter(s: Shingles, rows: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Whether a text weighs less by ``rows``, the weights over all rows, than by ``texts``, those
    over the different texts, scaled so that no shingle weighs more by ``rows``. Where one of two
    texts loses a share of at most LOSS, their similarity falls by at most LOSS."""
    n, at = len(s.first) - 1, cells(s.hashes)
    owner = np.repeat(np.arange(n), np.diff(s.first))
    have = np.bincount(owner, s.counts * rows[at], n)
    full = np.bincount(owner, s.counts * texts[at], n) * float((rows / texts).max())
    return have < (1 - LOSS) * full


def shingled(docs: DataFrame) -> DataFrame:
    """doc_id, k1 and k2 (of the word sequence) and its packed shingles, from doc_id and text;
    all but doc_id null without words."""

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in chunks(offsets):
                part = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                k1, k2, filled = sequence_keys(*part)
                names, more = pack(shingles(*part))
                keys = [pa.array(k.view(np.int64), mask=~filled) for k in (k1, k2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *keys, names, more],
                    ["doc_id", "k1", "k2", "names", "more"],
                )

    schema = "doc_id long, k1 long, k2 long, names binary, more binary"
    return docs.mapInArrow(by_batches("near dedup", run), schema)


def keyed(docs: DataFrame, text: str, k1: str, k2: str) -> DataFrame:
    """``docs`` with two hashes of each text's word sequence; those without words have no
    second one, and a first one that is as good as random."""
    hidden = free_name(docs, "text_keyed")
    source = docs.select("*", quoted(text).alias(hidden))
    schema = T.StructType([*docs.schema.fields]).add(k1, "long").add(k2, "long")

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            data, offsets = buffers(texts)
            for i, j in chunks(offsets):
                part = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                first, second, filled = sequence_keys(*part)
                first = np.where(filled, first, mix(np.arange(i, j).astype(_U)))
                columns = [c.slice(i, j - i) for c in batch.columns[:-1]]
                keys = [pa.array(first.view(np.int64)), pa.array(second.view(np.int64), mask=~filled)]
                yield pa.RecordBatch.from_arrays([*columns, *keys], schema.names)

    return source.mapInArrow(by_batches("near dedup", run), schema)


def signatures(unique: DataFrame, idf, bands: int, rows: int) -> DataFrame:
    """node, rep and buckets, from node, rep and packed shingles."""

    def run(batches):
        first, *others = idf.value
        for batch in batches:
            for i, j, s in unpacked_runs(batch.column(2), batch.column(3)):
                keys = band_keys(sample(s, first, bands * rows), bands, rows)
                owner = np.arange(j - i)
                for table in others:
                    again = lighter(s, first, table)
                    per = np.diff(s.first)
                    part = np.repeat(again, per)
                    edge = np.append(0, np.cumsum(per[again]))
                    some = Shingles(edge, s.hashes[part], s.counts[part])
                    more = band_keys(sample(some, table, bands * rows), bands, rows)
                    owner = np.append(owner, np.flatnonzero(again))
                    keys = np.concatenate([keys, more])
                order = np.argsort(owner, kind="stable")
                edges = np.append(0, np.cumsum(np.bincount(owner, minlength=j - i))) * bands
                values = pa.array(keys[order].reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists],
                    names=["node", "rep", "buckets"],
                )

    source = unique.select("node", "rep", "names", "more")
    found = source.mapInArrow(by_batches("near dedup", run), "node long, rep long, buckets array<long>")
    return found.withColumn("buckets", F.array_distinct("buckets"))


def similar(a: Shingles, b: Shingles, tables, least: float) -> np.ndarray:
    """Of texts side by side: whether their similarity is at least ``least`` by one of the
    weights."""
    n = len(a.first) - 1
    owner_a, owner_b = (np.repeat(np.arange(n), np.diff(s.first)) for s in (a, b))
    # ascending: by text, then by name
    shift = _U(8 * NAME_BYTES)
    key_a, key_b = (
        (owner.astype(_U) << shift) | (s.hashes >> _U(_DROPPED_BITS)) for owner, s in ((owner_a, a), (owner_b, b))
    )
    at = np.minimum(np.searchsorted(key_a, key_b), max(len(key_a) - 1, 0))
    hit = np.flatnonzero(key_a[at] == key_b) if len(key_a) else np.zeros(0, np.int64)
    both = np.minimum(a.counts[at[hit]], b.counts[hit]) if len(hit) else np.zeros(0)
    out = np.zeros(n, bool)
    for table in tables:
        weight_a, weight_b = (s.counts * table[cells(s.hashes)].astype(float) for s in (a, b))
        shared = np.bincount(owner_b[hit], both * table[cells(b.hashes[hit])].astype(float), n)
        total = np.bincount(owner_a, weight_a, n) + np.bincount(owner_b, weight_b, n) - shared
        likeness = shared / np.where(total > 0, total, 1)
        out |= likeness >= least
        for k in np.flatnonzero(np.abs(likeness - least) < 1e-9).tolist():
            # sums in another order could fall on the other side
            out[k] = any(weighted_jaccard(_of(a, k), _of(b, k), t) >= least for t in tables)
    return out


def _of(s: Shingles, k: int):
    part = slice(s.first[k], s.first[k + 1])
    return s.hashes[part], s.counts[part].astype(float)


def verified(pairs: DataFrame, unique: DataFrame, idf, least: float) -> DataFrame:
    """The pairs ``a``, ``b`` whose weighted Jaccard similarity is at least ``least`` by one of
    the weights."""
    left, right = (
        unique.select(F.col("node").alias(n), F.col("names").alias(f"{n}_names"), F.col("more").alias(f"{n}_more"))
        for n in ("a", "b")
    )

    def run(batches):
        for batch in batches:
            sizes = buffers(batch.column(2))[1] + buffers(batch.column(4))[1]
            for i, j in chunks(sizes, CHUNK * NAME_BYTES):
                part = batch.slice(i, j - i)
                sets = unpack(part.column(2), part.column(3)), unpack(part.column(4), part.column(5))
                near = pa.array(similar(*sets, idf.value, least))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(near)

    both = pairs.join(right, "b").join(left, "a")
    both = both.select("a", "b", "a_names", "a_more", "b_names", "b_more")
    return both.mapInArrow(by_batches("near dedup", run), "a long, b long")


def block_links(members: DataFrame, unique: DataFrame, idf, least: float) -> DataFrame:
    """Links between members of a bucket that are in different components. ``members`` has
    bucket, node, component and bytes (of the packed shingles, which ``unique`` holds).

    The members of a bucket's largest component need no comparison among themselves. All
    others are asked: blocks of them meet blocks of all members. In a block only texts that
    share shingles meet, by lists of the holders of each. Only links come out, and none
    between members that others already join.
    """
    per = members.groupBy("bucket", "component").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes")
    )
    largest = F.max(F.struct("n", "component"))["component"].alias("largest")
    total = per.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), largest)
    rest = per.join(total.select("bucket", "largest"), "bucket").where("component <> largest")
    rest = rest.groupBy("bucket").agg(F.sum("n").alias("m"), F.sum("bytes").alias("m_bytes"))

    def blocks(count, held):
        return F.ceil(F.greatest(F.col(count) / BLOCK, F.col(held) / BLOCK_BYTES)).cast("int")

    dealt = total.join(rest, "bucket").select(
        "bucket", "largest", blocks("n", "bytes").alias("p_of"), blocks("m", "m_bytes").alias("q_of")
    )
    met = members.join(dealt, "bucket").withColumn("asked", F.col("component") != F.col("largest"))
    own = F.xxhash64("node")
    p, q = F.pmod(own, F.col("p_of")).cast("int"), F.pmod(own, F.col("q_of")).cast("int")

    def every(count):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    columns = ["bucket", "p", "q", "asks", "asked", "node", "component"]
    held = met.withColumn("p", p).withColumn("q", every("q_of")).withColumn("asks", F.lit(False))
    asking = met.where("asked").withColumn("q", q).withColumn("p", every("p_of")).withColumn("asks", F.lit(True))
    spread = held.select(columns).unionByName(asking.select(columns))
    spread = spread.join(unique.select("node", "names", "more"), "node")

    def compare(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        asked = group.column("asked").to_numpy()
        node = group.column("node").to_numpy()
        label = group.column("component").to_numpy().copy()
        s = unpack(group.column("names").combine_chunks(), group.column("more").combine_chunks())
        per = np.diff(s.first)
        owner = np.repeat(np.arange(len(per)), per)
        inside = np.flatnonzero(~asks[owner])
        order = inside[np.argsort(s.hashes[inside], kind="stable")]
        # lists of holders: the rows of each shingle, one list after another
        holder, holder_count = owner[order], s.counts[order]
        names = s.hashes[order]
        a, b = [], []
        for table in idf.value:
            weight = table[cells(s.hashes)].astype(float)
            size = np.bincount(owner, s.counts * weight, len(per))
            for i in np.flatnonzero(asks).tolist():
                mine = slice(s.first[i], s.first[i + 1])
                lo = np.searchsorted(names, s.hashes[mine])
                many = np.searchsorted(names, s.hashes[mine], "right") - lo
                at = ranges(lo, many)
                both = np.minimum(holder_count[at], np.repeat(s.counts[mine], many))
                shared = np.bincount(holder[at], both * np.repeat(weight[mine], many), len(per))
                near = shared >= (least - 1e-6) * (size + size[i] - shared)
                # of two that are asked, one asking is enough
                near &= ~asks & (label != label[i]) & (~asked | (node > node[i]))
                for k in np.flatnonzero(near).tolist():
                    if label[k] != label[i] and weighted_jaccard(_of(s, i), _of(s, k), table) >= least:
                        a.append(node[i])
                        b.append(node[k])
                        label[label == label[k]] = label[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return spread.groupBy("bucket", "p", "q").applyInArrow(
        by_group("near dedup", compare), "a long, b long"
    )


def sequence_classes(docs: DataFrame, similarity: float, bands: int, rows: int) -> DataFrame:
    """``k1``, ``k2`` and ``class_id`` of every word sequence that has an id, from doc_id and
    text. Texts are cut into shingles once; only shingles are moved, and each sequence's
    once, however many rows repeat it."""
    spark = docs.sparkSession
    unique = shingled(docs).groupBy("k1", "k2").agg(
        F.min("doc_id").alias("rep"),
        F.first("names").alias("names"),
        F.first("more").alias("more"),
        F.count("*").alias("copies"),
    )
    everything = cut(unique.withColumn("node", F.monotonically_increasing_id()), "shingles")
    idf = spark.sparkContext.broadcast(idf_tables(everything))
    unique = everything.where("k1 is not null and rep is not null")
    signed = cut(signatures(unique, idf, bands, rows), "signatures")
    met = signed.select("node", "rep", F.explode("buckets").alias("bucket"))
    smallest = F.min(F.struct("rep", "node"))["node"].alias("pivot")
    shared = met.groupBy("bucket").agg(smallest, F.count("*").alias("n")).where("n > 1")
    members = cut(met.join(shared, "bucket").select("bucket", "pivot", "node"), "buckets")
    drop_cut(signed)
    pairs = members.where("pivot <> node").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    links = cut(verified(pairs.distinct(), unique, idf, similarity), "links")
    # buckets with more than one component left
    label = components(links)
    drop_cut(links)
    labelled = members.join(label, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component")
    )
    open_buckets = labelled.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    )
    unsettled = labelled.join(open_buckets.where("low < high").select("bucket"), "bucket", "left_semi")
    sizes = unique.select("node", F.octet_length("names").alias("bytes"))
    unsettled = cut(unsettled.join(sizes, "node"), "unsettled")
    drop_cut(members)
    more = cut(block_links(unsettled, unique, idf, similarity), "links")
    drop_cut(unsettled)
    if not more.isEmpty():
        # the stars found so far stand for their links
        stars = label.where("node <> component").select(
            F.col("component").alias("a"), F.col("node").alias("b")
        )
        before, label = label, components(stars.unionByName(more))
        drop_cut(before)
    drop_cut(more)
    reps = unique.select("k1", "k2", "node", "rep")
    least = label.join(reps, "node").groupBy(F.col("component").alias("u")).agg(F.min("rep").alias("m"))
    found = beside(label.select(F.col("component").alias("u"), F.col("node").alias("v")), least)
    class_of = reps.join(found.select(F.col("v").alias("node"), "m"), "node", "left").select(
        "k1", "k2", F.coalesce("m", "rep").alias("class_id")
    )
    out = cut(class_of, "classes")
    drop_cut(label)
    drop_cut(everything)
    idf.unpersist()
    return out


def near_duplicate_classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``doc_id`` and ``class_id`` (the smallest id of its class) for every row.

    Two texts are linked if their words are the same, or if they meet in a bucket and the
    weighted Jaccard similarity of their shingles is at least ``similarity``, with frequencies
    counted over all rows or over the different texts; classes are connected components. In a
    bucket everyone is compared with the smallest id first; where more than one component is
    left, members of different ones are compared with each other.

    Texts without words (null, empty, signs only) are linked to nothing: their class is their
    own id. A null id is a class of its own, whose class_id is null. The class is that of the
    row's text: rows that share an id are in one class if their texts are linked. An empty
    table gives no rows. Word sequences are told apart by 128 bits, shingles by 40.
    """
    ship(docs.sparkSession)
    source = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    classes = sequence_classes(source, similarity, bands, rows)
    rows_ = keyed(source, "text", "k1", "k2").select("doc_id", "k1", "k2")
    return rows_.join(classes, ["k1", "k2"], "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")
    )


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` without the rows whose text is in the class of a smaller id. Rows with a null id
    stay. A row goes by its own text: of rows that share an id, those stay whose text is in no
    class of a smaller one; rows that repeat both id and text stay or go together."""
    ship(docs.sparkSession)
    source = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    settings = {"similarity": SIMILARITY, "bands": BANDS, "rows": ROWS} | settings
    classes = sequence_classes(source, **settings)
    k1, k2 = free_name(docs, "dedup_key"), free_name(docs, "dedup_second_key")
    c1, c2, least = (free_name(docs, n) for n in ("class_key", "class_second_key", "class_least"))
    by = classes.select(F.col("k1").alias(c1), F.col("k2").alias(c2), F.col("class_id").alias(least))
    rows = keyed(docs, text, k1, k2)
    goes = (F.col(k1) == F.col(c1)) & (F.col(k2) == F.col(c2)) & (quoted(doc_id).cast("long") > F.col(least))
    return rows.join(by, goes, "left_anti").drop(k1, k2)
