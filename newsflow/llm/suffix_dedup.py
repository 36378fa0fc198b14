"""Removal of repeated passages with blockwise suffix sorting over a difference cover.

Every byte string of a given length that also starts in a document with a smaller id is
removed from the later documents. Equal strings must be brought together without moving all
suffixes, so each string is named by its anchor: the stretch of bytes inside it with the
smallest hash. Strings that share an anchor lie next to each other and travel as one piece.

1. Groups of documents list the anchors they hold; anchors of one document only are dropped.
2. Groups send their distinct pieces with living anchors, each with its smallest document,
   to the suffix bucket of the anchor. Anchors of very many documents are split: their
   strings travel one by one to the bucket of the whole string.
3. A bucket sorts the suffixes of its pieces block by block. Suffixes are ordered by their
   first bytes; longer ties are resolved by ranks that were worked out beforehand for the
   positions of a difference cover: for any two suffixes some small shift puts both on the
   cover. The smallest document of each run of equal strings goes back to the groups.
4. Groups mark the strings found and cut the covered bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from newsflow.llm.common import (
    BYTE_VALUES,
    buffers,
    by_group,
    by_two_groups,
    chunks,
    free_name,
    pieces as group_count,
    prefix_sums,
    quoted,
    ranges,
    ship,
    span_hash,
)

LENGTH = 50
#: A difference cover: every difference modulo 31 is one of two of these.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes by which suffixes are ordered before the cover's ranks are asked; at least PERIOD.
PREFIX = 32
#: Text bytes of a group of documents, and for each suffix bucket.
GROUP_BYTES, BUCKET_BYTES = 6 << 20, 6 << 20
#: Bytes of pieces whose suffixes are sorted at once.
BLOCK_BYTES = 1 << 20
#: An anchor of more documents than this is split by whole strings.
HOT = 10_000
_NONE = np.iinfo(np.int64).max
_U = np.uint64
_PLACE = _U((1 << 24) - 1)
_SEGMENT = 1 << 23


class Cuts:
    """The pieces of a group: which row, first and last string start (places in the group's
    bytes), bucket and number of the anchor, and a hash of the piece."""

    def __init__(self, parts):
        self.row, self.low, self.high, self.key, self.hash = (
            np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, d)
            for k, d in enumerate((np.int64, np.int64, np.int64, _U, _U))
        )


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _segments(offsets: np.ndarray, length: int):
    """(first row, edges) of runs of texts; a very long text comes in parts that overlap by
    less than a string. Edges are pairs of start and end for each row."""
    for i, j in chunks(offsets):
        start, end = offsets[i:j], offsets[i + 1 : j + 1]
        if j - i == 1 and end[0] - start[0] > _SEGMENT:
            for a in range(int(start[0]), int(end[0]), _SEGMENT):
                yield i, np.array([a]), np.array([min(a + _SEGMENT + length - 1, int(end[0]))])
        else:
            yield i, start, end


def cut(data, offsets, buckets: int, length: int = LENGTH, hot: np.ndarray | None = None) -> Cuts:
    """All pieces of a group; those with an anchor in ``hot`` (sorted) string by string."""
    gram = length - 30 if length >= 38 else 8
    width = length - gram + 1
    parts = []
    for row, start, end in _segments(offsets, length):
        base, n = int(start[0]), int(end[-1] - start[0])
        if n < length:
            continue
        start, end = start - base, end - base
        sums = prefix_sums(BYTE_VALUES[data[base : base + n]])
        at = np.arange(n - gram + 1)
        grams = span_hash(sums, at, at + gram)
        key = (grams & ~_PLACE) | at.astype(_U)
        # grams and strings that reach into the next text do not count
        last = np.minimum(end, n)
        bad = ranges(np.maximum(last - gram + 1, start), last - np.maximum(last - gram + 1, start))
        key[bad[bad < len(key)]] = ~_U(0)
        place = (_sliding_min(key, width) & _PLACE).astype(np.int64)
        sizes = np.maximum(end - start - length + 1, 0)
        strings = ranges(start, sizes)
        if not len(strings):
            continue
        owner = np.repeat(np.arange(len(start)), sizes)
        anchor = place[strings]
        new = np.ones(len(strings), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        low = strings[first]
        high = strings[np.append(first[1:], len(strings)) - 1]
        owner, value = owner[first], grams[anchor[first]]
        number = ((value >> _U(32)) % _U(buckets)) << _U(32) | (value & _U(0xFFFFFFFF))
        if hot is not None and len(hot):
            split = _found(number, hot)
            size = np.where(split, high - low + 1, 1)
            single = np.repeat(split, size)
            low2 = np.where(single, ranges(low, size), np.repeat(low, size))
            high = np.where(single, low2, np.repeat(high, size))
            low, owner, number = low2, np.repeat(owner, size), np.repeat(number, size)
        found = span_hash(sums, low, high + length)
        parts.append((owner + row, low + base, high + base, number, found))
    return Cuts(parts)


def _found(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _distinct(first: np.ndarray, *rest: np.ndarray):
    """Order by ``first`` and ``rest``, and where a new value of ``first`` begins."""
    order = np.lexsort((*rest[::-1], first))
    ordered = first[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(new)


# Step 1 and its answer


def list_anchors(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors, and how many documents (255 at most) hold each."""
    if not len(keys):
        return keys, np.zeros(0, np.uint8)
    order, first = _distinct(keys, rows)
    k, r = keys[order], rows[order]
    fresh = np.ones(len(k), np.int64)
    fresh[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return k[first], np.minimum(np.add.reduceat(fresh, first), 255).astype(np.uint8)


def living(table: pa.Table, hot: int) -> pa.Table:
    """For the anchors that groups list in one bucket: which are of several documents, and
    which of more than ``hot``; as bits in the order of each list."""
    lists = [np.frombuffer(x.as_py(), "<u4") for x in table.column("anchors")]
    counts = [np.frombuffer(x.as_py(), "u1") for x in table.column("counts")]
    _, inverse = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts))[inverse]
    edges = np.append(0, np.cumsum([len(x) for x in lists]))
    alive, split = [], []
    for a, b in zip(edges, edges[1:]):
        alive.append(np.packbits(total[a:b] > 1).tobytes())
        split.append(np.packbits(total[a:b] > hot).tobytes())
    return pa.table(
        {
            "group": table.column("group"),
            "bucket": table.column("bucket"),
            "alive": pa.array(alive, pa.binary()),
            "split": pa.array(split, pa.binary()),
        }
    )


# Step 3: suffix sorting


def _words(text: np.ndarray, places: np.ndarray, length: int) -> list[np.ndarray]:
    """The first ``length`` bytes at each place as big-endian numbers of 8 bytes."""
    padded = np.concatenate([text, np.zeros(length + 16, np.uint8)])
    view = np.ndarray((len(text) + length + 8,), ">u8", padded, strides=(1,))
    out = []
    for k in range(0, length, 8):
        word = view[places + k].astype(_U)
        if length - k < 8:
            word >>= _U(8 * (8 - (length - k)))
        out.append(word)
    return out


def _shared_bytes(words: list[np.ndarray], length: int) -> np.ndarray:
    """Of neighbours in order, how many first bytes are equal; 0 for the first one."""
    n = len(words[0])
    shared, same = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    for k, word in enumerate(words):
        differ = word[1:] ^ word[:-1]
        size = min(8, length - 8 * k)
        for b in range(1, size + 1):
            same &= (differ >> _U(8 * (size - b))) == 0
            shared[1:] += same
    return shared


def earliest(
    text: np.ndarray, starts: np.ndarray, docs: np.ndarray, length: int = LENGTH
) -> np.ndarray:
    """For each start the smallest of ``docs`` among the starts of equal strings."""
    best = docs.copy()
    if not len(starts):
        return best
    prefix = min(PREFIX, length)
    words = _words(text, starts, prefix)
    order = np.lexsort(words[::-1])
    new = np.zeros(len(starts), bool)
    new[0] = True
    for w in words:
        w = w[order]
        new[1:] |= w[1:] != w[:-1]
    del words
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    ordered = docs[order]
    low, high = np.minimum.reduceat(ordered, first), np.maximum.reduceat(ordered, first)
    tied = (low < high)[group]
    members, group = order[tied], group[tied]
    if not len(members):
        return best
    if length <= prefix:
        best[members] = low[group]
        return best
    # ranks of the cover's positions that a tie can ask for
    on_cover = np.zeros(PERIOD, bool)
    on_cover[list(COVER)] = True
    asked = np.zeros(len(text) + PERIOD + 1, np.int32)
    np.add.at(asked, starts[members], 1)
    np.add.at(asked, starts[members] + PERIOD, -1)
    sample = np.flatnonzero(np.cumsum(asked)[: len(text)] > 0)
    sample = sample[on_cover[sample % PERIOD]]
    words = _words(text, sample, length)
    by_text = np.lexsort(words[::-1])
    shared = _shared_bytes([w[by_text] for w in words], length)
    del words
    rank = np.zeros(len(text), np.int64)
    rank[sample[by_text]] = np.arange(len(sample))
    for shift in range(PERIOD):
        place = starts[members] + shift
        chosen = np.flatnonzero(on_cover[place % PERIOD])
        if not len(chosen):
            continue
        # suffixes equal for the rest of the string have one number
        number = np.cumsum(shared < length - shift)[rank[place[chosen]]]
        key = group[chosen] * np.int64(len(sample) + 1) + number
        inner, head = _distinct(key)
        least = np.minimum.reduceat(docs[members[chosen[inner]]], head)
        size = np.diff(np.append(head, len(key)))
        target = members[chosen[inner]]
        best[target] = np.minimum(best[target], np.repeat(least, size))
    return best


def sort_bucket(table: pa.Table, length: int) -> pa.Table:
    """Answers to the groups for the pieces of one bucket: the smallest document that holds
    the whole piece, and the strings of it that a still smaller one holds (as bits)."""

    def arrays(name: str, dtype: str) -> list[np.ndarray]:
        return [np.frombuffer(x.as_py(), dtype) for x in table.column(name)]

    keys = arrays("keys", "<u8")
    docs = np.concatenate(arrays("docs", "<i8"))
    sizes = np.concatenate(arrays("sizes", "<u2")).astype(np.int64)
    single = np.concatenate(arrays("single", "u1")) > 0
    text = np.concatenate(arrays("bytes", "u1"))
    edges = np.append(0, np.cumsum([len(k) for k in keys]))
    key = np.concatenate(keys)
    at = np.append(0, np.cumsum(sizes))
    hashes = np.zeros(len(key), _U)
    for i, j in chunks(at):
        sums = prefix_sums(BYTE_VALUES[text[at[i] : at[j]]])
        hashes[i:j] = span_hash(sums, at[i:j] - at[i], at[i + 1 : j + 1] - at[i])
    # the smallest document of each distinct piece
    order, first = _distinct(hashes, docs)
    number = np.zeros(len(key), np.int64)
    number[order] = np.cumsum(np.isin(np.arange(len(key)), first, assume_unique=True)) - 1
    chosen = order[first]
    least = docs[chosen]
    # only anchors with several distinct pieces need their suffixes sorted
    _, inverse, of = np.unique(key[chosen], return_inverse=True, return_counts=True)
    several = np.flatnonzero((of[inverse] > 1) & ~single[chosen])
    several = several[np.argsort(key[chosen][several], kind="stable")]
    mask = np.zeros(len(chosen), _U)
    sums = np.append(0, np.cumsum(sizes[chosen[several]]))
    anchors = key[chosen][several]
    i = 0
    while i < len(several):
        # one block of anchors at a time
        j = int(np.searchsorted(sums, sums[i] + BLOCK_BYTES, side="right")) - 1
        j = min(max(j, i + 1), len(several))
        j = int(np.searchsorted(anchors, anchors[j - 1], side="right"))
        part = chosen[several[i:j]]
        n = sizes[part]
        block = text[ranges(at[part], n)]
        begin = np.cumsum(n) - n
        strings = n - length + 1
        starts = ranges(begin, strings)
        owner = np.repeat(np.arange(j - i), strings)
        found = earliest(block, starts, docs[part][owner], length)
        hit = found < docs[part][owner]
        bit = _U(1) << (starts - begin[owner]).astype(_U)
        np.bitwise_or.at(mask, several[i:j][owner[hit]], bit[hit])
        i = j
    answer = least[number], mask[number]
    needed = (answer[0] < docs) | (answer[1] != 0) | single
    out = {"group": [], "hashes": [], "least": [], "masks": [], "hot": []}
    for g, a, b in zip(table.column("group").to_pylist(), edges, edges[1:]):
        k = a + np.flatnonzero(needed[a:b])
        if len(k):
            out["group"].append(g)
            out["hashes"].append(hashes[k].astype("<u8").tobytes())
            out["least"].append(answer[0][k].astype("<i8").tobytes())
            out["masks"].append(answer[1][k].astype("<u8").tobytes())
            out["hot"].append(np.unique(key[k[single[k]]]).astype("<u8").tobytes())
    types = {"group": pa.int64()} | dict.fromkeys(("hashes", "least", "masks", "hot"), pa.binary())
    return pa.table({n: pa.array(v, types[n]) for n, v in out.items()})


# The steps on groups of documents

_SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end")])
RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    + [
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("spans", T.ArrayType(_SPAN)),
    ]
)


def suffix_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    replace: bool = False,
    hot: int = HOT,
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``spans``:
    the maximal runs of UTF-8 bytes covered by strings of ``length`` bytes that also start in
    a row with a smaller id. With ``replace`` the text is what remains (characters of which
    only a part remains are dropped). Columns of these names are replaced.

    Strings are judged on the input. Matches inside a text, and between rows of one id, do
    not count. A null id counts as larger than all ids. Null texts are empty (and stay null
    with ``replace``); texts shorter than ``length`` are kept whole; an empty table gives no
    rows. ``length`` is at least 16.
    """
    if length < 16:
        raise ValueError("length is at least 16")
    spark = docs.sparkSession
    ship(spark)
    rest = [c for c in docs.columns if c.lower() not in {f.name for f in RESULT}]
    group_by, key, body = (free_name(docs, n) for n in ("dedup_group", "dedup_id", "dedup_text"))
    total = docs.agg(F.sum(F.octet_length(quoted(text)))).first()[0] or 0
    groups = group_count(spark, total, GROUP_BYTES)
    buckets = group_count(spark, total, BUCKET_BYTES)
    carried = [c for c in rest if c != text]
    source = docs.select(
        F.pmod(F.xxhash64(quoted(doc_id), quoted(text)), F.lit(groups)).alias(group_by),
        F.coalesce(quoted(doc_id).cast("long"), F.lit(_NONE)).alias(key),
        quoted(text).alias(body),
        *[quoted(c) for c in carried],
    )

    def column(table: pa.Table, name: str):
        return table.column(table.schema.get_field_index(name)).combine_chunks()

    def ids_of(table: pa.Table) -> np.ndarray:
        return column(table, key).to_numpy()

    def anchors(table: pa.Table) -> pa.Table:
        found = cut(*buffers(column(table, body)), buckets, length)
        numbers, counts = list_anchors(found.key, ids_of(table)[found.row])
        bucket = (numbers >> _U(32)).astype(np.int64)
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        edge = np.append(at, len(bucket))

        def parts(values: np.ndarray) -> pa.Array:
            return pa.array([values[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())

        return pa.table(
            {
                "bucket": pa.array(bucket[at], pa.int64()),
                "group": pa.array([column(table, group_by)[0].as_py()] * len(at), pa.int64()),
                "anchors": parts(numbers.astype("<u4")),
                "counts": parts(counts),
            }
        )

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        empty = {"bucket": pa.int64(), "group": pa.int64()}
        empty |= dict.fromkeys(("keys", "docs", "sizes", "single", "bytes"), pa.binary())
        out = {n: [] for n in empty}
        if table.num_rows and answers.num_rows:
            data, offsets = buffers(column(table, body))
            ids = ids_of(table)
            found = cut(data, offsets, buckets, length)
            numbers = np.unique(found.key)
            bits = sorted(
                (b.as_py(), x.as_py(), y.as_py())
                for b, x, y in zip(*(answers.column(n) for n in ("bucket", "alive", "split")))
            )
            alive, split = np.zeros(len(numbers), bool), np.zeros(len(numbers), bool)
            borders = np.array([[b, b + 1] for b, _, _ in bits], _U) << _U(32)
            edge = np.searchsorted(numbers, borders)
            for (_, x, y), (a, b) in zip(bits, edge.tolist()):
                alive[a:b] = np.unpackbits(np.frombuffer(x, "u1"), count=b - a)
                split[a:b] = np.unpackbits(np.frombuffer(y, "u1"), count=b - a)
            parted = numbers[split]
            if len(parted):
                found = cut(data, offsets, buckets, length, parted)
            kept = np.flatnonzero(alive[np.searchsorted(numbers, found.key)])
            order, first = _distinct(found.hash[kept], ids[found.row[kept]])
            kept = kept[order[first]]
            single = _found(found.key[kept], parted)
            bucket = np.where(single, found.hash[kept] % _U(buckets), found.key[kept] >> _U(32))
            bucket = bucket.astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            kept, single, bucket = kept[order], single[order], bucket[order]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(at, np.append(at[1:], len(bucket))):
                k = kept[a:b]
                size = found.high[k] - found.low[k] + length
                out["bucket"].append(int(bucket[a]))
                out["group"].append(column(table, group_by)[0].as_py())
                out["keys"].append(found.key[k].astype("<u8").tobytes())
                out["docs"].append(ids[found.row[k]].astype("<i8").tobytes())
                out["sizes"].append(size.astype("<u2").tobytes())
                out["single"].append(single[a:b].astype("u1").tobytes())
                out["bytes"].append(data[ranges(found.low[k], size)].tobytes())
        return pa.table({n: pa.array(v, empty[n]) for n, v in out.items()})

    keep_text = replace and text in rest
    schema = T.StructType([source.schema[c] for c in carried])
    if text in rest:
        schema = schema.add(text, "string")
    schema = T.StructType([*schema.fields, *RESULT])

    def apply(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in _arrow_types(schema).items()})
        texts = column(table, body)
        data, offsets = buffers(texts)
        removed = _removed(data, offsets, ids_of(table), answers, buckets, length)
        sums = np.append(0, np.cumsum(removed))
        run_start = removed.copy()
        run_start[1:] &= ~removed[:-1]
        border = offsets[offsets < len(removed)]
        run_start[border] = removed[border]
        run_end = removed.copy()
        run_end[:-1] &= ~removed[1:] | run_start[1:]
        starts, ends = np.flatnonzero(run_start), np.flatnonzero(run_end) + 1
        of = np.append(0, np.cumsum(np.diff(np.searchsorted(starts, offsets))))
        kept_bytes = data[~removed].tobytes()
        kept_at = offsets - sums[offsets]
        parts = [kept_bytes[a:b] for a, b in zip(kept_at.tolist(), kept_at[1:].tolist())]
        base = np.repeat(offsets[:-1], np.diff(of))
        places = [pa.array(starts - base), pa.array(ends - base)]
        spans = pa.ListArray.from_arrays(
            pa.array(of.astype(np.int32)), pa.StructArray.from_arrays(places, ["start", "end"])
        )
        columns = {c: column(table, c) for c in carried}
        if keep_text:
            known = texts.is_valid().to_pylist()
            kept = [p.decode("utf-8", "ignore") if k else None for p, k in zip(parts, known)]
            columns[text] = pa.array(kept, pa.string())
        elif text in rest:
            columns[text] = texts
        columns["n_bytes"] = pa.array(np.diff(offsets))
        columns["n_removed"] = pa.array(np.diff(sums[offsets]))
        columns["n_spans"] = pa.array(np.diff(of))
        digests = [hashlib.sha256(p).hexdigest() for p in parts]
        columns["kept_sha256"] = pa.array(digests, pa.string())
        columns["spans"] = spans
        return pa.table({n: columns[n] for n in schema.names})

    listed = source.groupBy(group_by).applyInArrow(
        by_group("suffix dedup", anchors), "bucket long, group long, anchors binary, counts binary"
    )
    alive = listed.groupBy("bucket").applyInArrow(
        by_group("suffix dedup", lambda t: living(t, hot)),
        "group long, bucket long, alive binary, split binary",
    )
    sent = source.groupBy(group_by).cogroup(alive.groupBy("group")).applyInArrow(
        by_two_groups("suffix dedup", send),
        "bucket long, group long, keys binary, docs binary, sizes binary, single binary, "
        "bytes binary",
    )
    answered = sent.groupBy("bucket").applyInArrow(
        by_group("suffix dedup", lambda t: sort_bucket(t, length)),
        "group long, hashes binary, least binary, masks binary, hot binary",
    )
    out = source.groupBy(group_by).cogroup(answered.groupBy("group")).applyInArrow(
        by_two_groups("suffix dedup", apply), schema
    )
    return out.select(*[quoted(c) for c in [*rest, *RESULT.names]])


def _arrow_types(schema: T.StructType) -> dict:
    from pyspark.sql.pandas.types import to_arrow_type

    return {f.name: to_arrow_type(f.dataType) for f in schema.fields}


def _removed(data, offsets, ids, answers: pa.Table, buckets: int, length: int) -> np.ndarray:
    """Which bytes of a group's texts are covered by strings to remove."""

    def joined(name, dtype):
        parts = [np.frombuffer(x.as_py(), dtype) for x in answers.column(name)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype)

    hashes, order = np.unique(joined("hashes", "<u8"), return_index=True)
    least, masks = joined("least", "<i8")[order], joined("masks", "<u8")[order]
    found = cut(data, offsets, buckets, length, np.unique(joined("hot", "<u8")))
    doc = ids[found.row]
    change = np.zeros(len(data) + 1, np.int32)
    if len(doc):
        order, first = _distinct(found.hash, doc)
        smallest = np.zeros(len(doc), np.int64)
        size = np.diff(np.append(first, len(doc)))
        smallest[order] = np.repeat(doc[order[first]], size)
        mask = np.zeros(len(doc), _U)
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, found.hash), len(hashes) - 1)
            hit = hashes[at] == found.hash
            smallest = np.where(hit, np.minimum(smallest, least[at]), smallest)
            mask = np.where(hit & (doc == smallest), masks[at], mask)
        whole = doc > smallest
        np.add.at(change, found.low[whole], 1)
        np.add.at(change, found.high[whole] + length, -1)
        some = np.flatnonzero((mask != 0) & ~whole)
        for bit in range(64):
            chosen = some[(mask[some] >> _U(bit)) & _U(1) == 1]
            np.add.at(change, found.low[chosen] + bit, 1)
            np.add.at(change, found.low[chosen] + bit + length, -1)
    return np.cumsum(change)[:-1] > 0
