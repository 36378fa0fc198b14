"""Splitting text into the pre-tokens of a byte-level BPE, and a store of what they encode to.

The split is that of the published pattern (contractions, letters, numbers, other signs,
each with one space before it, and white space), worked out on whole arrays of code points
instead of by a regular expression.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa

from newsflow.llm.common import mix, prefix_sums, span_hash, worker_cache

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Entries a worker keeps before it starts its store anew.
STORE_LIMIT = 1_200_000


@worker_cache
def char_classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    everything = "".join(map(chr, points))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            table[points[m.start()] : points[m.end() - 1] + 1] = kind
    return table


def token_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start. ``first`` marks the first code point of each text."""
    n = len(points)
    start = np.ones(n, bool)
    if not n:
        return start
    kind = char_classes()[points]
    start[1:] = kind[1:] != kind[:-1]
    start |= first
    run_ends, text_ends = np.ones(n, bool), np.ones(n, bool)
    run_ends[:-1], text_ends[:-1] = start[1:], first[1:]
    # the last white space of a run that something follows stands alone or leads it
    tail = (kind == SPACE) & run_ends & ~text_ends
    quote = np.flatnonzero((points == 39) & start & run_ends & ~text_ends)
    start |= tail
    start[1:][(tail & (points == 32))[:-1]] = False
    quote = quote[start[quote]]
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        one = points[quote + 1]
        two = points[np.minimum(quote + 2, n - 1)]
        inside = ~run_ends[quote + 1]
        length = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
        for a, b in ("re", "ve", "ll"):
            length[inside & (one == ord(a)) & (two == ord(b))] = 2
        quote, length = quote[length > 0], length[length > 0]
        start[quote + 1] = False
        after = quote + 1 + length
        start[after[after < n]] = True
    return start


def point_values(points: np.ndarray) -> np.ndarray:
    """Code points as values for a rolling hash."""
    table = _point_table()
    return table[points]


@worker_cache
def _point_table() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64))


class Growing:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.size = np.zeros(1024, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            self.data = np.concatenate(
                [self.data[: self.size], np.zeros(max(need, self.size // 2), self.data.dtype)]
            )
        self.data[self.size : need] = values
        self.size = need


class Store:
    """Hash of a piece -> the ids it encodes to, or only how many there are. Sorted keys are
    kept in a large and a small array, so that new ones cost little."""

    def __init__(self, encode, counts_only: bool = False, limit_bytes: int | None = None):
        self.encode, self.counts_only, self.limit_bytes = encode, counts_only, limit_bytes
        self.clear()

    def clear(self):
        self.first, self.count, self.ids = Growing(np.int64), Growing(np.int32), Growing(np.int32)
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.levels = [empty, empty]

    def __len__(self):
        return self.count.size

    def full(self) -> bool:
        # a key, its number, the first id and the count of each, and the ids
        held = 28 * len(self) + 4 * self.ids.size
        return len(self) > STORE_LIMIT or (self.limit_bytes is not None and held > self.limit_bytes)

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Entries for new ``keys`` (sorted); their numbers."""
        slots = self.count.size + np.arange(len(keys))
        self.first.extend(self.ids.size + np.cumsum(counts) - counts)
        self.count.extend(counts)
        self.ids.extend(ids)
        large, small = self.levels
        small = self._merged(small, (keys, slots))
        if len(small[0]) > 65536 + len(large[0]) // 8:
            large, small = self._merged(large, small), (small[0][:0], small[1][:0])
        self.levels = [large, small]
        return slots

    @staticmethod
    def _merged(a, b):
        at = np.searchsorted(a[0], b[0])
        return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])

    def find(self, keys: np.ndarray, text_of) -> np.ndarray:
        """The number of each of the distinct, sorted ``keys``; ``text_of(places)`` gives the
        pieces at those places of ``keys`` that the store lacks."""
        if self.full():
            self.clear()
        slots = np.full(len(keys), -1, np.int64)
        for known, numbers in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                slots[hit] = numbers[at[hit]]
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            counts, ids = self.encode(text_of(missing))
            slots[missing] = self.add(keys[missing], counts, ids[:0] if self.counts_only else ids)
        return slots


class ByteLevel:
    """A byte-level BPE of the tokenizers library, applied by distinct pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        config = json.loads(Path(path).read_text())
        split = config.get("pre_tokenizer") or {}
        #: Whether the split here is the tokenizer's own; otherwise texts are encoded whole.
        self.splits = (
            split.get("type") == "ByteLevel"
            and not split.get("add_prefix_space")
            and split.get("use_regex", True)
            and not config.get("normalizer")
        )

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for f in found for i in f), np.int32, int(counts.sum()))
        return counts, ids

    def whole_tokens(self) -> np.ndarray:
        """Hashes of the vocabulary strings that, as a text of their own, are one pre-token
        and encode to one token: a matching pre-token counts one without any merging."""
        if not self.splits:
            return np.zeros(0, np.uint64)
        texts = sorted(
            {self.tokenizer.decode([i]) for i in range(self.tokenizer.get_vocab_size())}
            - {"", *self.added}
        )
        texts = [t for t in texts if "�" not in t]
        counts, _ = self.encode(texts)
        texts = [t for t, n in zip(texts, counts) if n == 1]
        points, offsets = texts_to_points(texts)
        first = np.zeros(len(points), bool)
        first[offsets[:-1]] = True
        inside = np.cumsum(token_starts(points, first))
        alone = np.diff(inside[offsets[1:] - 1], prepend=0) == 1
        keys = span_hash(prefix_sums(point_values(points)), offsets[:-1], offsets[1:])
        return np.sort(keys[alone])


def texts_to_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return points, offsets


def has_any(texts: pa.Array, strings: list[str]) -> np.ndarray:
    """Rows that hold one of the strings."""
    import pyarrow.compute as pc

    found = np.zeros(len(texts), bool)
    for s in strings:
        found |= pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
    return found


def apply(points, offsets, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """For texts given as code points: where each of their pre-tokens is in the store, and
    how many pre-tokens each text has."""
    first = np.zeros(len(points) + 1, bool)
    first[offsets[:-1]] = True
    starts = np.flatnonzero(token_starts(points, first[:-1]))
    return look_up(points, offsets, starts, store)


def look_up(points, offsets, starts, store: Store) -> tuple[np.ndarray, np.ndarray]:
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    ends = np.append(starts[1:], len(points))
    keys = span_hash(prefix_sums(point_values(points)), starts, ends)
    distinct, sample, inverse = np.unique(keys, return_index=True, return_inverse=True)

    def text_of(places):
        chosen = sample[places]
        whole = points.tobytes().decode("utf-32-le")
        return [whole[a:b] for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist())]

    at = store.find(distinct, text_of)[inverse]
    return at, np.diff(np.searchsorted(starts, offsets))
