"""SentencePiece encoding and decoding by a shared-prefix forward pass.

Texts are marked (spaces become a sign of their own, one is put in front) and cut wherever
no piece of the vocabulary spans the border. The distinct marked words of a run of texts are
sorted, which lays them out as a trie in depth-first order: each word starts from the
forward states of the prefix it shares with the word before.

A forward state is the last piece of the best way to write a prefix. For a unigram model
that is the usual Viterbi maximum of summed scores. A model built by pair merges has no such
sum; there the best way is the one whose neighbours, merged alone, stay as they are. Exactly
one last piece satisfies that for each prefix, so the same pass finds the merges' result.
"""

from __future__ import annotations

import heapq
import zlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from newsflow.llm.common import (
    buffers,
    by_batches,
    chunks,
    code_points,
    free_name,
    quoted,
    ranges,
    ship,
    split_rows,
    worker_cache,
)
from newsflow.llm.pretokens import Store, look_up

MARK = "▁"
_TABLE_BITS = 22
#: Pairs of pieces whose merging a worker remembers: about 170 bytes each.
FITS_LIMIT = 200_000
#: Bytes of encoded words that a worker keeps before it starts its store anew.
STORE_BYTES = 32 << 20
#: What the model format calls a piece that is found before all others.
USER_DEFINED = 4


def message_fields(raw: bytes):
    """(number, value) of the fields of a message in the format that model files are in."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield tag >> 3, raw[at : at + size]
        at += size


def refuse_unknown_rules(model: bytes) -> None:
    """A ValueError for models with rules that are not applied here."""
    normalizer = {}
    for field, value in message_fields(model):
        if field == 1 and dict(message_fields(value)).get(3) == USER_DEFINED:
            raise ValueError("models with user-defined pieces cannot be used")
        if field == 3:
            normalizer = dict(message_fields(value))
    if normalizer.get(2) or normalizer.get(6):
        raise ValueError("models with normalisation rules cannot be used")
    if normalizer.get(4, 1) or not normalizer.get(5, 1):
        raise ValueError("models that remove or keep spaces as such cannot be used")


class Decoder:
    """The bytes that each id stands for, one after another: all that decoding needs."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.prefix = m.encode("a", out_type=str)[:1] != ["a"]
        out = [_bytes_of(m, i) for i in range(m.vocab_size())]
        self.at = np.append(0, np.cumsum([len(b) for b in out]))
        self.data = np.frombuffer(b"".join(out), np.uint8)

    def texts(self, ids: np.ndarray, edges: np.ndarray) -> list[str]:
        """The text of each run of ids; numbers outside the vocabulary are left out."""
        known = (ids >= 0) & (ids < len(self.at) - 1)
        place = np.where(known, ids, 0)
        size = np.where(known, self.at[place + 1] - self.at[place], 0)
        raw = self.data[ranges(self.at[place], size)]
        sums = np.append(0, np.cumsum(size))[edges]
        starts, ends = sums[:-1], sums[1:]
        if self.prefix and len(raw):
            starts = starts + ((ends > starts) & (raw[np.minimum(starts, len(raw) - 1)] == 32))
        whole = raw.tobytes()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]


def _bytes_of(m, i: int) -> bytes:
    if m.is_byte(i):
        return bytes([int(m.id_to_piece(i)[1:-1], 16)])
    if m.is_unknown(i):
        return " ⁇ ".encode()
    if m.is_control(i) or m.is_unused(i):
        return b""
    return m.id_to_piece(i).replace(MARK, " ").encode()


class Pieces:
    """The vocabulary of a model file. ``kind`` is ``bpe`` or ``unigram``."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        refuse_unknown_rules(m.serialized_model_proto())
        self.kind = kind
        self.size = m.vocab_size()
        self.unknown = m.unk_id()
        plain = [
            i
            for i in range(self.size)
            if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))
        ]
        self.ids = {m.id_to_piece(i): i for i in plain}
        self.names = {i: p for p, i in self.ids.items()}
        self.score = {m.id_to_piece(i): m.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids), default=1)
        self.prefix = m.encode("a", out_type=str)[:1] != ["a"]
        byte_ids = {m.id_to_piece(i): i for i in range(self.size) if m.is_byte(i)}
        self.bytes = [byte_ids.get(f"<0x{b:02X}>", self.unknown) for b in range(256)]
        self.joined = np.zeros(1 << _TABLE_BITS, bool)
        pairs = sorted({(a, b) for p in self.ids for a, b in zip(p, p[1:])})
        if pairs:
            a, b = (np.array([ord(x[k]) for x in pairs], np.uint32) for k in (0, 1))
            self.joined[self._pair(a, b)] = True
        self._fits: dict[tuple[str, str], bool] = {}

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mixed = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B))
        return mixed >> np.uint32(32 - _TABLE_BITS)

    def word_starts(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where words start: at texts and between characters that no piece joins."""
        start = np.ones(len(points), bool)
        start[1:] = ~self.joined[self._pair(points[:-1], points[1:])]
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(start)

    def merge(self, word: str) -> list[str]:
        """The result of merging the best-scored neighbours, leftmost first, until none is
        left."""
        part = list(word)
        after = list(range(1, len(part) + 1))
        before = list(range(-1, len(part) - 1))
        heap = []

        def offer(i):
            j = after[i]
            if j < len(part):
                both = part[i] + part[j]
                if both in self.score:
                    heapq.heappush(heap, (-self.score[both], i, both))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i] if part[i] else len(part)
            if j >= len(part) or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, ""
            after[i] = after[j]
            if after[j] < len(part):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in part if p]

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces next to each other stay as they are. No left piece: whether
        the right one is what its own text merges to."""
        found = self._fits.get((left, right))
        if found is None:
            # the model's own strings, not the slices of words
            key = self._own(left), self._own(right)
            if len(self._fits) > FITS_LIMIT:
                self._fits.clear()
            found = self.merge(left + right) == ([left, right] if left else [right])
            self._fits[key] = found
        return found

    def _own(self, piece: str) -> str:
        return self.names.get(self.ids.get(piece), piece)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of each word: one pass over the sorted words, forward states kept
        for the prefix that a word shares with the one before."""
        order = sorted(range(len(words)), key=words.__getitem__)
        found: list[list[int]] = [[]] * len(words)
        step = self._step_best if self.kind == "unigram" else self._step_merged
        last = ""
        states = [("", 0.0)]  # of every prefix: its last piece, the score so far
        for k in order:
            word = words[k]
            shared, limit = 0, min(len(last), len(word), len(states) - 1)
            while shared < limit and last[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                states.append(step(word, end, states))
            found[k] = self._back(word, states)
            last = word
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return counts, np.fromiter((i for f in found for i in f), np.int32, int(counts.sum()))

    def _step_merged(self, word, end, states):
        ids, fits = self.ids, self._fits
        for size in range(min(end, self.longest), 0, -1):
            piece = word[end - size : end]
            if piece in ids:
                left = states[end - size][0]
                ok = fits.get((left, piece))
                if ok is None:
                    ok = self.fits(left, piece)
                if ok:
                    return piece, 0.0
        # a character without a piece: nothing merges with it
        return word[end - 1], 0.0

    def _step_best(self, word, end, states):
        best = None
        for size in range(1, min(end, self.longest) + 1):
            piece = word[end - size : end]
            if piece in self.ids:
                total = states[end - size][1] + self.score[piece]
                if best is None or total > best[1]:
                    best = piece, total
        if best is None:
            best = word[end - 1], states[end - 1][1] + min(self.score.values(), default=0.0) - 10
        return best

    def _back(self, word, states) -> list[int]:
        out, end = [], len(word)
        while end:
            piece = states[end][0]
            i = self.ids.get(piece)
            if i is None:
                out += reversed([self.bytes[b] for b in piece.encode()])
            else:
                out.append(i)
            end -= len(piece)
        return out[::-1]


@worker_cache
def _model(path: str, kind: str) -> tuple[Pieces, Store]:
    model = Pieces(path, kind)
    return model, Store(model.encode_words, limit_bytes=STORE_BYTES)


@worker_cache
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def encode_texts(texts: pa.Array, path: str, kind: str):
    """(ids per text, all ids) of successive runs of texts; null is empty."""
    model, store = _model(path, kind)
    data, offsets = buffers(texts)
    for i, j in chunks(offsets):
        points, at = code_points(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        points = np.where(points == 32, np.uint32(ord(MARK)), points)
        if model.prefix:
            filled = np.diff(at) > 0
            points = np.insert(points, at[:-1][filled], np.uint32(ord(MARK)))
            at = at + np.append(0, np.cumsum(filled))
        place, n = look_up(points, at, model.word_starts(points, at), store)
        counts = store.count.data[place]
        sums = np.append(0, np.cumsum(counts))
        ends = np.cumsum(n)
        yield sums[ends] - sums[ends - n], store.ids.data[ranges(store.first.data[place], counts)]


def encode(
    docs: DataFrame,
    path: str,
    text: str = "text",
    to: str = "ids",
    kind: str = "bpe",
    decoded: str | None = None,
) -> DataFrame:
    """``docs`` with the ids of each whole text in ``to``, ``n_tokens``, and ``ids_crc32``
    (of the ids as little-endian 32-bit integers); columns of these names are replaced. With
    ``decoded`` the ids are decoded in the same pass, into a column of that name.

    The ids are those of the sentencepiece library without begin or end. Characters outside
    the vocabulary become their bytes. A null or empty text has no ids. Rows are independent
    of each other: repeated rows and null ids need nothing special. Words are known by a
    64-bit hash. Models with normalisation rules or user-defined pieces are refused.
    """
    ship(docs.sparkSession)
    added = [to, "n_tokens", "ids_crc32", *([decoded] if decoded else [])]
    rest = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    hidden = free_name(docs, "text_encoded")
    source = docs.select(*[quoted(c) for c in rest], quoted(text).alias(hidden))
    schema = T.StructType([*source.schema.fields[:-1]]).add(to, T.ArrayType(T.IntegerType()))
    schema = schema.add("n_tokens", "long").add("ids_crc32", "long")
    schema = schema.add(decoded, "string") if decoded else schema

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(hidden))
            row = 0
            for counts, ids in encode_texts(texts, path, kind):
                edges = np.append(0, np.cumsum(counts))
                raw, at = ids.astype("<u4").view("u1").data, (edges * 4).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])]
                part = batch.slice(row, len(counts))
                row += len(counts)
                columns = [part.column(part.schema.get_field_index(c)) for c in rest]
                columns += [
                    split_rows(pa.array(ids), edges),
                    pa.array(counts),
                    pa.array(crc, pa.int64()),
                ]
                if decoded:
                    columns.append(pa.array(_decoder(path).texts(ids, edges), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(by_batches("sentencepiece", run), schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids`` in ``to``. Null ids give an empty text; numbers
    outside the vocabulary are left out."""
    ship(rows.sparkSession)
    rest = [c for c in rows.columns if c.lower() != to.lower()]
    hidden = free_name(rows, "ids_decoded")
    source = rows.select(*[quoted(c) for c in rest], quoted(ids).alias(hidden))
    schema = T.StructType([*source.schema.fields[:-1]]).add(to, "string")

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(hidden))
            counts = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            flat = lists.flatten().fill_null(-1).to_numpy()
            edges = np.append(0, np.cumsum(counts))
            for i, j in chunks(edges):
                part = batch.slice(i, j - i)
                columns = [part.column(part.schema.get_field_index(c)) for c in rest]
                texts = _decoder(path).texts(flat[edges[i] : edges[j]], edges[i : j + 1] - edges[i])
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], schema.names)

    return source.mapInArrow(by_batches("sentencepiece", run), schema)
