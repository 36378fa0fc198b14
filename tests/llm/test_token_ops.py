import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsflow.llm import pretokens
from newsflow.llm.pretokens import ByteLevel, Store
from newsflow.llm.token_counts import count_batch, token_counts
from newsflow.llm.token_files import read_shards, token_files, write_shards
from newsflow.llm.common import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = list("  \n\t'ss trevemlld''xA1²Ⅷé!?<|>\x1c\x85　") + [
    "<|endoftext|>", "'s", "'re", "n't", " '", "中", "\U0001f642", "é", "  \n ",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def fuzz(n, size=40, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, size))) for _ in range(n)]


def test_counts_equal_the_library(tokenizer):
    texts = fuzz(5000) + ["", "a" * 5000, " " * 3000, "'" * 777]
    whole = ByteLevel(PATH).whole_tokens()
    got = count_batch(pa.array(texts), PATH, whole)
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert got.tolist() == want


def test_every_character_is_split_as_the_library_splits_it(tokenizer):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{chr(c)}a {chr(c)} 1{chr(c)}!" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    got = count_batch(pa.array(texts), PATH, np.zeros(0, np.uint64))
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert got.tolist() == want


def test_whole_tokens_are_proved():
    model = ByteLevel(PATH)
    whole = model.whole_tokens()
    assert 45_000 < len(whole) < 50_257 and (np.diff(whole.astype(object)) > 0).all()


def test_a_file_of_another_split_is_counted_by_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = fuzz(50)
    got = count_batch(pa.array([*texts, None]), path, np.zeros(0, np.uint64))
    other = Tokenizer.from_file(path)
    other.no_truncation()
    other.no_padding()
    want = [len(e.ids) for e in other.encode_batch([*texts, ""], add_special_tokens=False)]
    assert got.tolist() == want


def test_token_counts_keep_other_columns(spark, tokenizer):
    rows = [(1, "a b", "x"), (None, None, None), (2, "", "y"), (1, "a b", "x"), (3, "w " * 2000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string")
    got = token_counts(df, PATH)
    assert got.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    want = sorted(
        (r[0] or -1, len((r[1] or "").encode()), len(tokenizer.encode(r[1] or "").ids)) for r in rows
    )
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert [r.over_limit for r in got.where("doc_id = 3").collect()] == [True]
    assert token_counts(df.limit(0), PATH).count() == 0


def test_store_forgets_when_it_is_full(monkeypatch):
    monkeypatch.setattr(pretokens, "STORE_LIMIT", 50)
    asked = []

    def encode(texts):
        asked.extend(texts)
        return np.array([len(t) for t in texts]), np.concatenate([np.frombuffer(t.encode(), np.uint8) for t in texts]).astype(np.int32)

    store = Store(encode)
    for k in range(20):
        keys = np.sort(np.random.default_rng(k).integers(0, 100, 30).astype(np.uint64))
        keys = np.unique(keys)
        slots = store.find(keys, lambda at: [str(keys[i]) for i in at])
        first, count = store.first.data[slots], store.count.data[slots]
        for key, a, n in zip(keys, first, count):
            assert bytes(store.ids.data[a : a + n].astype(np.uint8)).decode() == str(key)


def test_token_files_round_trip(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = [(None, None), (5000, ""), (5001, "a <|endoftext|> b's"), (5002, None), (5001, "zz"), (5001, "zz")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    got = sorted(token_files(docs, PATH).collect(), key=lambda r: r.start)
    start, last = 0, None
    for r in got:
        assert r.start == start
        assert last is None or r.doc_id >= last
        start, last = start + r.n_tokens, r.doc_id

    def row(doc_id, text):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        return str(doc_id), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())

    want = sorted(row(*r) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want


def test_files_hold_flat_ids_and_offsets(spark, tokenizer):
    df = spark.createDataFrame([(k, f"text number {k}") for k in range(20)], "doc_id long, text string")
    folder = scratch(spark, "files")
    shards = write_shards(df, folder, PATH, 2)
    assert sum(s.n_docs for s in shards) == 20
    flat = np.concatenate([np.fromfile(s.path + ".ids", f"<u{s.width}") for s in shards if s.n_docs])
    want = [i for k in range(20) for i in [*tokenizer.encode(f"text number {k}").ids, 2]]
    assert flat.tolist() == want and {s.width for s in shards} == {2}
    for s in shards:
        offsets = np.fromfile(s.path + ".offsets", "<i8")
        assert len(offsets) == s.n_docs + 1 and offsets[-1] == s.n_ids
    assert read_shards(spark, folder, shards).count() == 20


def test_token_files_of_nothing(spark):
    assert token_files(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_ids_of_other_names(spark):
    df = spark.createDataFrame([(1, "a")], "key long, body string").withColumn("tie", F.lit("x"))
    assert [tuple(r)[:3] for r in token_files(df, PATH, doc_id="key", text="body").collect()] == [(1, 0, 2)]
