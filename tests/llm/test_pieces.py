import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from newsflow.llm.common import by_batches
from newsflow.llm.pieces import Decoder, Pieces, decode, encode, encode_texts, refuse_unknown_rules

PATH = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = list("abcdefgh   ..,\n\t'éß中文\U0001f642\x00▁<0x>==--  aaaa") + [
    "the", "ing", "tion", "aa", "▁▁", "    ", "</s>", "<0x0A>",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids_of(texts):
    out = []
    for counts, ids in encode_texts(pa.array(texts, pa.string()), PATH, "bpe"):
        edges = np.append(0, np.cumsum(counts))
        out += [ids[a:b].tolist() for a, b in zip(edges, edges[1:])]
    return out


def test_ids_equal_the_library(library):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 30))) for _ in range(5000)]
    texts += ["", " ", " " * 40, "=" * 100, "a" * 77, "-" * 33 + " " + "-" * 19, "x" * 5000]
    got = ids_of(texts)
    assert got == library.encode(texts)
    edges = np.append(0, np.cumsum([len(i) for i in got]))
    back = Decoder(PATH).texts(np.array([i for ids in got for i in ids]), edges)
    assert back == [library.decode(i) for i in got]
    assert back == [t.replace("▁", " ") for t in texts]


def test_real_texts(spark, sf_dir, library):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert ids_of(texts) == library.encode(texts)


def test_merges_and_states_agree():
    model = Pieces(PATH)
    rnd = random.Random(5)
    for _ in range(500):
        word = "▁" + "".join(rnd.choice("aeinrst") for _ in range(rnd.randint(1, 14)))
        _, ids = model.encode_words([word])
        assert [model.ids[p] for p in model.merge(word)] == ids.tolist()


def test_unigram_words_take_the_best_sum():
    """The model of a kind that no file here has: scores are set by hand."""
    model = Pieces(PATH)
    model.kind = "unigram"
    scores = {"a": -2.0, "b": -2.1, "c": -2.3, "ab": -3.3, "bc": -2.9, "abc": -6.5, "ca": -3.1, "aa": -3.9}
    model.ids = {p: i for i, p in enumerate(scores)}
    model.score, model.longest = scores, 3
    words = ["".join(w) for n in range(1, 7) for w in itertools.product("abc", repeat=n)]
    counts, ids = model.encode_words(words)
    names = list(scores)
    edges = np.append(0, np.cumsum(counts))

    def best(word):
        top = [0.0] + [-1e9] * len(word)
        for end in range(1, len(word) + 1):
            for size in range(1, 4):
                piece = word[max(0, end - size) : end]
                if len(piece) == size and piece in scores:
                    top[end] = max(top[end], top[end - size] + scores[piece])
        return top[-1]

    for word, a, b in zip(words, edges, edges[1:]):
        found = [names[i] for i in ids[a:b]]
        assert "".join(found) == word
        assert sum(scores[p] for p in found) == pytest.approx(best(word))


def test_encode_and_decode_frames(spark, library):
    rows = [(1, "Hello  wörld\n", 5), (None, None, 6), (2, "", 7), (1, "Hello  wörld\n", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS int")
    out = encode(df, PATH)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "ids_crc32"]
    back = decode(out, PATH).collect()
    assert len(back) == 4
    for r in back:
        assert r.ids == library.encode(r.text or "") and r.decoded == (r.text or "")
        assert r.n_tokens == len(r.ids)
    assert decode(encode(df.limit(0), PATH), PATH).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([-1, 99_999],)], "ids array<int>")
    assert [r.decoded for r in decode(odd, PATH).collect()] == ["", "", ""]


def test_one_pass_encodes_and_decodes(spark, library):
    rows = [(1, "Hello  wörld\n", 5), (None, None, 6), (2, "", 7), (3, "é▁\U0001f642" * 400, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Decoded int").repartition(2)
    out = encode(df, PATH, decoded="decoded")
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "ids_crc32", "decoded"]
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    for r in out.collect():
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)


def test_any_ids_are_decoded_as_the_library_does(library):
    rnd = random.Random(4)
    lists = [[rnd.randrange(3, 32_000) for _ in range(rnd.randint(0, 9))] for _ in range(500)]
    edges = np.append(0, np.cumsum([len(i) for i in lists]))
    got = Decoder(PATH).texts(np.array([i for ids in lists for i in ids]), edges)
    for text, ids in zip(got, lists):
        if not any(library.is_byte(i) for i in ids):
            assert text == library.decode(ids)


def test_what_a_worker_keeps_is_bounded_by_bytes(monkeypatch):
    from newsflow.llm import pieces

    monkeypatch.setattr(pieces, "STORE_BYTES", 20_000)
    by_batches("another operator", lambda batches: batches)(iter(()))
    pieces._model.cache_clear()
    rnd = random.Random(6)
    texts = [" ".join("".join(rnd.choices("abcdef", k=9)) for _ in range(30)) for _ in range(400)]
    want = sentencepiece.SentencePieceProcessor(model_file=PATH).encode(texts)
    got = []
    for k in range(0, 400, 20):
        got += ids_of(texts[k : k + 20])
        store = pieces._model(PATH, "bpe")[1]
        # what one run of texts adds comes on top
        assert 28 * len(store) + 4 * store.ids.size < 20_000 + 20 * 30 * (28 + 4 * 10)
    assert got == want
    pieces._model.cache_clear()


def test_models_with_other_rules_are_refused(library):
    def message(field, value):
        if isinstance(value, int):
            return bytes([field << 3, value])
        return bytes([field << 3 | 2, len(value)]) + value

    refuse_unknown_rules(library.serialized_model_proto())
    rules = {4: 0, 5: 1}
    for change in ({2: b"map"}, {6: b"rule"}, {4: 1}, {5: 0}):
        spec = b"".join(message(f, v) for f, v in (rules | change).items())
        with pytest.raises(ValueError):
            refuse_unknown_rules(message(3, spec))
    with pytest.raises(ValueError, match="user-defined"):
        refuse_unknown_rules(message(1, message(1, b"x") + message(3, 4)))
