import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsflow.llm import decontaminate as module
from newsflow.llm.decontaminate import FMIndex, Wavelet, decontaminate, scan, suffix_array, windows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size):
    windows = []
    for name, text in items:
        w = words_of(text)
        windows += [(name, w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
    for text in docs:
        w = words_of(text)
        hit, found = [False] * len(w), set()
        for name, p in windows:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    found.add(name)
                    hit[k : k + len(p)] = [True] * len(p)
        yield len(w), sum(hit), sorted(found)


def test_suffix_array_and_ranks():
    rng = np.random.default_rng(1)
    for _ in range(50):
        seq = rng.integers(0, rng.integers(1, 6), rng.integers(1, 80))
        assert suffix_array(seq).tolist() == sorted(range(len(seq)), key=lambda i: seq[i:].tolist())
        tree = Wavelet(seq, 6)
        place = rng.integers(0, len(seq) + 1, 30)
        symbol = rng.integers(0, 6, 30)
        assert tree.rank(symbol, place).tolist() == [
            int((seq[:p] == s).sum()) for s, p in zip(symbol, place)
        ]
        assert tree.access(np.arange(len(seq))).tolist() == seq.tolist()


def test_fm_index_finds_every_place():
    rng = np.random.default_rng(2)
    for _ in range(40):
        seq = rng.integers(0, 4, rng.integers(2, 200))
        index = FMIndex(seq, 4)
        for size in (1, 2, 3, 5):
            pattern = rng.integers(1, 4, (1, size))
            low, high = index.search(pattern, np.array([size]))
            got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            want = [k for k in range(len(seq) - size + 1) if (seq[k : k + size] == pattern[0]).all()]
            assert got == want


@pytest.mark.parametrize("size", [3, 5, 10])
def test_scan_equals_brute_force(size, monkeypatch):
    rnd = random.Random(size)
    for _ in range(15):
        def text(n):
            return " ".join(rnd.choice(["a", "b", "cé", "D", "e1"]) for _ in range(rnd.randint(0, n))) + rnd.choice(["", ".", " \n"])

        docs = [text(40) for _ in range(30)] + [None, ""]
        items = [(str(i), text(12)) for i in range(6)]
        w = windows_of(items, size)
        got = [g[:3] for g in scan(pa.array(docs, pa.string()), [([i for i, _ in items], w)] if w else [])]
        assert got == list(brute(docs, items, size))


def test_frames_blocks_and_removal(spark, monkeypatch):
    item = "One two three four five six seven eight nine ten eleven"
    items = [(1, item), (12, "zwölf WÖRTER"), (2, None), (None, "zwölf wörter"), (3, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("n_hit", F.lit(1))
    docs = [
        (1, f"Start {item.upper()}! end zwölf-wÖrter x"),
        (2, "one two three four five six seven eight nine"),
        (3, None),
        (None, "a two three four five six seven eight nine ten eleven. b"),
        (4, "zwölf wÖrter zwölf wÖrter"),
        (4, "zwölf wörter"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("Spans", F.lit("own"))
    want = [(n, h, len(f)) for n, h, f in brute([d[1] for d in docs], [(str(i or ""), t) for i, t in items], 10)]
    for block in (4 << 20, 30):
        monkeypatch.setattr(module, "BLOCK_BYTES", block)
        got = decontaminate(df, benchmark).collect()
        assert [(r.n_words, r.n_hit, r.n_items) for r in got] == want
        assert [r.contaminated for r in got] == [h > 0 for _, h, _ in want]
    cleaned = decontaminate(df, benchmark, remove=True)
    assert cleaned.columns[:2] == ["doc_id", "text"]
    texts = [r.text for r in cleaned.collect()]
    # only ASCII letters are lower-cased, so both spellings are items of their own
    assert texts == ["Start ! end  x", docs[1][1], None, "a . b", "", ""]
    assert [r.n_hit for r in decontaminate(cleaned, benchmark).collect()] == [0] * 6


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [r.n_hit for r in decontaminate(docs, items.limit(0)).collect()] == [0]
    assert decontaminate(docs.limit(0), items).count() == 0
    assert [r.n_hit for r in decontaminate(docs, items).collect()] == [2]


def test_a_large_benchmark_takes_several_passes(spark, monkeypatch):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["alpha", "beta", "gamma", "delta", "eps"])
    items = [(str(i), " ".join(word() for _ in range(rnd.randint(3, 14)))) for i in range(40)]
    docs = [(i, " ".join(word() for _ in range(120))) for i in range(30)] + [(None, None), (31, "")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    held = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(
        type(spark.sparkContext), "broadcast", lambda self, v: held.append(v) or broadcast(self, v)
    )
    whole = sorted(map(str, decontaminate(df, benchmark, window=5).collect()))
    assert len(held) == 1
    held.clear()
    monkeypatch.setattr(module, "BLOCK_BYTES", 300)
    monkeypatch.setattr(module, "PASS_BYTES", 600)
    assert sorted(map(str, decontaminate(df, benchmark, window=5).collect())) == whole
    sizes = [sum(len(i) for i, _ in blocks) for blocks in held]
    assert len(held) == 3 and sum(sizes) == 40 and max(sizes) < 40
    texts = dict(docs)
    for r in decontaminate(df, benchmark, window=5, remove=True).collect():
        raw, out, last = (texts[r.doc_id] or "").encode(), b"", 0
        for s in r.spans:
            out, last = out + raw[last : s.start], s.end
        assert (r.text or "") == (out + raw[last:]).decode()
