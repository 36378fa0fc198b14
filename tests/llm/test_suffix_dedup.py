import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsflow.llm import suffix_dedup as module
from newsflow.llm.suffix_dedup import COVER, PERIOD, earliest, suffix_dedup

LAST = np.iinfo(np.int64).max


def brute(rows, length):
    first = {}
    for doc_id, text in rows:
        for s in range(len(text) - length + 1):
            key = text[s : s + length]
            first[key] = min(first.get(key, LAST), doc_id)
    out = []
    for doc_id, text in rows:
        gone = bytearray(len(text))
        for s in range(len(text) - length + 1):
            if first[text[s : s + length]] < doc_id:
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(text, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((doc_id, len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def digest(df):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((LAST if r[0] is None else r[0], *r[1:]) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    rnd = random.Random(4)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()
    rows = [(r.doc_id, r.text) for r in docs]
    passages = ["".join(rnd.choice("abcde fgh") for _ in range(200)) for _ in range(5)]
    for k in range(120):
        p, i = rnd.choice(passages), rnd.randint(0, 100)
        noise = ["".join(rnd.choice("xyzé") for _ in range(rnd.randint(0, 60))) for _ in range(2)]
        tail = rnd.choice(["", "a" * 80, "ab" * 60, "Q" * 49])
        rows.append((rnd.choice([1000 + k, 1000 + k, None, 5]), noise[0] + p[i : rnd.randint(i + 30, 200)] + tail + noise[1]))
    return [*rows, (7000, None), (7001, ""), (7002, "short"), (7003, "short")]


def test_cover_meets_every_difference():
    for a in range(PERIOD):
        for b in range(PERIOD):
            assert any((a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER for d in range(PERIOD))


def test_ties_are_resolved_by_the_cover():
    rnd = random.Random(1)
    for _ in range(150):
        length = rnd.choice([60, 50, 40, 33, 32, 20, 16])
        letters = rnd.choice(["ab", "a", "abcdef"])
        once = "".join(rnd.choice(letters) for _ in range(rnd.randint(length, 400)))
        text = np.frombuffer((once + once[: rnd.randint(0, len(once))] + once).encode(), np.uint8)
        places = range(len(text) - length + 1)
        starts = np.sort(np.array(rnd.sample(places, min(len(places), 100))))
        docs = np.array([rnd.randint(0, 20) for _ in starts])
        least = {}
        for s, d in zip(starts, docs):
            key = text[s : s + length].tobytes()
            least[key] = min(least.get(key, 99), d)
        want = [least[text[s : s + length].tobytes()] for s in starts]
        assert earliest(text, starts, docs, length).tolist() == want


@pytest.mark.parametrize("length, hot", [(50, 10_000), (50, 20), (50, 2), (20, 10_000), (33, 8)])
def test_equals_brute_force(spark, rows, monkeypatch, length, hot):
    monkeypatch.setattr(module, "GROUP_BYTES", 30_000)
    monkeypatch.setattr(module, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(module, "BLOCK_BYTES", 4_000)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute([(LAST if i is None else i, (t or "").encode()) for i, t in rows], length)
    assert digest(suffix_dedup(df, length=length, hot=hot)) == want


def test_parts_of_a_very_long_text_overlap(spark, monkeypatch):
    rnd = random.Random(2)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    long = "".join(rnd.choice("rstuvw ") for _ in range(3000)) + passage + "x" * 500
    monkeypatch.setattr(module, "_SEGMENT", 64)
    rows = [(1, passage), (2, long), (3, long[1000:2500])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(suffix_dedup(df)) == brute([(i, t.encode()) for i, t in rows], 50)


def test_replace_and_clashing_columns(spark):
    passage = "é" * 40
    rows = [(2, f"a{passage}b", "x", 1), (1, passage, None, 2), (3, None, "y", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_BYTES string, dedup_group int")
    out = suffix_dedup(df, replace=True)
    assert out.columns[:3] == ["doc_id", "text", "dedup_group"]
    got = {r.doc_id: (r.text, r.n_removed, [tuple(s) for s in r.spans]) for r in out.collect()}
    assert got == {2: ("ab", 80, [(1, 81)]), 1: (passage, 0, []), 3: (None, 0, [])}
    assert suffix_dedup(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup(df, length=8)


def test_part_of_a_character_is_dropped(spark):
    # the passage starts inside the two-byte letter
    tail = "b" * 60
    rows = [(1, "é" + tail), (2, "©" + tail)]  # both end in the byte 0xA9
    df = spark.createDataFrame(rows, "doc_id long, text string")
    (row,) = suffix_dedup(df, replace=True).where("doc_id = 2").collect()
    assert row.n_removed == 61 and row.text == ""


def test_hot_anchors_are_split_the_same_everywhere(spark, monkeypatch):
    """A passage in all documents, each with its own surroundings."""
    monkeypatch.setattr(module, "GROUP_BYTES", 2_000)
    monkeypatch.setattr(module, "BUCKET_BYTES", 2_000)
    rnd = random.Random(3)
    passage = "the very common passage that all of the documents share, word by word"
    noise = lambda: "".join(rnd.choice("qrstuvwxyz") for _ in range(40))
    rows = [(k, noise() + passage + noise()) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute([(i, t.encode()) for i, t in rows], 50)
    assert digest(suffix_dedup(df, hot=5)) == want == digest(suffix_dedup(df))


def test_null_ids_come_last(spark):
    text = "".join(random.Random(6).choice("abcdef") for _ in range(90))
    df = spark.createDataFrame([(None, text), (None, text), (4, text)], "doc_id long, text string")
    got = suffix_dedup(df).groupBy("doc_id").agg(F.sum("n_removed").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {None: 180, 4: 0}
