import random

import numpy as np
import pyarrow as pa
import pytest

from newsflow.llm import common
from newsflow.llm.common import (
    BYTE_VALUES,
    buffers,
    by_batches,
    chunks,
    code_points,
    cut,
    free_name,
    prefix_sums,
    ranges,
    shared_folder,
    span_hash,
    worker_cache,
)


def test_buffers_of_slices_nulls_and_chunks():
    texts = ["", None, "äb", "x" * 50, None]
    array = pa.array(["skip", *texts], pa.string()).slice(1)
    chunked = pa.chunked_array([array, pa.array(["end"])])
    for values, column in ((texts, array), ([*texts, "end"], chunked), ([], pa.array([], pa.string()))):
        data, offsets = buffers(column)
        got = [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]
        assert got == [v or "" for v in values]


def test_code_points_and_their_offsets():
    texts = ["", "aé", "中\U0001f642x", ""]
    points, offsets = code_points(*buffers(pa.array(texts)))
    assert ["".join(map(chr, points[a:b])) for a, b in zip(offsets, offsets[1:])] == texts


def test_chunks_cover_all_rows_in_order():
    rnd = random.Random(1)
    for _ in range(50):
        sizes = [rnd.choice([0, 1, 5, 30]) for _ in range(rnd.randint(0, 20))]
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
        got = list(chunks(offsets, 10))
        assert [k for i, j in got for k in range(i, j)] == list(range(len(sizes)))
        assert all(j - i == 1 or offsets[j] - offsets[i] <= 10 for i, j in got)


def test_ranges():
    assert ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert ranges(np.zeros(0), np.zeros(0)).tolist() == []


def test_equal_spans_hash_equally_wherever_they_stand():
    text = np.frombuffer(b"abcabcabd" * 50, np.uint8)
    sums = prefix_sums(BYTE_VALUES[text])
    starts = np.arange(len(text) - 6)
    hashes = span_hash(sums, starts, starts + 6).tolist()
    by_text = {}
    for s, h in zip(starts, hashes):
        by_text.setdefault(text[s : s + 6].tobytes(), set()).add(h)
    assert all(len(h) == 1 for h in by_text.values())
    assert len({h for v in by_text.values() for h in v}) == len(by_text)


def test_caches_end_with_the_operator():
    made = []

    @worker_cache
    def model(path):
        made.append(path)
        return path

    def run(batches):
        for b in batches:
            yield model("m") + b

    assert list(by_batches("one", run)(["a", "b"])) == ["ma", "mb"]
    assert list(by_batches("one", run)(["c"])) == ["mc"] and made == ["m"]
    assert list(by_batches("two", run)(["d"])) == ["md"] and made == ["m", "m"]


class Session:
    """A session of a master, with or without a shared folder."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master})()
        self.conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: folder or default)})


def test_shared_folder():
    assert shared_folder(Session("yarn", "hdfs://x/y")) == "hdfs://x/y"
    local = Session("local[2]")
    assert shared_folder(local) == shared_folder(local)
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:1"):
        with pytest.raises(ValueError):
            shared_folder(Session(master))


def test_cut_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, t string")
    again = cut(df, "test")
    assert again.schema == df.schema and sorted(again.collect()) == sorted(df.collect())
    assert cut(df.limit(0), "test").count() == 0
    assert "ExistingRDD" not in again._jdf.queryExecution().toString()


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "a long, A_ long")
    assert free_name(df, "A") == "A__" and free_name(df, "b") == "b"


def test_package_is_shipped_only_where_it_is_not_seen(monkeypatch, tmp_path):
    sent = []
    context = type("Context", (), {"addPyFile": lambda self, p: sent.append(p)})()
    session = type("Session", (), {"sparkContext": context})()
    common.ship(session)
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("PYTHONPATH", raising=False)
    common.ship(session)
    common.ship(session)
    assert len(sent) == (1 if sent else 0) and sent
