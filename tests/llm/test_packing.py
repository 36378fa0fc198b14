import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsflow.llm import packing
from newsflow.llm.packing import Limits, best_plan, cut_pieces, place, plan, sequences, takes

PATH = public_tokenizers.path("byte_bpe_50k.json")


def one_by_one(counts, limits, weights, rule):
    """Best-fit piece by piece; the contents of the sequences."""
    capacity, weight = limits.capacity, np.array(weights, float)
    open_, held = [], []
    for length in sorted(counts, reverse=True):
        need = takes(length)
        for _ in range(counts[length]):
            best = None
            for k, left in enumerate(open_):
                if (left >= need).all():
                    if rule == "dot":
                        s = -float(((left / capacity) * (need / capacity) * weight).sum())
                    else:
                        s = float((((left - need) / capacity) ** 2 * weight).sum())
                    if best is None or s < best[0]:
                        best = s, k
            if best is None:
                open_.append(capacity.copy())
                held.append([])
                best = 0, len(open_) - 1
            open_[best[1]] = open_[best[1]] - need
            held[best[1]].append(length)
    return held


def contents(made, counts):
    """The lengths in each sequence of a plan; asserts that offsets have no gaps."""
    found = defaultdict(list)
    rows = sorted(made.segments)
    for length, n in counts.items():
        mine = [s for s in rows if s[0] == length]
        for number in range(n):
            _, first, each, base, used = max(s for s in mine if s[1] <= number)
            found[base + (number - first) // each].append((used + (number - first) % each * length, length))
    out = []
    for k in sorted(found):
        at = 0
        for offset, length in sorted(found[k]):
            assert offset == at
            at += length
        out.append([x for _, x in sorted(found[k])])
    assert sorted(found) == list(range(made.sequences))
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [Limits(50), Limits(50, 3), Limits(50, None, 700), Limits(40, 4, 500)])
def test_plans_are_best_fit_under_every_limit(rule, limits):
    rnd = random.Random(str(limits))
    for _ in range(15):
        counts = dict(Counter(rnd.choice([1, 2, 3, 5, rnd.randint(1, limits.longest)]) for _ in range(60)))
        weights = rnd.choice([(1.0, 1.0, 1.0), (1.0, 0.5, 2.0)])
        made = plan(counts, limits, weights, rule)
        got = contents(made, counts)
        for lengths in got:
            assert (sum(takes(x) for x in lengths) <= limits.capacity).all()
        assert Counter(x for s in got for x in s) == counts
        if rule == "norm":
            want = one_by_one(counts, limits, weights, rule)
            assert Counter(map(tuple, got)) == Counter(map(tuple, want))
        else:
            assert made.sequences <= len(one_by_one(counts, limits, weights, rule)) * 1.2 + 1


def test_plans_are_near_the_least_possible():
    rnd = random.Random(1)
    counts = dict(Counter(min(1024, int(rnd.paretovariate(0.7) * 20)) for _ in range(30_000)))
    least = -(-sum(x * n for x, n in counts.items()) // 1024)
    assert least <= best_plan(counts, Limits()).sequences <= least * 1.002 + 1


def test_limits():
    assert Limits(100).longest == 100 and Limits(100, None, 400).longest == 20
    with pytest.raises(ValueError):
        Limits(100, 0).longest


def table(spark):
    rnd = random.Random(2)
    words = ["alpha", " beta", "\n", "naïve ", "中文", " 12 ", "<|endoftext|>", "  "]
    texts = ["".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(120)]
    texts += ["", None, "word " * 400, texts[5], texts[5], "a" * 900]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "y"), (3, "again", "z"), (3, "again", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, OFFSET string").repartition(3), rows


def test_pieces_and_places(spark):
    docs, rows = table(spark)
    library = Tokenizer.from_file(PATH)
    size = 64
    pieces = cut_pieces(docs, PATH, longest=size)
    want = []
    for i, text, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        edges = [0, *range(len(ids) % size or min(size, len(ids)), len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            raw = np.array(ids[a:b], "<u4").tobytes()
            want.append((i, k, a, b - a, zlib.crc32(raw)))
    found = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("crc"))
    assert Counter(map(tuple, found.collect())) == Counter(want)

    got = place(pieces, Limits(size)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got) == Counter(want)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for pairs in held.values():
        at = 0
        for offset, length in sorted(pairs):
            assert offset == at
            at += length
        assert at <= size
    total = sum(w[3] for w in want)
    assert len(held) <= math.ceil(total / size) * 1.05 + 1

    whole = sequences(place(pieces, Limits(size, documents=3))).collect()
    assert all(r.n_tokens == sum(r.lengths) == len(r.ids) // 4 <= size and r.n_pieces <= 3 for r in whole)
    assert sum(r.n_pieces for r in whole) == len(want)


def test_groups_of_a_common_length_are_numbered_one_after_another(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 7)
    rows = [(i, 5) for i in range(200)] + [(1000 + i, 3) for i in range(31)]
    got = place(spark.createDataFrame(rows, "k int, length int").repartition(4), Limits(16)).collect()
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    assert len(got) == 231 and len({r.k for r in got}) == 231
    for pairs in held.values():
        assert [o for o, _ in sorted(pairs)] == np.append(0, np.cumsum([x for _, x in sorted(pairs)]))[:-1].tolist()
        assert sum(x for _, x in pairs) <= 16


def test_lengths_that_fit_nowhere_and_clashing_columns(spark):
    rows = [(1, None, 5), (2, 0, 5), (3, -4, 5), (4, 17, 5), (5, 16, 5), (6, 2, None)]
    got = place(spark.createDataFrame(rows, "k int, size long, Offset int"), Limits(16), length="size")
    assert got.columns == ["k", "size", "sequence_id", "offset"]
    found = {r.k: (r.sequence_id, r.offset) for r in got.collect()}
    assert all(found[k] == (None, None) for k in (1, 2, 3, 4))
    assert {found[5][0], found[6][0]} == {0, 1} and found[5][1] == found[6][1] == 0
    empty = spark.createDataFrame([], "k int, length int")
    assert place(empty).collect() == []
    assert cut_pieces(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_the_query_has_the_columns_of_its_contract(spark, sf_dir):
    from newsflow.llm.queries import op12_packing

    assert op12_packing(spark, sf_dir).dtypes == [
        ("doc_id", "bigint"),
        ("piece", "int"),
        ("start", "bigint"),
        ("length", "bigint"),
        ("ids_crc32", "bigint"),
        ("sequence_id", "bigint"),
        ("offset", "bigint"),
    ]
