import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from newsflow.llm import code_compression
from newsflow.llm.code_compression import compress, moved_radius, neighbours, next_book, settle


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def plain(rows, parts, entries, rounds):
    """Every part against every entry, in whole numbers."""
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    sizes = defaultdict(int)
    for r in kept:
        sizes[len(r[1])] += 1
    size = max(sizes, key=lambda s: (sizes[s], s), default=0)
    kept = [(i, [math.floor(4096 * c) for c in v], label) for i, v, label in kept if len(v) == size]
    width = size // parts
    ordered = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))[:entries]
    books = [[r[1][p * width : (p + 1) * width] for r in ordered] for p in range(parts)]

    def nearest(p, v):
        mine = v[p * width : (p + 1) * width]
        return min((far(mine, e), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = defaultdict(list)
            for _, v, _ in kept:
                held[nearest(p, v)[1]].append(v[p * width : (p + 1) * width])
            new.append(
                [
                    [sum(x) // len(held[j]) for x in zip(*held[j])] if held[j] else e
                    for j, e in enumerate(books[p])
                ]
            )
        books = new
    total, out = defaultdict(int), []
    for i, v, label in kept:
        found = [nearest(p, v) for p in range(parts)]
        error = sum(d for d, _ in found)
        total[label] += error
        out.append((i, "".join(f"{j:02x}" for _, j in found), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[label], sha) for i, c, e, label in out), key=str)


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "x") for r in rows], "vec_id long, embedding array<double>, label string, CODE string"
    ).repartition(3)


def random_rows(n, size, step, seed):
    rnd = random.Random(seed)
    return [
        (i, [rnd.randint(-6, 6) * step for _ in range(size)], rnd.choice(["a", "b", None])) for i in range(n)
    ]


@pytest.mark.parametrize("step", [1 / 4096, 1 / 64, 1e9], ids=["ties", "usual", "beyond 64 bits"])
def test_equals_comparing_all(spark, step):
    rows = random_rows(150, 8, step, 3)
    got = compress(frame(spark, rows), parts=4, entries=5, rounds=3)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = plain(rows, 4, 5, 3)
    if step == 1e9:
        want = [(i, c, e if e < 2**63 else None, t if t < 2**63 else None, s) for i, c, e, t, s in want]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_odd_rows(spark):
    good = random_rows(20, 4, 1 / 512, 5)
    odd = [
        (100, None, "a"),
        (101, [1.0, None, 0.0, 0.0], "a"),
        (102, [float("nan"), 0.0, 0.0, 0.0], None),
        (103, [0.0, 0.0, float("inf"), 0.0], "b"),
        (104, [1.0, 2.0], "b"),
        (105, [], "b"),
        (None, good[3][1], "c"),
        (None, good[3][1], "c"),
        (7, good[7][1], None),
    ]
    rows = good + odd
    got = compress(frame(spark, rows), parts=2, entries=16, rounds=6)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 2, 16, 6)


def test_empty_tables_and_few_rows(spark):
    rows = random_rows(3, 4, 0.1, 1)
    assert compress(frame(spark, rows).limit(0)).collect() == []
    got = compress(frame(spark, rows), parts=2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 2, 16, 6)
    with pytest.raises(ValueError, match="equal parts"):
        compress(frame(spark, rows), parts=3)


def test_many_labels_meet_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(code_compression, "MAX_BROADCAST", 0)
    rows = random_rows(60, 4, 1 / 128, 9)
    got = compress(frame(spark, rows), parts=2, entries=4, rounds=2)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().toString().split("Physical")[1]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 2, 4, 2)


def test_balls_skip_most_of_the_work_and_lose_nothing():
    rnd = np.random.default_rng(0)
    centres = rnd.integers(-900, 900, (16, 6))
    parts = (centres[rnd.integers(0, 16, 4000)] + rnd.integers(-60, 60, (4000, 6))).astype(np.int64)
    book = parts[:16].tolist()
    at, radius, work = np.zeros(len(parts), np.int64), None, []
    for _ in range(6):
        near = neighbours(book, radius)
        at, distance, computed = settle(parts, at, np.array(book), near)
        work.append(computed)
        full = ((parts[:, None] - np.array(book)[None]) ** 2).sum(2)
        assert (at == full.argmin(1)).all() and (distance == full.min(1)).all()
        counts = [int((at == j).sum()) for j in range(16)]
        sums = [parts[at == j].sum(0).tolist() for j in range(16)]
        moved = next_book(book, counts, sums)
        furthest = [math.isqrt(int(distance[at == j].max(initial=0))) + 1 for j in range(16)]
        radius = moved_radius(book, moved, furthest)
        book = moved
    # later rounds compute a fraction of the 16 distances, and balls have fewer neighbours
    assert work[-1] < 3 * len(parts) < work[0]
    assert sum(len(others) for others, _ in neighbours(book, radius)) < 16 * 15
