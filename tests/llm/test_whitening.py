import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from newsflow.llm import whitening
from newsflow.llm.vectors import common_size
from newsflow.llm.whitening import pair_squares, whiten


def plain(rows):
    """x of every usable row, and the exact covariance of the distinct ones as fractions."""
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    kept = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in kept]
    sizes = Counter(len(x) for x in {x for _, x in kept})
    size = max(sizes, key=lambda s: (sizes[s], s))
    kept = [(i, x) for i, x in kept if len(x) == size]
    fit = sorted({x for _, x in kept})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    cov = [
        [sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit) for j in range(size)]
        for i in range(size)
    ]
    return kept, n, sums, np.array([[float(Fraction(c, n**3)) for c in row] for row in cov])


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "x") for r in rows], "vec_id long, embedding array<double>, N string"
    ).repartition(3)


def random_rows(n, size, seed, far=0.0):
    rnd = random.Random(seed)
    mixing = [[rnd.gauss(0, 1 + k) for k in range(size)] for _ in range(size)]
    rows = []
    for i in range(n):
        z = [rnd.gauss(0, 1) for _ in range(size)]
        rows.append((i, [far + sum(m * c for m, c in zip(line, z)) for line in mixing]))
    return rows


def check(spark, rows, components=16):
    kept, n, sums, cov = plain(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = whiten(frame(spark, rows), components=components).collect()
    k = min(components, len(values))
    assert len(got) == len(kept) * k
    at = {i: [x for j, x in kept if j == i] for i, _ in kept}
    sign = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        c = r.component - 1
        assert r.explained == pytest.approx(values[c] / np.trace(cov), rel=1e-9)
        fits = False
        for x in at[r.vec_id]:
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
            y = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
            want = float(y @ vectors[:, c]) / math.sqrt(values[c])
            if (deviation if deviation < 2**63 else None) != r.deviation:
                continue
            if abs(want) > 1e-3:
                sign.setdefault(c, np.sign(want * r.whitened))
            fits |= abs(want * sign.get(c, 1) - r.whitened) < 1e-7
        assert fits
    return got


def test_equals_plain_fractions(spark):
    rows = random_rows(120, 5, 1)
    check(spark, rows + rows[:40] + [(500, rows[0][1]), (None, rows[1][1])], components=3)


def test_more_components_than_dimensions_and_far_from_zero(spark):
    got = check(spark, random_rows(60, 3, 2, far=1e6))
    assert {r.component for r in got} == {1, 2, 3}


def test_deviations_beyond_a_long_are_null(spark):
    got = check(spark, random_rows(30, 3, 4, far=0.0) + [(99, [3e9, 0.0, 1.0])], components=1)
    assert any(r.deviation is None for r in got)


def test_odd_rows(spark):
    odd = [
        (100, None),
        (101, [1.0, None, 0.0]),
        (102, [float("nan"), 0.0, 0.0]),
        (103, [0.0, 0.0, float("-inf")]),
        (104, [1.0, 2.0]),
        (105, []),
    ]
    check(spark, random_rows(40, 3, 7) + odd)


def test_without_variance_there_are_no_rows(spark):
    assert whiten(frame(spark, [(1, [1.0, 2.0])] * 5)).collect() == []
    assert whiten(frame(spark, [(1, [1.0])]).limit(0)).collect() == []
    assert whiten(frame(spark, [(1, [])])).collect() == []
    # one dimension never changes: a component less
    rows = [(i, [math.sin(i), 2.0, math.cos(i)]) for i in range(30)]
    assert {r.component for r in whiten(frame(spark, rows)).collect()} == {1, 2}


def test_squares_of_sums_are_exact():
    for top in (50, 2**24, 2**40):
        rnd = np.random.default_rng(top)
        y = rnd.integers(-top, top, (17, 4))
        want = [
            sum((int(r[i]) + (int(r[j]) if i != j else 0)) ** 2 for r in y)
            for i in range(4)
            for j in range(i, 4)
        ]
        assert pair_squares(y) == want
    full = np.full((whitening.ROWS, 2), -(2**25) + 1)
    assert pair_squares(full)[1] == whitening.ROWS * (2**26 - 2) ** 2


def test_the_commonest_size_wins_and_the_greater_of_equals(spark):
    assert common_size(spark.createDataFrame([(2,), (3,), (2,)], "size int")) == 2
    assert common_size(spark.createDataFrame([(2,), (3,)], "size int")) == 3


def test_the_query_has_the_columns_of_its_contract(spark, sf_dir):
    from newsflow.llm.queries import op11_whitening

    got = op11_whitening(spark, sf_dir)
    assert got.dtypes == [
        ("vec_id", "bigint"),
        ("component", "int"),
        ("n", "bigint"),
        ("deviation", "bigint"),
        ("whitened", "double"),
        ("explained", "double"),
        ("identity_error", "double"),
    ]
    # the real table against plain fractions
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows])
    n, sums = len(np.unique(x, axis=0)), np.unique(x, axis=0).sum(0)
    centred = np.unique(x, axis=0) - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    found = got.toPandas()
    assert len(found) == 16 * len(rows) and (found.n == n).all() and found.identity_error.max() < 1e-9
    for c in range(16):
        e, axis = values[-1 - c], vectors[:, -1 - c]
        part = found[found.component == c + 1].set_index("vec_id")
        want = (x - sums / n) @ axis / np.sqrt(e)
        mine = part.loc[[i for i, _ in rows]].whitened.to_numpy()
        assert np.allclose(np.abs(mine), np.abs(want), atol=1e-6)
        assert np.allclose(part.explained, e / values.sum(), rtol=1e-9)
    deviation = ((n * x - sums) ** 2).sum(1)
    assert found[found.component == 1].set_index("vec_id").loc[[i for i, _ in rows]].deviation.tolist() == deviation.tolist()
