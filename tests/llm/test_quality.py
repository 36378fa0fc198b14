import math
import os
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsflow.llm.common import buffers
from newsflow.llm.quality import WIDTH, features, fit_nnpu, held_out, quality, score_quality, train

TABLES = Path(os.environ.get("TESTDATA", "/root/testdata")) / "sf0.01"


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    good = labels == 1
    n = good.sum()
    return (rank[good].sum() - n * (n + 1) / 2) / (n * (len(scores) - n))


def test_features_do_not_cross_texts():
    texts = ["", "a", "Ab 1!", "$$$ %%%", "word word word", "ÄÖ\n\n"]
    both = features(*buffers(pa.array(texts)))
    alone = np.concatenate([features(*buffers(pa.array([t]))) for t in texts])
    assert both.shape == (6, WIDTH) and np.allclose(both, alone)
    assert both[0].sum() == 0


def test_nnpu_separates_with_positives_and_mixture_alone():
    rng = np.random.default_rng(3)
    draw = lambda n, at: rng.normal(at, 1, (n, 6)).astype(np.float32)
    positive = draw(800, 1.0)
    mixture = np.concatenate([draw(1800, 1.0), draw(1200, -1.0)])
    model = fit_nnpu(positive, mixture, prior=0.6, hidden=8, steps=400)
    held = np.concatenate([draw(500, 1.0), draw(500, -1.0)])
    labels = np.repeat([1, 0], 500)
    margin = model.margin(held)
    assert auc(labels, margin) > 0.97
    assert abs((margin > 0).mean() - 0.5) < 0.1


def test_held_out_fold(spark):
    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


@pytest.mark.skipif(not TABLES.exists(), reason="test tables are not on this machine")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    scored = quality(docs, labels)
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").where("held_out").toPandas()
    assert auc(rows.quality.values, rows.score.values) > 0.97
    assert rows.predicted[rows.quality == 1].mean() > 0.97
    assert ((rows.score >= 0.3).astype(int) == rows.predicted).all()


def test_only_the_text_counts_and_labels_of_the_fold_do_not(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    other = labels.withColumn(
        "quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    a, b = train(docs, labels, steps=20), train(docs, other, steps=20)
    assert np.array_equal(a.w1, b.w1) and a.prior == b.prior
    odd = spark.createDataFrame([(1, "A text."), (None, "A text."), (2, None), (3, "")], "doc_id long, text string")
    odd = odd.withColumn("SCORE", F.lit("own"))
    got = {(r.doc_id, r.text): r.score for r in score_quality(odd, a).collect()}
    assert got[1, "A text."] == got[None, "A text."] and got[2, None] == got[3, ""]
    assert all(0 <= s <= 1 for s in got.values())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "x"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = quality(docs, labels).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.5, 1)] * 2
    assert quality(docs.limit(0), labels.limit(0)).count() == 0


def test_an_id_that_many_rows_repeat_is_sampled_once(spark):
    from newsflow.llm import quality as module

    rows = [(k, f"text number {k}") for k in range(30)] + [(5, f"another text {k % 50}") for k in range(2000)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ids = spark.createDataFrame([(k,) for k in range(30)], "doc_id long")
    assert len(module._sample(texts, ids)) == 30


def plain_features(text):
    """The shares of class pairs and repeated words of one text, counted one by one."""
    from newsflow.llm import quality as module

    raw = text.encode()
    kinds = [int(module._KINDS[b]) for b in raw]
    out = np.zeros(WIDTH)
    fine = module.CLASSES**2
    for a, b in zip(kinds, kinds[1:]):
        out[a * module.CLASSES + b] += 1
        out[fine + int(module._COARSE[a]) * module.COARSE + int(module._COARSE[b])] += 1
    out[:-3] /= max(len(raw) - 1, 1)
    found = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    out[-3] = sum(a == b for a, b in zip(found, found[1:]))
    out[-2] = sum(a == b for a, b in zip(found, found[2:]))
    out[-1] = len(found) - len(set(found))
    out[-3:] /= max(len(found), 1)
    return np.sqrt(out)


TEXTS = ["", "a", "Ab 1! the the cat the", "$$$ %%%", "ÄÖ\n\nx x x", "One. Two, three; four?\t" * 9]


def test_features_and_scores_equal_a_plain_version():
    want = np.array([plain_features(t) for t in TEXTS])
    assert np.allclose(features(*buffers(pa.array(TEXTS))), want, atol=1e-6)
    rng = np.random.default_rng(1)
    model = fit_nnpu(rng.random((40, WIDTH), np.float32), rng.random((60, WIDTH), np.float32), 0.4, steps=3)
    for text, got in zip(TEXTS, model.score(pa.array(TEXTS))):
        x = plain_features(text)
        hidden = [
            max(0.0, sum((x[i] - model.mean[i]) * model.scale[i] * model.w1[i, j] for i in range(WIDTH)) + model.b1[j])
            for j in range(len(model.b1))
        ]
        margin = sum(h * w for h, w in zip(hidden, model.w2)) + model.b2
        assert got == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-4)


@pytest.mark.parametrize("prior", [0.3, 0.95])
def test_a_step_goes_down_the_non_negative_risk(prior):
    """Numeric derivatives of the risk as it is written: the first step of the fit moves every
    weight against its sign, or along that of the negative part where it is below zero."""
    rng = np.random.default_rng(5)
    p = rng.normal(0.6, 1, (64, 3)).astype(np.float32)
    u = rng.normal(0.0, 1, (64, 3)).astype(np.float32)
    settings = {"prior": prior, "hidden": 2, "batch": 64, "decay": 0.0, "seed": 3, "rate": 1e-3}
    start, after = (fit_nnpu(p, u, steps=n, **settings) for n in (0, 1))
    draws = np.random.default_rng(3)
    draws.normal(0, 1, (3, 2)), draws.normal(0, 1, 2)
    xu, xp = u[draws.integers(0, 64, 64)], p[draws.integers(0, 64, 64)]

    def margins(x, w1):
        h = np.maximum(((x - start.mean) * start.scale).astype(float) @ w1 + start.b1, 0)
        return h @ start.w2 + start.b2

    def risks(w1):
        of = {k: margins(x, w1) for k, x in (("p", xp), ("u", xu))}
        positive = prior * np.log1p(np.exp(-of["p"])).mean()
        negative = np.log1p(np.exp(of["u"])).mean() - prior * np.log1p(np.exp(of["p"])).mean()
        return positive, negative

    below = risks(start.w1.astype(float))[1] < 0
    for i in range(3):
        for j in range(2):
            ends = []
            for way in (1e-5, -1e-5):
                w1 = start.w1.astype(float).copy()
                w1[i, j] += way
                positive, negative = risks(w1)
                ends.append(-negative if below else positive + negative)
            slope = (ends[0] - ends[1]) / 2e-5
            if abs(slope) > 1e-4:
                assert np.sign(after.w1[i, j] - start.w1[i, j]) == -np.sign(slope)
