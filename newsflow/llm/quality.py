"""Quality classifier by positive-unlabelled learning.

Texts become frequencies of pairs of byte classes. Trusted positives and unlabelled web text
train a small network that minimises the non-negative unbiased risk, with the class prior
estimated from the data. The fit uses bounded samples; every text is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsflow.llm.common import buffers, by_batches, chunks, free_name, mix, quoted, ship
from newsflow.llm.decontaminate import words

#: At most so many rows of each sample are used for the fit.
POSITIVES, UNLABELLED = 8_000, 24_000
CUT = 0.3

# Byte classes: the signs of ASCII one by one, the rest in kinds.
_KINDS = np.zeros(256, np.uint8)
_KINDS[ord("a") : ord("z") + 1] = 1
_KINDS[ord("A") : ord("Z") + 1] = 2
_KINDS[ord("0") : ord("9") + 1] = 3
_KINDS[128:] = 4
_KINDS[[9, 11, 12, 32]] = 5
_KINDS[[10, 13]] = 6
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_KINDS[_SIGNS] = np.arange(7, 7 + len(_SIGNS))
CLASSES = 7 + len(_SIGNS)
#: The same with signs in two kinds: those of ordinary prose and the others.
_COARSE = np.arange(CLASSES, dtype=np.int32)
_COARSE[7:] = [7 if chr(b) in ".,;:'\"-()?!" else 8 for b in _SIGNS]
COARSE = 9
#: Fine pairs, coarse pairs, and three shares of repeated words.
WIDTH = CLASSES * CLASSES + COARSE * COARSE + 3


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of class pairs, and of words that repeat the word before,
    the one before that, or any earlier one. Pairs do not cross texts, and an empty text is
    all zeros."""
    n = len(offsets) - 1
    fine = CLASSES * CLASSES
    out = np.zeros((n, WIDTH), np.float32)
    if len(data) < 2:
        return out
    kind = _KINDS[data].astype(np.int32)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    inside = row[:-1] == row[1:]
    pair = kind[:-1] * CLASSES + kind[1:]
    key = row[:-1][inside] * fine + pair[inside]
    out[:, :fine] = np.bincount(key, minlength=n * fine).reshape(n, fine)
    coarse = (_COARSE[:, None] * COARSE + _COARSE[None, :]).reshape(-1)
    for k in range(COARSE * COARSE):
        out[:, fine + k] = out[:, :fine][:, coarse == k].sum(1)
    out[:, :-3] /= np.maximum(np.diff(offsets)[:, None] - 1, 1)
    _, _, hashes, counts = words(data, offsets)
    owner = np.repeat(np.arange(n), counts)
    for back in (1, 2):
        same = (hashes[back:] == hashes[:-back]) & (owner[back:] == owner[:-back])
        out[:, -4 + back] = np.bincount(owner[back:][same], minlength=n)
    distinct = np.unique(mix(owner.astype(np.uint64) + np.uint64(1)) ^ hashes, return_index=True)[1]
    out[:, -1] = counts - np.bincount(owner[distinct], minlength=n)
    out[:, -3:] /= np.maximum(counts[:, None], 1)
    return np.sqrt(out)


def feature_blocks(texts: pa.Array):
    """Features of successive runs of texts, of bounded size."""
    data, offsets = buffers(texts)
    for i, j in chunks(offsets):
        for a in range(i, j, 2048):
            b = min(a + 2048, j)
            yield features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


@dataclass
class Model:
    used: np.ndarray  # the features that vary in the samples
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x[:, self.used] - self.mean) * self.scale) @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def score(self, texts: pa.Array) -> np.ndarray:
        parts = [1 / (1 + np.exp(-self.margin(x))) for x in feature_blocks(texts)]
        return np.concatenate(parts).astype(float) if parts else np.zeros(0)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_nnpu(
    positive: np.ndarray,
    unlabelled: np.ndarray,
    prior: float,
    hidden: int = 12,
    steps: int = 1200,
    batch: int = 512,
    rate: float = 3e-3,
    decay: float = 3e-3,
    seed: int = 7,
    used: np.ndarray | None = None,
) -> Model:
    """Minimise prior * R+(P) + max(0, R-(U) - prior * R-(P)) with the logistic loss. Where
    the estimated negative risk of a batch falls below zero, the step raises it instead.
    ``used`` tells which features the columns are."""
    rng = np.random.default_rng(seed)
    n, m = len(positive), len(unlabelled)
    mean = (positive.sum(0) + unlabelled.sum(0)) / (n + m)
    spread = (np.square(positive - mean).sum(0) + np.square(unlabelled - mean).sum(0)) / (n + m)
    scale = 1 / (np.sqrt(spread) + 0.01)
    used = np.arange(positive.shape[1]) if used is None else used
    p, u = (positive - mean) * scale, (unlabelled - mean) * scale
    params = [
        rng.normal(0, np.sqrt(2 / p.shape[1]), (p.shape[1], hidden)).astype(np.float32),
        np.zeros(hidden, np.float32),
        rng.normal(0, np.sqrt(2 / hidden), hidden).astype(np.float32),
        np.zeros(1, np.float32),
    ]
    first = [np.zeros_like(a) for a in params]
    second = [np.zeros_like(a) for a in params]
    for t in range(1, steps + 1):
        xu = u[rng.integers(0, len(u), min(batch, len(u)))]
        xp = p[rng.integers(0, len(p), min(batch, len(p)))]
        x = np.concatenate([xp, xu])
        z = x @ params[0] + params[1]
        h = np.maximum(z, 0)
        out = h @ params[2] + params[3][0]
        out_p, out_u = out[: len(xp)], out[len(xp) :]
        negative = np.logaddexp(0, out_u).mean() - prior * np.logaddexp(0, out_p).mean()
        # derivatives of the mean losses: of being called negative, then positive
        gp, gu = _sigmoid(out_p) / len(xp), _sigmoid(out_u) / len(xu)
        if negative >= 0:
            grad = np.concatenate([prior * ((_sigmoid(out_p) - 1) / len(xp) - gp), gu])
        else:
            grad = np.concatenate([prior * gp, -gu])
        dh = grad[:, None] * params[2] * (z > 0)
        grads = [
            x.T @ dh + decay * params[0],
            dh.sum(0),
            h.T @ grad + decay * params[2],
            grad.sum()[None],
        ]
        for a, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(used, mean, scale, *params[:3], float(params[3][0]), prior)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


_HASH_RANGE = 1 << 31


def _chosen(ids: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` ids with the smallest hash. A share of the hash range that holds a few
    more is cut out first, so that only about as many ids as are wanted meet in one place."""
    total = ids.count()
    share = min(1.0, (limit + 6 * limit**0.5 + 50) / max(total, 1))
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(_HASH_RANGE))
    near = ids.select("doc_id", place.alias("place")).where(F.col("place") < share * _HASH_RANGE)
    return near.distinct().orderBy("place", "doc_id").limit(limit).select("doc_id")


def _sample(texts: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features, in halves of the usual width, of a bounded list of ids: of rows that share an
    id the one with the smallest text, so that there are as many as ids."""

    def run(batches):
        for batch in batches:
            for x in feature_blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.astype("<f2").tobytes() for r in x], pa.binary())], ["x"]
                )

    found = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    found = found.groupBy("doc_id").agg(F.min("text").alias("text")).select("text")
    data, _ = buffers(found.mapInArrow(by_batches("quality", run), "x binary").toArrow().column(0))
    return data.view("<f2").reshape(-1, WIDTH)


def _varying(x: np.ndarray) -> np.ndarray:
    """Features that are not all but constant; works column block by column block."""
    parts = [x[:, k : k + 64].astype(np.float32).std(0) for k in range(0, x.shape[1], 64)]
    return np.concatenate(parts) > 1e-4


def train(
    docs: DataFrame,
    labels: DataFrame,
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    **settings,
) -> Model | None:
    """Fit on at most ``positives`` labelled good rows and ``unlabelled`` rows of all
    documents, both outside the held-out fold; the prior is the share of good rows among all
    labelled rows outside it. None if there is no labelled good row or no document.

    Samples are chosen by id; rows that repeat an id are one text, the smallest. An id with
    labels that contradict each other counts as good here, and as both in the prior. Very long
    texts are read whole."""
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
    known = known.where(~held_out(F.col("doc_id")))
    share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    if not share:
        return None
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.where(~held_out(F.col("doc_id")))
    p = _sample(texts, _chosen(known.where("quality = 1").select("doc_id"), positives))
    u = _sample(texts, _chosen(texts.select("doc_id").where("doc_id is not null"), unlabelled))
    if not len(p) or not len(u):
        return None
    used = np.flatnonzero(_varying(p) | _varying(u))
    p, u = p[:, used].astype(np.float32), u[:, used].astype(np.float32)
    return fit_nnpu(p, u, float(share), used=used, **settings)


def score_quality(
    docs: DataFrame, model: Model | None, text: str = "text", to: str = "score"
) -> DataFrame:
    """``docs`` with the chance, 0 to 1, that the text is good. Null counts as empty; without
    a model (nothing to learn from) every score is 0.5. Only the text is looked at."""
    spark = docs.sparkSession
    ship(spark)
    rest = [c for c in docs.columns if c.lower() != to.lower()]
    hidden = free_name(docs, "text_scored")
    source = docs.select(*[quoted(c) for c in rest], quoted(text).alias(hidden))
    schema = source.drop(hidden).schema.add(to, "double")
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        fitted = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(hidden))
            scores = np.full(len(texts), 0.5) if fitted is None else fitted.score(texts)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores)], schema.names)

    return source.mapInArrow(by_batches("quality", run), schema)


def quality(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, ``held_out``, ``score`` and ``predicted`` (score at least ``cut``) of every
    document; a null id is never held out."""
    scored = score_quality(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )
