import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsflow.llm import fingerprints as module
from newsflow.llm.fingerprints import (
    BUCKETS,
    TRIPLETS,
    bucket_counts,
    fingerprints,
    fingerprints_of,
    likeness,
    neighbour_likeness,
)
from newsflow.llm.common import buffers

EDGES = [(None, None), (5000, ""), (5001, "abécd"), (5002, None), (5001, "zz"), (5001, "zz"), (7, "hello world")]


def test_counts_cover_every_triplet_and_never_cross_texts():
    texts = ["", "a", "ab", "abc", "abcd", "äöü" * 50, "abcabc" * 100]
    counts = bucket_counts(*buffers(pa.array(texts)))
    sizes = [len(t.encode()) for t in texts]
    assert counts.sum(1).tolist() == [sum(max(0, n - c) for _, _, c in TRIPLETS) for n in sizes]
    alone = [bucket_counts(*buffers(pa.array([t])))[0].tolist() for t in texts]
    assert counts.tolist() == alone


def test_likeness_is_bounded_and_orders_edits():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    base = [rnd.choice(words) for _ in range(600)]
    other = [rnd.choice("klmnopqrstuvwxyz") * 5 for _ in range(600)]
    texts = [" ".join(base[: 600 - k] + other[:k]) for k in (0, 0, 60, 300, 600)]
    prints = fingerprints_of(pa.array(texts))
    scores = likeness([prints[0]] * 5, prints).tolist()
    assert prints[0] == prints[1] and scores[:2] == [1.0, 1.0]
    assert 1.0 > scores[2] > scores[3] > scores[4] >= 0.0
    assert all(len(p) == 2 * (3 + BUCKETS // 4) for p in prints)


def brute(rows):
    out = []
    for k, (_, doc_id, _, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][3]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        own, changed, following = fingerprints_of(pa.array([text, edited, after]))
        out.append(
            (
                doc_id,
                len(text),
                hashlib.sha256(edited.encode()).hexdigest(),
                own,
                changed,
                float(likeness([own], [changed])[0]),
                float(likeness([own], [following])[0]),
            )
        )
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_neighbours_equal_brute_force(spark, sf_dir, parts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(EDGES, docs.schema)).withColumn("at", F.lit("clash"))
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text").collect()
    order = sorted(
        ((r.doc_id is not None, r.doc_id, r.h, r.text or "") for r in keyed),
        key=lambda r: (r[0], r[1] or 0, r[2]),
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted((tuple(r) for r in neighbour_likeness(docs).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(order)


def test_single_rows_and_empty_tables(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string")
    assert neighbour_likeness(df.limit(0)).count() == 0
    (row,) = neighbour_likeness(df.where("doc_id = 7")).collect()
    assert row.near_next == 1.0 and row.n_chars == 11
    (row,) = neighbour_likeness(df.where("doc_id is null")).collect()
    assert row.doc_id is None and row.near_edited == 1.0


def test_fingerprint_column(spark):
    df = spark.createDataFrame([(1, "same", 0), (2, "same", 0), (3, None, 0), (4, "", 0)], "doc_id long, text string, FingerPrint int")
    got = {r.doc_id: r.fingerprint for r in fingerprints(df).collect()}
    assert got[1] == got[2] and got[3] == got[4] != got[1]


def test_groups_by_cuts(spark):
    cuts = list(range(0, 6000, 7))
    df = spark.range(-10, 6100)
    got = df.select("id", module._group_of(F.col("id"), cuts).alias("g")).collect()
    assert all(r.g == sum(c <= r.id for c in cuts) for r in got)


def test_rows_of_one_id_are_in_many_groups(spark):
    """A third of all rows have no id, another third share one."""
    ids = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id"))
    rows = spark.range(600).select(ids.cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    source = rows.withColumn("tie", F.xxhash64("text"))
    key = F.struct(
        F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), "tie"
    )
    cuts = module._cuts(source, key)
    group = module._group_of(key, cuts).alias("group")
    sizes = source.groupBy(group, F.coalesce("doc_id", F.lit(-1)).isin(-1).alias("null"), (F.col("doc_id") == 7).alias("hot")).count().collect()
    assert len({r.group for r in sizes if r.null}) > 1 and max(r["count"] for r in sizes) < 300
    plain = sorted(rows.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = neighbour_likeness(rows).collect()
    assert len(got) == 600 and sorted(r.doc_id or -1 for r in got) == sorted(r.doc_id or -1 for r in plain)
    # every text is followed by one: all next texts differ from their own here
    assert all(r.near_next < 1 for r in got)
