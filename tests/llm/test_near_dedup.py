import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsflow.llm import near_dedup as module
from newsflow.llm.components import components
from newsflow.llm.near_dedup import (
    CELL_BITS,
    cells,
    idf_table,
    near_dedup,
    near_duplicate_classes,
    runs,
    sample,
    weighted_jaccard,
)


def sets_of(texts):
    out = []
    for i, j, s in runs(pa.array(texts, pa.string())):
        out += [
            (s.hashes[s.first[k] : s.first[k + 1]], s.counts[s.first[k] : s.first[k + 1]])
            for k in range(j - i)
        ]
    return out


def classes(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute(rows, idf, least=0.8):
    known = [(i, t) for i, t in rows if i is not None]
    sets = sets_of([t for _, t in known])
    holders = {}
    for n, (hashes, _) in enumerate(sets):
        for h in hashes.tolist():
            holders.setdefault(h, []).append(n)
    pairs = {(a, b) for held in holders.values() for a in held for b in held if a < b}
    near = [(known[a][0], known[b][0]) for a, b in pairs if weighted_jaccard(sets[a], sets[b], idf) >= least]
    return classes({i for i, _ in known}, near)


def planted():
    rnd = random.Random(5)
    words = [f"wort{i}" for i in range(3000)]
    base = [rnd.choice(words) for _ in range(300)]
    rows, key = [], 100_000

    def add(x, sep=" "):
        nonlocal key
        rows.append((key, sep.join(x)))
        key += 1

    for _ in range(100):  # copies of a text that is not in the table itself
        x = list(base)
        for _ in range(rnd.randint(1, 7)):
            x[rnd.randrange(300)] = rnd.choice(words)
        add(x, "  ")
    chain = base[::-1]
    for _ in range(20):  # each close to the one before
        for _ in range(6):
            chain[rnd.randrange(300)] = rnd.choice(words)
        add(chain)
    for _ in range(30):  # half of the text is common: candidates, but no links
        add(base[:150] + [rnd.choice(words) for _ in range(150)])
    return rows


EDGES = [(1, None), (2, ""), (3, "..."), (None, "abc def"), (None, None), (4, "abc def"), (5, "ABC def!"), (5, "abc def")]


def test_shingles_of_short_and_repeating_texts():
    (a, b, c, d, e) = sets_of(["a b c d", "A b, c d", "", "x y x y x y x y x y", None])
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == [1]
    assert len(c[0]) == 0 and len(e[0]) == 0
    assert sorted(d[1].tolist()) == [3, 3]


def test_samples_agree_as_often_as_sets_are_similar():
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    base = [rnd.choice(words) for _ in range(300)]
    idf = np.random.default_rng(1).uniform(0.5, 8, 1 << CELL_BITS).astype(np.float32)
    for edits in (2, 8, 25):
        other = list(base)
        for _ in range(edits):
            other[rnd.randrange(300)] = rnd.choice(words)
        ((_, _, s),) = runs(pa.array([" ".join(base), " ".join(other)]))
        got = sample(s, idf, 1500)
        a, b = sets_of([" ".join(base), " ".join(other)])
        assert (got[0] == got[1]).mean() == pytest.approx(weighted_jaccard(a, b, idf), abs=0.05)


def test_frequencies_cover_all_texts(spark):
    texts = ["one two three four five six"] * 3 + ["one two three four five", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    idf = idf_table(df, "text")
    (both, only) = sets_of([texts[0], texts[3]])
    shared = only[0][0]
    assert idf[cells(np.array([shared]))][0] == pytest.approx(np.log1p(6 / 4))
    other = [h for h in both[0] if h != shared][0]
    assert idf[cells(np.array([other]))][0] == pytest.approx(np.log1p(6 / 3))


@pytest.mark.parametrize("block", [48, 4])
def test_classes_equal_brute_force(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id + 1000, r.text) for r in docs] + planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(df).collect()}
    assert len(got) == len(rows)
    want = brute(rows, idf_table(df, "text"))
    assert got == want
    assert len(set(want.values())) < len(rows) - 30


def test_edges(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string").withColumn("bucket", F.lit("own"))
    got = sorted(((r.doc_id or 0), (r.class_id or 0)) for r in near_duplicate_classes(df).collect())
    assert got == [(0, 0), (0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4)]
    assert near_duplicate_classes(df.limit(0)).count() == 0
    kept = near_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 4]


def test_rows_of_one_id_go_by_their_own_text(spark):
    a, b, c = ("alpha beta gamma delta", "one two three four five", "red green blue black white")
    rows = [(2, a, 1), (5, a, 2), (5, b, 3), (9, c, 4), (5, b, 5), (7, b, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int").repartition(3)
    got = sorted(tuple(r) for r in near_duplicate_classes(df).collect())
    assert got == [(2, 2), (5, 2), (5, 5), (5, 5), (7, 5), (9, 9)]
    # no text is lost, and no copy under a larger id stays
    assert sorted(r.k for r in near_dedup(df).collect()) == [1, 3, 4, 5]


def test_packed_shingles_come_back():
    texts = ["a b c d e f", "", "x y x y x y x y x y x y", None, "one two"]
    ((_, _, s),) = runs(pa.array(texts))
    back = module.unpack(*module.pack(s))
    assert back.first.tolist() == s.first.tolist() and back.hashes.tolist() == s.hashes.tolist()
    assert back.counts.tolist() == s.counts.tolist() and s.counts.max() > 1
    part = module.pack(s)[0].slice(2, 2), module.pack(s)[1].slice(2, 2)
    assert module.unpack(*part).counts.tolist() == s.counts[s.first[2] : s.first[4]].tolist()


def test_pairs_side_by_side_equal_one_by_one():
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 30))) for _ in range(200)]
    others = [t if rnd.random() < 0.3 else t + " w1 w2" * rnd.randint(0, 4) for t in texts]
    idf = np.random.default_rng(3).uniform(0.5, 8, 1 << CELL_BITS).astype(np.float32)
    ((_, _, a),), ((_, _, b),) = runs(pa.array(texts)), runs(pa.array(others))
    for least in (0.5, 0.8):
        got = module.similar(a, b, [idf], least)
        want = [weighted_jaccard(x, y, idf) >= least for x, y in zip(sets_of(texts), sets_of(others))]
        assert got.tolist() == want and 0 < sum(want) < len(want)


def test_links_across_components_ask_only_the_minority(spark, monkeypatch):
    """Rows that are sent grow with the bucket, not with its square, while few are asked."""
    monkeypatch.setattr(module, "BLOCK", 10)
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    base = [rnd.choice(words) for _ in range(120)]
    rows = []
    for k in range(400):
        x = list(base)
        x[rnd.randrange(120)] = rnd.choice(words)
        rows.append((k, " ".join(x)))
    sent = []
    spread = module.by_group

    def spy(name, run):
        if run.__name__ == "compare":
            return spread(name, lambda t: pa.table({"a": pa.array([t.num_rows]), "b": pa.array([0])}))
        return spread(name, run)

    monkeypatch.setattr(module, "by_group", spy)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    unique = module.cut(
        module.shingled(df).select("names", "more", F.col("doc_id").alias("node")), "texts"
    )
    # one bucket: 390 members in a component, 10 alone
    component = F.when(F.col("node") < 390, 0).otherwise(F.col("node")).cast("long")
    members = unique.select(F.lit(1).alias("bucket"), "node", component.alias("component"), F.lit(100).alias("bytes"))
    idf = spark.sparkContext.broadcast([np.ones(1 << CELL_BITS, np.float32)])
    sent = module.block_links(members, unique, idf, 0.8).agg(F.sum("a")).first()[0]
    assert sent == 400 * 1 + 10 * 40


def test_exact_copies_in_great_number(spark):
    rows = [(k, "the same few words again and again") for k in range(3000)] + [(9000, "something else here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_duplicate_classes(df).groupBy("class_id").count().collect()
    assert {r.class_id: r["count"] for r in got} == {0: 3000, 9000: 1}


@pytest.mark.parametrize("edits, share", [(1, 3), (1, 5)])
def test_near_copies_of_a_text_that_many_rows_repeat(spark, edits, share):
    rnd = random.Random(share)
    words = [f"wort{i}" for i in range(5000)]
    hot = [rnd.choice(words) for _ in range(100)]
    near = list(hot)
    for k in range(edits):
        near[30 + 40 * k] = f"other{k}"
    rows = [(k, " ".join(hot if k % share == 0 else rnd.choices(words, k=100))) for k in range(1500)]
    rows.append((9000, " ".join(near)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(df).collect()}
    assert got == {k: 0 if k % share == 0 else k for k in range(1500)} | {9000: 0}


def test_components_of_chains_stars_and_cycles(spark):
    rnd = random.Random(2)
    links = [(k, k + 1) for k in range(60)] + [(500, k) for k in range(501, 560)]
    links += [(900, 901), (901, 902), (902, 900), (950, 950)]
    links += [(rnd.randint(2000, 2100), rnd.randint(2000, 2100)) for _ in range(80)]
    rnd.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert got == classes(ids, [(a, b) for a, b in links if a != b])
    assert components(df.limit(0)).count() == 0
