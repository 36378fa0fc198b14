import random

import pytest
import sentencepiece

import corpus_pipeline
from corpus_pipeline import STAGES
from newsflow.llm.common import scratch
from newsflow.llm.decontaminate import decontaminate
from newsflow.llm.queries import PIECE_BPE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage returns, written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in STAGES:
        path = scratch(spark, f"test-{name}")
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_and_ids(stages):
    ids = {r.doc_id for r in stages[0].select("doc_id").collect()}
    for kept in stages[1:-1]:
        assert kept.columns == COLUMNS
        rows = kept.collect()
        now = [r.doc_id for r in rows]
        assert len(now) == len(set(now)) and set(now) <= ids
        assert all(r.n_chars == len(r.text) for r in rows)
        ids = set(now)
    assert {r.doc_id for r in stages[-1].collect()} == ids


def test_quality_keeps_good_labelled_documents(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    assert len(good & kept) >= 0.97 * len(good)


def test_no_copies_and_no_repeated_passages_are_left(stages):
    texts = [r.text for r in stages[2].collect()]
    assert len(texts) == len(set(texts))
    seen = {}
    for r in stages[3].orderBy("doc_id").collect():
        raw = r.text.encode()
        own = {raw[k : k + 50] for k in range(len(raw) - 49)}
        # what is left may only meet across a removed passage
        assert len([w for w in own if w in seen]) <= 49
        seen.update(dict.fromkeys(own, r.doc_id))


def test_no_benchmark_windows_are_left(spark, sf_dir, stages):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    before = decontaminate(stages[3], benchmark)
    after = {r.doc_id: r for r in decontaminate(stages[4], benchmark).collect()}
    for r in before.collect():
        if r.n_hit == 0:
            assert after[r.doc_id].text == r.text
        assert after[r.doc_id].n_hit == 0 or r.n_hit > 0
    assert sum(r.n_hit for r in after.values()) == 0


def test_ids_are_the_library_s(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    for r in stages[-1].collect():
        assert r.ids == library.encode(r.text) and r.exact and r.n_tokens == len(r.ids)


def test_run_gives_the_same_rows(spark, sf_dir, stages):
    got = {r.doc_id: r.ids_crc32 for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {r.doc_id: r.ids_crc32 for r in stages[-1].collect()}


def test_planted_cases(spark, tmp_path):
    """Copies, a shared passage and a benchmark passage among clean documents."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(4000)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."
    rows = [(k, prose(120)) for k in range(60)]
    near = rows[10][1].split()
    near[40], near[80] = "changed", "too"
    passage, item = prose(60), prose(40)
    rows += [(100, rows[5][1]), (101, " ".join(near)), (102, f"{prose(80)} {passage} {prose(80)}")]
    rows += [(103, f"{prose(80)} {passage} {prose(80)}"), (104, f"{prose(90)} {item} {prose(90)}")]
    rows += [(200 + k, "*** !!! $$$ " * 50) for k in range(6)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0 if i >= 200 else 1, 0) for i, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.text for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(60)) <= set(got) and {100, 101}.isdisjoint(got) and {102, 103, 104} <= set(got)
    assert all(got[k] == dict(rows)[k] for k in range(60))
    assert passage in got[102] and passage not in got[103] and item[:-1].lower() not in got[104].lower()
