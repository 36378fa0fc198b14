"""Every registered query against its SQL on the smallest tables."""

import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
import check
from newsflow.checks import queries as checks
from newsflow.checks.oracles import ORACLES
from newsflow.checks.queries import QUERIES
from newsflow.operators import sentiment
from tests.helpers import plan_text


@pytest.fixture(scope="module")
def connection(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, connection, sf_dir, name):
    same, notes = check.compare(spark, connection, name, sf_dir)
    assert same, notes


def test_every_query_of_the_library_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows_and_a_schema(spark, sf_dir):
    df = registry.entry(spark)
    assert df.columns[:4] == ["window_start", "window_end", "category", "keyword"]
    levels = {r.trend_level for r in df.collect()}
    assert len(levels) >= 2


def test_terms_are_counted_in_parts_of_a_bounded_number_of_articles(spark, tmp_path, monkeypatch):
    text = F.concat_ws(" ", F.concat(F.lit("word"), F.col("id") % 7), F.lit("\n the many"), F.concat(F.lit("term"), F.col("id") % 11))
    documents = spark.range(400).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("s").alias("source"))
    documents.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))

    def run():
        df = QUERIES["term_trends"](spark, str(tmp_path))
        return plan_text(df), sorted(map(str, df.collect()))

    _, whole = run()
    monkeypatch.setattr(checks, "ARTICLES_PER_PART", 50)
    plan, got = run()
    assert re.search(r"rangepartitioning\(.*, 9\)", plan)
    # the parts and one more shuffle
    assert plan.count("Exchange") == 2
    assert got == whole and got


def test_rare_outcomes_occur_in_the_rows_that_sql_checks(spark, sf_dir):
    levels = {r.trend_level for r in QUERIES["term_trends"](spark, sf_dir).collect()}
    assert levels == {"BREAKING", "HOT", "WARM", "NORMAL"}
    categories = {r.category for r in QUERIES["category_frequent"](spark, sf_dir).collect()}
    assert {"politics", "tech", "sports", "business"} <= categories


@pytest.mark.parametrize(
    "error, absent",
    [
        (ModuleNotFoundError("x", name="newsflow.llm"), True),
        (ModuleNotFoundError("x", name="newsflow.llm.queries"), True),
        (ModuleNotFoundError("x", name="tokenizers"), True),
        (ModuleNotFoundError("x", name="newsflow.lexicons"), False),
        (ImportError("cannot import name", name="newsflow.llm.common"), False),
    ],
)
def test_only_absent_packages_are_passed_over(error, absent):
    assert registry._absent(error) is absent


def test_the_library_works_without_the_training_text_package():
    code = (
        "import sys\n"
        "class Absent:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('newsflow.llm', 'corpus_pipeline')):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Absent())\n"
        "import __spark_entry__ as e\n"
        "assert set(e.queries()) == set(e.oracle_sql()) == set(e.QUERIES)\n"
    )
    root = Path(registry.__file__).parent
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_a_lexicon_table_of_any_size_counts_the_same(spark, monkeypatch):
    lexicon = spark.createDataFrame(
        [("good", "up", 1.5), ("bad", "down", -1.0), ("odd", "up", 0.25), ("odd", "down", -0.25)],
        "word string, side string, weight double",
    )
    texts = [["good", "good", "bad"], ["odd", "odd", "none"], [], None, ["good"]]
    rows = [(k, texts[k % 5]) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, tokens array<string>").repartition(3)
    want = {0: (2, 1, 2.0), 1: (2, 2, 0.0), 2: (0, 0, 0.0), 3: (0, 0, 0.0), 4: (1, 0, 1.5)}
    for limit in (sentiment.MAX_LEXICON, 0):
        monkeypatch.setattr(sentiment, "MAX_LEXICON", limit)
        got = sentiment.lexicon_totals(df, lexicon, ["k"], sides=("up", "down"))
        assert ("BroadcastHashJoin" in plan_text(got)) == (limit > 0)
        found = {r.k: (r.up_count, r.down_count, r.weight) for r in got.collect()}
        assert found == {k: want[k % 5] for k in range(200)}
    nothing = sentiment.lexicon_totals(df, lexicon.limit(0), ["k"], sides=("up",)).collect()
    assert {(r.up_count, r.weight) for r in nothing} == {(0, 0.0)} and len(nothing) == 200
