"""What the physical plans must and must not hold."""

import re

import pytest

from newsflow.checks.queries import QUERIES
from newsflow.functions.sketch import DEPTH
from newsflow.operators.breaking import ALERT_KEYS, build_sketch, estimate, running_estimates
from newsflow.operators.dedup import dedup_links
from newsflow.plans.articles import cleaned_articles
from newsflow.plans.breaking import breaking_alerts, burst_counts
from newsflow.plans.trends import category_activity, keyword_events, keyword_trends
from newsflow.sources.tables import raw_records, table
from tests.helpers import final_plan_text, plan_text

BATCH = [name for name in QUERIES if not name.startswith(("stream_", "topic_"))]


@pytest.mark.parametrize("name", BATCH)
def test_no_python_no_cross_join_no_collected_scan(spark, sf_dir, name):
    plan = plan_text(QUERIES[name](spark, sf_dir))
    for word in ("Python", "Pandas", "Cartesian", "NestedLoop", "GlobalLimit", "Sample"):
        assert word not in plan, word


@pytest.fixture(scope="module")
def articles(spark, sf_dir):
    return cleaned_articles(raw_records(table(spark, sf_dir, "documents")))


def before_the_title_shuffle(plan: str) -> str:
    return plan[plan.index("row_number(), 1, Partial") :]


def test_trends_leave_the_text_behind(articles):
    plan = plan_text(keyword_trends(articles))
    columns = re.search(r"Project \[(.*)\]", before_the_title_shuffle(plan))[1]
    columns = re.sub(r"\w+\([^()]*\) AS ", "", columns)  # a hash of the rest goes along
    names = re.findall(r"(?:^|, )(\w+)#\d+", columns)
    assert "title" in names and "content" not in names


def test_trends_shuffle_three_times(articles):
    plan = plan_text(keyword_trends(articles))
    # Titles, slots, windows; events are de-duplicated where their titles already are.
    assert plan.count("Exchange hashpartitioning") == 3


def test_activity_counts_before_it_multiplies(articles):
    plan = plan_text(category_activity(articles))
    assert plan.index("Generate explode(array(") < plan.index("functions=[partial_count(1)]")


def test_records_are_parsed_once(articles):
    assert plan_text(articles).count("from_json") == 1
    assert plan_text(keyword_events(articles)).count("from_json") == 1


def test_keywords_are_computed_once(spark, sf_dir):
    plan = plan_text(QUERIES["keyword_events"](spark, sf_dir))
    assert plan.count("INSET a, about, after") == 1


def test_alerts_read_the_input_once(articles):
    plan = final_plan_text(breaking_alerts(articles, mode="running", threshold=3))
    assert plan.count("FileScan") == 1
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("mode", ["table", "exact"])
@pytest.mark.parametrize("reset", [None, "day"])
def test_alerts_of_every_mode_read_the_input_once(articles, mode, reset):
    plan = final_plan_text(breaking_alerts(articles, mode=mode, threshold=1, reset=reset))
    assert plan.count("FileScan") == 1


def test_running_sums_are_neither_multiplied_nor_joined(articles):
    events = keyword_events(articles, ["link"])
    counts = burst_counts(events).select(*ALERT_KEYS, "exact_count")
    plan = plan_text(running_estimates(counts, reset="window"))
    only_counts = plan_text(counts)
    assert "Join" not in plan and plan.count("Generate") == only_counts.count("Generate")
    assert plan.count("Exchange") == only_counts.count("Exchange") + DEPTH
    # without a reset only the sums of pieces are multiplied, and summed before they are sent
    plan = plan_text(running_estimates(counts))
    assert "Join" not in plan


def test_a_sketch_is_built_once_for_all_lookups(spark):
    rows = spark.range(5000).selectExpr("concat('k', id % 700) AS keyword", "id % 7 AS n")
    plan = final_plan_text(estimate(rows, build_sketch(rows)))
    assert plan.count("Generate") == 1 and plan.count("BroadcastExchange") == DEPTH
    assert plan.count("ReusedExchange") == DEPTH - 1


@pytest.mark.parametrize("name", BATCH)
def test_whole_texts_are_not_dealt_out(spark, sf_dir, name):
    assert "RoundRobin" not in plan_text(QUERIES[name](spark, sf_dir))


def test_unique_titles_need_no_event_dedup(articles):
    plan = plan_text(breaking_alerts(articles, unique_titles=True, mode="exact"))
    assert "SortAggregate" not in plan


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = plan_text(QUERIES["category_activity"](spark, sf_dir))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan
    assert "IsNotNull(ts)" in plan or "isnotnull(ts" in plan


def test_link_keys_are_limited_below_the_shuffle(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumnRenamed("url", "link")
    plan = plan_text(dedup_links(pages, order_by=["page_id"]))
    assert "row_number(), 1, Partial" in plan
