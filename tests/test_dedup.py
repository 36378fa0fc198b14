from newsflow.operators import dedup
from tests.helpers import as_set, final_plan_text, plan_text, ts


def links(spark, rows):
    return spark.createDataFrame(
        [(link, ts(f"2024-01-01T10:0{n}:00")) for link, n in rows],
        "link string, published_ts timestamp_ntz",
    )


def test_links_differ_by_neither_case_nor_padding(spark):
    df = links(spark, [("http://A", 1), (" http://a ", 0), ("http://b", 2), ("", 3), (None, 4)])
    kept = dedup.dedup_links(df)
    assert as_set(kept, "link") == {(" http://a ",), ("http://b",)}
    assert as_set(dedup.dedup_links(kept), "link") == as_set(kept, "link")


def test_titles_keep_the_earliest_and_empty_ones_are_one_title(spark):
    rows = [("", "l1", 3), ("", "l2", 2), ("a", "l3", 1), ("a", "l4", 1), ("b", "l5", 5)]
    df = spark.createDataFrame(
        [(t, link, ts(f"2024-01-01T10:0{n}:00")) for t, link, n in rows],
        "title string, link string, published_ts timestamp_ntz",
    )
    kept = dedup.dedup_titles(df)
    assert as_set(kept, "title", "link") == {("", "l2"), ("a", "l3"), ("b", "l5")}


def test_hot_keys_are_cut_below_the_shuffle(spark):
    df = spark.range(0, 30_000, 1, 8).selectExpr(
        "IF(id % 3 = 0, 'hot', concat('t', id)) AS title",
        "concat('l', id) AS link",
        "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, 0, id) AS published_ts",
    )
    kept = dedup.dedup_titles(df)
    assert kept.count() == 20_001
    assert kept.filter("title = 'hot'").first().link == "l0"
    plan = plan_text(kept)
    assert plan.index("row_number(), 1, Final") < plan.index("Exchange hashpartitioning(title")
    assert plan.index("Exchange hashpartitioning(title") < plan.index("row_number(), 1, Partial")


def events(spark):
    rows = [
        ("t", "c", "k", 2, "l1"),
        ("t", "c", "k", 1, "l3"),
        ("t", "c", "k", 1, "l2"),
        ("t", "d", "k", 3, "l4"),
        ("u", "c", "k", 4, None),
    ]
    return spark.createDataFrame(
        [(t, c, k, ts(f"2024-01-01T10:0{n}:00"), link) for t, c, k, n, link in rows],
        "title string, category string, keyword string, published_ts timestamp_ntz, link string",
    )


def test_events_keep_the_earliest(spark):
    kept = dedup.dedup_events(events(spark))
    assert as_set(kept, "title", "category", "link") == {
        ("t", "c", "l2"),
        ("t", "d", "l4"),
        ("u", "c", None),
    }


def test_events_without_other_columns_need_no_sort(spark):
    kept = dedup.dedup_events(events(spark).drop("link"))
    assert kept.count() == 3
    assert "Sort" not in final_plan_text(kept)
