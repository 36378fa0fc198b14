import hashlib
from collections import Counter, defaultdict
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from newsflow.operators import breaking as b
from newsflow.plans import breaking as plans
from tests.helpers import final_plan_text, ts

START = ts("2024-01-01T10:00:00")


def counts_frame(spark, rows):
    return spark.createDataFrame(
        [(START + timedelta(minutes=m), c, k, n) for m, c, k, n in rows],
        "window_start timestamp_ntz, category string, keyword string, exact_count bigint",
    )


def test_one_keyword_accumulates_over_windows(spark):
    rows = [(m, "c", "quake", 4) for m in range(4)]
    got = b.running_estimates(counts_frame(spark, rows)).orderBy("window_start")
    assert [r.approx_count for r in got.collect()] == [4, 8, 12, 16]


def sketch_rows(rows, depth, width):
    """The running sketch, row by row."""
    table = defaultdict(int)
    out = {}
    for m, c, k, n in sorted(rows, key=lambda r: (r[0], r[1] or "", r[2])):
        cells = []
        for i in range(depth):
            digest = hashlib.md5(f"{i // 4}:{k}".encode()).hexdigest()
            cells.append((i, int(digest[i % 4 * 8 : i % 4 * 8 + 8], 16) % width))
        for cell in cells:
            table[cell] += n
        out[(m, c, k)] = min(table[cell] for cell in cells)
    return out


MANY = [
    (m, c, f"k{k}", 1 + (m * 7 + k * 3) % 5)
    for m in range(0, 300, 25)
    for c in ("x", "y", None)
    for k in range(12)
]


@pytest.mark.parametrize("chunk", ["minute", "hour", "day"])
@pytest.mark.parametrize("width", [5, 1000])
def test_running_estimates_equal_brute_force(spark, chunk, width):
    got = b.running_estimates(counts_frame(spark, MANY), depth=6, width=width, chunk=chunk)
    assert {
        ((r.window_start - START).seconds // 60, r.category, r.keyword): r.approx_count
        for r in got.collect()
    } == sketch_rows(MANY, 6, width)


def test_estimates_never_fall_below_the_count(spark):
    df = spark.createDataFrame(
        [(f"k{n}", 1 + n % 9) for n in range(500)], "keyword string, n bigint"
    )
    sketch = b.build_sketch(df, depth=3, width=50).cache()
    assert sketch.count() <= 150
    both = b.estimate(df, sketch, depth=3, width=50)
    assert both.count() == 500
    assert both.filter("approx_count < n").isEmpty()
    assert not both.filter("approx_count > n").isEmpty()
    unseen = spark.createDataFrame([("never",)], "keyword string")
    empty = b.build_sketch(df.limit(0), depth=3, width=50)
    assert b.estimate(unseen, empty, depth=3, width=50).first().approx_count == 0


def test_merged_sketches_are_the_sketch_of_the_union(spark):
    df = spark.createDataFrame(
        [(f"k{n % 40}", n) for n in range(200)], "keyword string, n bigint"
    )
    parts = [b.build_sketch(df.filter(f"n % 3 = {i}")) for i in range(3)]
    merged = {tuple(r) for r in b.merge_sketches(*parts).collect()}
    assert merged == {tuple(r) for r in b.build_sketch(df).collect()}


@pytest.mark.parametrize("reset", ["window", "hour", "day"])
def test_sketches_start_anew(spark, reset):
    got = b.running_estimates(counts_frame(spark, MANY), depth=6, width=20, reset=reset)
    unit = {"window": 1, "hour": 60, "day": 1440}[reset]
    want = {}
    for part in {m // unit for m, *_ in MANY}:
        want |= sketch_rows([r for r in MANY if r[0] // unit == part], 6, 20)
    assert {
        ((r.window_start - START).seconds // 60, r.category, r.keyword): r.approx_count
        for r in got.collect()
    } == want


def test_a_finished_sketch_per_window(spark):
    counts = counts_frame(spark, MANY)
    got = plans.estimated_counts(counts, "table", reset="window")
    total = defaultdict(int)
    for m, _, k, n in MANY:
        total[m, k] += n
    rows = got.collect()
    assert len(rows) == len(MANY)
    for r in rows:
        assert r.approx_count == total[(r.window_start - START).seconds // 60, r.keyword]


def test_lookups_need_no_shuffle_and_no_copies(spark):
    df = spark.range(1000).selectExpr("concat('k', id) AS keyword", "id AS n")
    rows = [(row, 1, 2) for row in range(5)]
    sketch = spark.createDataFrame(rows, "sketch_row int, bucket bigint, cell bigint")
    plan = final_plan_text(b.estimate(df, sketch))
    assert "Generate" not in plan and "hashpartitioning" not in plan
    assert plan.count("BroadcastHashJoin") == 5


def hot_events(spark, n=3000):
    """A third of all events share one keyword; titles repeat, links do too."""
    return spark.range(0, n, 1, 6).selectExpr(
        "TIMESTAMP_NTZ '2024-01-01 10:00:00' + make_dt_interval(0, 0, 0, id % 1500)"
        " AS published_ts",
        "IF(id % 7 = 0, NULL, 'c') AS category",
        "IF(id % 3 = 0, 'hot', concat('key', id % 200)) AS keyword",
        "concat('title ', lpad(id % 900, 4, '0')) AS title",
        "IF(id % 11 = 0, NULL, concat('link', id % 4)) AS link",
    )


def brute_alerts(rows, threshold):
    groups = defaultdict(list)
    for r in rows:
        slot = r.published_ts.replace(second=0, microsecond=0)
        for back in range(5):
            groups[(slot - timedelta(minutes=back), r.category, r.keyword)].append(r)
    return {
        (
            start,
            category,
            keyword,
            len(members),
            tuple(sorted({m.title for m in members if m.title})[:3]),
            tuple(sorted({m.link for m in members if m.link})[:3]),
        )
        for (start, category, keyword), members in groups.items()
        if len(members) >= threshold
    }


@pytest.mark.parametrize("threshold", [1, 4, 15])
def test_exact_alerts_equal_brute_force(spark, threshold):
    events = hot_events(spark)
    got = plans.alerts_of_events(events, mode="exact", threshold=threshold).collect()
    assert {
        (
            r.window_start,
            r.category,
            r.keyword,
            r.exact_count,
            tuple(r.sample_titles),
            tuple(r.sample_links),
        )
        for r in got
    } == brute_alerts(events.collect(), threshold)
    assert len(got) == len({(r.window_start, r.category, r.keyword) for r in got})
    assert all(r.window_end - r.window_start == timedelta(minutes=5) for r in got)
    assert all(r.status == "BREAKING" for r in got)


def test_stream_form_of_alerts_equals_batch_form(spark):
    events = hot_events(spark)
    columns = ["category", "keyword", "title", "link"]
    window = F.window("published_ts", "5 minutes", "1 minute")
    titles = (
        events.groupBy(window, *columns)
        .count()
        .selectExpr("window.start AS window_start", "window.end AS window_end", *columns, "count AS n")
    )

    def rows(df):
        return Counter(str(r) for r in df.collect())

    for mode in plans.MODES:
        batch = plans.alerts_of_events(events, mode=mode)
        assert rows(plans.alerts_of_windows(titles, mode=mode)) == rows(batch)


def test_folded_events_give_the_same_alerts(spark):
    events = hot_events(spark).withColumns(
        {
            "published_ts": F.col("published_ts").cast("timestamp"),
            "title": F.expr("if(hash(title) % 5 = 0, NULL, title)"),
            "link": F.expr("if(hash(link) % 3 = 0, NULL, link)"),
            "keyword": F.expr("if(hash(title, link) % 7 = 0, NULL, keyword)"),
        }
    )
    events = events.unionByName(events.withColumns({"title": F.lit(None).cast("string"), "link": F.lit(None).cast("string"), "category": F.lit("bare")}))
    columns = ["category", "keyword", "title", "link"]
    folded = b.fold_evidence(events, "5 minutes", "1 minute")
    titles = (
        folded.groupBy(F.window("published_ts", "5 minutes", "1 minute"), *columns)
        .agg(F.sum("n").alias("n"))
        .selectExpr("window.start AS window_start", "window.end AS window_end", *columns, "n")
    )
    for threshold in (1, 15):
        got = plans.alerts_of_windows(titles, mode="exact", threshold=threshold)
        want = plans.alerts_of_events(events, mode="exact", threshold=threshold)
        assert Counter(str(r) for r in got.collect()) == Counter(str(r) for r in want.collect())
    per_key = folded.groupBy(F.window("published_ts", "1 minute"), "category", "keyword").count()
    assert per_key.agg(F.max("count")).first()[0] <= 6
    latest = "max(published_ts)"
    assert folded.selectExpr(latest).first() == events.selectExpr(latest).first()


def test_folding_holds_a_bounded_number_of_rows():
    pd = pytest.importorskip("pandas")
    columns = ["slot", "category", "keyword", "title", "link", "micros", "n"]
    rows = [(0, "c", "k" if n % 2 else None, f"t{n:03}", f"l{n % 9}", n, 1) for n in range(200)]
    parts = [pd.DataFrame(rows[n : n + 10], columns=columns) for n in range(0, 200, 10)]
    out = list(b._folding(at_once=20)(iter(parts)))
    found = pd.concat(out)
    assert len(found) <= 2 * 6
    assert found["n"].sum() == 200 and found["micros"].max() == 199
    assert sorted(found[found["keyword"].notna()]["title"])[:3] == ["t001", "t003", "t005"]
    assert sorted(set(found[found["keyword"].isna()]["link"]))[:3] == ["l0", "l1", "l2"]
    # keys that do not repeat leave the task in pieces
    parts = [part.assign(slot=part["micros"]) for part in parts]
    out = list(b._folding(at_once=20)(iter(parts)))
    assert len(out) == 10 and sum(map(len, out)) == 200


def test_alerts_without_titles_or_links_are_kept(spark):
    events = hot_events(spark).withColumns(
        {"title": F.lit(None).cast("string"), "link": F.lit(None).cast("string")}
    )
    got = plans.alerts_of_events(events, mode="exact").collect()
    assert got and all(r.sample_titles == [] and r.sample_links == [] for r in got)


def test_modes_are_checked(spark):
    with pytest.raises(ValueError):
        plans.estimated_counts(counts_frame(spark, MANY), "other")
    with pytest.raises(ValueError):
        plans.alerts_of_events(hot_events(spark), duration="5 minutes", slide="2 minutes")


def test_evidence_is_cut_below_the_shuffle(spark, tmp_path):
    hot_events(spark).write.parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = final_plan_text(plans.alerts_of_events(events, mode="exact"))
    finally:
        spark.conf.set(name, before)
    assert "row_number(), 3, Partial" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    # events are read once and leave their task folded by title and link
    assert plan.count("FileScan") == 1
    first = plan[: plan.index("FileScan")].rindex("Exchange hashpartitioning")
    assert "val#" in plan[first : plan.index("\n", first)]
