"""Topics and collections as folders of segments."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from newsflow.sinks import Target, fan_out, run_available, write_batch, write_collection
from newsflow.sources import segments
from newsflow.sources.segments import FORMAT, Log, Staged, register_segments
from newsflow.sources.topics import read_cleaned_topic, read_raw_topic, read_topic

NOW = {"availableNow": True}


@pytest.fixture
def folder(spark, tmp_path):
    register_segments(spark)
    return str(tmp_path / "topic")


def send(spark, folder, values, query="q", batch=0):
    rows = spark.createDataFrame([(None, v) for v in values], "key string, value string")
    write_batch(rows.repartition(2), Target(FORMAT, folder), query, batch)


def values(df):
    return sorted(r.value for r in df.collect())


def test_rows_have_places_without_gaps(spark, folder):
    send(spark, folder, [f"a{i}" for i in range(7)])
    send(spark, folder, [f"b{i}" for i in range(5)], batch=1)
    got = spark.read.format(FORMAT).load(folder)
    assert got.columns == ["key", "value", "partition", "offset"]
    places = {}
    for r in got.collect():
        places.setdefault(r.partition, []).append(r.offset)
    assert all(sorted(o) == list(range(len(o))) for o in places.values())
    assert len(values(got)) == 12
    # only the columns that are asked for are read
    assert got.select("offset").count() == 12


def test_a_batch_that_is_written_again_adds_nothing(spark, folder):
    send(spark, folder, ["a", "b"])
    send(spark, folder, ["a", "b"])
    send(spark, folder, ["c"], query="other")
    assert values(spark.read.format(FORMAT).load(folder)) == ["a", "b", "c"]
    # the files of the second try are gone
    named = {s["file"] for r in Log(folder).refresh() for s in r["segments"]}
    assert {str(p) for p in Path(folder, "data").iterdir()} == named


def test_rows_of_a_failed_write_are_never_seen(spark, folder):
    send(spark, folder, ["a"])
    failing = spark.range(10).select(
        F.lit(None).cast("string").alias("key"),
        F.when(F.col("id") < 9, F.col("id").cast("string")).otherwise(F.raise_error("stop")).alias("value"),
    )
    with pytest.raises(Exception, match="stop"):
        write_batch(failing.coalesce(1), Target(FORMAT, folder), "q", 1)
    assert values(spark.read.format(FORMAT).load(folder)) == ["a"]
    send(spark, folder, ["b"], batch=1)
    assert values(spark.read.format(FORMAT).load(folder)) == ["a", "b"]


def test_two_writers_take_different_numbers(folder):
    first, second = Log(folder), Log(folder)
    assert first.refresh() == second.refresh() == []
    first.commit([Staged("x", 3)], '{"fields":[]}', "one", 0, 1)
    second.commit([Staged("y", 2)], '{"fields":[]}', "two", 0, 1)
    assert [r["query"] for r in Log(folder).refresh()] == ["one", "two"]
    assert Log(folder).ends() == {"0": 5}


@pytest.mark.parametrize("killed_at", ["before the collection", "between", "after both"])
def test_a_job_killed_between_its_two_writes_delivers_each_row_once(spark, folder, tmp_path, monkeypatch, killed_at):
    send(spark, folder, [f"r{i}" for i in range(20)])
    collection, topic = Target(FORMAT, str(tmp_path / "rows")), Target(FORMAT, str(tmp_path / "out"))
    checkpoint = str(tmp_path / "checkpoint")
    stream = lambda: read_topic(spark, FORMAT, path=folder).select("value", F.col("offset").cast("string").alias("category"))
    import newsflow.sinks.stream as module

    write, calls = module.write_batch, []

    def dies(df, target, query, batch):
        calls.append(target)
        if killed_at == "before the collection":
            raise RuntimeError("killed")
        if killed_at == "after both" or target is collection:
            write(df, target, query, batch)
        if target is topic:
            raise RuntimeError("killed")

    monkeypatch.setattr(module, "write_batch", dies)
    with pytest.raises(Exception, match="killed"):
        run_available(fan_out(stream(), collection, topic, checkpoint, trigger=NOW))
    monkeypatch.setattr(module, "write_batch", write)
    run_available(fan_out(stream(), collection, topic, checkpoint, trigger=NOW))
    want = sorted(f"r{i}" for i in range(20))
    assert values(spark.read.format(FORMAT).load(collection.path)) == want
    sent = spark.read.format(FORMAT).load(topic.path)
    assert sorted(json.loads(r.value)["value"] for r in sent.collect()) == want


def test_earliest_latest_and_restarts(spark, tmp_path):
    base = str(tmp_path)
    send(spark, f"{base}/news", ["old1", "old2"])
    out = {n: Target("parquet", str(tmp_path / n)) for n in ("all", "new")}
    readers = {"all": read_raw_topic, "new": read_cleaned_topic}
    queries = {
        n: write_collection(read(spark, base, "news", fmt=FORMAT), out[n], str(tmp_path / f"{n}-checkpoint"))
        for n, read in readers.items()
    }
    for q in queries.values():
        q.processAllAvailable()
    send(spark, f"{base}/news", ["new1"], batch=1)
    for q in queries.values():
        q.processAllAvailable()
        q.stop()
    assert values(spark.read.parquet(out["all"].path)) == ["new1", "old1", "old2"]
    assert values(spark.read.parquet(out["new"].path)) == ["new1"]
    # a restart goes on where the checkpoint ends, wherever a first start would begin
    send(spark, f"{base}/news", ["new2"], batch=2)
    for n, read in readers.items():
        rows = read(spark, base, "news", fmt=FORMAT)
        run_available(write_collection(rows, out[n], str(tmp_path / f"{n}-checkpoint"), NOW))
    assert values(spark.read.parquet(out["all"].path)) == ["new1", "new2", "old1", "old2"]
    assert values(spark.read.parquet(out["new"].path)) == ["new1", "new2"]


def test_a_trigger_takes_no_more_than_its_limit(spark, folder, tmp_path):
    for n in range(4):
        send(spark, folder, [f"{n}-{i}" for i in range(10)], batch=n)
    out = Target(FORMAT, str(tmp_path / "out"))

    def run():
        rows = read_topic(spark, FORMAT, {"maxRecordsPerTrigger": "12", "consumer": "c"}, path=folder)
        query = write_collection(rows.select("value"), out, str(tmp_path / "checkpoint"))
        query.processAllAvailable()
        query.stop()
        return [sum(s["count"] for s in r["segments"]) for r in Log(out.path).refresh()]

    counts = run()
    assert sum(counts) == 40 and max(counts) <= 12
    for n in range(4, 7):
        send(spark, folder, [f"{n}-{i}" for i in range(10)], batch=n)
    counts = run()  # after a restart, too
    assert sum(counts) == 70 and max(counts) <= 12
    assert len(set(values(spark.read.format(FORMAT).load(out.path)))) == 70


def test_an_empty_folder_and_other_columns(spark, folder, tmp_path):
    empty = spark.read.format(FORMAT).load(str(tmp_path / "nothing"))
    assert empty.columns == ["key", "value", "partition", "offset"] and empty.count() == 0
    rows = spark.sql("SELECT 1L AS id, array('a', NULL) AS words, TIMESTAMP_NTZ '2024-01-01 10:00:00' AS at")
    write_batch(rows, Target(FORMAT, folder), "q", 0)
    got = spark.read.format(FORMAT).load(folder)
    assert got.select("id", "words", "at").collect() == rows.collect()
    with pytest.raises(Exception, match="startingOffsets"):
        spark.readStream.format(FORMAT).option("startingOffsets", "middle").load(folder).writeStream.format(
            "noop"
        ).option("checkpointLocation", str(tmp_path / "c")).start().processAllAvailable()
    with pytest.raises(Exception, match="appended"):
        rows.write.format(FORMAT).mode("overwrite").save(folder)


def test_drafts_are_not_records(folder):
    log = Log(folder)
    log.commit([Staged("x", 1)], '{"fields":[]}', "q", 0, 1)
    Path(folder, "log", "draft-1").write_text("half a rec")
    assert len(Log(folder).refresh()) == 1
    assert sorted(os.listdir(Path(folder, "log"))) == ["0" * 20 + ".json", "draft-1"]
    assert segments.Log("file://" + folder).ends() == {"0": 1}
