"""Streaming writers. Every query has a checkpoint folder of its own."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from newsflow.operators.parse import to_json_value
from newsflow.sinks.batch import Target, write_batch
from newsflow.sources.segments import FORMAT, register_segments


def _start(writer, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(**trigger) if trigger else writer).start()


def _append(df: DataFrame, target: Target, checkpoint: str, trigger) -> StreamingQuery:
    options = dict(target.options, **({"path": target.path} if target.path else {}))
    if target.fmt == FORMAT:
        # a query is known by its checkpoint, also after a restart
        register_segments(df.sparkSession)
        options.setdefault("query", checkpoint)
    return _start(df.writeStream.format(target.fmt).options(**options), checkpoint, trigger)


def write_topic(
    df: DataFrame, target: Target, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append rows to a topic as JSON ``value``."""
    return _append(to_json_value(df), target, checkpoint, trigger)


def write_collection(
    df: DataFrame, target: Target, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append whole rows to a collection."""
    return _append(df, target, checkpoint, trigger)


def fan_out(
    df: DataFrame,
    collection: Target,
    topic: Target,
    checkpoint: str,
    key: str | None = "category",
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    stored: Callable[[DataFrame], DataFrame] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write each micro-batch to a collection and, as JSON keyed by ``key``, to a topic.

    ``prepare`` turns the batch into the rows to write, ``stored`` those into the shape the
    collection keeps. The rows are computed once for both sinks; nothing is written when
    there are none.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        cached = [batch.persist()]
        try:
            rows = batch
            if prepare:
                rows = prepare(batch).persist()
                cached.append(rows)
            if not rows.isEmpty():
                write_batch(stored(rows) if stored else rows, collection, query, batch_id)
                write_batch(to_json_value(rows, key=key), topic, query, batch_id)
        finally:
            for df in cached:
                df.unpersist()

    return _start(df.writeStream.foreachBatch(write), checkpoint, trigger)


def run_available(query: StreamingQuery) -> None:
    """Wait for a query that stops by itself (``trigger={"availableNow": True}``)."""
    query.awaitTermination()
