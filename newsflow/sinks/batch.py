"""Batch writes used inside a micro-batch."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from newsflow.sources.segments import FORMAT, register_segments

FILE_FORMATS = ("parquet", "orc", "json", "csv", "text")


@dataclass(frozen=True)
class Target:
    """Where rows go: a format, its options and, for files, a path."""

    fmt: str
    path: str | None = None
    options: dict[str, str] = field(default_factory=dict)


def write_batch(df: DataFrame, target: Target, query: str, batch_id: int) -> None:
    """Write one micro-batch so that writing it again after a failure adds nothing.

    Files go to a folder of their own per streaming query and batch, replaced as a whole;
    the folders read back as the columns ``query`` and ``batch_id``. A query's id lives in
    its checkpoint: runs with other checkpoints write elsewhere, whatever their batch ids.
    The ``segments`` format is appended to by one commit record per query and batch. Other
    formats are appended to: delivery is then at least once unless their options name a key
    to upsert on.
    """
    if target.fmt == FORMAT:
        register_segments(df.sparkSession)
        named = {"query": query, "batch_id": str(batch_id)}
        writer = df.write.format(FORMAT).options(**target.options, **named)
        writer.mode("append").save(target.path)
        return
    writer = df.write.format(target.fmt).options(**target.options)
    if target.fmt in FILE_FORMATS:
        writer.mode("overwrite").save(f"{target.path}/query={query}/batch_id={batch_id}")
    elif target.path is not None:
        writer.mode("append").save(target.path)
    else:
        writer.mode("append").save()
