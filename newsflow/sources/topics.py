"""Message topics.

The format is a parameter: ``kafka`` where its connector is on the class path, ``segments``
where there is no broker, or any built-in file format whose rows have a ``value`` column.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from newsflow.sources.segments import FORMAT, register_segments

_VALUE = StructType([StructField("value", StringType())])


def read_topic(
    spark: SparkSession,
    fmt: str = "kafka",
    options: dict[str, str] | None = None,
    path: str | None = None,
    schema: StructType | None = None,
) -> DataFrame:
    """Streaming rows of a topic. File formats read ``path``; other than ``text`` they
    need a schema, by default one ``value`` column."""
    if fmt == FORMAT:
        register_segments(spark)
    reader = spark.readStream.format(fmt).options(**(options or {}))
    if fmt not in ("kafka", "text", "rate", FORMAT):
        reader = reader.schema(schema or _VALUE)
    return reader.load(path) if path is not None else reader.load()


def _topic(spark, servers: str, topic: str, offsets: str, options, fmt: str) -> DataFrame:
    start = {"startingOffsets": offsets}
    if fmt == FORMAT:
        return read_topic(spark, fmt, start | (options or {}), f"{servers.rstrip('/')}/{topic}")
    where = {"kafka.bootstrap.servers": servers, "subscribe": topic}
    return read_topic(spark, fmt, where | start | (options or {}))


def read_raw_topic(
    spark: SparkSession,
    servers: str,
    topic: str,
    options: dict[str, str] | None = None,
    fmt: str = "kafka",
) -> DataFrame:
    """Raw article records from the first one kept. ``options`` adds to or replaces the
    source's settings; without ``maxOffsetsPerTrigger`` the first micro-batch is all of the
    topic. With the format ``segments``, ``servers`` is the folder that holds the topics, and
    the setting is ``maxRecordsPerTrigger``."""
    return _topic(spark, servers, topic, "earliest", options, fmt)


def read_cleaned_topic(
    spark: SparkSession,
    servers: str,
    topic: str,
    options: dict[str, str] | None = None,
    fmt: str = "kafka",
) -> DataFrame:
    """Cleaned article records from now on; history is skipped on the first start."""
    return _topic(spark, servers, topic, "latest", options, fmt)


def read_table_stream(
    spark: SparkSession, folder: str, name: str, options: dict[str, str] | None = None
) -> DataFrame:
    """The Parquet table ``name`` in ``folder``, one file or a folder of parts, as a stream
    with the schema it has now. ``options`` may limit a micro-batch (``maxFilesPerTrigger``,
    ``maxBytesPerTrigger``)."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    # a stream's plain path must be a folder; a pattern may match either
    pattern = f"{folder}/{name[:-1]}[{name[-1]}]"
    return spark.readStream.schema(schema).options(**(options or {})).parquet(pattern)
