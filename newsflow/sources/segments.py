"""Topics and collections in a shared folder, without a broker.

The format ``segments`` is a folder of Parquet files (``data``) and a log of commits
(``log``). A write stages its files, and one commit record makes all of them visible at once;
what a failed write leaves is never read. A record names the query and batch it is of: a
batch that is written again after a failure adds nothing. Rows lie in partitions and have
offsets there, as in a broker's topic, and streams start from the ``earliest`` row or, with
``startingOffsets=latest``, from what comes after their start.

Options: ``path``; reading: ``startingOffsets``, ``consumer`` (a name under which a stream
notes how far it is; a new checkpoint of that name goes on from there),
``maxRecordsPerTrigger`` (without ``consumer`` it does not hold for the first micro-batch after
a start, as Spark does not tell a source where its checkpoint is); writing: ``partitions``
(of a new topic), ``query`` and ``batch_id``. One writer at a time commits; of two, the later
one tries the next number. The folder must be one that drivers and executors see under the
same path.
"""

import json
import os
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

FORMAT = "segments"
#: Where a row lies; added to the columns that were written.
PLACE = [StructField("partition", IntegerType()), StructField("offset", LongType())]
MESSAGE = [StructField("key", StringType()), StructField("value", StringType())]
#: Rows of a file read at once.
ROWS = 8192


def register_segments(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(SegmentSource)


@dataclass
class Staged(WriterCommitMessage):
    """A file that a task has written, not yet visible."""

    file: str
    count: int


@dataclass
class Stretch(InputPartition):
    """Rows ``first`` to ``last`` of a file, and the offset of its first row."""

    file: str
    partition: int
    base: int
    first: int
    last: int


class Log:
    """The commit records of a folder, in order."""

    def __init__(self, path: str):
        uri = path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"
        self.files, self.path = pyarrow.fs.FileSystem.from_uri(uri)
        self.read: list[dict] = []

    def refresh(self) -> list[dict]:
        """All records; those read before are not read again."""
        while True:
            name = self._record(len(self.read))
            if self.files.get_file_info(name).type != pyarrow.fs.FileType.File:
                return self.read
            with self.files.open_input_stream(name) as f:
                self.read.append(json.loads(f.read()))

    def _record(self, n: int) -> str:
        return f"{self.path}/log/{n:020d}.json"

    def ends(self) -> dict[str, int]:
        """The offset after the last row of each partition."""
        found: dict[str, int] = {}
        for record in self.refresh():
            for s in record["segments"]:
                found[str(s["partition"])] = s["base"] + s["count"]
        return found

    def committed(self, query: str | None, batch: int | None) -> bool:
        if query is None or batch is None:
            return False
        last = next((r for r in reversed(self.refresh()) if r["query"] == query), None)
        return last is not None and last["batch"] >= batch

    def commit(self, staged: list[Staged], schema: str, query, batch, partitions: int) -> None:
        """One record for all staged files; nothing if the batch has one already."""
        while not self.committed(query, batch):
            records, ends = self.refresh(), self.ends()
            width = records[0]["partitions"] if records else partitions
            segments = []
            for n, s in enumerate(s for s in staged if s and s.count):
                place = (len(records) + n) % width
                base = ends.get(str(place), 0)
                ends[str(place)] = base + s.count
                segments.append({"partition": place, "base": base, "count": s.count, "file": s.file})
            record = {"query": query, "batch": batch, "partitions": width, "schema": schema}
            if self._publish(len(records), record | {"segments": segments}):
                return
        self.discard(staged)

    def _publish(self, n: int, record: dict) -> bool:
        """Write record ``n`` as a whole; False if another writer has taken the number."""
        self.files.create_dir(f"{self.path}/log", recursive=True)
        draft = f"{self.path}/log/draft-{uuid.uuid4().hex}"
        with self.files.open_output_stream(draft) as f:
            f.write(json.dumps(record).encode())
        if isinstance(self.files, pyarrow.fs.LocalFileSystem):
            try:
                os.link(draft, self._record(n))
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
            return True
        if self.files.get_file_info(self._record(n)).type != pyarrow.fs.FileType.NotFound:
            self.files.delete_file(draft)
            return False
        self.files.move(draft, self._record(n))
        return True

    def noted(self, consumer: str | None) -> dict[str, int] | None:
        """How far a stream of that name has planned to read."""
        name = f"{self.path}/consumers/{consumer}.json"
        if consumer is None or self.files.get_file_info(name).type != pyarrow.fs.FileType.File:
            return None
        with self.files.open_input_stream(name) as f:
            return json.loads(f.read())

    def note(self, consumer: str | None, ends: dict[str, int]) -> None:
        if consumer is None:
            return
        self.files.create_dir(f"{self.path}/consumers", recursive=True)
        draft = f"{self.path}/consumers/draft-{uuid.uuid4().hex}"
        with self.files.open_output_stream(draft) as f:
            f.write(json.dumps(ends).encode())
        self.files.move(draft, f"{self.path}/consumers/{consumer}.json")

    def discard(self, staged: list[Staged]) -> None:
        for s in staged:
            if s and self.files.get_file_info(s.file).type == pyarrow.fs.FileType.File:
                self.files.delete_file(s.file)

    def stretches(self, start: dict[str, int], end: dict[str, int]) -> list[Stretch]:
        """The files that hold rows from ``start`` to ``end``."""
        out = []
        for record in self.refresh():
            for s in record["segments"]:
                place, base = str(s["partition"]), s["base"]
                first = max(start.get(place, 0) - base, 0)
                last = min(end.get(place, 0) - base, s["count"])
                if first < last:
                    out.append(Stretch(s["file"], s["partition"], base, first, last))
        return out

    def rows(self, part: Stretch, names: list[str]):
        """The rows of a stretch with the places they have."""
        at = 0
        with self.files.open_input_file(part.file) as f:
            file = pq.ParquetFile(f)
            wanted = [n for n in names if n not in ("partition", "offset")]
            for batch in file.iter_batches(ROWS, columns=wanted):
                a, b = max(part.first - at, 0), min(part.last - at, batch.num_rows)
                if a < b:
                    kept = batch.slice(a, b - a)
                    places = {
                        "partition": pa.array([part.partition] * kept.num_rows, pa.int32()),
                        "offset": pa.array(range(part.base + at + a, part.base + at + b), pa.int64()),
                    }
                    columns = [places[n] if n in places else kept.column(n) for n in names]
                    yield pa.RecordBatch.from_arrays(columns, names)
                at += batch.num_rows


class _Rows:
    """What batch and streaming readers share."""

    def __init__(self, options, schema: StructType):
        self.path, self.names = options["path"], schema.names
        self.starting = options.get("startingOffsets", "earliest")
        self.limit = int(options.get("maxRecordsPerTrigger", 0))
        self.consumer = options.get("consumer")
        if self.starting not in ("earliest", "latest"):
            raise ValueError("startingOffsets must be earliest or latest")

    def read(self, partition: Stretch):
        yield from Log(self.path).rows(partition, self.names)


class BatchRows(_Rows, DataSourceReader):
    def partitions(self):
        log = Log(self.path)
        # a folder without rows still needs a partition
        return log.stretches({}, log.ends()) or [Stretch("", 0, 0, 0, 0)]

    def read(self, partition: Stretch):
        if partition.file:
            yield from super().read(partition)


class StreamRows(_Rows, DataSourceStreamReader):
    def __init__(self, options, schema: StructType):
        super().__init__(options, schema)
        self.log, self.position = Log(self.path), None

    def initialOffset(self) -> dict:
        noted = self.log.noted(self.consumer)
        if noted is None:
            noted = self.log.ends() if self.starting == "latest" else {}
            self.log.note(self.consumer, noted)
        return noted

    def latestOffset(self) -> dict:
        ends = self.log.ends()
        if self.position is None and self.consumer:
            self.position = self.initialOffset()
        if self.limit and self.position is not None and ends:
            each = -(-self.limit // len(ends))
            ends = {p: min(n, self.position.get(p, 0) + each) for p, n in ends.items()}
        return ends

    def partitions(self, start: dict, end: dict):
        self.position = end
        self.log.note(self.consumer, end)
        return self.log.stretches(start, end)


class _Writes:
    """What batch and streaming writers share."""

    def __init__(self, options, schema: StructType):
        self.path, self.schema = options["path"], schema.json()
        self.query = options.get("query")
        self.batch = int(options["batch_id"]) if "batch_id" in options else None
        self.wide = int(options.get("partitions", 4))

    def write(self, iterator):
        log = Log(self.path)
        log.files.create_dir(f"{log.path}/data", recursive=True)
        name, count, file = f"{log.path}/data/{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                file = file or pq.ParquetWriter(name, batch.schema, filesystem=log.files)
                file.write_batch(batch)
                count += batch.num_rows
        finally:
            if file is not None:
                file.close()
        return Staged(name, count)


class BatchWrites(_Writes, DataSourceArrowWriter):
    def commit(self, messages) -> None:
        Log(self.path).commit(messages, self.schema, self.query, self.batch, self.wide)

    def abort(self, messages) -> None:
        Log(self.path).discard(messages)


class StreamWrites(_Writes, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId: int) -> None:
        Log(self.path).commit(messages, self.schema, self.query, batchId, self.wide)

    def abort(self, messages, batchId: int) -> None:
        Log(self.path).discard(messages)


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        """The columns that were written first, and the place of a row."""
        records = Log(self.options["path"]).refresh()
        if not records:
            return StructType(MESSAGE + PLACE)
        return StructType(StructType.fromJson(json.loads(records[0]["schema"])).fields + PLACE)

    def reader(self, schema: StructType):
        return BatchRows(self.options, schema)

    def streamReader(self, schema: StructType):
        return StreamRows(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool):
        if overwrite:
            raise ValueError("segments can only be appended to")
        return BatchWrites(self.options, schema)

    def streamWriter(self, schema: StructType, overwrite: bool):
        return StreamWrites(self.options, schema)
