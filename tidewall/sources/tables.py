"""Two data sources: lines of files as bytes, and the audit trail with appends that happen once.

`spark.read.format("tidewall_lines")` and `readStream` give a row (file, start, raw) for each line. Files are read in ranges of bytes,
so that a large file is many tasks; a line belongs to the range in which it starts. Lines are cut at `cap` bytes before anything is decoded,
so bytes that are no text reach the reader as they are. A stream's offset says how far each file was read; only whole
lines are taken, and what a file gets later is read later.

`df.write.format("tidewall_trail")` appends rows (value: JSON text) in two phases. Tasks write files of their own attempt into a hidden
folder; the commit drops those of other attempts and renames the folder to `batch=<id>`. The same id is never
committed twice, so a job that runs again appends nothing, and readers of the folder see all of a batch or nothing. Paths may be local or of
any store that pyarrow.fs knows; where a store renames by copying, a batch appears file by file.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

EVENT_CAP, RANGE_BYTES, BLOCK = 8 << 20, 64 << 20, 1 << 20


def store(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if re.match(r"^file:/*", path):
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:/*", "", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> dict[str, int]:
    """Sizes of the files of a folder (or the one file), by name; hidden ones are left out."""
    from pyarrow import fs

    system, at = store(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return {at: info.size}
    found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not re.search(r"/[._]", f.path[len(at) :])}


@dataclass
class Range(InputPartition):
    file: str
    start: int
    stop: int


def lines(system, part: Range, cap: int) -> Iterator[tuple[str, int, bytes]]:
    """The lines that start in a range, without their newline and cut at cap bytes. Memory holds one block and one cut line."""
    with system.open_input_file(part.file) as file:
        at, first = part.start, part.start == 0
        if not first:
            # a line starts here if the byte before is a newline
            file.seek(part.start - 1)
            at = part.start - 1
        else:
            file.seek(0)
        begin, held, kept = at, [], 0
        skip = not first
        while True:
            block = file.read(BLOCK)
            if not block:
                if kept and not skip and begin < part.stop:
                    yield part.file, begin, b"".join(held)[:cap]
                elif not skip and at > begin and begin < part.stop:
                    yield part.file, begin, b""
                return
            pos = 0
            while pos < len(block):
                to = block.find(b"\n", pos)
                end = to if to >= 0 else len(block)
                if not skip and kept < cap:
                    held.append(block[pos : min(end, pos + cap - kept)])
                    kept += len(held[-1])
                if to < 0:
                    break
                if not skip:
                    yield part.file, begin, b"".join(held)
                begin, held, kept, skip, pos = at + to + 1, [], 0, False, to + 1
                if begin >= part.stop:
                    return
            at += len(block)


class _Lines:
    def __init__(self, options: dict):
        self.path, self.cap, self.step = options["path"], int(options.get("cap", EVENT_CAP)), int(options.get("rangebytes", RANGE_BYTES))

    def ranges(self, file: str, start: int, stop: int) -> list[Range]:
        return [Range(file, a, min(a + self.step, stop)) for a in range(start, stop, self.step)]

    def batches(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, _ = store(self.path)
        rows, held = [], 0
        for row in lines(system, part, self.cap):
            rows.append(row)
            held += len(row[2])
            if len(rows) >= 10_000 or held > 4 << 20:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        file, start, raw = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(start, pa.int64()), pa.array(raw, pa.binary())], names=["file", "start", "raw"])


class LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.of = _Lines(options)

    def partitions(self) -> list[Range]:
        return [r for file, size in listed(self.of.path).items() for r in self.of.ranges(file, 0, size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.of.batches(partition)


class LinesStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.of = _Lines(options)

    def initialOffset(self) -> dict:
        return {}

    def _whole(self, file: str, size: int) -> int:
        """The end of the last whole line of a file."""
        system, _ = store(self.of.path)
        with system.open_input_file(file) as f:
            at = size
            while at > 0:
                back = max(0, at - BLOCK)
                f.seek(back)
                to = f.read(at - back).rfind(b"\n")
                if to >= 0:
                    return back + to + 1
                at = back
        return 0

    def latestOffset(self) -> dict:
        return {file: self._whole(file, size) for file, size in listed(self.of.path).items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for file, stop in sorted(end.items()) if stop > start.get(file, 0) for r in self.of.ranges(file, start.get(file, 0), stop)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.of.batches(partition)


class LinesSource(DataSource):
    """Options: path, cap (bytes of a line that are kept), rangeBytes (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "tidewall_lines"

    def schema(self) -> str:
        return "file string, start long, raw binary"

    def reader(self, schema: StructType) -> LinesReader:
        return LinesReader(self.options)

    def streamReader(self, schema: StructType) -> LinesStreamReader:
        return LinesStreamReader(self.options)


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    file: str
    rows: int


class _Trail:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.job = uuid.uuid4().hex

    def folder(self) -> str:
        return f"{store(self.path)[1].rstrip('/')}/_pending/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        from pyspark import TaskContext

        system, _ = store(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId() if task else 0:05d}-{task.taskAttemptId() if task else 0}-{uuid.uuid4().hex[:8]}.json"
        system.create_dir(self.folder(), recursive=True)
        rows = 0
        with system.open_output_stream(f"{self.folder()}/{name}") as out:
            for batch in iterator:
                for value in batch.column(0).to_pylist():
                    if value is not None:
                        out.write(value.replace("\n", " ").encode() + b"\n")
                        rows += 1
        return Attempt(self.folder(), name, rows)

    def publish(self, batch: str, messages: list) -> None:
        """Makes the files of the messages a batch; they say where they are, as the one who commits may not be the one who sent the tasks."""
        from pyarrow import fs

        system, at = store(self.path)
        target = f"{at.rstrip('/')}/batch={batch}"
        kept = [m for m in messages if m is not None and m.rows]
        if not kept or system.get_file_info(target).type != fs.FileType.NotFound:
            self.discard(messages)  # nothing to add, or this batch is there
            return
        folder = kept[0].folder
        for m in kept:
            if m.folder != folder:
                system.move(f"{m.folder}/{m.file}", f"{folder}/{m.file}")
        names = {m.file for m in kept}
        for f in system.get_file_info(fs.FileSelector(folder)):
            if f.base_name not in names:
                system.delete_file(f.path)
        try:
            system.move(folder, target)
        except OSError:
            if system.get_file_info(target).type == fs.FileType.NotFound:
                raise
            self.discard(messages)  # another run of it came first

    def discard(self, messages: list) -> None:
        system, _ = store(self.path)
        for folder in {self.folder(), *(m.folder for m in messages if m is not None)}:
            system.delete_dir_contents(folder, missing_dir_ok=True)


def _named(batch: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"a batch's name has letters, digits, _, . and - only: {batch!r}")
    return batch


class TrailWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.trail, self.batch = _Trail(options), _named(options["batch"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        return self.trail.write(iterator)

    def commit(self, messages: list) -> None:
        self.trail.publish(self.batch, messages)

    def abort(self, messages: list) -> None:
        self.trail.discard(messages)


class TrailStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.trail, self.prefix = _Trail(options), _named(options.get("batch", "stream"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        return self.trail.write(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        self.trail.publish(f"{self.prefix}-{batchId}", messages)

    def abort(self, messages: list, batchId: int) -> None:
        self.trail.discard(messages)


class TrailSource(DataSource):
    """Options: path, batch (the name of this append; of a stream, what its batches' names start with)."""

    @classmethod
    def name(cls) -> str:
        return "tidewall_trail"

    def writer(self, schema: StructType, overwrite: bool) -> TrailWriter:
        if overwrite:
            raise ValueError("the trail is only appended to")
        return TrailWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> TrailStreamWriter:
        return TrailStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(LinesSource)
    spark.dataSource.register(TrailSource)


def as_lines(rows: DataFrame) -> DataFrame:
    """value: each row as JSON text, with its nulls."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def append_once(rows: DataFrame, path: str, batch: str) -> None:
    """Appends rows to the trail at path under a name; a second append of that name does nothing."""
    register(rows.sparkSession)
    as_lines(rows).write.format("tidewall_trail").mode("append").option("path", path).option("batch", batch).save()


__all__ = ["LinesSource", "TrailSource", "append_once", "as_lines", "register"]
