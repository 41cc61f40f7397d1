"""Zstandard dumps that are read by more than one task a file.

``spark.read.text`` gives a ``.zst`` file to one task and refuses windows over
128 MB, which large dumps use. A zstd file is a row of frames that decompress
on their own, so here a task reads a run of frames:

1. ``split_index`` walks the frame and block headers (3 bytes read for a block
   of up to 128 KB, nothing decompressed), one task a group of files, and writes
   runs of about ``split_bytes`` compressed bytes under ``spark.checkpoint.dir``
   (by default 16 runs a core, of 4 KB to 32 MB).
2. ``read_frames`` reads them as a Python data source, one partition a run.

A line belongs to the run in which it starts. Only a line that starts right at
a run's first byte is read by the run before: every run but a file's first drops
what stands before its first newline, and every run reads on to the first newline
behind its end. So lines that cross frames, or cover several, come out once.

A file of one frame stays one task, since its bytes depend on each other.

Defined results: lines end at ``\\n`` (a ``\\r`` before it goes); a last line needs
no newline; empty lines stay; bytes that are not UTF-8 become U+FFFD; skippable
frames and empty files give nothing; a file that ends inside a frame, or holds
anything else than frames, is an error. A run is read again from the file
when its executor is lost. A task holds the window of its frame (at most 2 GB,
usually 8 MB), one batch of about 4 MB and the longest line.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..session import checkpoint_path

# FIXED VALUES of the zstd format: skippable frames' first magic number, the
# longest frame header, the longest window a reader may be asked for
SKIPPABLE = 0x184D2A50
MAX_HEADER = 18
MAX_WINDOW = 2 ** 31

RUNS_PER_CORE = 16
SPLIT_BYTES = (4 << 10, 32 << 20)
FRAME_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
READ_BYTES = 1 << 20
LINES = pa.schema([("file", pa.string()), ("line", pa.string())])
INDEX = "path string, start long, stop long"


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Hadoop-style path (``file:/a`` or ``/a``: local)."""
    local = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(uri)


def frame_ends(f, length: int) -> Iterator[int]:
    """The end of each frame of an open file, from headers alone."""
    import zstandard

    def take(at: int, n: int, least: int) -> bytes:
        f.seek(at)
        got = f.read(n)
        if len(got) < least:
            raise ValueError(f"the file ends inside a frame, at byte {length}")
        return got

    at = 0
    while at < length:
        head = take(at, MAX_HEADER, 5)
        if int.from_bytes(head[:4], "little") & ~0xF == SKIPPABLE:
            at += 8 + int.from_bytes(take(at + 4, 4, 4), "little")
        else:
            checksum = zstandard.get_frame_parameters(head).has_checksum
            at += zstandard.frame_header_size(head)
            last = 0
            while not last:
                block = int.from_bytes(take(at, 3, 3), "little")
                last, repeated = block & 1, block >> 1 & 3 == 1
                at += 3 + (1 if repeated else block >> 3)
            at += 4 if checksum else 0
        if at > length:
            raise ValueError(f"the file ends inside a frame, at byte {length}")
        yield at


def runs(ends: Iterator[int], split_bytes: int) -> Iterator[tuple[int, int]]:
    """Neighbouring frames joined into (start, stop) of at least ``split_bytes``."""
    start = stop = 0
    for stop in ends:
        if stop - start >= split_bytes:
            yield start, stop
            start = stop
    if stop > start:
        yield start, stop


def split_index(spark: SparkSession, path: str, split_bytes: int | None = None) -> str:
    """The folder of a written table (path, start, stop) of all ``.zst`` files under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zst").load(path).select("path", "length")
    if split_bytes is None:
        total = files.agg(F.sum("length")).first()[0] or 0
        split_bytes = min(max(total // (RUNS_PER_CORE * spark.sparkContext.defaultParallelism), SPLIT_BYTES[0]), SPLIT_BYTES[1])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                system, place = located(uri)
                with system.open_input_file(place) as f:
                    found = list(runs(frame_ends(f, length), split_bytes))
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(found), pa.string()), pa.array([s for s, _ in found], pa.int64()), pa.array([e for _, e in found], pa.int64())], names=["path", "start", "stop"])

    folder = checkpoint_path(spark, f"zst-index-{uuid.uuid4().hex}")
    files.mapInArrow(walk, INDEX).write.parquet(folder)
    return folder


class Span:
    """The next ``n`` bytes of an open file, as a source of bytes."""

    def __init__(self, f, n: int | None):
        self.f, self.left = f, n

    def read(self, size: int) -> bytes:
        got = self.f.read(size if self.left is None else min(size, self.left))
        if self.left is not None:
            self.left -= len(got)
        return got


def decompressed(f, start: int, stop: int | None) -> Iterator[bytes]:
    """Text of the frames in [start, stop), to the end of the file for None."""
    import zstandard

    f.seek(start)
    source = Span(f, None if stop is None else stop - start)
    reader = zstandard.ZstdDecompressor(max_window_size=MAX_WINDOW).stream_reader(source, read_size=READ_BYTES, read_across_frames=True)
    while chunk := reader.read(READ_BYTES):
        yield chunk


def lines_of(f, start: int, stop: int) -> Iterator[bytes]:
    """The lines of the run [start, stop), by the rule of the module."""
    dropping, pending = start > 0, []
    for chunk in decompressed(f, start, stop):
        if dropping:
            at = chunk.find(b"\n")
            if at < 0:
                continue
            chunk, dropping = chunk[at + 1:], False
        first, *others = chunk.split(b"\n")
        pending.append(first)
        if others:
            yield b"".join(pending)
            yield from others[:-1]
            pending = [others[-1]]
    if dropping:
        return
    for chunk in decompressed(f, stop, None):
        at = chunk.find(b"\n")
        pending.append(chunk if at < 0 else chunk[:at])
        if at >= 0:
            yield b"".join(pending)
            return
    if any(pending):
        yield b"".join(pending)


@dataclass
class Run(InputPartition):
    path: str
    start: int
    stop: int


class FrameReader(DataSourceReader):
    def __init__(self, index: str):
        self.index = index

    def partitions(self) -> list[Run]:
        import pyarrow.parquet as pq

        system, folder = located(self.index)
        rows = pq.read_table(folder, filesystem=system).to_pylist()
        return [Run(r["path"], r["start"], r["stop"]) for r in rows]

    def read(self, run: Run | None) -> Iterator[pa.RecordBatch]:
        if run is None:  # an index without runs
            return
        system, place = located(run.path)
        name, batch, size = os.path.basename(place), [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(batch), pa.string()), pa.array(batch, pa.string())], schema=LINES)

        with system.open_input_file(place) as f:
            for line in lines_of(f, run.start, run.stop):
                batch.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                size += len(line) + 1
                if size >= BATCH_BYTES:
                    yield made()
                    batch, size = [], 0
        if batch:
            yield made()


@dataclass
class Parts(WriterCommitMessage):
    names: list[str]


class FrameWriter(DataSourceArrowWriter):
    """A task writes its rows as ``<file>-<partition>.zst``, under a hidden name
    until the job commits; frames end at line ends, at ``frame_bytes`` of text."""

    def __init__(self, folder: str, frame_bytes: int):
        self.folder, self.frame_bytes = folder, frame_bytes

    def write(self, batches: Iterator[pa.RecordBatch]) -> Parts:
        import zstandard

        task = TaskContext.get()
        system, folder = located(self.folder)
        system.create_dir(folder, recursive=True)
        packer, names, out, text, size = zstandard.ZstdCompressor(write_checksum=True), [], None, [], 0
        current = None

        def flush() -> None:
            nonlocal text, size
            if text:
                out.write(packer.compress("".join(text).encode()))
            text, size = [], 0

        for b in batches:
            for file, line in zip(b.column("file").to_pylist(), b.column("line").to_pylist()):
                if file != current:
                    if out is not None:
                        flush()
                        out.close()
                    current = file
                    names.append(f"_{task.taskAttemptId()}_{file.removesuffix('.zst')}-{task.partitionId():05d}.zst")
                    out = system.open_output_stream(f"{folder}/{names[-1]}", compression=None)
                text.append(line + "\n")
                size += len(line) + 1
                if size >= self.frame_bytes:
                    flush()
        if out is not None:
            flush()
            out.close()
        return Parts(names)

    def commit(self, messages: list[Parts | None]) -> None:
        system, folder = located(self.folder)
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{folder}/{name}", f"{folder}/{re.sub('^_[0-9]+_', '', name)}")

    def abort(self, messages: list[Parts | None]) -> None:
        system, folder = located(self.folder)
        for name in (n for m in messages if m for n in m.names):
            system.delete_file(f"{folder}/{name}")


class ZstLines(DataSource):
    """(file, line) of zstd files; options ``index`` (read), ``path`` and ``frame_bytes`` (write)."""

    @classmethod
    def name(cls) -> str:
        return "zst_lines"

    def schema(self) -> str:
        return "file string, line string"

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options["index"])

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options["path"], int(self.options.get("frame_bytes", FRAME_BYTES)))


def read_frames(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """(file, line) for every line of every ``.zst`` file under ``path``."""
    spark.dataSource.register(ZstLines)
    return spark.read.format("zst_lines").option("index", split_index(spark, path, split_bytes)).load()


def write_frames(lines: DataFrame, path: str, frame_bytes: int = FRAME_BYTES) -> None:
    """(file, line) rows as multi-frame files ``<file>-<partition>.zst`` in a new
    folder; rows with a null in either column, or a line break in a line, are an error."""
    lines.sparkSession.dataSource.register(ZstLines)
    bad = F.col("file").isNull() | F.col("line").isNull() | F.col("line").contains("\n")
    checked = lines.select(F.when(bad, F.raise_error(F.lit("a dump line needs a file and no line break"))).otherwise(F.col("file")).alias("file"), "line")
    checked.sortWithinPartitions("file").write.format("zst_lines").option("frame_bytes", frame_bytes).mode("append").save(path)
