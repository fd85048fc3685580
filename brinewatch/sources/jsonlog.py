"""Event logs of JSON lines as a source: batch scans from a sequence number, and a stream that keeps its place.

A log is a folder of segments; a segment's name says its first number (log-0000000000001000.jsonl), so a scan from a number skips segments that end before it. Tasks read
ranges of bytes, each from the first line that begins in its range to the last. A line that isn't a JSON object with a whole number "sequence" is corrupt: it fails the scan and says where it stands
(corrupt=fail), or comes back with a null number and its text (corrupt=keep). Blank lines are none. Any folder that pyarrow's file systems reach will do.

The stream's offset is the last segment and the bytes of it that end in a line; segments before it are whole. An unfinished last line waits for its end.

spark.dataSource.register(EventLog), then spark.read.format("eventlog").option("path", folder).option("from", 1000).load(): (seq, payload, segment, at).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RANGE = 32 << 20
SCHEMA = "seq long, payload string, segment string, at long"
BATCH = 10_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def segments(path: str) -> list[tuple[str, int, int]]:
    """(file, first number, bytes) of a log's segments in order."""
    system, folder = opened(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f.base_name, int(f.base_name[4:-6]), f.size) for f in found if f.base_name.startswith("log-") and f.base_name.endswith(".jsonl"))


@dataclass
class Piece(InputPartition):
    """Lines of a segment that begin in [first, end)."""

    segment: str
    first: int
    end: int


def lines(path: str, piece: Piece) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in a piece."""
    system, folder = opened(path)
    with system.open_input_file(f"{folder}/{piece.segment}") as f:
        at = max(piece.first - 1, 0)
        f.seek(at)
        held = b""
        skip = piece.first > 0  # the line that the byte before belongs to began earlier (it may end with that byte)
        while True:
            block = f.read(1 << 20)
            if not block:
                break
            held += block
            *whole, rest = held.split(b"\n")
            for line in whole:
                if not skip:
                    if at >= piece.end:
                        return
                    yield at, line
                skip = False
                at += len(line) + 1
            held = rest
            if at >= piece.end and not skip:
                return
        if held and not skip and at < piece.end:
            yield at, held


def numbered(line: bytes) -> int | None:
    """The line's sequence number; None if it is corrupt."""
    try:
        seq = json.loads(line)["sequence"]
    except (ValueError, KeyError, TypeError):
        return None
    return seq if type(seq) is int else None


def records(path: str, piece: Piece, first: int, corrupt: str) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["seq", "payload", "segment", "at"])
        rows.clear()
        return out

    for at, line in lines(path, piece):
        if not line.strip():
            continue
        seq = numbered(line)
        if seq is None and corrupt == "fail":
            raise ValueError(f"corrupt line at byte {at} of {piece.segment}")
        if seq is None or seq >= first:
            rows.append((seq, line.decode("utf-8", "replace"), piece.segment, at))
        if len(rows) >= BATCH:
            yield batch()
    if rows:
        yield batch()


class _Options:
    def __init__(self, options: dict) -> None:
        self.path, self.first, self.corrupt, self.range = options["path"], int(options.get("from", 0)), options.get("corrupt", "fail"), int(options.get("range", RANGE))

    def pieces(self, segment: str, first: int, end: int) -> list[Piece]:
        return [Piece(segment, s, min(s + self.range, end)) for s in range(first, end, self.range)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        yield from records(self.path, partition, self.first, self.corrupt)


class LogReader(_Options, DataSourceReader):
    def partitions(self) -> list[Piece]:
        found = segments(self.path)
        kept = [s for s, after in zip(found, [*found[1:], None], strict=False) if after is None or after[1] > self.first]
        return [p for name, _, size in kept for p in self.pieces(name, 0, size)] or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.segment:
            yield from super().read(partition)


class LogStream(_Options, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        found = [s for s in segments(self.path) if s[1] <= self.first]
        return {"segment": found[-1][0] if found else "", "bytes": 0}

    def latestOffset(self) -> dict:
        found = segments(self.path)
        if not found:
            return self.initialOffset()
        name, _, size = found[-1]
        system, folder = opened(self.path)
        with system.open_input_file(f"{folder}/{name}") as f:
            end = size
            while end > 0:  # back to the last line's end
                begin = max(0, end - (1 << 16))
                f.seek(begin)
                cut = f.read(end - begin).rfind(b"\n")
                if cut >= 0:
                    return {"segment": name, "bytes": begin + cut + 1}
                end = begin
        return {"segment": name, "bytes": 0}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for name, _, size in segments(self.path):
            if start["segment"] <= name <= end["segment"]:
                out += self.pieces(name, start["bytes"] if name == start["segment"] else 0, end["bytes"] if name == end["segment"] else size)
        return out or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.segment:
            yield from super().read(partition)

    def commit(self, end: dict) -> None:
        pass


class EventLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "eventlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options)


def write(rows: DataFrame, path: str, width: int = 1_000_000) -> None:
    """rows(seq, payload: a JSON object that holds "sequence") as segments of so many numbers. A segment appears whole, under its name, also if its task runs twice."""
    opened(path)[0].create_dir(opened(path)[1], recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = opened(path)
        segment, out, name, n = None, None, "", 0

        def done() -> pa.RecordBatch:
            out.close()
            system.move(name, f"{folder}/log-{segment:016d}.jsonl")
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([n], pa.int64())], ["segment", "n"])

        for b in batches:
            for s, line in zip(b.column("segment").to_pylist(), b.column("payload").to_pylist(), strict=True):
                if s != segment:
                    if out is not None:
                        yield done()
                    segment, name, n = s, f"{folder}/.writing-{uuid.uuid4().hex}", 0
                    out = system.open_output_stream(name)
                out.write(line.encode() + b"\n")
                n += 1
        if out is not None:
            yield done()

    placed = rows.select((F.expr(f"seq div {width}") * width).alias("segment"), "seq", "payload").repartition("segment").sortWithinPartitions("segment", "seq").select("segment", "payload")
    placed.mapInArrow(put, "segment long, n long").agg(F.sum("n")).collect()


def scan(spark: SparkSession, path: str, first: int = 0, corrupt: str = "fail", size: int = RANGE) -> DataFrame:
    """A log from a number on, as a table."""
    spark.dataSource.register(EventLog)
    return spark.read.format("eventlog").option("path", path).option("from", first).option("corrupt", corrupt).option("range", size).load()


def stream(spark: SparkSession, path: str, first: int = 0, corrupt: str = "fail", size: int = RANGE) -> DataFrame:
    """A log from a number on, as a stream."""
    spark.dataSource.register(EventLog)
    return spark.readStream.format("eventlog").option("path", path).option("from", first).option("corrupt", corrupt).option("range", size).load()
