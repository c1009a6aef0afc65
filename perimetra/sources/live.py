"""Files of JSON lines that grow while they are read, as a batch and as a streaming source.

An offset holds, for each file, the bytes up to its last whole line, so a torn tail waits for its line feed, a restart
reads on from the byte where it stopped, and a batch that is run again reads the same lines. A row's gap_s comes from the
line before it in the file, which a task reads again where its range begins, so it does not depend on how lines are dealt
to batches or tasks. Files must only grow; one that shrank, or went, before it was read to its end is an error, as rows
would be lost in silence. The folder must be mounted on all hosts.
"""

from __future__ import annotations

import fnmatch
import json
import os
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "growing_lines"
SCHEMA = "file string, seq long, t double, gap_s double, line string"
_STEP = 1 << 16


@dataclass
class Span(InputPartition):
    """The lines of a file that begin in [begin, end); `begin` is the start of a line only if `whole`."""

    path: str
    begin: int
    end: int
    whole: bool


def whole_lines(path: str) -> int:
    """Bytes of the file up to its last line feed."""
    with open(path, "rb") as file:
        at = file.seek(0, os.SEEK_END)
        while at > 0:
            low = max(0, at - _STEP)
            file.seek(low)
            found = file.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return 0


def time_of(line: bytes) -> float | None:
    """The number `t` of a line's object, if it has one."""
    try:
        found = json.loads(line)
    except ValueError:
        return None
    t = found.get("t") if isinstance(found, dict) else None
    return float(t) if isinstance(t, (int, float)) and not isinstance(t, bool) else None


def _time_before(path: str, begin: int) -> float | None:
    """The time of the last line before `begin` (the start of a line) that has one."""
    with open(path, "rb") as file:
        tail, at = b"", begin
        while at > 0:
            low = max(0, at - _STEP)
            file.seek(low)
            lines = (file.read(at - low) + tail).split(b"\n")
            for line in reversed(lines[1:] if low else lines):
                if line and (t := time_of(line)) is not None:
                    return t
            tail, at = lines[0], low
    return None


def read_span(span: Span, least: float) -> Iterator[tuple]:
    """Rows of a span: file's stem, place of the line, t, seconds since the line before if `least` or more, the line."""
    stem = os.path.splitext(os.path.basename(span.path))[0]
    with open(span.path, "rb") as file:
        at = span.begin
        if not span.whole:
            file.seek(at - 1)
            at += len(file.readline()) - 1
        file.seek(at)
        before = _time_before(span.path, at) if 0 < at < span.end else None
        while at < span.end:
            line = file.readline()
            if not line:
                raise EOFError(f"{span.path} ends at {at}, before {span.end}")
            if line.strip():
                t = time_of(line)
                gap = t - before if t is not None and before is not None else 0.0
                yield stem, at, t, gap if gap >= least else None, line.rstrip(b"\r\n").decode("utf-8", "replace")
                before = t if t is not None else before
            at += len(line)


class _Folder:
    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("growing_lines needs a path")
        self.path, self.pattern = options["path"].removeprefix("file://"), options.get("pattern", "*.jsonl")
        self.least, self.split = float(options.get("gap", 2.0)), int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))
        self.tries, self.first, self.most = int(options.get("tries", 6)), float(options.get("backoff", 0.5)), float(options.get("backoffmost", options.get("backoffMost", 30.0)))

    def offsets(self) -> dict[str, int]:
        """Bytes of whole lines of each file. A folder that is away is looked for again after waits that double."""
        for attempt in range(self.tries):
            try:
                names = sorted(n for n in os.listdir(self.path) if fnmatch.fnmatch(n, self.pattern))
                return {n: whole_lines(os.path.join(self.path, n)) for n in names}
            except OSError:
                if attempt + 1 == self.tries:
                    raise
                time.sleep(min(self.most, self.first * 2**attempt))
        return {}

    def spans(self, start: dict[str, int], end: dict[str, int]) -> Sequence[Span]:
        out = []
        for name, last in end.items():
            path, first = os.path.join(self.path, name), start.get(name, 0)
            if last < first or first < last and (not os.path.exists(path) or os.path.getsize(path) < last):
                raise ValueError(f"{path} has shrunk: {last} bytes were seen, {first} read")
            out += [Span(path, low, min(low + self.split, last), low == first) for low in range(first, last, self.split)]
        gone = [n for n in start if n not in end]
        if gone:
            raise ValueError(f"files are gone: {gone[:3]}")
        return out


class _Batch(DataSourceReader):
    def __init__(self, folder: _Folder) -> None:
        self.folder = folder

    def partitions(self) -> Sequence[InputPartition]:
        return self.folder.spans({}, self.folder.offsets())

    def read(self, partition: Span) -> Iterator[tuple]:
        return read_span(partition, self.folder.least) if isinstance(partition, Span) else iter([])


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: _Folder) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.folder.offsets()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.folder.spans(start, end)

    def read(self, partition: Span) -> Iterator[tuple]:
        return read_span(partition, self.folder.least)


class GrowingLines(DataSource):
    """format("growing_lines"): options path, pattern (*.jsonl), gap (least seconds that count as one), splitBytes, tries, backoff, backoffMost."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Batch(_Folder(dict(self.options)))

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Stream(_Folder(dict(self.options)))


def register(spark: SparkSession) -> None:
    """Make format("growing_lines") known to the session."""
    spark.dataSource.register(GrowingLines)
