"""Files of lines that grow, as a data source: a batch reads what is there, a stream goes on where it stopped.

`spark.read.format("growing_lines")` and `spark.readStream.format("growing_lines")` after `register(spark)`. A stream's
offset is how many bytes of each file are read, and never lies within a line: an unfinished last line waits. A file that
is shorter than what was read of it was rewritten and is read again from its start. Files are those under `path` whose
names end in `suffix` (.jsonl) and do not begin with `._`, in any store that Arrow opens.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a file that one task reads, and that are searched at once for the end of a line.
SPLIT, STEP = 32 << 20, 1 << 16
ROWS = 4096


@dataclass
class Span(InputPartition):
    """Bytes of a file: the lines that begin in [start, end). `first` is where the file's new part begins."""

    path: str
    start: int
    end: int
    first: int
    rewritten: bool


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def listed(folder: str, suffix: str) -> dict[str, int]:
    """The size of each file."""
    fs, at = _open(folder)
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        return {}
    found = [fs.get_file_info(at)] if fs.get_file_info(at).is_file else fs.get_file_info(pafs.FileSelector(at, recursive=True))
    scheme = folder.partition("://")[0] + "://" if "://" in folder else ""
    return {scheme + f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(suffix) and not f.base_name.startswith("._")}


def whole_lines(path: str, size: int) -> int:
    """The bytes up to the end of the last line that is complete."""
    fs, at = _open(path)
    with fs.open_input_file(at) as f:
        end = size
        while end > 0:
            start = max(0, end - STEP)
            cut = f.read_at(end - start, start).rfind(b"\n")
            if cut >= 0:
                return start + cut + 1
            end = start
    return 0


def spans(start: dict[str, int], end: dict[str, int]) -> list[Span]:
    """What lies between two offsets, in parts."""
    out = []
    for path, to in sorted(end.items()):
        since = start.get(path, 0)
        rewritten = to < since
        since = 0 if rewritten else since
        out += [Span(path, a, min(a + SPLIT, to), since, rewritten) for a in range(since, to, SPLIT)]
    return out


def lines_of(span: Span) -> Iterator[pa.RecordBatch]:
    """path, offset, line, rewritten (on a rewritten file's first line) of the lines that begin in a span; bytes that are no UTF-8 are replaced."""
    fs, at = _open(span.path)
    with io.BufferedReader(fs.open_input_file(at), 1 << 20) as f:
        f.seek(max(span.first, span.start - 1))
        place = f.tell()
        if span.start > span.first:
            place += len(f.readline())
        offsets, lines = [], []
        while place < span.end:
            raw = f.readline()
            if not raw:
                break  # the file was cut meanwhile; the next offset tells
            offsets.append(place)
            lines.append(raw.rstrip(b"\n").decode("utf-8", "replace"))
            place += len(raw)
            if len(lines) == ROWS or place >= span.end:
                first = [span.rewritten and o == 0 for o in offsets]
                yield pa.record_batch([pa.array([span.path] * len(lines)), pa.array(offsets, pa.int64()), pa.array(lines), pa.array(first)], names=["path", "offset", "line", "rewritten"])
                offsets, lines = [], []
        if lines:
            yield pa.record_batch([pa.array([span.path] * len(lines)), pa.array(offsets, pa.int64()), pa.array(lines), pa.array([False] * len(lines))], names=["path", "offset", "line", "rewritten"])


class Reader(DataSourceReader):
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def partitions(self) -> list[Span]:
        return spans({}, listed(self.folder, self.suffix))

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        return lines_of(partition) if partition else iter(())  # none: there are no files


class StreamReader(DataSourceStreamReader):
    """Offsets are JSON objects of bytes by file; files of unchanged size are not opened."""

    def __init__(self, folder: str, suffix: str, from_start: bool):
        self.folder, self.suffix, self.from_start, self.known = folder, suffix, from_start, {}

    def initialOffset(self) -> dict:
        return {"files": json.dumps({} if self.from_start else self._now())}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(self._now())}

    def _now(self) -> dict[str, int]:
        sizes = listed(self.folder, self.suffix)
        self.known = {p: self.known[p] if p in self.known and self.known[p][0] == s else (s, whole_lines(p, s)) for p, s in sizes.items()}
        return {p: end for p, (_, end) in self.known.items()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return spans(json.loads(start["files"]), json.loads(end["files"]))

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return lines_of(partition)

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "path string, offset bigint, line string, rewritten boolean"

    def _options(self) -> tuple[str, str]:
        if "path" not in self.options:
            raise ValueError("growing_lines needs a path")
        return self.options["path"], self.options.get("suffix", ".jsonl")

    def reader(self, schema) -> Reader:
        return Reader(*self._options())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(*self._options(), self.options.get("from_start", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLines)
