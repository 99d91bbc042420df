"""Sources in Python: growing log files, each read on from where it was left, and metrics that a plugin gathers.

    spark.dataSource.register(LogTail)
    spark.readStream.format("log_tail").option("path", "/logs/*.log").option("start", "end").load()

Files are reached through any file system that Arrow knows. The driver lists them and finds the last line end of those that have grown;
tasks read ranges of bytes. Where each file was left is the stream's offset, which the query's checkpoint keeps.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from logspark.model import LINE, METRIC

#: Bytes of a range, of what is read at once, and of what is read first to end a line that goes on after its range.
RANGE_BYTES, READ_BYTES, AHEAD_BYTES = 64 << 20, 1 << 20, 1 << 12
#: A task takes small ranges and files until it has so many bytes; a part of a file counts as so many more.
TASK_BYTES, OPEN_BYTES = 4 << 20, 1 << 15
_LINES = pa.schema([("log_path", pa.string()), ("line_seq", pa.int64()), ("byte_offset", pa.int64()), ("raw", pa.string()), ("raw_len", pa.int32())])


def open_at(uri: str) -> tuple[fs.FileSystem, str, str]:
    """The file system, the path in it, and what goes before such paths in URIs."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    system, path = fs.FileSystem.from_uri(uri)
    return system, path, uri[: len(uri) - len(path)] if uri.endswith(path) else uri.split("://")[0] + "://"


def list_files(uri: str, exclude: list[str] = ()) -> dict[str, int]:
    """Size by URI of the files that a path or glob names; those of folders too. Names that begin with . or _ are passed over."""
    special = next((i for i, c in enumerate(uri) if c in "*?["), None)
    base = uri if special is None else uri[:special].rpartition("/")[0]
    system, top, before = open_at(base)
    info = system.get_file_info(top)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
    pattern = None if special is None else top.rstrip("/") + uri[len(base) :]
    out = {}
    for f in found:
        hidden = any(p[:1] in "._" for p in f.path[len(top) :].split("/") if p)
        if f.type != fs.FileType.File or hidden or any(fnmatch.fnmatchcase(f.path, e) for e in exclude):
            continue
        # a folder that the glob matches stands for all in it
        if pattern is None or fnmatch.fnmatchcase(f.path, pattern) or fnmatch.fnmatchcase(f.path, pattern.rstrip("/") + "/*"):
            out[before + f.path] = f.size
    return out


def last_line_end(uri: str, size: int, at_least: int = 0) -> int:
    """The place after the last line end of a file, at_least if it has none after that."""
    system, path, _ = open_at(uri)
    with system.open_input_file(path) as f:
        end = size
        while end > at_least:
            start = max(at_least, end - READ_BYTES)
            cut = f.read_at(end - start, start).rfind(b"\n")
            if cut >= 0:
                return start + cut + 1
            end = start
    return at_least


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    #: Whether what follows the last line end is a line, too.
    whole: bool = True


def ranges(path: str, start: int, end: int, size: int, whole: bool) -> list[Range]:
    return [Range(path, s, min(end, s + size), whole) for s in range(start, end, size)]


@dataclass
class Task(InputPartition):
    """Parts of files that a task reads in turn, in ranges of `size` bytes."""

    parts: list[Range]
    size: int


def tasks(parts: list[Range], size: int) -> list[Task]:
    """The parts dealt to tasks in whole ranges: small ones are put together, so that tasks are as many as the bytes need."""
    out, room = [], 0
    for p in parts:
        at = p.start
        while at < p.end:
            if room <= 0:
                out.append(Task([], size))
                room = max(size, TASK_BYTES)
            end = min(p.end, at + max(1, room // size) * size)
            out[-1].parts.append(Range(p.path, at, end, p.whole))
            room -= end - at + OPEN_BYTES
            at = end
    return out


def read_task(task: Task) -> Iterator[pa.RecordBatch]:
    for p in task.parts:
        system, path, _ = open_at(p.path)
        with system.open_input_file(path) as f:
            for r in ranges(p.path, p.start, p.end, task.size, p.whole):
                yield from _lines(f, r)


def read_range(r: Range) -> Iterator[pa.RecordBatch]:
    """The lines that begin in a range. line_seq and byte_offset are the place of a line's first byte; a carriage return stays, what isn't UTF-8 becomes U+FFFD."""
    system, path, _ = open_at(r.path)
    with system.open_input_file(path) as f:
        yield from _lines(f, r)


def _lines(f: pa.NativeFile, r: Range) -> Iterator[pa.RecordBatch]:
    at, held, ahead = r.start, b"", AHEAD_BYTES
    if r.start:
        # the line that begins before the range is the one before's, unless it ends just there
        at -= 1
        skipping = True
    else:
        skipping = False
    read = at
    while True:
        # no more than the range, then by twice as much until its last line ends
        if read < r.end:
            block = f.read_at(min(READ_BYTES, r.end - read), read)
        else:
            block, ahead = f.read_at(min(READ_BYTES, ahead), read), 2 * ahead
        read += len(block)
        held += block
        if skipping:
            cut = held.find(b"\n")
            if cut < 0 and block and read < r.end:
                at, held = at + len(held), b""
                continue
            # a line that goes on through the whole range is that of another
            if cut < 0:
                return
            at, held, skipping = at + cut + 1, held[cut + 1 :], False
        cut = held.rfind(b"\n") + 1
        if not block and r.whole and held:
            cut = len(held)
        lines = held[:cut].split(b"\n")
        if cut and held[cut - 1 : cut] == b"\n":
            lines.pop()
        if cut:
            sizes = np.array([len(x) + 1 for x in lines], np.int64)
            places = at + np.cumsum(sizes) - sizes
            n = int(np.searchsorted(places, r.end))
            text = [x.decode("utf-8", "replace") for x in lines[:n]]
            yield pa.RecordBatch.from_arrays([pa.array([r.path] * n, pa.string()), pa.array(places[:n]), pa.array(places[:n]), pa.array(text, pa.string()), pa.array(sizes[:n], pa.int32())], schema=_LINES)
            at, held = at + cut, held[cut:]
            if at >= r.end:
                return
        if not block or (at >= r.end):
            return


class _Files:
    def __init__(self, options: dict[str, str]):
        if options.get("start", "beginning") not in ("beginning", "end"):
            raise ValueError("start is beginning or end")
        self.path, self.exclude = options["path"], [x for x in options.get("exclude", "").split(",") if x]
        self.size, self.from_end = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES))), options.get("start") == "end"

    def files(self) -> dict[str, int]:
        return list_files(self.path, self.exclude)


class _BatchReader(_Files, DataSourceReader):
    def partitions(self) -> list[Task]:
        return tasks([Range(p, 0, n) for p, n in sorted(self.files().items())], self.size) or [Task([], self.size)]

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        return read_task(partition)


class _StreamReader(_Files, DataSourceStreamReader):
    """Offsets are the places up to which files were read. A file that isn't among them is new, and read from its beginning."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.known: dict[str, tuple[int, int]] = {}

    def _ends(self) -> dict[str, int]:
        out = {}
        for p, size in self.files().items():
            before, end = self.known.get(p, (-1, 0))
            if size != before:
                # of a file that has shrunk everything is new
                end = last_line_end(p, size, end if size > before else 0)
                self.known[p] = size, end
            out[p] = end
        return out

    def initialOffset(self) -> dict:
        return self._ends() if self.from_end else {}

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict) -> list[Task]:
        begins = {p: start.get(p, 0) for p in end}
        return tasks([Range(p, begins[p] if begins[p] <= n else 0, n, False) for p, n in sorted(end.items())], self.size)

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        return read_task(partition)


class LogTail(DataSource):
    """Lines of the files that `path` (a file, a folder or a glob) names: see model.LINE.

    Options: path; exclude, globs of paths, by commas; rangeBytes, read at a time (a task takes as many small ranges as make 4 MB); start, of a stream that has no checkpoint: `beginning`, or `end`, which passes over what
    files hold then. A stream takes lines when they are ended; files that appear later are read from their beginning, a file that has shrunk is read anew. As a batch also a last line without an end is a line.
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return LINE

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


@dataclass
class Instance(InputPartition):
    value: str


class _Gatherer(DataSourceReader):
    def __init__(self, plugin: Monitor):
        self.plugin = plugin

    def partitions(self) -> list[Instance]:
        return [Instance(x) for x in self.plugin.instances()]

    def read(self, partition: Instance) -> Iterator[tuple]:
        monitor = self.plugin.name()
        try:
            samples = list(self.plugin.gather(partition.value))
        except Exception as e:  # a plugin that fails says so in a row, and the others go on
            samples = [(f"{monitor}.error", f"{type(e).__name__}: {e}", None, None)]
        for metric, value, extra, ts_ms in samples:
            number = float(value) if isinstance(value, (int, float)) else None
            yield monitor, partition.value, metric, number, None if number is not None else str(value), extra, ts_ms, None


class Monitor(DataSource):
    """A plugin: subclasses name themselves, say which instances there are, and gather (metric, value, extra, ts_ms) of one in a task. Rows are model.METRIC without ts.

    spark.dataSource.register(MyMonitor); spark.read.format("my_monitor").option("hosts", "a,b").load()
    """

    def schema(self) -> str:
        return METRIC

    def instances(self) -> list[str]:
        return [""]

    def gather(self, instance: str) -> Iterator[tuple[str, object, dict[str, str] | None, int | None]]:
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return _Gatherer(self)
