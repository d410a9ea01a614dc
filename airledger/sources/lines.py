"""Lines of log files as a data source that splits files by bytes, for batches and streams.

A large log is many tasks' work, and its lines keep their order: (file, offset), where offset is the
byte at which a line starts. Files are listed and read through pyarrow, so they may lie in any store
that it knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a file that one task reads, and of one read.
SPLIT_BYTES, READ_BYTES = 64 << 20, 1 << 20
#: Bytes read on at the end of a split for the rest of its last line, and lines of a batch.
TAIL_BYTES, BATCH_LINES = 1 << 10, 8192
#: Tasks that small splits are dealt to, before these get more than SPLIT_BYTES each.
TASKS = 512
SHAPE = "file string, offset long, line string"


class Split:
    """Bytes [begin, end) of a file. Lines that start in it belong to it; with `whole`, only those that
    end in a line feed count, as a writer may not be done with the last one."""

    def __init__(self, path: str, begin: int, end: int, whole: bool = False):
        self.path, self.begin, self.end, self.whole = path, begin, end, whole


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(path: str, pattern: str) -> dict[str, int]:
    """Sizes of the files of a folder (or of the file) that match the pattern, by name."""
    store, place = _open(path)
    info = store.get_file_info(place)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place))
    prefix = path.removesuffix(place) if path.endswith(place) else ""
    return {prefix + f.path: f.size for f in sorted(found, key=lambda f: f.base_name) if f.type == fs.FileType.File and (f is info or fnmatch.fnmatch(f.base_name, pattern))}


class Splits(InputPartition):
    """Splits that one task reads, one after the other."""

    def __init__(self, parts: list[tuple[str, int, int]], whole: bool = False):
        self.parts, self.whole = parts, whole


def _dealt(parts: list[tuple[str, int, int]], whole: bool = False) -> list[Splits]:
    """A task for each split, or for several splits in a row if there were more than TASKS, up to SPLIT_BYTES
    of them: small splits of a large log do not become more tasks than a driver can start."""
    size = sum(end - begin for _, begin, end in parts)
    tasks = max(TASKS, -(-size // SPLIT_BYTES))
    each = max(1, -(-len(parts) // tasks))
    return [Splits(parts[k : k + each], whole) for k in range(0, len(parts), each)]


def _rows(splits: Splits) -> Iterator[pa.RecordBatch]:
    """Batches of (file, offset, line) of the lines that start in the splits, without their ends."""
    names: list[str] = []
    offsets: list[int] = []
    lines: list[str] = []
    for path, parts in groupby(splits.parts, lambda part: part[0]):
        store, place = _open(path)
        name = place.rsplit("/", 1)[-1]
        with store.open_input_file(place) as file:
            size = file.size()
            for _, begin, end in parts:
                for offset, line in _lines_of(file, size, Split(path, begin, end, splits.whole)):
                    names.append(name)
                    offsets.append(offset)
                    lines.append(line)
                    if len(lines) == BATCH_LINES:
                        yield _batch(names, offsets, lines)
                        names, offsets, lines = [], [], []
    if lines:
        yield _batch(names, offsets, lines)


def _batch(names: list[str], offsets: list[int], lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(offsets, pa.int64()), pa.array(lines)], names=["file", "offset", "line"])


def _lines_of(file: pa.NativeFile, size: int, split: Split) -> Iterator[tuple[int, str]]:
    """(offset, line) of the lines that start in a split. No more is read than the split and what is
    missing of its last line."""
    start = max(0, split.begin - 1)  # a line starts where the byte before is a line feed
    file.seek(start)
    held, skip, at, ahead = [], split.begin > 0, start, TAIL_BYTES
    while True:
        block = file.read(min(READ_BYTES, max(split.end - at, ahead)))
        ahead = ahead * 2 if at >= split.end else ahead
        at += len(block)
        held.append(block)
        last = not block
        if not last and b"\n" not in block:
            if skip and at >= split.end:
                return  # the line of an earlier split goes on beyond this one
            continue
        ended = b"".join(held).split(b"\n")
        held = [ended.pop()]
        if last and held[0] and not split.whole:
            ended.append(held[0])
        for line in ended:
            if skip:
                skip = False
            elif start < split.end:
                yield start, line.removesuffix(b"\r").decode("utf-8", "replace")
            start += len(line) + 1
            if start >= split.end:
                break
        if last or start >= min(split.end, size):
            return


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern, self.split = options["path"], options.get("pattern", "*"), int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Split]:
        files = _listed(self.path, self.pattern)
        return _dealt([(f, i, min(i + self.split, size)) for f, size in files.items() for i in range(0, size, self.split)])

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        yield from _rows(partition)


class LogStreamReader(DataSourceStreamReader):
    """The offset of the stream is how many bytes of each file are read. It only moves to ends of lines."""

    def __init__(self, options: dict):
        self.path, self.pattern, self.split = options["path"], options.get("pattern", "*"), int(options.get("splitbytes", SPLIT_BYTES))

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps({f: self._whole(f, size) for f, size in _listed(self.path, self.pattern).items()}, sort_keys=True)}

    @staticmethod
    def _whole(path: str, size: int) -> int:
        """The end of the last whole line among the first `size` bytes."""
        store, place = _open(path)
        with store.open_input_file(place) as file:
            end = size
            while end > 0:
                begin = max(0, end - READ_BYTES)
                file.seek(begin)
                at = file.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Split]:
        had, have = json.loads(start["files"]), json.loads(end["files"])
        return _dealt([(f, i, min(i + self.split, size)) for f, size in have.items() for i in range(had.get(f, 0), size, self.split)], True)

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        yield from _rows(partition)

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """Format log_lines: options path (a folder or a file), pattern of names, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)
