"""Line files that grow: transcripts that speech recognition appends to while a lecture runs.

Spark's own file stream takes a file once, when it appears. This data source also reads what is appended: its offsets are the
bytes read of each file, up to the last whole line. Batch and stream plan the same way: each file's new bytes are cut into
ranges, and a line belongs to the range that its first byte lies in, so a file of any size is read by many tasks.
Files are opened through Arrow's file systems (local and mounted folders, object stores); all tasks must see the folder.

    spark.dataSource.register(GrowingLines)
    spark.readStream.format("growing_lines").load(folder)     # path string, start long, line string
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a range, and of what is read at once.
RANGE = 64_000_000
_CHUNK = 1_000_000
_SCHEMA = "path string, start long, line string"


@dataclass
class ByteRange(InputPartition):
    path: str
    begin: int
    end: int
    size: int


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:/") else (fs.LocalFileSystem(), folder)


def whole_lines(folder: str, known: dict[str, int]) -> dict[str, int]:
    """Bytes of each file up to its last line end; only what is new since `known` is looked at, from its end."""
    from pyarrow import fs

    files, root = _opened(folder)
    info = files.get_file_info(root)
    found = files.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
    out = {}
    for f in found:
        if f.type != fs.FileType.File or f.base_name.startswith(("_", ".")):
            continue
        at, least = f.size, known.get(f.path, 0)
        with files.open_input_file(f.path) as source:
            while at > least:
                begin = max(least, at - _CHUNK)
                source.seek(begin)
                cut = source.read(at - begin).rfind(b"\n")
                if cut >= 0:
                    at = begin + cut + 1
                    break
                at = begin
        out[f.path] = max(at, least)
    return out


def ranges(before: dict[str, int], after: dict[str, int], size: int) -> list[ByteRange]:
    return [ByteRange(path, a, min(a + size, end), end) for path, end in sorted(after.items()) for a in range(before.get(path, 0), end, size)]


def lines_of(folder: str, part: ByteRange) -> Iterator[pa.RecordBatch]:
    """Lines whose first byte lies in the range; the last one may end behind it."""
    files, _ = _opened(folder)
    with files.open_input_file(part.path) as source:
        at = part.begin
        if at:
            source.seek(at - 1)
            skipped = b""
            while b"\n" not in skipped and at - 1 < part.size:  # the rest of a line that began before
                skipped = source.read(min(_CHUNK, part.size - at + 1))
                cut = skipped.find(b"\n")
                at += (cut if cut >= 0 else len(skipped))
        rest = b""
        begin = at  # of `rest`
        source.seek(at)
        while begin < part.end:
            chunk = source.read(min(_CHUNK, part.size - begin - len(rest)))
            rest += chunk
            starts, texts, used = [], [], 0
            while begin + used < part.end and (cut := rest.find(b"\n", used)) >= 0:
                starts.append(begin + used)
                texts.append(rest[used:cut].removesuffix(b"\r").decode("utf-8", "replace"))
                used = cut + 1
            if starts:
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(starts)), pa.array(starts, pa.int64()), pa.array(texts)], names=["path", "start", "line"])
            begin, rest = begin + used, rest[used:]
            if not chunk and not used:
                break


class _Batch(DataSourceReader):
    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def partitions(self):
        return ranges({}, whole_lines(self.folder, {}), self.size)

    def read(self, partition):
        return lines_of(self.folder, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        self.seen = whole_lines(self.folder, self.seen)
        return {"files": json.dumps(self.seen, sort_keys=True)}

    def partitions(self, start: dict, end: dict):
        return ranges(json.loads(start["files"]), json.loads(end["files"]), self.size)

    def read(self, partition):
        return lines_of(self.folder, partition)


class GrowingLines(DataSource):
    """Options: path, and range_bytes. Lines without an end are not read yet; in a batch, too."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return _SCHEMA

    def _options(self):
        return self.options["path"], int(self.options.get("range_bytes", RANGE))

    def reader(self, schema):
        return _Batch(*self._options())

    def streamReader(self, schema):
        return _Stream(*self._options())
