"""Lines of text files as a Spark data source of its own: byte ranges, positions, counts, and a stream of what is appended.

``spark.read.format("riskweave_lines")`` cuts files into ranges of ``splitBytes``; a line belongs to the range that its
first byte lies in. A row is (split, row, file, at, value): the number of the range among all, the line's number in
it, and the byte where it begins. With the option ``counts`` a row is (split, n_lines) instead, so that Spark can
number lines by a running sum over ranges; ``first`` leaves out the ranges before it, unread. The same format as a
stream keeps for each file how far it was read, so a file may grow; only whole lines are taken.

Lines end as Python's do: at a line feed, a carriage return or both. Files are opened through pyarrow's file systems.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "riskweave_lines"
LINES, COUNTS = "split long, row long, file string, at long, value string", "split long, n_lines long"
SPLIT_BYTES, BLOCK = 128 << 20, 1 << 20


@dataclass
class Range(InputPartition):
    """Bytes of a file, as the source numbers them."""

    split: int
    file: str
    start: int
    end: int


def filesystem(path: str):
    """(file system, path in it) of a path or URI; raises ``pa.ArrowInvalid`` for schemes that pyarrow does not know."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the file, or of the files of a folder in the order of their names; hidden ones left out."""
    from pyarrow import fs

    system, inner = filesystem(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(inner))
    base = path.rstrip("/")
    return sorted((f"{base}/{f.base_name}", f.size) for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._")


def ranges(path: str, size: int) -> list[Range]:
    cut = [(name, at, min(at + size, whole)) for name, whole in files(path) for at in range(0, whole, size)]
    return [Range(k, *r) for k, r in enumerate(cut)]


def raw_lines(part: Range) -> Iterator[tuple[int, bytes]]:
    """(first byte, bytes without the line feed) of the lines that begin in a range, read block by block."""
    system, inner = filesystem(part.file)
    with system.open_input_file(inner) as f:
        at = part.start
        if at:  # the range's first line begins behind the first line feed from the byte before it on
            at -= 1
            f.seek(at)
            while block := f.read(BLOCK):
                k = block.find(b"\n")
                if k >= 0:
                    at += k + 1
                    break
                at += len(block)
            f.seek(at)
        rest = [] if at < part.end else None
        while rest is not None and (block := f.read(BLOCK)):
            pieces = block.split(b"\n")
            rest.append(pieces[0])
            for more in pieces[1:]:
                line = b"".join(rest)
                yield at, line
                at += len(line) + 1
                rest = [more]
                if at >= part.end:
                    return
        if rest and at < part.end and (line := b"".join(rest)):
            yield at, line


def whole_lines(part: Range) -> Iterator[tuple[int, str]]:
    """(first byte, text) of the lines of a range, a carriage return ending a line as well."""
    for at, raw in raw_lines(part):
        for piece in raw.removesuffix(b"\r").split(b"\r"):
            yield at, piece.decode("utf-8", "replace")
            at += len(piece) + 1


def batches(part: Range) -> Iterator[pa.RecordBatch]:
    rows, size, n = [], 0, 0

    def made() -> pa.RecordBatch:
        at, text = zip(*rows, strict=True)
        k = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([part.split] * k, pa.int64()), pa.array(range(n, n + k), pa.int64()), pa.array([part.file] * k), pa.array(at, pa.int64()), pa.array(text)], names=["split", "row", "file", "at", "value"])

    for row in whole_lines(part):
        rows.append(row)
        size += len(row[1])
        if len(rows) >= 1000 or size > 4 * BLOCK:
            yield made()
            n, rows, size = n + len(rows), [], 0
    if rows:
        yield made()


class LinesReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.counts = options["path"], str(options.get("counts", "false")).lower() == "true"
        self.size, self.first = int(options.get("splitBytes", SPLIT_BYTES)), int(options.get("first", 0))

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.size)[self.first :] or [Range(-1, "", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.split < 0:
            return
        if self.counts:
            n = sum(1 for _ in whole_lines(part))
            yield pa.RecordBatch.from_arrays([pa.array([part.split], pa.int64()), pa.array([n], pa.int64())], names=["split", "n_lines"])
        else:
            yield from batches(part)


class LinesStream(DataSourceStreamReader):
    """Offsets are {file: bytes that were read}; a file that grows goes on where it ended."""

    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {name: end for name, size in files(self.path) if (end := self._whole(name, size))}

    @staticmethod
    def _whole(name: str, size: int) -> int:
        """Where the last whole line ends."""
        system, inner = filesystem(name)
        with system.open_input_file(inner) as f:
            while size:
                start = max(0, size - BLOCK)
                f.seek(start)
                k = f.read(size - start).rfind(b"\n")
                if k >= 0:
                    return start + k + 1
                size = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        cut = [(name, at, min(at + self.size, upto)) for name, upto in sorted(end.items()) for at in range(start.get(name, 0), upto, self.size)]
        return [Range(k, *r) for k, r in enumerate(cut)] or [Range(-1, "", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.split >= 0:
            yield from batches(part)

    def commit(self, end: dict) -> None:
        pass


class Lines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COUNTS if str(self.options.get("counts", "false")).lower() == "true" else LINES

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options)

    def streamReader(self, schema) -> LinesStream:
        return LinesStream(self.options)


def register(spark) -> None:
    """Makes the format known to the session."""
    from riskweave.session import ship

    ship(spark)
    spark.dataSource.register(Lines)
