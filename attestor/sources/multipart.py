"""Multipart bodies as files: a data source that Spark reads in batch or as a stream.

spark.dataSource.register(Multipart)
spark.read.format("multipart").load(path)     # path: a file, a folder or a pattern

A path holds bodies as HTTP clients send them, one a file, with the boundary in the file's first line. Each body is cut into byte ranges of
split bytes: a part belongs to the range in which its boundary begins, and a reader goes on past its range's end to the
end of its last part, so a body of any size is read by many tasks and every part once. A task takes ranges that follow one another, TASK bytes
of them where they are smaller: the number of tasks grows with the bytes and not with the ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "body string, part_offset long, name string, file_name string, content_type string, content binary, length long"
SPLIT = 32 << 20
BLOCK = 1 << 20
TASK = 4 << 20  # bytes of a task whose ranges are smaller
OPENED = 64 << 10  # bytes that opening a body counts as
#: A boundary line: two dashes, up to 70 characters, and the line's end.
FIRST = re.compile(rb"--([^\r\n]{1,70})\r?\n")


@dataclass
class Ranges(InputPartition):
    """What a task reads: path, begin and end of stretches of bodies, each cut into ranges."""

    stretches: list[tuple[str, int, int]]


def filesystem(path: str):
    """pyarrow's file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def bodies(path: str) -> list[tuple[str, int]]:
    """The files under a path and their sizes, sorted; of a pattern those whose names fit its last part."""
    import fnmatch

    from pyarrow import fs

    system, inside = filesystem(path.rstrip("/"))
    prefix = path.rstrip("/")[: len(path.rstrip("/")) - len(inside)]
    folder, _, pattern = inside.rpartition("/")
    if not any(c in pattern for c in "*?["):
        info = system.get_file_info(inside)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.is_file:
            return [(path.rstrip("/"), info.size)]
        folder, pattern = inside, "*"
    found = system.get_file_info(fs.FileSelector(folder))
    return sorted((prefix + f.path, f.size) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, pattern) and not f.base_name.startswith(("_", ".")))


def tasks(files: list[tuple[str, int]], split: int) -> Iterator[Ranges]:
    """All ranges of the bodies, dealt to tasks in their order."""
    held, room = [], TASK
    for path, size in files:
        at, room = 0, room - OPENED
        while at < size:
            end = min(at + max(1, room // split) * split, size)
            held.append((path, at, end))
            at, room = end, room - (end - at)
            if room < split:
                yield Ranges(held)
                held, room = [], TASK
    if held:
        yield Ranges(held)


def header(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode("utf-8", "replace").split("\n"):
        key, colon, value = line.partition(":")
        if colon:
            out[key.strip().lower()] = value.strip()
    return out


class Body:
    """A body whose ranges are read one after the other. A window of its bytes goes forward, so that ranges side by side read a block once."""

    def __init__(self, path: str, boundary: bytes | None = None):
        system, inside = filesystem(path)
        self.path, self.file = path, system.open_input_file(inside)
        self.size = self.file.size()
        first = FIRST.match(self.file.read_at(min(80, self.size), 0))
        self.boundary = boundary or (first and first[1])  # None: no multipart body
        self.line = b"\n--" + (self.boundary or b"")
        self.mark = re.compile(rb"\r?" + re.escape(self.line) + rb"(--)?[ \t]*(?=\r?\n|\Z)")
        self.at, self.held = -1, b"\n"

    def following(self, start: int, before: int | None = None) -> tuple[int, int, int, bool] | None:
        """Where the first boundary from start on begins, has its dashes and ends, and whether it is the body's last one. Reads as far as that takes; before: no
        farther than to know that no dashes stand before it. A boundary follows a line end, the body's first one an assumed one at -1."""
        if not self.at <= start <= self.at + len(self.held):
            self.at, self.held = (start, b"") if start >= 0 else (-1, b"\n")
        seek = start
        while True:
            found, upto = self.mark.search(self.held, seek - self.at), self.at + len(self.held)
            if found and (upto >= self.size or found.end() < len(self.held)):
                dashes = found.end() - len(found[0].lstrip(b"\r\n"))
                return self.at + found.start(), self.at + dashes, self.at + found.end(), bool(found[1])
            if upto >= self.size:
                return None
            # The last line may be a boundary whose rest, or the line end after it, is not yet read.
            last = self.held.rfind(b"\n", seek - self.at)
            seek = max(seek, self.at + last - 1 if last >= 0 and self.line.startswith(self.held[last : last + len(self.line)]) else upto - 1)
            if before is not None and seek + 1 >= before:
                return None
            kept = self.held[start - self.at :]
            self.at, self.held = start, kept + self.file.read_at(max(BLOCK, len(kept)), upto)

    def parts(self, begin: int, end: int) -> Iterator[tuple]:
        """The parts whose boundary begins in a byte range. A part without a file name is a field, one without an end was cut off: neither gives a row."""
        opening = self.following(max(begin - 2, -1), end)
        while opening and not opening[3] and opening[1] < end:
            closing = self.following(opening[2])
            if not closing:
                return
            content = self.held[opening[2] - self.at : closing[0] - self.at]
            blank = re.search(rb"\r?\n\r?\n", content)
            fields, content = (header(content[: blank.start()]), content[blank.end() :]) if blank else (header(content), b"")
            named = {k.lower(): v for k, v in re.findall(r';\s*([a-z]+)="?([^";]*)"?', fields.get("content-disposition", ""), re.I)}
            if opening[1] >= begin and "filename" in named:
                yield self.path, opening[1], named.get("name"), re.split(r"[/\\]", named["filename"])[-1], fields.get("content-type"), content, len(content)
            opening = closing


def part_rows(path: str, boundary: bytes | None, begin: int, end: int, split: int | None = None) -> Iterator[tuple]:
    """The parts whose boundary begins in a byte range, range after range where it is cut by split. None: the boundary is that of the body's first line; a body
    that does not begin with one has no parts."""
    with closing((body := Body(path, boundary)).file):
        for at in range(begin, end, split or end - begin) if body.boundary else ():
            yield from body.parts(at, min(at + split, end) if split else end)


class Multipart(DataSource):
    """Options: path, and split, the bytes of a range."""

    @classmethod
    def name(cls) -> str:
        return "multipart"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MultipartReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return MultipartStream(self.options)


class MultipartReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[Ranges]:
        return list(tasks(bodies(self.path), self.split))

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for path, begin, end in partition.stretches:
            yield from part_rows(path, None, begin, end, self.split)


class MultipartStream(SimpleDataSourceStreamReader):
    """Bodies that arrive in a folder, in the order of their names; a body is read once."""

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def initialOffset(self) -> dict:
        return {"after": ""}

    def _rows(self, after: str, upto: str | None) -> tuple[list[tuple], str]:
        files = [(p, size) for p, size in bodies(self.path) if p > after and (upto is None or p <= upto)]
        return [row for p, size in files if size for row in part_rows(p, None, 0, size, self.split)], max((p for p, _ in files), default=after)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, last = self._rows(start["after"], None)
        return iter(rows), {"after": last}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start["after"], end["after"])[0])
