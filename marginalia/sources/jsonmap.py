"""One large JSON object of lists, read by many tasks.

A document ``{"key": [...], "key": [...], ...}`` is one record to a line reader. Here its bytes are dealt into ranges; the task of a
range reads the entries whose key begins in it, on to the end of the last of them. An entry begins behind the end of a list, a comma
and a quoted key with a list behind it. Within a string no quote stands behind a comma without a backslash between, so such a place is
never inside one."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 32 << 20
_BACK = 1 << 12  # bytes before a range in which the comma before its first key may stand
_STEP = 1 << 20
_ENTRY = re.compile(rb'\]\s*,\s*("(?:[^"\\]|\\.)*+"\s*:\s*\[)', re.S)
_OPENING = re.compile(rb'\s*\{\s*(?=")')


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def _opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inner


def entries(read, size: int, begin: int, end: int) -> Iterator[tuple[str, str]]:
    """Key and value (as JSON text) of the entries whose key begins in [begin, end). ``read(at, n)`` gives bytes of the document."""
    at = max(0, begin - _BACK)
    data = read(at, end - at)

    def starts() -> list[int]:
        found = [at + m.start(1) for m in _ENTRY.finditer(data)]
        first = _OPENING.match(data) if at == 0 else None
        return sorted({*found, *([first.end()] if first else [])})

    # Read on until an entry begins at or after the range's end, or the document is over.
    while True:
        known = starts()
        later = [s for s in known if s >= end]
        if later or at + len(data) >= size:
            break
        data += read(at + len(data), _STEP)
    mine = [s for s in known if begin <= s < end]
    for k, start in enumerate(mine):
        following = mine[k + 1] if k + 1 < len(mine) else later[0] if later else None
        text = data[start - at : None if following is None else following - at].decode("utf-8", "replace").rstrip()
        if following is not None:
            text = text.rstrip(", \t\r\n")
        try:
            key, stop = json.JSONDecoder().raw_decode(text)
            value = text[stop:].lstrip()[1:].lstrip()
            _, stop = json.JSONDecoder().raw_decode(value)
        except ValueError:
            continue  # a malformed entry yields no row
        yield key, value[:stop]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[_Range]:
        system, inner = _opened(self.path)
        size = system.get_file_info(inner).size or 0
        return [_Range(self.path, at, min(at + self.split, size)) for at in range(0, size, self.split)] or [_Range(self.path, 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple[str, str]]:
        system, inner = _opened(partition.path)
        with system.open_input_file(inner) as file:
            size = file.size()

            def read(at: int, n: int) -> bytes:
                file.seek(at)
                return file.read(max(0, min(n, size - at)))

            yield from entries(read, size, partition.begin, partition.end)


class JsonMap(DataSource):
    """``spark.read.format("json_map").option("splitBytes", n).load(path)``: key, value."""

    @classmethod
    def name(cls) -> str:
        return "json_map"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})
