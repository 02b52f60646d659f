"""The name database as one file of five sections.

A header of 7 marker bytes, a version byte and five section offsets; then
strings (length and UTF-8 text), constraint GUIDs, offsets of strings, rows of
12 bytes (constraint, number and start of its strings) and rows of 24 bytes
(function GUID, start and number of its constraints), in order of GUID. Counts
and indices are 32-bit little-endian, section offsets 64-bit.

    spark.dataSource.register(FoldSource)
    spark.read.format("fold").load(path)
    db.coalesce(1).write.format("fold").mode("overwrite").save(path)

The marker is the option 'magic': tools differ in theirs.
"""

from __future__ import annotations

import mmap
import os
import re
import struct
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


class Layout:
    """A packed row; unlike the library's own, it can be sent to executors."""

    def __init__(self, text: str) -> None:
        self.text, self.size = text, struct.calcsize(text)

    def pack(self, *values) -> bytes:
        return struct.pack(self.text, *values)

    def unpack_from(self, data, at: int = 0) -> tuple:
        return struct.unpack_from(self.text, data, at)


# Fixed values of the format.
VERSION = 1
HEADER = Layout("<7sB5Q")
FUNCTION, CONSTRAINT = Layout("<16sII"), Layout("<III")
COUNT = Layout("<I")

MAGIC = "NWNAMES"
TOO_LARGE = "beyond 2^32 do not fit this format; keep the database as Parquet"
SCHEMA = "function_guid string, constraint_guid string, symbol string"


class Pages:
    """Bytes of a file of any store, read in pages of which the last used are kept."""

    SIZE, KEPT = 1 << 20, 64

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.length, self.pages = file, file.size(), OrderedDict()

    def __len__(self) -> int:
        return self.length

    def _page(self, n: int) -> bytes:
        if n in self.pages:
            self.pages.move_to_end(n)
        else:
            self.pages[n] = self.file.read_at(min(self.SIZE, self.length - n * self.SIZE), n * self.SIZE)
            if len(self.pages) > self.KEPT:
                self.pages.popitem(last=False)
        return self.pages[n]

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.length)
        if stop <= start:
            return b""
        first, last = start // self.SIZE, (stop - 1) // self.SIZE
        return b"".join(self._page(n) for n in range(first, last + 1))[start - first * self.SIZE : stop - first * self.SIZE]


class Fold:
    """Random access to a file's bytes: in memory, mapped, or in pages."""

    def __init__(self, data: bytes | mmap.mmap | Pages, magic: str = MAGIC) -> None:
        if len(data) < HEADER.size:
            raise ValueError("file too short for a header")
        mark, version, *self.at = HEADER.unpack_from(data[: HEADER.size])
        if mark != magic.encode():
            raise ValueError(f"marker {mark!r} is not {magic!r}")
        if version != VERSION:
            raise ValueError(f"version {version} is not {VERSION}")
        if any(x + 4 > len(data) for x in self.at):
            raise ValueError("section beyond the end of the file")
        self.data = data
        self.strings, self.guids, self.lists, self.pairs, self.functions = self.at

    def _row(self, layout: Layout, at: int) -> tuple:
        return layout.unpack_from(self.data[at : at + layout.size])

    def function_count(self) -> int:
        return self._row(COUNT, self.functions)[0]

    def function(self, i: int) -> tuple[str, int, int]:
        guid, first, n = self._row(FUNCTION, self.functions + 4 + FUNCTION.size * i)
        return guid.hex(), first, n

    def string(self, offset: int) -> str:
        start = self.strings + offset
        n = self._row(COUNT, start)[0]
        return self.data[start + 4 : start + 4 + n].decode()

    def constraints(self, i: int) -> Iterator[tuple[str, list[str]]]:
        """Constraint GUIDs of the i-th function with their names."""
        _, first, n = self.function(i)
        for k in range(first, first + n):
            guid, size, begin = self._row(CONSTRAINT, self.pairs + 4 + CONSTRAINT.size * k)
            at, list_at = self.guids + 4 + 16 * guid, self.lists + 4 + 4 * begin
            offsets = struct.unpack(f"<{size}I", self.data[list_at : list_at + 4 * size])
            yield self.data[at : at + 16].hex(), [self.string(o) for o in offsets]

    def find(self, guid: str) -> int | None:
        """Place of a function by binary search."""
        low, high = 0, self.function_count()
        while low < high:
            middle = (low + high) // 2
            if self.function(middle)[0] < guid:
                low = middle + 1
            else:
                high = middle
        return low if low < self.function_count() and self.function(low)[0] == guid else None


class _Span(InputPartition):
    def __init__(self, path: str, first: int, past: int) -> None:
        self.path, self.first, self.past = path, first, past


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store that a path belongs to, by its scheme, and the path there; without a scheme it is this machine's."""
    return fs.FileSystem.from_uri(path) if re.match("[A-Za-z][A-Za-z0-9+.-]+:", path) else (fs.LocalFileSystem(), os.path.abspath(path))


def _open(path: str, magic: str) -> Fold:
    store, place = _store(path)
    if not isinstance(store, fs.LocalFileSystem):
        return Fold(Pages(store.open_input_file(place)), magic)
    with open(place, "rb") as file:
        size = os.fstat(file.fileno()).st_size
        return Fold(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) if size else b"", magic)


class FoldReader(DataSourceReader):
    """Spans of functions, each read by its own task from the mapped file."""

    def __init__(self, options: dict) -> None:
        self.path, self.magic = options["path"], options.get("magic", MAGIC)
        self.span, self.only = int(options.get("span", 50_000)), options.get("function")

    def partitions(self) -> list[InputPartition]:
        fold = _open(self.path, self.magic)
        if self.only is not None:
            at = fold.find(self.only)
            return [_Span(self.path, at or 0, at + 1 if at is not None else 0)]
        n = fold.function_count()
        return [_Span(self.path, i, min(i + self.span, n)) for i in range(0, n, self.span)] or [_Span(self.path, 0, 0)]

    def read(self, part: _Span) -> Iterator[tuple]:
        fold = _open(part.path, self.magic)
        for i in range(part.first, part.past):
            guid = fold.function(i)[0]
            for constraint, names in fold.constraints(i):
                for name in names:
                    yield guid, constraint, name


class _Written(WriterCommitMessage):
    def __init__(self, part: str) -> None:
        self.part = part


class FoldWriter(DataSourceWriter):
    """One task writes the file: its indices are global. Larger databases are kept as Parquet.

    The part is written beside the file, in the store that the path names by its
    scheme, so on a cluster task and driver see the same one.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.magic, self.overwrite = options["path"], options.get("magic", MAGIC), overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        part = f"{self.path}.{uuid.uuid4().hex}"
        store, place = _store(part)
        data = encode(((r.function_guid, r.constraint_guid, r.symbol) for r in rows), self.magic)
        with store.open_output_stream(place) as file:
            file.write(data)
        return _Written(part)

    def commit(self, messages: list) -> None:
        parts = [m.part for m in messages if m]
        size = lambda p: (lambda s, place: s.get_file_info(place).size)(*_store(p))
        full = [p for p in parts if size(p) > len(encode([], self.magic))]
        store, place = _store(self.path)
        if len(full) > 1:
            self.abort(messages)
            raise ValueError("the file is written by one task: use coalesce(1)")
        if store.get_file_info(place).type != fs.FileType.NotFound and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        keep = (full or parts)[0]
        store.move(_store(keep)[1], place)
        self._remove(p for p in parts if p != keep)

    def abort(self, messages: list) -> None:
        self._remove(m.part for m in messages if m)

    @staticmethod
    def _remove(parts) -> None:
        for part in parts:
            store, place = _store(part)
            if store.get_file_info(place).type != fs.FileType.NotFound:
                store.delete_file(place)


class FoldSource(DataSource):
    """spark.read.format('fold') and df.write.format('fold')."""

    @classmethod
    def name(cls) -> str:
        return "fold"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FoldReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FoldWriter(dict(self.options), overwrite)


def encode(rows, magic: str = MAGIC) -> bytes:
    """The file's bytes for (function, constraint, symbol) rows; equal rows in any order give equal bytes."""
    nested: dict[str, dict[str, set[str]]] = {}
    for function, constraint, symbol in rows:
        nested.setdefault(function, {}).setdefault(constraint, set()).add(symbol)
    names = sorted({s for by in nested.values() for group in by.values() for s in group})
    guids = sorted({c for by in nested.values() for c in by})
    number = {c: i for i, c in enumerate(guids)}
    strings, place = bytearray(COUNT.pack(len(names))), {}
    for name in names:
        raw = name.encode()
        place[name] = len(strings)
        strings += COUNT.pack(len(raw)) + raw
        if len(strings) >= 1 << 32:
            raise ValueError(f"strings {TOO_LARGE}")
    lists, pairs, functions = [], bytearray(), bytearray()
    pair = 0
    for function in sorted(nested):
        by = nested[function]
        functions += FUNCTION.pack(bytes.fromhex(function), pair, len(by))
        for constraint in sorted(by):
            group = sorted(by[constraint])
            pairs += CONSTRAINT.pack(number[constraint], len(group), len(lists))
            lists += [place[s] for s in group]
            pair += 1
    if max(len(lists), pair, len(guids), len(nested)) >= 1 << 32:
        raise ValueError(f"lists {TOO_LARGE}")
    sections = [
        bytes(strings),
        COUNT.pack(len(guids)) + bytes.fromhex("".join(guids)),
        COUNT.pack(len(lists)) + struct.pack(f"<{len(lists)}I", *lists),
        COUNT.pack(pair) + bytes(pairs),
        COUNT.pack(len(nested)) + bytes(functions),
    ]
    at, offsets = HEADER.size, []
    for s in sections:
        offsets.append(at)
        at += len(s)
    return HEADER.pack(magic.encode(), VERSION, *offsets) + b"".join(sections)
