"""Symbol files in PDB format: procedures and sections out of them, and new ones from named functions.

A file is a set of streams in blocks (MSF 7.0). Stream 1 holds the identity,
stream 3 the list of modules and where section headers and global symbols are.
"""

from __future__ import annotations

import mmap
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format.
SIGNATURE = b"Microsoft C/C++ MSF 7.00\r\n\x1aDS\0\0\0"
VERSION_INFO, VERSION_DBI, VERSION_TPI = 20000404, 19990903, 20040203
S_END, S_LPROC32, S_GPROC32, S_PUB32, S_ENVBLOCK = 0x0006, 0x110F, 0x1110, 0x110E, 0x113D
S_LPROC32_ID, S_GPROC32_ID = 0x1146, 0x1147
PROCEDURES = (S_LPROC32, S_GPROC32, S_LPROC32_ID, S_GPROC32_ID)
LF_ARGLIST, LF_PROCEDURE = 0x1201, 0x1008
FIRST_TYPE = 0x1000
#: An entry with this word in a file's environment block allows the file to be replaced.
CANARY = "pdbgen_canary"
# Fixed values of hash tables of names.
HASH_SIGNATURE, BUCKETS, CHAIN = 0xEFFE0000 + 19990810, 4096, 12


class BadSymbols(ValueError):
    """The file is no symbol file this reader understands."""


def name_hash(name: bytes) -> int:
    """The hash of a symbol's name: words of four, then two, then one byte xored, letter case left aside."""
    n = len(name) & ~3
    value = 0
    for (word,) in struct.iter_unpack("<I", name[:n]):
        value ^= word
    if len(name) & 2:
        value ^= struct.unpack_from("<H", name, n)[0]
    if len(name) & 1:
        value ^= name[-1]
    value |= 0x20202020
    value ^= value >> 11
    return value ^ (value >> 16)


def _hash_table(records: list[tuple[int, bytes]]) -> bytes:
    """The table of symbols (offset in the record stream, name): records bucket by bucket, a bit for each bucket in use, where it begins."""
    by: dict[int, list] = {}
    for offset, name in records:
        by.setdefault(name_hash(name) % BUCKETS, []).append((len(name), name.lower(), offset))
    rows, bits, starts = b"", bytearray((BUCKETS + 32) // 32 * 4), []
    for bucket in sorted(by):
        bits[bucket >> 3] |= 1 << (bucket & 7)
        starts.append(len(rows) // 8 * CHAIN)
        rows += b"".join(struct.pack("<II", offset + 1, 1) for _, _, offset in sorted(by[bucket]))
    buckets = (bytes(bits) + struct.pack(f"<{len(starts)}I", *starts)) if by else b""
    return struct.pack("<iIII", -1, HASH_SIGNATURE, len(rows), len(buckets)) + rows + buckets


class Slices:
    """Bytes of a file, or of parts of it in a row."""

    def __init__(self, data: bytes | mmap.mmap) -> None:
        self.data = data

    @classmethod
    def open(cls, path: str) -> Slices:
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(file.fileno()).st_size else b"")

    def view(self, parts: list[tuple[int, int]]) -> bytes:
        """The parts (offset, size) joined; EOFError where one goes past the end."""
        if any(at < 0 or at + n > len(self.data) for at, n in parts):
            raise EOFError("part beyond the end of the file")
        return b"".join(self.data[at : at + n] for at, n in parts)


class SymbolFile:
    """A parsed file."""

    def __init__(self, source: Slices) -> None:
        try:
            self._streams(source)
            self._identity()
        except (struct.error, EOFError) as error:
            raise BadSymbols(f"truncated or damaged: {error}") from None

    def _streams(self, source: Slices) -> None:
        if source.view([(0, 32)]) != SIGNATURE:
            raise BadSymbols("no MSF 7.0 header")
        self.block, _, _, size, _, where = struct.unpack("<6I", source.view([(32, 24)]))
        if not self.block:
            raise BadSymbols("no block size")
        blocks = lambda n: -(-n // self.block)

        def read(ids: tuple[int, ...], size: int) -> bytes:
            return source.view([(b * self.block, min(self.block, size - i * self.block)) for i, b in enumerate(ids)])

        ids = struct.unpack(f"<{blocks(size)}I", source.view([(where * self.block, 4 * blocks(size))]))
        directory = read(ids, size)
        count = struct.unpack_from("<I", directory)[0]
        sizes = [0 if s == 0xFFFFFFFF else s for s in struct.unpack_from(f"<{count}I", directory, 4)]
        at, self.streams = 4 + 4 * count, []
        for s in sizes:
            own = struct.unpack_from(f"<{blocks(s)}I", directory, at)
            at += 4 * blocks(s)
            self.streams.append(read(own, s))

    def _identity(self) -> None:
        _, self.signature, self.age = struct.unpack_from("<3I", self.streams[1])
        self.guid = self.streams[1][12:28].hex()
        dbi = self.streams[3] if len(self.streams) > 3 else b""
        self.globals, self.public_hash, self.modules, self.headers = 0xFFFF, 0xFFFF, [], b""
        if len(dbi) < 64:
            return
        self.public_hash, self.globals = struct.unpack_from("<H", dbi, 16)[0], struct.unpack_from("<H", dbi, 20)[0]
        mods, contributions, secmap, sources, types, _, debug, ec = struct.unpack_from("<8i", dbi, 24)
        at = 64
        while at < 64 + mods:
            stream, symbols = struct.unpack_from("<H", dbi, at + 34)[0], struct.unpack_from("<I", dbi, at + 36)[0]
            end = dbi.index(b"\0", at + 64)
            name = dbi[at + 64 : end].decode("utf-8", "replace")
            at = (dbi.index(b"\0", end + 1) + 1 + 3) & ~3
            self.modules.append((name, stream, symbols))
        at = 64 + mods + contributions + secmap + sources + types + ec
        if debug >= 12:
            number = struct.unpack_from("<H", dbi, at + 10)[0]
            if number != 0xFFFF:
                self.headers = self.streams[number]

    def sections(self) -> list[tuple[str, int, int]]:
        """Name, relative address and size of each section."""
        rows = [struct.unpack_from("<8sII", self.headers, i) for i in range(0, len(self.headers) - 39, 40)]
        return [(n.split(b"\0")[0].decode("utf-8", "replace"), a, s) for n, s, a in rows]

    @staticmethod
    def records(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
        """Kind and content of symbol records."""
        while at + 4 <= len(data):
            size, kind = struct.unpack_from("<HH", data, at)
            if size < 2:
                return
            yield kind, data[at + 4 : at + 2 + size]
            at += 2 + size

    def producers(self) -> Iterator[tuple[int, bytes, int]]:
        """Symbol data of the global stream, then of each module that can be read; others are passed over."""
        if self.globals < len(self.streams):
            yield 0, self.streams[self.globals], 0
        for i, (_, stream, size) in enumerate(self.modules, 1):
            if stream < len(self.streams) and size <= len(self.streams[stream]):
                yield i, self.streams[stream][:size], 4

    def procedures(self) -> Iterator[dict]:
        """Procedures with a section that exists; what cannot be decoded is dropped."""
        places = self.sections()
        for producer, data, at in self.producers():
            for n, (kind, body) in enumerate(self.records(data, at)):
                if kind in PROCEDURES and len(body) >= 36:
                    size, offset, segment = *struct.unpack_from("<I", body, 12), *struct.unpack_from("<IH", body, 28)
                    if 1 <= segment <= len(places):
                        name = body[35:].split(b"\0")[0].decode("utf-8", "replace")
                        yield {"producer_idx": producer, "symbol_idx": n, "name": name, "rva": places[segment - 1][1] + offset, "len": size}

    def publics(self) -> list[str]:
        """Names of public symbols."""
        data = self.streams[self.globals] if self.globals < len(self.streams) else b""
        return [body[10:].split(b"\0")[0].decode("utf-8", "replace") for kind, body in self.records(data) if kind == S_PUB32 and len(body) > 10]

    def find_public(self, name: str) -> tuple[int, int] | None:
        """Section and offset of a public symbol, by the hash table of names; None if it has none of this name."""
        if max(self.public_hash, self.globals) >= len(self.streams):
            return None
        table, symbols, raw = self.streams[self.public_hash], self.streams[self.globals], name.encode()
        _, _, size, rest = struct.unpack_from("<iIII", table, 28)
        bucket, at = name_hash(raw) % BUCKETS, 44 + size
        if not rest or not table[at + (bucket >> 3)] >> (bucket & 7) & 1:
            return None
        width = (BUCKETS + 32) // 32 * 4
        before = int.from_bytes(table[at : at + width], "little") & ((1 << bucket) - 1)
        starts = [x // CHAIN for x in struct.unpack_from(f"<{(rest - width) // 4}I", table, at + width)] + [size // 8]
        place = before.bit_count()
        for i in range(starts[place], starts[place + 1]):
            offset = struct.unpack_from("<I", table, 44 + 8 * i)[0] - 1
            length, kind = struct.unpack_from("<HH", symbols, offset)
            body = symbols[offset + 4 : offset + 2 + length]
            if kind == S_PUB32 and body[10:].split(b"\0")[0] == raw:
                where, section = struct.unpack_from("<IH", body, 4)
                return section, where
        return None

    def environment(self) -> list[str]:
        """Entries of environment blocks among the global symbols."""
        data = self.streams[self.globals] if self.globals < len(self.streams) else b""
        return [x.decode("utf-8", "replace") for kind, body in self.records(data) if kind == S_ENVBLOCK for x in body[1:].split(b"\0") if x]


def may_replace(path: str) -> bool:
    """Whether nothing lies at a path, or a symbol file that this writer made."""
    if not os.path.exists(path):
        return True
    try:
        return any(CANARY in x for x in SymbolFile(Slices.open(path)).environment())
    except BadSymbols:
        return False


_SCHEMA = pa.schema([("path", pa.string()), ("producer_idx", pa.int32()), ("symbol_idx", pa.int32()), ("name", pa.string()), ("rva", pa.int64()), ("len", pa.int64()), ("error", pa.string())])


def procedures(files: DataFrame) -> DataFrame:
    """Procedures of symbol files (path, content), one task a file; a file that cannot be read has a row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                try:
                    rows = [r | {"path": path.as_py()} for r in SymbolFile(Slices(content.as_py() or b"")).procedures()]
                except BadSymbols as error:
                    rows = [{"path": path.as_py(), "error": str(error)}]
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return files.select("path", "content").mapInArrow(run, "path string, producer_idx int, symbol_idx int, name string, rva long, len long, error string")


_IDENTITY = pa.schema([("path", pa.string()), ("guid", pa.string()), ("age", pa.int64()), ("signature", pa.int64()), ("replaceable", pa.bool_()), ("sections", pa.string()), ("modules", pa.string()), ("publics", pa.int64()), ("found", pa.int64()), ("error", pa.string())])


def identities(files: DataFrame) -> DataFrame:
    """One row a symbol file (path, content): identity, whether this writer made it, sections, modules, number of public symbols and of those its table of names leads to, or an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                row: dict = {"path": path.as_py()}
                try:
                    s = SymbolFile(Slices(content.as_py() or b""))
                    row |= {"guid": s.guid, "age": s.age, "signature": s.signature, "replaceable": any(CANARY in x for x in s.environment())}
                    row |= {"sections": ",".join(f"{n} {a} {z}" for n, a, z in s.sections()), "modules": ",".join(m[0] for m in s.modules), "publics": len(s.publics()), "found": sum(s.find_public(n) is not None for n in s.publics())}
                except BadSymbols as error:
                    row["error"] = str(error)
                yield pa.RecordBatch.from_pylist([row], schema=_IDENTITY)

    return files.select("path", "content").mapInArrow(run, "path string, guid string, age long, signature long, replaceable boolean, sections string, modules string, publics long, found long, error string")


def _record(kind: int, body: bytes) -> bytes:
    body += b"\0" * (-(len(body) + 2) % 4)
    return struct.pack("<HH", len(body) + 2, kind) + body


def encode(identity: tuple[str, int, int], sections: list[tuple], functions: list[tuple[int, int, int, str]], block: int = 4096) -> bytes:
    """A symbol file. identity: GUID hex, age, signature; sections: (name, virtual_address, virtual_size,
    size_of_raw_data, pointer_to_raw_data, characteristics) in order; functions: (section from 1, offset, size, name).

    One module for each section that has functions, a global procedure and a
    public symbol for each function, all of the type void(), tables that find public
    symbols by name and by address, and the mark that lets the file be replaced.
    """
    guid, age, signature = identity
    types = [struct.pack("<HI", LF_ARGLIST, 0), struct.pack("<HIBBHI", LF_PROCEDURE, 3, 0, 0, 0, FIRST_TYPE)]
    void = FIRST_TYPE + 1
    body = b"".join(struct.pack("<H", len(t)) + t for t in types)
    tpi = struct.pack("<5I", VERSION_TPI, 56, FIRST_TYPE, FIRST_TYPE + len(types), len(body)) + struct.pack("<HHII6i", 0xFFFF, 0xFFFF, 4, 0x3FFFF, 0, 0, 0, 0, 0, 0) + body
    ipi = struct.pack("<5I", VERSION_TPI, 56, FIRST_TYPE, FIRST_TYPE, 0) + struct.pack("<HHII6i", 0xFFFF, 0xFFFF, 4, 0x3FFFF, 0, 0, 0, 0, 0, 0)
    info = struct.pack("<3I", VERSION_INFO, signature & 0xFFFFFFFF, age) + bytes.fromhex(guid) + struct.pack("<IIIIII", 0, 0, 0, 0, 0, VERSION_INFO)

    streams: list[bytes] = [b"", info, tpi, b"", ipi]
    symbols, modules, contributions = b"", [], []
    by_section: dict[int, list] = {}
    for f in sorted(functions):
        by_section.setdefault(f[0], []).append(f)
    public = []
    for number, own in by_section.items():
        name, address, size, _, _, flags = sections[number - 1]
        parts, at = [struct.pack("<I", 4)], 4
        for _, offset, length, symbol in own:
            head = struct.pack("<6I", 0, 0, 0, length, 0, length)
            text = symbol.encode() + b"\0"
            procedure = _record(S_GPROC32, head + struct.pack("<IIHB", void, offset, number, 0) + text)
            end = struct.pack("<I", at + len(procedure))
            parts += [procedure[:8] + end + procedure[12:], _record(S_END, b"")]
            at += len(procedure) + 4
            public.append((number, offset, text[:-1], _record(S_PUB32, struct.pack("<IIH", 2, offset, number) + text)))
        data = b"".join(parts)
        contribution = struct.pack("<HHiiIHHII", number, 0, 0, size, flags, len(modules), 0, 0, 0)
        streams.append(data + struct.pack("<I", 0))
        entry = struct.pack("<I", 0) + contribution + struct.pack("<HHIIIHHIII", 0, len(streams) - 1, len(data), 0, 0, 0, 0, 0, 0, 0)
        entry += f"{name}_module".encode() + b"\0" + f"{name}.obj".encode() + b"\0"
        modules.append(entry + b"\0" * (-len(entry) % 4))
        contributions.append(contribution)
    places, at = [], 0
    for *_, record in public:
        places.append(at)
        at += len(record)
    names = _hash_table([(where, name) for where, (_, _, name, _) in zip(places, public)])
    by_address = [where for *_, where in sorted((number, offset, name, where) for where, (number, offset, name, _) in zip(places, public))]
    symbols = b"".join(record for *_, record in public) + _record(S_ENVBLOCK, b"\0" + f"made from matched names, may be replaced: {CANARY}".encode() + b"\0\0")
    published = struct.pack("<IIIIHHII", len(names), 4 * len(public), 0, 0, 0, 0, 0, len(sections)) + names + struct.pack(f"<{len(public)}I", *by_address)
    streams += [symbols, _hash_table([]), published]
    records, global_hash, public_hash = len(streams) - 3, len(streams) - 2, len(streams) - 1
    headers = b"".join(struct.pack("<8sIIIIIIHHI", n.encode()[:8], size, a, raw, pointer, 0, 0, 0, 0, flags) for n, a, size, raw, pointer, flags in sections)
    streams.append(headers)
    mods = b"".join(modules)
    contributed = struct.pack("<I", 0xEFFE0000 + 19970605) + b"".join(contributions)
    secmap = struct.pack("<HH", len(sections), len(sections)) + b"".join(struct.pack("<HHHHHHII", 0x109, 0, 0, i, 0xFFFF, 0xFFFF, 0, s[2]) for i, s in enumerate(sections, 1))
    sources = struct.pack("<HH", len(modules), 0) + struct.pack(f"<{2 * len(modules)}H", *range(len(modules)), *[0] * len(modules))
    sources += b"\0" * (-len(sources) % 4)
    debug = struct.pack("<11H", *[0xFFFF] * 5, len(streams) - 1, *[0xFFFF] * 5)
    dbi = struct.pack("<iIIHHHHHHiiiiiIiiHHI", -1, VERSION_DBI, age, global_hash, 0x8E00, public_hash, 0, records, 0, len(mods), len(contributed), len(secmap), len(sources), 0, 0, len(debug), 0, 0, 0x8664, 0)
    streams[3] = dbi + mods + contributed + secmap + sources + debug
    return _container(streams, block)


def _container(streams: list[bytes], block: int) -> bytes:
    """Streams in blocks, after a header and two maps of free blocks."""
    blocks: list[bytes] = []

    def place(data: bytes) -> list[int]:
        ids = []
        for i in range(0, len(data), block):
            while (len(blocks) + 1) % block in (1, 2):  # maps of free blocks lie at 1 and 2 of each interval
                blocks.append(b"\xff" * block)
            ids.append(len(blocks) + 1)
            blocks.append(data[i : i + block].ljust(block, b"\0"))
        return ids

    held = [place(s) for s in streams]
    directory = struct.pack(f"<{1 + len(streams)}I", len(streams), *map(len, streams)) + b"".join(struct.pack(f"<{len(h)}I", *h) for h in held)
    root = place(directory)
    where = place(struct.pack(f"<{len(root)}I", *root))
    if len(where) != 1:
        raise ValueError("too many symbols for this block size")
    head = SIGNATURE + struct.pack("<6I", block, 1, len(blocks) + 1, len(directory), 0, where[0])
    return head.ljust(block, b"\0") + b"".join(blocks)


def write(path: str, identity: tuple[str, int, int], sections: list[tuple], functions: list[tuple[int, int, int, str]]) -> None:
    """Write a symbol file, but never over one that something else made."""
    if not may_replace(path):
        raise FileExistsError(f"{path} was not made by this writer")
    with open(f"{path}.part", "wb") as file:
        file.write(encode(identity, sections, functions))
    os.replace(f"{path}.part", path)
