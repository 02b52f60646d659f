"""Small executables and symbol files, made byte by byte."""

import struct

from namewright.sources import pdb

BASE = 0x140000000
GUID = "00112233445566778899aabbccddeeff"


def executable(functions: dict[str, bytes], unwind: list[tuple[str, str | None]], strings: dict[str, bytes], bits: int = 64) -> tuple[bytes, dict[str, int]]:
    """A file with .text, .rdata, .data and .pdata, and where everything lies.

    functions: code by name, in which b'<call:NAME>' and b'<lea:NAME>' are
    placeholders of direct calls and of address loads; unwind: functions with a
    row, and the one theirs chains to.
    """
    text, places, fixes = b"", {}, []
    for name, code in functions.items():
        text = text.ljust((len(text) + 15) & ~15, b"\xcc")
        places[name] = BASE + 0x1000 + len(text)
        while b"<" in code:
            before, rest = code.split(b"<", 1)
            what, code = rest.split(b">", 1)
            kind, _, target = what.decode().partition(":")
            text += before + {"call": b"\xe8", "jmp": b"\xe9", "lea": b"\x48\x8d\x0d"}[kind]
            fixes.append((len(text), target))
            text += bytes(4)
        text += code
    places["end"] = BASE + 0x1000 + len(text)
    rdata = b""
    for name, data in strings.items():
        places[name] = BASE + 0x3000 + len(rdata)
        rdata += data
    text = bytearray(text)
    for at, target in fixes:
        struct.pack_into("<i", text, at, places[target] - (BASE + 0x1000 + at + 4))
    rdata = rdata.ljust((len(rdata) + 3) & ~3, b"\0")
    names = list(functions)
    end = lambda f: places[names[names.index(f) + 1]] if f != names[-1] else places["end"]
    row = lambda f, info: struct.pack("<III", places[f] - BASE, end(f) - BASE, info)
    pdata = b""
    for f, parent in unwind:
        info = 0x3000 + len(rdata)
        rdata += bytes([(4 << 3 | 1) if parent else 1, 0, 0, 0]) + (row(parent, 0) if parent else b"")
        pdata += row(f, info)
    record = b"RSDS" + bytes.fromhex(GUID) + struct.pack("<I", 7) + b"x.pdb\0\0\0"
    debug_at = len(rdata)
    rdata += struct.pack("<IIHHIIII", 0, 0, 0, 0, 2, len(record), 0x3000 + debug_at + 28, 0x1400 + debug_at + 28) + record
    sections = [(b".text", 0x1000, bytes(text), 0x400, 0x60000020), (b".rdata", 0x3000, rdata, 0x1400, 0x40000040), (b".data", 0x5000, b"\0" * 64, 0x2400, 0xC0000040), (b".pdata", 0x6000, pdata, 0x2800, 0x40000040)]
    directories = [(0, 0)] * 16
    directories[3], directories[6] = (0x6000, len(pdata)), (0x3000 + debug_at, 28)
    if bits == 64:
        optional = struct.pack("<H22xQ", 0x20B, BASE).ljust(108, b"\0")
    else:
        optional = struct.pack("<H26xI", 0x10B, BASE & 0xFFFFFFFF).ljust(92, b"\0")
    optional += struct.pack("<I", 16) + b"".join(struct.pack("<II", *d) for d in directories)
    head = b"MZ".ljust(0x3C, b"\0") + struct.pack("<I", 0x40) + b"PE\0\0"
    head += struct.pack("<HHIIIHH", 0x8664, len(sections), 1234567, 0, 0, len(optional), 0x22) + optional
    for name, at, data, pointer, flags in sections:
        head += struct.pack("<8sIIII12xI", name, max(len(data), 1), at, max(len(data), 1), pointer, flags)
    out = head
    for _, _, data, pointer, _ in sections:
        out = out.ljust(pointer, b"\0") + data
    return out, places


CODE = {
    "main": bytes.fromhex("4883ec28") + b"<call:helper><lea:text><call:twin_a>" + bytes.fromhex("4883c428c3"),
    "helper": bytes.fromhex("8bff488bff85c97402ffc1c3"),
    "twin_a": bytes.fromhex("31c0c3"),
    "twin_b": bytes.fromhex("31c0c3"),
    "tail": bytes.fromhex("85c9") + bytes.fromhex("7505") + b"<jmp:far>" + bytes.fromhex("c3"),
    "pad": b"\xcc" * 0x90,
    "far": b"<lea:wide>" + bytes.fromhex("c3"),
}
STRINGS = {"text": b"hello world\0", "wide": "wide text".encode("utf-16-le") + b"\0\0", "short": b"abc\0"}
UNWIND = [("main", None), ("helper", None), ("tail", None), ("twin_b", "tail")]


def sample() -> tuple[bytes, dict[str, int]]:
    return executable(CODE, UNWIND, STRINGS)


def symbols(places: dict[str, int], names: dict[str, str] | None = None) -> bytes:
    own = names or {n: n for n in CODE if n != "pad"}
    return pdb.encode((GUID, 7, 1234567), [(".text", 0x1000, 0x1000, 0x1000, 0x400, 0x60000020)], [(1, places[n] - BASE - 0x1000, 4, shown) for n, shown in own.items()])
