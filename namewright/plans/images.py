"""Executables and symbol files made from the part table, for the queries of the file readers.

Supplier i of n gives an executable with the parts whose key leaves i when divided
by n: one function in a slot of 64 bytes and one string in a slot of 128 for each,
in order. What the readers must find follows from the keys alone, so SQL can tell.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.plans.corpus import v5_sql
from namewright.sources import pdb

BASE, TEXT, SLOT, STRING_SLOT = 0x140000000, 0x1000, 64, 128
FLAGS = {".text": 0x60000020, ".rdata": 0x40000040, ".data": 0xC0000040, ".pdata": 0x40000040}
PAGE = 0x1000


def code(part: int, size: int, at: int, k: int, count: int, rdata: int, data: int) -> bytes:
    """The function of a part at an address: a call, an address of its string, perhaps other data, a branch, a return or a jump far ahead."""
    out = bytearray(bytes.fromhex("4883ec28"))
    out += bytes.fromhex("8bff" if part % 2 == 0 else "488bff")
    out += b"\xb9" + struct.pack("<I", size)

    def relative(opcode: str, target: int) -> None:
        out.extend(bytes.fromhex(opcode))
        out.extend(struct.pack("<i", target - (at + len(out) + 4)))

    relative("e8", BASE + TEXT + SLOT * ((k + 1) % count))
    relative("488d0d", rdata + STRING_SLOT * k)
    if part % 3 == 0:
        relative("8b05", data + 4 * k)
    elif part % 3 == 1:
        out += bytes.fromhex("65488b042528000000")
    out += bytes.fromhex("85c97402ffc1")
    if part % 4 == 0 and k + 5 < count:
        relative("e9", BASE + TEXT + SLOT * (k + 5))
    else:
        out += bytes.fromhex("4883c428c3")
    return bytes(out)


def string(part: int, name: str) -> bytes:
    """The string of a part: its name in one or two bytes a letter, or one too short to count."""
    text = "abc" if part % 7 == 3 else f"{name}#{part}"
    return text.encode("utf-8" if part % 2 == 0 else "utf-16-le") + b"\0\0"


def executable(supplier: int, parts: list[tuple[int, str, int]], bits: int = 64) -> bytes:
    """The executable of a supplier; parts (key, name, size) in order of key. bits 32 changes the headers alone."""
    count = len(parts)
    pages = lambda n: max(PAGE, -(-n // PAGE) * PAGE)
    rdata = TEXT + pages(SLOT * count)
    strings = b"".join(string(p, n).ljust(STRING_SLOT, b"\0") for p, n, _ in parts)
    functions = [code(p, s, BASE + TEXT + SLOT * k, k, count, BASE + rdata, BASE + rdata) for k, (p, _, s) in enumerate(parts)]
    info_at = STRING_SLOT * count
    row = lambda k, info: struct.pack("<III", TEXT + SLOT * k, TEXT + SLOT * k + len(functions[k]), info)
    infos, pdata_rows = b"", b""
    for k in range(0, count, 2):
        at = rdata + info_at + len(infos)
        infos += bytes([4 << 3 | 1, 0, 0, 0]) + row(k - 2, 0) if k % 4 == 2 else bytes([1, 0, 0, 0])
        pdata_rows += row(k, at)
    record = b"RSDS" + hashlib.md5(f"s{supplier}".encode()).digest() + struct.pack("<I", supplier % 9 + 1) + b"x.pdb\0\0\0"
    debug_at = info_at + len(infos)
    data = rdata + pages(debug_at + 28 + len(record))
    pdata = data + pages(4 * count)
    functions = [code(p, s, BASE + TEXT + SLOT * k, k, count, BASE + rdata, BASE + data) for k, (p, _, s) in enumerate(parts)]
    text = b"".join(f.ljust(SLOT, b"\xcc") for f in functions)
    # Raw data lies in the file as it does in memory.
    debug = struct.pack("<IIHHIIII", 0, 0, 0, 0, 2, len(record), rdata + debug_at + 28, rdata + debug_at + 28)
    sections = [(".text", TEXT, text), (".rdata", rdata, strings + infos + debug + record), (".data", data, bytes(4 * count)), (".pdata", pdata, pdata_rows)]
    directories = [(0, 0)] * 16
    directories[3], directories[6] = (pdata, len(pdata_rows)), (rdata + debug_at, 28)
    optional = struct.pack("<H22xQ", 0x20B, BASE).ljust(108, b"\0") if bits == 64 else struct.pack("<H26xI", 0x10B, BASE & 0xFFFFFFFF).ljust(92, b"\0")
    optional += struct.pack("<I", 16) + b"".join(struct.pack("<II", *d) for d in directories)
    out = b"MZ".ljust(0x3C, b"\0") + struct.pack("<I", 0x40) + b"PE\0\0"
    out += struct.pack("<HHIIIHH", 0x8664, len(sections), 1_000_000 + supplier, 0, 0, len(optional), 0x22) + optional
    for name, at, content in sections:
        out += struct.pack("<8sIIII12xI", name.encode(), len(content), at, len(content), at, FLAGS[name])
    for _, at, content in sections:
        out = out.ljust(at, b"\0") + content
    return out


def symbols(supplier: int, parts: list[tuple[int, str, int]]) -> bytes:
    """The symbol file of a supplier's executable: a name for each function."""
    layout = [(".text", TEXT, SLOT * len(parts), SLOT * len(parts), TEXT, FLAGS[".text"])]
    return pdb.encode((hashlib.md5(f"s{supplier}".encode()).hexdigest(), supplier % 9 + 1, 1_000_000 + supplier), layout, [(1, SLOT * k, 40, f"{n}#{p}") for k, (p, n, _) in enumerate(parts)])


def files(spark: SparkSession, sf_dir: str, kind: str = "exe") -> DataFrame:
    """(path, content) of every supplier: its executable ('exe'), its symbol file ('pdb'), or, of 'mixed', executables
    of which some are of 32 bits and some are broken off."""
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    # A supplier has as many parts as there are parts for each supplier: some tens.
    groups = part.groupBy((F.col("p_partkey") % n).alias("s")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name", "p_size"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = [tuple(r.values()) for r in rows.as_py()]
                content = symbols(s, parts) if kind == "pdb" else executable(s, parts, 32 if kind == "mixed" and s % 10 == 7 else 64)
                if kind == "mixed" and s % 10 == 3:
                    content = content[:200]
                yield pa.RecordBatch.from_pydict({"path": [f"s{s}.{'pdb' if kind == 'pdb' else 'exe'}"], "content": [content]})

    return groups.mapInArrow(run, "path string, content binary")


_PAGES = "greatest(4096, ({0} + 4095) // 4096 * 4096)"
_ASCII = "hex(encode(CASE WHEN p % 7 = 3 THEN 'abc' ELSE name || '#' || p END))"
#: In SQL: img (one row a file), pt (one row a function, with its code's places), blk (its blocks).
SQL = f"""
ns AS (SELECT count(*) AS n FROM supplier),
p0 AS (SELECT p_partkey % n AS s, p_partkey AS p, p_name AS name, p_size AS size, row_number() OVER (PARTITION BY p_partkey % n ORDER BY p_partkey) - 1 AS k,
       count(*) OVER (PARTITION BY p_partkey % n) AS cnt FROM part, ns),
img0 AS (SELECT s, any_value(cnt) AS cnt, 4096 + {_PAGES.format("64 * any_value(cnt)")} AS rdata FROM p0 GROUP BY s),
img1 AS (SELECT *, 128 * cnt + ((cnt + 1) // 2) * 4 + ((cnt + 1) // 4) * 12 AS debug_at FROM img0),
img2 AS (SELECT *, rdata + {_PAGES.format("debug_at + 60")} AS data FROM img1),
img AS (SELECT *, data + {_PAGES.format("4 * cnt")} AS pdata, 's' || s || '.exe' AS path FROM img2),
pt0 AS (SELECT p0.*, path, rdata, data, {BASE + TEXT} + 64 * k AS place, p % 2 AS odd, CASE WHEN p % 4 = 0 AND k + 5 < p0.cnt THEN true ELSE false END AS jumps,
        CASE p % 3 WHEN 0 THEN 6 WHEN 1 THEN 9 ELSE 0 END AS extra FROM p0 JOIN img USING (s)),
pt AS (SELECT *, 11 + odd AS call_at, 16 + odd AS lea_at, 23 + odd AS extra_at, 23 + odd + extra + 4 AS branch_end, 34 + odd + extra AS len FROM pt0),
blk AS (
  SELECT path, place, place AS start, place + branch_end AS "end", '4883ec28' || CASE WHEN odd = 0 THEN '8bff' ELSE '' END || 'b9' || lpad(lower(hex(size)), 2, '0') || '000000' || repeat('0', 24)
    || CASE p % 3 WHEN 0 THEN repeat('0', 12) WHEN 1 THEN '65488b042528000000' ELSE '' END || '85c97402' AS code FROM pt
  UNION ALL SELECT path, place, place + branch_end, place + branch_end + 2, 'ffc1' FROM pt
  UNION ALL SELECT path, place, place + branch_end + 2, place + len, CASE WHEN jumps THEN repeat('0', 10) ELSE '4883c428c3' END FROM pt),
bg AS (SELECT *, {v5_sql("basic_block", "code")} AS guid FROM blk),
fg AS (SELECT path, place, string_agg(guid, '' ORDER BY start) AS code FROM bg GROUP BY ALL)
"""
FUNCTION_SQL = f"SELECT path, place AS address, len AS size, {v5_sql('function', 'code')} AS guid FROM fg JOIN pt USING (path, place)"
