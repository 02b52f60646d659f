import io
import json
import os
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from binaries import BASE, CODE, GUID, executable, sample, symbols
from namewright.__main__ import main
from namewright.operators import blocks
from namewright.plans.pipeline import Analyzer, DatabaseBuilder, disassembly
from namewright.sources import discovery, fold, pdb, pe, x86
from namewright.streaming import name_stream, name_stream_by_constraints

A, B, C = "41" * 16, "42" * 16, "43" * 16
ROWS = [(A, B, "test_value_1"), (A, B, "test_value_3"), (A, C, "test_value_1"), (A, C, "test_value_2"), (B, C, "ünï")]

guids = st.binary(min_size=16, max_size=16).map(bytes.hex)


# --- the database file ------------------------------------------------------------


@settings(max_examples=50, deadline=None)
@given(st.sets(st.tuples(guids, guids, st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=12)), max_size=30))
def test_fold_round_trip(rows):
    data = fold.encode(rows)
    f = fold.Fold(data)
    got = {(f.function(i)[0], c, n) for i in range(f.function_count()) for c, names in f.constraints(i) for n in names}
    assert got == rows and fold.encode(sorted(rows, reverse=True)) == data
    for i in range(f.function_count()):
        assert f.find(f.function(i)[0]) == i
    assert f.find("f" * 31 + "e") in (None, f.function_count() - 1)


def test_fold_layout():
    data = fold.encode([(A, B, "xy")], "ABCDEFG")
    strings, guids_, lists, pairs, functions = struct.unpack_from("<5Q", data, 8)
    assert data[:8] == b"ABCDEFG\x01" and strings == 48
    assert data[strings:guids_] == struct.pack("<II", 1, 2) + b"xy"
    assert data[guids_:lists] == struct.pack("<I", 1) + bytes.fromhex(B)
    assert data[lists:pairs] == struct.pack("<II", 1, 4)
    assert data[pairs:functions] == struct.pack("<IIII", 1, 0, 1, 0)
    assert data[functions:] == struct.pack("<I", 1) + bytes.fromhex(A) + struct.pack("<II", 0, 1)


@pytest.mark.parametrize("damage", [lambda d: d[:40], lambda d: b"X" + d[1:], lambda d: d[:7] + b"\x02" + d[8:], lambda d: d[:60], lambda d: b""])
def test_fold_damage(damage):
    with pytest.raises(ValueError):
        fold.Fold(damage(fold.encode(ROWS)))


def test_fold_source(spark, tmp_path, rows):
    spark.dataSource.register(fold.FoldSource)
    path = str(tmp_path / "db.fold")
    df = spark.createDataFrame(ROWS, fold.SCHEMA)
    df.coalesce(1).write.format("fold").mode("overwrite").save(path)
    assert rows(spark.read.format("fold").option("span", 1).load(path)) == sorted(ROWS, key=str)
    assert rows(spark.read.format("fold").option("function", B).load(path)) == [(B, C, "ünï")]
    assert spark.read.format("fold").option("function", C).load(path).count() == 0
    with pytest.raises(Exception, match="marker"):
        spark.read.format("fold").option("magic", "OTHERS!").load(path).count()
    with pytest.raises(Exception, match="coalesce"):
        df.repartition(3, "symbol").write.format("fold").mode("overwrite").save(path)
    with pytest.raises(Exception):
        df.coalesce(1).write.format("fold").mode("append").save(path)
    assert os.listdir(tmp_path) == ["db.fold"]
    df.limit(0).coalesce(1).write.format("fold").mode("overwrite").save(path)
    assert spark.read.format("fold").load(path).count() == 0


def test_fold_in_pages(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fold.Pages, "SIZE", 7)
    monkeypatch.setattr(fold.Pages, "KEPT", 2)
    path = tmp_path / "x.fold"
    path.write_bytes(fold.encode(ROWS))
    f = fold.Fold(fold.Pages(pa.OSFile(str(path))))
    assert sorted((f.function(i)[0], c, n) for i in range(f.function_count()) for c, names in f.constraints(i) for n in names) == sorted(ROWS)
    store, place = fold._store(f"file://{path}")
    assert place == str(path) == fold._store(str(path))[1]


# --- the decoder ------------------------------------------------------------------


@pytest.mark.parametrize(
    "code, mnemonic, flow, target",
    [
        ("e801000000", "Call", "Call", 0x1006), ("e900100000", "Jmp", "UnconditionalBranch", 0x2005), ("ebfe", "Jmp", "UnconditionalBranch", 0x1000),
        ("0f8400000100", "Je", "ConditionalBranch", 0x11006), ("7502", "Jne", "ConditionalBranch", 0x1004), ("e302", "Jrcxz", "ConditionalBranch", 0x1004),
        ("c3", "Ret", "Return", None), ("c20800", "Ret", "Return", None), ("cc", "Int", "Interrupt", None), ("0f0b", "Ud", "Exception", None),
        ("ffe0", "Jmp", "IndirectBranch", None), ("ff1500000000", "Call", "IndirectCall", None), ("0f05", "Syscall", "Call", None),
        ("48b80102030405060708", "Mov", "Next", None), ("0f1f440000", "Other", "Next", None), ("f30f100500010000", "Other", "Next", None), ("c5f877", "Other", "Next", None),
        ("c4e279180500000000", "Other", "Next", None), ("62f17c48100500000000", "Other", "Next", None), ("660f3a0fc108", "Other", "Next", None), ("66c7003412", "Mov", "Next", None),
        ("4869c000010000", "Other", "Next", None), ("f7050000000001000000", "Other", "Next", None), ("f6c101", "Other", "Next", None), ("a11122334455667788", "Mov", "Next", None),
    ],
)
def test_decoder(code, mnemonic, flow, target):
    raw = bytes.fromhex(code)
    x = x86.Decoder(raw + b"\x90" * 4, 0x1000, 64).decode(0x1000)
    assert (x.bytes, x.mnemonic, x.flow, x.branch_target) == (raw, mnemonic, flow, target)


def test_memory_operands():
    of = lambda h, bits=64: x86.Decoder(bytes.fromhex(h), 0x1000, bits).decode(0x1000)
    x = of("488d0d10000000")
    assert (x.mnemonic, x.mem_base, x.mem_disp, x.mem_size) == ("Lea", "RIP", 0x1017, 0)
    x = of("65488b042528000000")
    assert (x.mem_base, x.mem_index, x.mem_disp, x.segment_prefix, x.mem_size) == (None, None, 0x28, "GS", 8)
    x = of("8b0d78563412", 32)
    assert (x.mem_base, x.mem_disp, x.mem_size) == (None, 0x12345678, 4)
    x = of("8b448bfc")
    assert (x.mem_base, x.mem_index, x.mem_disp) == ("RBX", "RCX", -4)


def test_invalid_code():
    for code in ("0f04", "06", "e80000", "66" * 16 + "90", ""):
        with pytest.raises(x86.Invalid):
            x86.Decoder(bytes.fromhex(code), 0, 64).decode(0)


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=40), st.sampled_from([32, 64]))
def test_decoder_never_breaks(code, bits):
    try:
        x = x86.Decoder(code, 0, bits).decode(0)
        assert 0 < len(x.bytes) <= 15 and code.startswith(x.bytes)
    except x86.Invalid:
        pass
    try:
        f = x86.analyse(code, 0, 0, bits)
        assert 0 < f["size"] <= len(code) and all(0 <= a < b <= f["size"] for a, b in f["blocks"])
    except ValueError:
        pass


def test_tail_calls():
    far = bytes.fromhex("e900010000c3") + b"\xcc" * 0x100
    assert x86.analyse(far, 0, 0, 64)["calls"] == [(0, 0x105)]
    near = bytes.fromhex("eb02cccc31c0c3")
    f = x86.analyse(near, 0, 0, 64)
    assert f["calls"] == [] and f["size"] == 7 and f["blocks"] == [(0, 2), (4, 7)]


def test_normalised_bytes(spark):
    code = {
        "488bff": "", "8bff": "8bff", "e801000000": "00" * 5, "e900100000": "00" * 5, "eb02": "eb02", "0f8400000100": "0f8400000100",
        "488d0d10000000": "00" * 7, "65488b042528000000": "65488b042528000000", "ff1500000000": "00" * 6,
    }
    rows = []
    for i, h in enumerate(code):
        x = x86.Decoder(bytes.fromhex(h), 0x1000, 64).decode(0x1000)
        rows.append(("x", i, x.ip, x.bytes, x.mnemonic, x.op_kinds, x.reg0, x.reg1, x.branch_target, x.mem_base, x.mem_index, x.mem_disp, x.segment_prefix))
    df = spark.createDataFrame(rows, "binary_id string, entry_point long, ip long, bytes binary, mnemonic string, op_kinds array<string>, reg0 string, reg1 string, branch_target long, mem_base string, mem_index string, mem_disp long, segment_prefix string")
    bounds = df.select("binary_id", "entry_point", F.lit(0x1000).alias("first"), F.lit(0x1100).alias("past"))
    got = {r.entry_point: r.code for r in blocks.normalised(df, bounds).collect()}
    assert [got[i] for i in range(len(code))] == list(code.values())


# --- executables ------------------------------------------------------------------


@pytest.mark.parametrize(
    "data, expected",
    [
        (b"hello\0", "68656c6c6f"), (b"hell\0", None), (bytes.fromhex("680065006c000000"), "680065006c00"), (bytes.fromhex("680065000000"), None),
        (bytes.fromhex("61000000"), None), (bytes.fromhex("fffefdfcfb00"), None), (bytes.fromhex("610000d862000000"), None), (b"A" * 4096, "41" * 4096),
    ],
)
def test_strings(data, expected):
    got = pe.string_constant(data)
    assert (got.hex() if got else got) == expected


def test_headers():
    data, places = sample()
    e = pe.Executable.parse(data)
    assert (e.image_base, e.bitness, e.timestamp, e.pdb_identity()) == (BASE, 64, 1234567, (GUID, 7))
    assert [s.name for s in e.sections] == [".text", ".rdata", ".data", ".pdata"]
    assert e.string(places["text"]) == b"hello world" and e.string(places["short"]) is None
    assert e.is_writable(BASE + 0x5000) and not e.is_writable(BASE + 0x1000) and not e.is_writable(BASE + 0x900000)
    assert e.read(BASE - 1, 4) is None and e.read(places["helper"], 2) == b"\x8b\xff"
    rows = {r[0]: r[3] for r in e.runtime_functions()}
    assert rows == {places["main"]: None, places["helper"]: None, places["tail"]: None, places["twin_b"]: places["tail"]}
    found, failed = e.functions()
    assert set(found) == {places[n] for n in ("main", "helper", "twin_a", "tail", "far")} and not failed
    assert pe.Executable.parse(executable(CODE, [], {"text": b"x", "wide": b"y"}, 32)[0]).bitness == 32


@pytest.mark.parametrize("data", [b"", b"MZ", b"\x7fELF" + bytes(100), sample()[0][:200], b"MZ" + bytes(200)])
def test_bad_executables(data):
    with pytest.raises(pe.BadExecutable):
        pe.Executable.parse(data)


def test_symbol_file(tmp_path):
    _, places = sample()
    s = pdb.SymbolFile(pdb.Slices(symbols(places)))
    assert (s.guid, s.age, s.signature) == (GUID, 7, 1234567)
    assert {p["name"]: p["rva"] + BASE for p in s.procedures()} == {n: places[n] for n in CODE if n != "pad"}
    assert {n: s.find_public(n) for n in CODE if n != "pad"} == {n: (1, places[n] - BASE - 0x1000) for n in CODE if n != "pad"}
    assert s.find_public("nothing") is None and s.find_public("MAIN") is None and pdb.SymbolFile(pdb.Slices(pdb.encode((GUID, 7, 1), [], []))).find_public("main") is None
    for damaged in (b"", b"x" * 5000, symbols(places)[:9000]):
        with pytest.raises(pdb.BadSymbols):
            pdb.SymbolFile(pdb.Slices(damaged))
    path = str(tmp_path / "x.pdb")
    assert pdb.may_replace(path)
    pdb.write(path, (GUID, 7, 1), [], [])
    pdb.write(path, (GUID, 8, 1), [], [])
    open(path, "wb").write(b"something else")
    with pytest.raises(FileExistsError):
        pdb.write(path, (GUID, 7, 1), [], [])
    with pytest.raises(EOFError):
        pdb.Slices(b"abc").view([(0, 2), (2, 2)])
    assert pdb.Slices(b"abcdef").view([(4, 2), (0, 1)]) == b"efa"


def test_tables_of_names(tmp_path):
    names = [f"f{i}" for i in range(9000)] + ["ünï", "a" * 300, "Main", "main", "x"]
    s = pdb.SymbolFile(pdb.Slices(pdb.encode((GUID, 1, 1), [(".text", 0x1000, 1 << 20, 1 << 20, 0x400, 0x60000020)], [(1, 16 * i, 4, n) for i, n in enumerate(names)])))
    assert all(s.find_public(n) == (1, 16 * i) for i, n in enumerate(names))
    table = s.streams[s.public_hash]
    size, addresses = struct.unpack_from("<II", table)
    assert 28 + size + addresses == len(table) and addresses == 4 * len(names)
    # The hash of a name does not tell upper from lower case.
    assert pdb.name_hash(b"Main") == pdb.name_hash(b"mAIN") != pdb.name_hash(b"main2")


# --- from end to end ----------------------------------------------------------------


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("bin")
    data, places = sample()
    (root / "deep").mkdir()
    (root / "deep" / "one.EXE").write_bytes(data)
    (root / "deep" / "one.pdb").write_bytes(symbols(places))
    (root / "alone.exe").write_bytes(data + b"alone")
    (root / "bad.exe").write_bytes(b"MZ nothing")
    (root / "bad.pdb").write_bytes(symbols(places))
    other, moved = executable({"first": b"\xcc" * 32, **CODE}, [("main", None), ("tail", None), ("twin_b", None)], {"z": b"other text\0", "text": b"hello world\0", "wide": "wide text".encode("utf-16-le") + b"\0\0"})
    (root / "target.exe").write_bytes(other)
    return root, places, moved


def test_discovery(spark, folder):
    root, _, _ = folder
    assert {os.path.basename(r.path) for r in discovery.directory(spark, str(root)).collect()} == {"one.EXE", "bad.exe"}


def test_build_and_analyze(spark, folder, capsys):
    root, places, moved = folder
    built = DatabaseBuilder(spark).add_directory(str(root)).build()
    stats = built.stats.first()
    assert (stats.processed_files, stats.failed_files, stats.unique_functions) == (2, 1, 5)
    a = Analyzer(spark, [str(root / "target.exe")], built.db)
    result = a.analyze()
    names = {r.address: r.symbol_name for r in result.matches.collect()}
    expected = {moved[n]: n for n in ("main", "helper", "tail", "far")}
    assert {k: v for k, v in names.items() if v} == expected | {moved["twin_a"]: "twin_a"}
    assert moved["twin_b"] in names and names[moved["twin_b"]] is None
    assert disassembly(a.tables.instructions, a.tables.blocks).count() > 10
    path = str(root / "made.pdb")
    assert a.write_symbols(result, path) == 5
    again = {p["name"]: p["rva"] + BASE for p in pdb.SymbolFile(pdb.Slices.open(path)).procedures()}
    assert again == {n: moved[n] for n in ("main", "helper", "tail", "far", "twin_a")}
    assert Analyzer(spark, [str(root / "target.exe")]).analyze().matches is None
    assert DatabaseBuilder(spark).build().db.count() == 0


def test_disassembly_makes_no_guids(spark, folder, monkeypatch):
    from namewright.operators import blocks

    monkeypatch.setattr(blocks, "normalised", lambda *_: pytest.fail("GUIDs of functions nobody asked for"))
    t = pe.tables(pe.analysed(discovery.files(spark, [str(folder[0] / "target.exe")])))
    assert disassembly(t.instructions, t.blocks).count() > 10


def test_command_line(spark, folder, tmp_path, capsys):
    root, _, _ = folder
    db, out = str(tmp_path / "names.fold"), str(tmp_path / "dump.json")
    assert main(["gen-db", "-e", str(root / "deep"), "-d", db], spark) == 0
    assert main(["dump-db", "-d", db, "-o", out], spark) == 0
    dumped = json.load(open(out))
    assert len(dumped) == 5 and all(len(d["function"]) == 36 and d["constraints"] for d in dumped)
    assert main(["dump-db", "-d", db, "-o", out, "-f", "00000000-0000-0000-0000-000000000001"], spark) == 0
    assert json.load(open(out)) == [{"function": "00000000-0000-0000-0000-000000000001", "constraints": []}]
    assert main(["analyze", "--exe", str(root / "target.exe"), "--database", db, "--generate-pdb"], spark) == 0
    said = capsys.readouterr().out
    assert "5 of 6 functions named" in said and os.path.exists(root / "target.pdb")
    with pytest.raises(SystemExit):
        main(["analyze", "--exe", "x", "--generate-pdb"], spark)


def test_stream(spark, tmp_path):
    functions = spark.createDataFrame([("x", 1, A), ("x", 2, C), ("x", 3, B)], "binary_id string, address long, guid string")
    functions.write.parquet(str(tmp_path / "in"))
    db = spark.createDataFrame([(A, "0" * 32, "one"), (B, "0" * 32, "two"), (B, "0" * 32, "three")], fold.SCHEMA)
    stream = spark.readStream.schema(functions.schema).parquet(str(tmp_path / "in"))
    query = name_stream(stream, db, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("x", 1, A, "one")]


def test_stream_of_functions_with_constraints(spark, tmp_path):
    functions = spark.createDataFrame([("x", 1, A, [B, C]), ("x", 2, A, [C]), ("x", 3, A, None), ("x", 4, B, [])], "binary_id string, address long, guid string, constraints array<string>")
    functions.write.parquet(str(tmp_path / "in"))
    db = spark.createDataFrame([*[(A, "0" * 32, n) for n in "abc"], (A, B, "a"), (A, B, "b"), (A, C, "b"), (A, C, "c"), (B, "0" * 32, "z")], fold.SCHEMA)
    stream = spark.readStream.schema(functions.schema).parquet(str(tmp_path / "in"))
    name_stream_by_constraints(stream, db, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    got = {(r.address, r.symbol_name, r.tier) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "b", "intersection"), (4, "z", "nil")}


def test_options_and_exports(spark, folder):
    import namewright

    root, _, moved = folder
    said = io.StringIO()
    options = namewright.AnalysisOptions(max_rounds=2).with_progress(namewright.Text(said))
    result = namewright.Analyzer(spark, [str(root / "target.exe")], options=options).analyze()
    addresses = [r.address for r in result.in_order().collect()]
    assert addresses == sorted(addresses) and moved["main"] in addresses and "analyze" in said.getvalue()
    assert all(getattr(namewright, n) for n in namewright.__all__)
    with pytest.raises(AttributeError):
        namewright.nothing


def test_bar():
    from namewright.plans.progress import Bar

    bar = Bar(io.StringIO())
    bar.start("work", 4)
    bar.done = 1
    assert bar.line(2.0, "x") == "work [00:00:02] [" + "#" * 10 + "-" * 30 + "] 1/4 (0.5/s, 00:00:06) x"
    bar.step("y")
    bar.finish()
    assert "2/4" in bar.out.getvalue()
