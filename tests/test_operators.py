import random

import pytest
from pyspark.sql import functions as F

from namewright import session
from namewright.functions import guid as g
from namewright.operators import blocks, constraints, database, graph, matching, procedures, ranges
from namewright.plans import corpus

A, B, C, D = ("41" * 16, "42" * 16, "43" * 16, "44" * 16)
C1, C2 = "01" * 16, "02" * 16
BASE = 0x140000000


@pytest.fixture(scope="module")
def small_db(spark):
    return spark.createDataFrame([(A, B, "test_value_1"), (A, B, "test_value_3"), (A, C, "test_value_1"), (A, C, "test_value_2")], "function_guid string, constraint_guid string, symbol string")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup(spark, small_db, rows):
    assert rows(database.lookup_sets(small_db, A)) == [(B, ["test_value_1", "test_value_3"]), (C, ["test_value_1", "test_value_2"])]
    assert rows(database.lookup(small_db, D)) == []
    assert rows(database.flat(database.nested(small_db))) == rows(small_db)
    assert database.dump(small_db, D).first().json == '{"function":"44444444-4444-4444-4444-444444444444","constraints":[]}'
    assert rows(database.string_dictionary(small_db)) == [("test_value_1", 0), ("test_value_2", 1), ("test_value_3", 2)]
    assert rows(database.list_offsets(small_db)) == [(A, 2, 4, 0, 0)]
    assert rows(database.statistics(small_db, 3, 1)) == [(3, 1, 1, 0)]


def test_intersection_of_small_db(spark, small_db):
    functions = spark.createDataFrame([("x", 1, A)], "binary_id string, address long, guid string")
    seen = spark.createDataFrame([("x", 1, B), ("x", 1, C)], "binary_id string, address long, guid string")
    calls = spark.createDataFrame([], "binary_id string, caller long, target long, address long")
    assert matching.match(functions, seen, calls, small_db).counts.first().symbol_name == "test_value_1"


CASES = {
    "nil wins": ({g.NIL: "a"}, [], "a", 0, 0),
    "singleton": ({g.NIL: "ab", C1: "b"}, [C1], "b", 1, 1),
    "duplicates": ({g.NIL: "ab", C1: "b"}, [C1, C1], "b", 1, 2),
    "intersection": ({g.NIL: "abc", C1: "ab", C2: "bc"}, [C1, C2], "b", 2, 2),
    "one set only": ({g.NIL: "abc", C1: "ab", C2: "bc"}, [C1], None, 1, 1),
    "two survivors": ({g.NIL: "abc", C1: "ab", C2: "abc"}, [C1, C2], None, 2, 2),
    "no survivor": ({g.NIL: "abcd", C1: "ab", C2: "cd"}, [C1, C2], None, 2, 2),
    "not in the database": ({}, [C1], None, 0, 1),
    "conflict": ({g.NIL: "ab", C1: "a", C2: "b"}, [C1, C2], "a", 2, 2),
}


def test_tiers(spark):
    functions, seen, db, expected = [], [], [], {}
    for i, (sets, observed, name, matched, total) in enumerate(CASES.values()):
        guid = f"{i:032x}"[::-1]
        functions.append(("x", i, guid))
        seen += [("x", i, c) for c in observed]
        db += [(guid, c, s) for c, names in sets.items() for s in names]
        expected[i] = (name, matched, total)
    functions = spark.createDataFrame(functions, "binary_id string, address long, guid string")
    seen = spark.createDataFrame(seen, "binary_id string, address long, guid string")
    db = spark.createDataFrame(db, "function_guid string, constraint_guid string, symbol string")
    calls = spark.createDataFrame([], "binary_id string, caller long, target long, address long")
    got = {r.address: (r.symbol_name, r.matched_constraints, r.total_constraints) for r in matching.match(functions, seen, calls, db).counts.collect()}
    assert got == expected
    shuffled = matching.match(functions.orderBy(F.rand(3)), seen.orderBy(F.rand(4)), calls, db).counts
    assert {r.address: r.symbol_name for r in shuffled.collect()} == {k: v[0] for k, v in expected.items()}


def test_feedback(spark):
    functions = spark.createDataFrame([("x", 1, A), ("x", 2, B)], "binary_id string, address long, guid string")
    calls = spark.createDataFrame([("x", 1, 2, 5)], "binary_id string, caller long, target long, address long")
    parent = spark.range(1).select(g.symbol_parent_call(F.lit("main")).alias("x")).first().x
    db = spark.createDataFrame([(A, g.NIL, "main"), (B, g.NIL, "x"), (B, g.NIL, "y"), (B, parent, "x")], "function_guid string, constraint_guid string, symbol string")
    found = matching.match(functions, constraints.static_constraints(functions, calls), calls, db)
    got = {r.address: tuple(r)[2:] for r in found.counts.collect()}
    assert got == {1: ("main", 0, 1), 2: ("x", 1, 2)} and found.rounds == 3
    rounds = {r.address: r["round"] for r in found.named.collect()}
    assert rounds == {1: 1, 2: 2}
    assert matching.summary(found.counts).first() == (2, 2)


def test_empty_database(spark):
    functions = spark.createDataFrame([("x", 1, A), ("x", 2, None)], "binary_id string, address long, guid string")
    calls = spark.createDataFrame([], "binary_id string, caller long, target long, address long")
    db = spark.createDataFrame([], "function_guid string, constraint_guid string, symbol string")
    counts = matching.match(functions, constraints.static_constraints(functions, calls), calls, db).counts
    assert {tuple(r) for r in counts.collect()} == {("x", 1, None, 0, 0), ("x", 2, None, 0, 0)}


def test_failed_callees(spark, rows):
    functions = spark.createDataFrame([("x", 1, A), ("x", 2, B), ("x", 3, C)], "binary_id string, address long, guid string")
    calls = spark.createDataFrame([("x", 1, 9, 5), ("x", 2, 1, 6)], "binary_id string, caller long, target long, address long")
    assert rows(constraints.analysed(functions, calls).select("address")) == [(2,), (3,)]


def test_recursive_call_constrains_itself_twice(spark):
    functions = spark.createDataFrame([("x", 1, A)], "binary_id string, address long, guid string")
    calls = spark.createDataFrame([("x", 1, 1, 5)], "binary_id string, caller long, target long, address long")
    found = constraints.static_constraints(functions, calls).collect()
    assert {(r.address, r.off, r.kind) for r in found} == {(1, 4, "child_call"), (1, 4, "parent_call")}


@pytest.mark.parametrize("roots, failed, expected", [([1], [], {1, 2, 3}), ([1, 5], [], {1, 2, 3, 5, 6}), ([1, 5], [6], {1, 2, 3, 5}), ([], [], set())])
def test_reachable(spark, roots, failed, expected):
    edges = spark.createDataFrame([("x", a, b) for a, b in ((1, 2), (2, 3), (3, 1), (5, 6))], "binary_id string, caller long, target long")
    of = lambda xs: spark.createDataFrame([("x", a) for a in xs], "binary_id string, address long")
    assert {r.address for r in graph.reachable(of(roots), edges, of(failed)).collect()} == expected


def test_chained_rows(spark, rows):
    data = [(0x1000, 0x1100, None), (0x1100, 0x1180, 0x1000), (0x1180, 0x1200, 0x1100), (0x2000, 0x2040, None), (0x3000, 0x3010, 0x9999), (0x4000, 0x4010, 0x4000)]
    df = spark.createDataFrame([("x", i, *r) for i, r in enumerate(data)], "binary_id string, ordinal long, start long, end long, chained_start long")
    assert rows(graph.chain_ranges(df)) == [("x", 0x1000, 0x1200), ("x", 0x2000, 0x2040)]


def test_later_unwind_row_wins(spark, rows):
    df = spark.createDataFrame([("x", 0, 1, 5, None), ("x", 1, 1, 9, None)], "binary_id string, ordinal long, start long, end long, chained_start long")
    assert rows(graph.chain_ranges(df)) == [("x", 1, 9)]


def test_sections(spark):
    sections = spark.createDataFrame(
        [("x", 1, ".text", 0x1000, 0x500, 0x500, 0x400, 0x60000020), ("x", 2, ".rdata", 0x2000, 0x300, 0x300, 0x900, 0x40000040), ("x", 3, ".data", 0x3000, 0x100, 0x100, 0xC00, 0xC0000040)],
        "binary_id string, idx int, name string, virtual_address long, virtual_size long, size_of_raw_data long, pointer_to_raw_data long, characteristics long",
    )
    addresses = [0x140001000, 0x1400014FF, 0x140001500, 0x140002010, 0x140003050]
    df = spark.createDataFrame([("x", a - BASE) for a in addresses], "binary_id string, rva long")
    held = {r.rva + BASE: r.writable for r in ranges.with_writable(df, sections).collect()}
    assert held == dict(zip(addresses, [False, False, False, False, True]))
    names = {r.rva + BASE: r.section_name for r in ranges.by_section(df, sections).collect()}
    assert names == {0x140001000: ".text", 0x1400014FF: ".text", 0x140002010: ".rdata", 0x140003050: ".data"}
    offsets = {r.rva + BASE: (r.file_offset, r.error) for r in ranges.file_offsets(df, sections).collect()}
    assert offsets[0x140001500] == (None, "not mapped") and offsets[0x140002010] == (0x910, None)


@pytest.mark.parametrize(
    "bounds, last, expected",
    [
        ([(100, 1), (110, 1), (120, 0), (130, 1)], 140, [(100, 110), (110, 120), (130, 140)]),
        ([(100, 1), (110, 0), (110, 1)], 120, [(100, 110), (110, 120)]),
        ([(100, 1), (120, 1)], 120, [(100, 120)]),
    ],
)
def test_sweep(spark, rows, bounds, last, expected):
    df = spark.createDataFrame([("x", 100, a, k, last) for a, k in bounds], "binary_id string, entry_point long, addr long, kind int, max_address long")
    assert rows(blocks.sweep(df).select("start", "end")) == expected


def test_first_names(spark, rows):
    df = spark.createDataFrame([("x", 1, 2, 0, "b"), ("x", 1, 0, 5, "c"), ("x", 1, 0, 3, "a"), ("x", 2, 1, 1, None), ("x", 2, 1, 2, "z")], "binary_id string, address long, producer_idx int, symbol_idx int, name string")
    assert rows(procedures.first_names(df)) == [("x", 1, "a"), ("x", 2, None)]


def _hashes(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("sha1(")


def test_each_guid_is_hashed_once(spark):
    """Per function: two blocks and itself, two call constraints, the name and two of its constraints; per reference: its bytes."""
    folder = "/root/testdata/sf0.001"
    c = corpus.load(spark, folder)
    assert _hashes(c.functions) == 3
    assert _hashes(c.static()) == 3 + 2 + 1
    assert _hashes(constraints.distinct_constraints(c.labelled())) <= 3 + 2 + 3 + 1
    # The database joins the functions again for their own GUIDs.
    assert _hashes(corpus.reference_db(c)) == 2 * 3 + 3 + 2 + 3 + 1


def test_chains_of_any_depth_and_circles(spark, rows):
    data = [(i, i + 1, i - 1 if i else None) for i in range(70)] + [(100, 101, 102), (101, 102, 100), (102, 103, 101), (103, 104, 102), (200, 201, 199), (201, 202, 200)]
    df = spark.createDataFrame([("x", i, *r) for i, r in enumerate(data)], "binary_id string, ordinal long, start long, end long, chained_start long")
    assert rows(graph.chain_ranges(df)) == [("x", 0, 70)]


def test_reach_over_a_long_path(spark):
    edges = spark.createDataFrame([("x", i, i + 1) for i in range(12)], "binary_id string, caller long, target long")
    assert graph.reachable(spark.createDataFrame([("x", 0)], "binary_id string, address long"), edges).count() == 13


def test_instructions_in_blocks(spark, rows):
    spans = spark.createDataFrame([("x", 1, 0, 4), ("x", 1, 6, 8), ("y", 1, 0, 2)], "binary_id string, entry_point long, start long, end long")
    code = spark.createDataFrame([("x", 1, i, f"{i:02x}") for i in range(10)] + [("y", 1, 1, "ff"), ("z", 1, 1, "ee")], "binary_id string, entry_point long, ip long, code string")
    got = rows(blocks.within_blocks(code, spans, "code"))
    assert got == [("x", 1, 0, 4, i, f"{i:02x}") for i in range(4)] + [("x", 1, 6, 8, i, f"{i:02x}") for i in (6, 7)] + [("y", 1, 0, 2, 1, "ff")]


def test_scratch_is_deleted(spark):
    kept = session.cut(spark.range(3))
    with session.scratch():
        inner = session.cut(spark.range(4))
        path = inner.inputFiles()[0].rsplit("/", 1)[0]
        assert inner.count() == 4 and session.exists(spark, path)
    assert not session.exists(spark, path) and kept.count() == 3


def shuffled(df):
    """Rows that the plan of df shuffles when it runs; what cut() wrote before is not in it."""
    df.collect()
    total, open_ = 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            open_.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                total += node.metrics().apply("shuffleRecordsWritten").value()
            open_ += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_intersection_shuffles_no_pairs(spark, no_broadcast):
    # One body with 300 names; each of 12 constraints has about half of them, and 300 functions ask for four to six constraints.
    rng = random.Random(5)
    sets = {f"{c:032x}": {f"n{i}" for i in range(300) if rng.random() < 0.5} for c in range(1, 13)}
    asked = {a: rng.sample(sorted(sets), rng.choice([4, 5, 6, 7, 8])) for a in range(300)}
    db = spark.createDataFrame([(A, c, n) for c, names in sets.items() for n in names], "function_guid string, constraint_guid string, symbol string")
    hits = spark.createDataFrame([("x", a, A, c, len(sets[c]), None) for a, cs in asked.items() for c in cs], "binary_id string, address long, function_guid string, constraint_guid string, n long, only_symbol string")
    found = matching.tiers(hits, db)
    expected = {a: next(iter(n)) if len(n) == 1 else None for a, cs in asked.items() for n in [set.intersection(*[sets[c] for c in cs])]}
    assert sum(n is not None for n in expected.values()) > 20
    assert {r.address: r.common_name for r in found.collect()} == expected
    # A pair of a question and a name of its smallest set for each of its constraints would be some 200,000.
    assert shuffled(found) < 40_000
