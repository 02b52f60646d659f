import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from namewright.functions import guid as g

ONE_BLOCK = "426ec51572205888a717a8955e4a0662"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "column, expected",
    [
        (lambda: g.symbol_guid(F.lit("main")), "2f1a3d25566152b5a4a6b7dfe5eb8c52"),
        (lambda: g.symbol_child_call(F.lit("main")), "05c6a014cfda51028787a77e837ef425"),
        (lambda: g.symbol_parent_call(F.lit("main")), "33a3b26e5b255fda8b0cd8211184af66"),
        (lambda: g.block_guid(F.lit("8bff0000000000c3")), "408a77fa2b745b528d3fbb68314d329d"),
        (lambda: g.block_guid(F.lit("")), "24cedfce2b125056b1a738064b22ccc7"),
        (lambda: g.function_guid(F.lit("408a77fa2b745b528d3fbb68314d329d")), ONE_BLOCK),
        (lambda: g.function_guid(F.lit("408a77fa2b745b528d3fbb68314d329d24cedfce2b125056b1a738064b22ccc7")), "a2a646dba64a59d698058c205083c9af"),
        (lambda: g.child_call(F.lit(ONE_BLOCK)), "0b82b6da900c565bbd4bf0940ddf4bc6"),
        (lambda: g.parent_call(F.lit(ONE_BLOCK)), "1f1533de3a545164a4eb41df5120125b"),
        (lambda: g.data_const(F.lit("68656c6c6f")), "deb3a23d424a5363bd388061a84cec70"),
        (lambda: g.dashed(F.lit(ONE_BLOCK)), "426ec515-7220-5888-a717-a8955e4a0662"),
    ],
)
def test_vectors(spark, column, expected):
    assert value(spark, column()) == expected


@settings(max_examples=5, deadline=None)
@given(texts=st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_as_the_standard_library(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", g.symbol_guid(F.col("t")).alias("x"))
    space = uuid.UUID(hex=g.NAMESPACES["symbol"])
    assert all(r.x == uuid.uuid5(space, r.t).hex for r in df.collect())


def test_spellings(spark):
    plain = "0e09be0fc6f859259e2a3a94f56d3efb"
    dashed = str(uuid.UUID(plain))
    same = [plain, plain.upper(), dashed, "{" + dashed.upper() + "}", plain + " ", " ".join(plain), "urn:uuid:" + dashed]
    none = [None, "", "0" * 32, str(uuid.UUID(int=0)), plain[:-1], plain + "0", "x" * 32]
    df = spark.createDataFrame([(t,) for t in same + none], "t string")
    got = [r.x for r in df.select(g.guid_hex(g.guid_bytes(F.col("t"))).alias("x")).collect()]
    assert got == [plain] * len(same) + [None] * len(none)


def test_numbers(spark):
    from namewright.functions.numbers import parse_number

    cases = {"0x1F": 31, "31": 31, " 0X00ff ": 255, "0x": None, "0xzz": None, "x": None, "": None, "0x7fffffffffffffff": 2**63 - 1, "0xffffffffffffffff": None, "0x" + "0" * 40 + "1": 1, "-5": -5, "0x" + "f" * 30: None}
    df = spark.createDataFrame([*[(t,) for t in cases], (None,)], "t string")
    assert [r.x for r in df.select(parse_number(F.col("t")).alias("x")).collect()] == [*cases.values(), None]
