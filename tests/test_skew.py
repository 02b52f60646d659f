import math
import random

from pyspark.sql import functions as F

from namewright.operators import skew


def brute(rows, probs):
    by = {}
    for k, v in rows:
        if k is not None:
            by.setdefault(k, []).append(v)
    out = {}
    for k, vs in by.items():
        known = sorted(v for v in vs if v is not None and v == v)
        out[k] = (len(vs), len(known), *[known[max(1, math.ceil(p * len(known))) - 1] if known else None for p in probs])
    return out


def check(spark, rows, kind, probs=(0.0, 0.5, 0.95, 1.0), **more):
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in rows], f"key string, value {kind}, n int, c int")
    got = {r[0]: tuple(r[1:]) for r in skew.key_quantiles(df, "key", "value", probs, **more).collect()}
    assert got == brute(rows, probs)


def test_heavy_keys(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randrange(-(2**62), 2**62)) for _ in range(3000)] + [("ties", rng.choice([5, 5, 5, 9])) for _ in range(2000)]
    rows += [(f"k{i % 700}", rng.choice([None, i])) for i in range(3000)] + [(None, 3)] * 50 + [("none", None)] * 30
    check(spark, rows, "long", share=0.01, bins=4)
    check(spark, rows, "long")


def test_doubles(spark):
    rng = random.Random(2)
    rows = [("hot", rng.choice([rng.gauss(0, 1e300), float("nan"), None, 0.0, 1e-300])) for _ in range(2000)] + [("a", 1.5), ("a", None)]
    check(spark, rows, "double", share=0.1, bins=8)


def test_empty(spark):
    df = spark.createDataFrame([], "key string, value long")
    assert skew.key_quantiles(df, "key", "value").count() == 0
    assert skew.heavy_values(df, "value") == []


def test_heavy_and_totals(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 7).when(F.col("id") < 420, None).otherwise(F.col("id")).cast("long").alias("k"), "id")
    heavy = skew.heavy_hashes(df, "k", share=0.1, floor=10)
    assert len(heavy) == 1
    totals = {"n": F.count(F.lit(1)), "top": F.max("id")}
    got = {tuple(r) for r in skew.with_totals(df, "k", totals, heavy).select("k", "id", "n", "top").collect()}
    assert got == {tuple(r) for r in skew.with_totals(df, "k", totals, []).select("k", "id", "n", "top").collect()}
    assert len(got) == 980 and (7, 3, 400, 399) in got


def test_several_columns_and_the_ceiling(spark, monkeypatch):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") + 10).alias("a"), F.when(F.col("id") % 2 == 0, 2).alias("b"), F.lit(None).cast("long").alias("c"))
    assert skew.heavy_values(df, "a", "b", "c", share=0.1, floor=10) == [[1], [2], []]
    assert skew.share_for(df, 1 / 8) == 1 / 8
    monkeypatch.setattr(skew, "CEILING", 100)
    assert skew.LEAST_SHARE <= skew.share_for(df, 1 / 8) < 1 / 8
    rng = random.Random(3)
    check(spark, [(f"k{i % 10}", rng.randrange(9)) for i in range(3000)], "long", share=0.5)


def test_nulls_only(spark):
    assert skew.heavy_values(spark.createDataFrame([(None,)] * 3, "v long"), "v", floor=1) == []
