"""Per-key results when a few keys hold most of the rows.

Nothing here gathers the rows of one key in one task. Heavy keys are few by
arithmetic (at most 1/share keys can hold a share of the rows each), so their
state may be broadcast; all other keys are small, so plain shuffles are even.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namewright.session import cut

#: A key with this share of the rows is heavy; there are at most 1/HEAVY of them.
HEAVY = 1 / 4096
#: Groups in which sketches are merged.
SKETCHES = 32
#: Fewer rows than this never make a key heavy: one task takes them easily.
FLOOR = 20_000
#: In tables where a share of the rows is more than this, keys of so many rows are heavy, too, ...
CEILING = 4_000_000
#: ... down to this share, which bounds how many there can be.
LEAST_SHARE = 1 / 65536


def share_for(df: DataFrame, share: float) -> float:
    """The share of df's rows that makes a key heavy: share, or less where that would be more than CEILING rows.

    The number of rows is taken from the optimizer's size of the table, at eight
    bytes a row: it need not be exact, since shares only route rows.
    """
    rows = max(1, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // 8)
    return min(share, max(LEAST_SHARE, CEILING / rows))


def heavy_values(df: DataFrame, *columns: str, share: float = HEAVY, floor: int = FLOOR) -> list:
    """Values of a column of whole numbers that hold at least about share of the rows, for routing only.

    With several columns a list for each of them, from the same scan.

    One scan with mergeable frequent-items sketches of fixed size, which are
    merged in groups first, so that no task reads one from every other. The
    estimate is off by less than half the share: a value just below it may be
    listed and one just above may not. Results never depend on the list, only
    the balance of the tasks. Nulls are no values. At most about 1/share values,
    most frequent first. An empty table gives an empty list.
    """
    share = share_for(df, share)
    tracked = min(1 << 20, max(64, 1 << (int(8 / share) - 1).bit_length()))
    names = [f"v{i}" for i in range(len(columns))]
    sketches = (
        df.select(*[F.col(c).cast("long").alias(v) for c, v in zip(columns, names)], (F.spark_partition_id() % SKETCHES).alias("part"))
        .groupBy("part")
        .agg(*[x for v in names for x in (F.count(v).alias(f"n_{v}"), F.expr(f"approx_top_k_accumulate({v}, {tracked}) FILTER (WHERE {v} IS NOT NULL)").alias(f"sketch_{v}"))])
    )
    found = []
    # One row for each group and column; grouped by a constant, so that no rows give no group, where the sketch of nothing would fail.
    each = sketches.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"n_{v}").alias("n"), F.col(f"sketch_{v}").alias("sketch")) for i, v in enumerate(names)]))).filter("n > 0")
    rows = each.groupBy("i").agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {tracked}), {min(tracked, int(1 / share) + 1)})").alias("top")).collect()  # one for each column
    by = {r.i: [x["item"] for x in r.top if x["count"] >= max(r.n * share, floor)] for r in rows}
    found = [by.get(i, []) for i in range(len(columns))]
    return found if len(columns) > 1 else found[0]


def heavy_hashes(df: DataFrame, column: str, share: float = HEAVY, floor: int = FLOOR) -> list[int]:
    """Hashes of the heavy values of a column of any type, for is_heavy()."""
    hashed = F.when(F.col(column).isNotNull(), F.xxhash64(F.col(column)))
    return heavy_values(df.select(hashed.alias("h")), "h", share=share, floor=floor)


def is_heavy(column: Column, hashes: list[int]) -> Column:
    """True where the value's hash is listed; two values with one hash are merely routed alike."""
    return F.xxhash64(column).isin(hashes) & column.isNotNull() if hashes else F.lit(False)


def is_any(column: Column, values: list) -> Column:
    """True where the column is one of the values; null is none of them."""
    return F.coalesce(column.isin(values), F.lit(False)) if values else F.lit(False)


def once(column: Column) -> Column:
    """The column, computed in the projection where it stands and not again in every filter after it."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def with_totals(df: DataFrame, key: str, totals: dict[str, Column], heavy: list[int]) -> DataFrame:
    """df with per-key aggregates as more columns; rows with a null key are dropped.

    heavy: what heavy_hashes() lists for the key.

    Keys that are not heavy: one shuffle by key and a window, which spills. Heavy
    keys: partial aggregation and a broadcast of at most len(heavy) rows, so that
    their rows stay where they are.
    """
    light = df.filter(F.col(key).isNotNull() & ~is_heavy(F.col(key), heavy))
    window = Window.partitionBy(key)
    out = light.select("*", *[c.over(window).alias(n) for n, c in totals.items()])
    if heavy:
        dense = df.filter(is_heavy(F.col(key), heavy))
        per_key = dense.groupBy(key).agg(*[c.alias(n) for n, c in totals.items()])
        out = out.unionByName(dense.join(F.broadcast(per_key), key).select(out.columns))
    return out


def key_quantiles(
    df: DataFrame,
    key: str,
    value: str,
    probs: tuple[float, ...] = (0.5,),
    *,
    share: float = 1 / 1024,
    bins: int = 256,
) -> DataFrame:
    """Rows, non-null values and exact quantiles of value for every key.

    Result: the key column, n (rows), n_values (rows with a value) and
    q0, q1, ... in the order of probs: the smallest value v such that at least
    ceil(p * n_values) rows of the key have a value <= v (p = 0 gives the least).
    Without values the quantiles are null. Null keys give no row; NaN counts as
    no value; repeated rows count each time. Columns besides key and value are
    ignored, whatever their names.

    Rows shrink first to (key, value) counts, which merge on the map side. Keys
    with less than share of the rows, and less than CEILING rows, take one shuffle by key and a running sum.
    Each heavier key keeps an interval per quantile, is counted into bins of it,
    and goes on with the bin that holds the rank, until the interval is a single
    value. Counts merge, so values of a heavy key are never brought together.
    """
    kind = df.schema[value].dataType
    whole = isinstance(kind, T.IntegralType)
    v = F.col(value).cast("long") if whole else F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    counts = cut(
        df.filter(F.col(key).isNotNull())
        .select(F.col(key).alias("k"), v.alias("v"))
        .groupBy("k", "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    totals = counts.groupBy("k").agg(
        F.sum("c").alias("n"),
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("c"))), F.lit(0)).alias("m"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
    )
    rows = counts.agg(F.sum("c")).first()[0] or 0
    # At most 1/share rows, or 1/LEAST_SHARE in tables where a share is more than CEILING rows, reach the driver.
    bar = min(rows * share, max(rows * LEAST_SHARE, CEILING))
    heavy = totals.filter((F.col("n") >= bar) & (F.col("m") > 0)).collect() if rows else []
    names = [f"q{i}" for i in range(len(probs))]
    rank = lambda p, m: F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * m)).cast("long")

    heavy_keys = [r.k for r in heavy]
    by_key = Window.partitionBy("k")
    running = by_key.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    has = F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)
    light = (
        counts.filter(~is_any(F.col("k"), heavy_keys))
        .select("k", "v", "c", F.sum(has).over(running).alias("upto"), F.sum(has).over(by_key).alias("m"))
        .groupBy("k")
        .agg(
            F.sum("c").alias("n"),
            F.max("m").alias("n_values"),
            *[F.min(F.when(F.col("upto") >= rank(p, F.col("m")), F.col("v"))).alias(q) for p, q in zip(probs, names)],
        )
    )
    if heavy:
        light = light.unionByName(_refine(counts, heavy, probs, bins, whole))
    return light.select(F.col("k").alias(key), "n", "n_values", *[F.col(q).cast(kind).alias(q) for q in names])


def _refine(counts: DataFrame, heavy: list, probs: tuple[float, ...], bins: int, whole: bool) -> DataFrame:
    """The heavy keys' rows of key_quantiles()."""
    spark = counts.sparkSession
    plain = lambda k: bytes(k) if isinstance(k, bytearray) else k
    kind = "long" if whole else "double"
    schema = T.StructType([
        T.StructField("k", counts.schema["k"].dataType),
        T.StructField("p", T.IntegerType()),
        *[T.StructField(x, T.LongType() if whole else T.DoubleType()) for x in ("lo", "hi")],
        T.StructField("rank", T.LongType()),
    ])
    open_ = [(plain(r.k), i, r.lo, r.hi, max(1, math.ceil(p * r.m))) for r in heavy for i, p in enumerate(probs)]
    done: dict = {}
    dense = counts.filter(is_any(F.col("k"), [r.k for r in heavy]) & F.col("v").isNotNull())
    # Exact differences for integers, halves for doubles: neither overflows.
    scale = (lambda c: c.cast("decimal(20,0)")) if whole else (lambda c: c * 0.5)
    while open_:
        done |= {(k, i): lo for k, i, lo, hi, _ in open_ if lo == hi}
        open_ = [x for x in open_ if x[2] != x[3]]
        if not open_:
            break
        state = spark.createDataFrame(open_, schema)
        width = (scale(F.col("hi")) - scale(F.col("lo"))).cast("double")
        at = (scale(F.col("v")) - scale(F.col("lo"))).cast("double") / width
        histogram = (
            dense.join(F.broadcast(state), "k")
            .filter(F.col("v").between(F.col("lo"), F.col("hi")))
            .withColumn("bin", F.least(F.floor(at * bins), F.lit(bins - 1)))
            .groupBy("k", "p", "rank", "bin")
            .agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        )
        upto = Window.partitionBy("k", "p").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        # One row for each key and quantile.
        chosen = (
            histogram.withColumn("upto", F.sum("c").over(upto))
            .filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
            .select("k", "p", F.col("lo").cast(kind), F.col("hi").cast(kind), F.col("rank") - (F.col("upto") - F.col("c")))
            .collect()
        )
        open_ = [(plain(r[0]), *r[1:]) for r in chosen]
    out = T.StructType([
        T.StructField("k", counts.schema["k"].dataType),
        T.StructField("n", T.LongType()),
        T.StructField("n_values", T.LongType()),
        *[T.StructField(f"q{i}", T.LongType() if whole else T.DoubleType()) for i in range(len(probs))],
    ])
    return spark.createDataFrame([(plain(r.k), r.n, r.m, *[done[plain(r.k), i] for i in range(len(probs))]) for r in heavy], out)
