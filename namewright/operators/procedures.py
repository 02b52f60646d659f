"""Procedures of symbol files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_producers(globals_: DataFrame, modules: list[DataFrame]) -> DataFrame:
    """Symbols of the global stream (producer 0), then of each module in order (1, 2, ...)."""
    parts = [p.withColumn("producer_idx", F.lit(i)) for i, p in enumerate([globals_, *modules])]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def procedures(symbols: DataFrame) -> DataFrame:
    """Symbols that are procedures with a known address."""
    return symbols.filter((F.col("kind") == "proc") & F.col("rva").isNotNull()).drop("kind")


def first_names(symbols: DataFrame) -> DataFrame:
    """One name an address: of the first producer, then the first symbol.

    symbols(binary_id, address, producer_idx, symbol_idx, name). Null names take
    part, as the first symbol of an address decides; equal places are decided by
    the least name. A min over structs: no window, and it combines on the map side.
    """
    first = F.min(F.struct("producer_idx", "symbol_idx", "name")).alias("f")
    return symbols.groupBy("binary_id", "address").agg(first).select("binary_id", "address", F.col("f.name").alias("name"))
