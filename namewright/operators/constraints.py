"""Constraints of functions: what they call, who calls them, what data they read.

functions(binary_id, address, guid, ...), calls(binary_id, caller, address,
target) with address the call site, labels(binary_id, address, name),
data_refs(binary_id, entry_point, address, target, is_readonly, estimated_size,
bytes_hex). Every operator gives (binary_id, address, guid, off, kind), a bag:
one row a site. Joins are on (binary_id, address); a callee that everybody calls
makes a skewed partition of calls, which adaptive execution splits, since the
other side has one row for each function. Null keys join nothing; empty tables
give empty results; columns besides those named are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewright.functions import guid as g
from namewright.operators.skew import once


COLUMNS = ["binary_id", "address", "guid", "off", "kind"]


def _edges(calls: DataFrame, *sides: str) -> DataFrame:
    """Calls seen from their ends: address is the near end, far the other, off from the caller's start.

    side 'child' has the caller near, 'parent' the callee; both sides come from one pass over calls.
    """
    near = {"child": ("caller", "target"), "parent": ("target", "caller")}
    ends = F.array(*[F.struct(F.col(n).alias("address"), F.col(f).alias("far"), F.lit(s).alias("side")) for s in sides for n, f in [near[s]]])
    off = (F.col("address") - F.col("caller")).cast("long").alias("off")
    return calls.select("binary_id", off, F.inline(ends))


def _joined(edges: DataFrame, made: DataFrame) -> DataFrame:
    """Constraints on the near ends of edges by made(binary_id, far, made): an array of (kind, side, guid) for each far end.

    What a function or a name makes is hashed once for each function, before the join, not once for each call.
    """
    joined = edges.join(made, ["binary_id", "far"])
    mine = F.filter("made", lambda m: m["side"] == F.col("side"))
    return joined.select("binary_id", "address", "off", F.inline(F.transform(mine, lambda m: F.struct(m["guid"].alias("guid"), m["kind"].alias("kind"))))).select(*COLUMNS)


def _made(pairs: Column, prefix: str, *sides: str) -> Column:
    return F.array(*[F.struct(F.lit(f"{prefix}{s}_call").alias("kind"), F.lit(s).alias("side"), pairs[s].alias("guid")) for s in sides])


def _by_guid(functions: DataFrame, *sides: str) -> DataFrame:
    rows = functions.select("binary_id", F.col("address").alias("far"), g.function_calls(F.col("guid")).alias("pair"))
    return rows.select("binary_id", "far", _made(F.col("pair"), "", *sides).alias("made"))


def _by_name(labels: DataFrame, *sides: str) -> DataFrame:
    rows = labels.select("binary_id", F.col("address").alias("far"), g.symbol_calls(F.col("name")).alias("pair"))
    return rows.select("binary_id", "far", _made(F.col("pair"), "symbol_", *sides).alias("made"))


def child_calls(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """One row a call of a known function, on the caller."""
    return _joined(_edges(calls, "child"), _by_guid(functions, "child"))


def parent_calls(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """One row a call by a known function, on the callee."""
    return _joined(_edges(calls, "parent"), _by_guid(functions, "parent"))


def symbol_child_calls(labels: DataFrame, calls: DataFrame) -> DataFrame:
    """One row a call of a named function, on the caller."""
    return _joined(_edges(calls, "child"), _by_name(labels, "child"))


def symbol_parent_calls(labels: DataFrame, calls: DataFrame) -> DataFrame:
    """One row a call by a named function, on the callee."""
    return _joined(_edges(calls, "parent"), _by_name(labels, "parent"))


def data_constants(data_refs: DataFrame) -> DataFrame:
    """One row a reference to constant bytes: read-only, of no known size, and readable as a string.

    bytes_hex is null where no string could be read.
    """
    usable = data_refs.filter("is_readonly AND estimated_size IS NULL AND bytes_hex IS NOT NULL")
    placed = usable.select("binary_id", F.col("entry_point").alias("address"), (F.col("address") - F.col("entry_point")).alias("off"), "bytes_hex")
    return placed.select("binary_id", "address", once(g.data_const(F.col("bytes_hex"))).alias("guid"), F.col("off").cast("long"), F.lit("data_const").alias("kind"))


def analysed(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions without those that call something that could not be analysed.

    failed callees are targets of calls with no row in functions; callers of such
    are dropped once, callers of those are not.
    """
    known = functions.select("binary_id", F.col("address").alias("target"))
    failed = calls.join(known, ["binary_id", "target"], "left_anti").select("binary_id", F.col("caller").alias("address")).distinct()
    return functions.join(failed, ["binary_id", "address"], "left_anti")


def union(*parts: DataFrame) -> DataFrame:
    """The bag of several kinds of constraints."""
    return reduce(DataFrame.unionByName, parts)


def distinct_constraints(constraints: DataFrame) -> DataFrame:
    """Each constraint once for each function."""
    return constraints.select("binary_id", "address", "guid").filter("guid IS NOT NULL").distinct()


def static_constraints(functions: DataFrame, calls: DataFrame, data_refs: DataFrame | None = None) -> DataFrame:
    """What is known of functions without any name: child and parent calls and data."""
    linked = _joined(_edges(calls, "child", "parent"), _by_guid(functions, "child", "parent"))
    return union(linked, *([data_constants(data_refs)] if data_refs is not None else []))


def labelled_constraints(functions: DataFrame, labels: DataFrame, calls: DataFrame, data_refs: DataFrame | None = None) -> DataFrame:
    """What is known of named functions: the static constraints, and names on either side of calls.

    Both ends of calls and all four kinds come from one join.
    """
    sides = ("child", "parent")
    nothing = F.array().cast("array<struct<kind:string,side:string,guid:string>>")
    both = _by_guid(functions, *sides).withColumnRenamed("made", "own").join(_by_name(labels, *sides).withColumnRenamed("made", "named"), ["binary_id", "far"], "full")
    made = both.select("binary_id", "far", F.concat(F.coalesce("own", nothing), F.coalesce("named", nothing)).alias("made"))
    linked = _joined(_edges(calls, *sides), made)
    return union(linked, *([data_constants(data_refs)] if data_refs is not None else []))
