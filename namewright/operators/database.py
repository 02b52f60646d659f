"""The name database: which names go with a function GUID and a constraint GUID.

db(function_guid, constraint_guid, symbol) is flat and distinct; the nil
constraint stands for the function GUID alone. Aggregates of it combine on the
map side, so a stub body with millions of names costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namewright.functions.guid import NIL
from namewright.operators.skew import once


def build(labelled: DataFrame, constraints: DataFrame) -> DataFrame:
    """db of labelled(binary_id, address, guid, name) with constraints(binary_id, address, guid).

    Every named function also gives the nil constraint. Rows without guid or name
    give nothing.
    """
    named = labelled.select("binary_id", "address", once(F.col("guid")).alias("function_guid"), F.col("name").alias("symbol")).dropna()
    own = named.select("function_guid", F.lit(NIL).alias("constraint_guid"), "symbol")
    seen = constraints.select("binary_id", "address", F.col("guid").alias("constraint_guid")).dropna()
    linked = named.join(seen, ["binary_id", "address"]).select("function_guid", "constraint_guid", "symbol")
    return own.unionByName(linked).distinct()


def summarised(db: DataFrame) -> DataFrame:
    """n names for each function and constraint, and the name where it is the only one."""
    n = F.count(F.lit(1))
    return db.groupBy("function_guid", "constraint_guid").agg(n.alias("n"), F.when(n == 1, F.min("symbol")).alias("only_symbol"))


def nested(db: DataFrame) -> DataFrame:
    """One row a function: constraints in order of GUID, each with its names in order."""
    lists = db.groupBy("function_guid", "constraint_guid").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))
    pair = F.struct(F.col("constraint_guid").alias("constraint"), "symbols")
    return lists.groupBy(F.col("function_guid").alias("function")).agg(F.sort_array(F.collect_list(pair)).alias("constraints"))


def flat(nested_db: DataFrame) -> DataFrame:
    """db again from nested rows."""
    rows = nested_db.select(F.col("function").alias("function_guid"), F.explode("constraints").alias("c"))
    return rows.select("function_guid", F.col("c.constraint").alias("constraint_guid"), F.explode("c.symbols").alias("symbol"))


def functions(db: DataFrame) -> DataFrame:
    """The function GUIDs in order."""
    return db.select("function_guid").distinct().orderBy("function_guid")


def lookup(db: DataFrame, function_guid: str) -> DataFrame:
    """The constraints and names of one function; an unknown one has none."""
    return db.filter(F.col("function_guid") == function_guid).select("constraint_guid", "symbol")


def lookup_sets(db: DataFrame, function_guid: str) -> DataFrame:
    """lookup() with the names of a constraint as one ordered set."""
    return lookup(db, function_guid).groupBy("constraint_guid").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))


def for_functions(db: DataFrame, guids: DataFrame) -> DataFrame:
    """The part of db about the functions at hand, guids(function_guid)."""
    return db.join(guids.select("function_guid").distinct(), "function_guid", "left_semi")


def statistics(db: DataFrame, processed_files: int, failed_files: int = 0) -> DataFrame:
    """One row: processed and failed files, distinct functions, constraints with one name."""
    groups = summarised(db)
    return groups.agg(
        F.lit(processed_files).cast("long").alias("processed_files"),
        F.lit(failed_files).cast("long").alias("failed_files"),
        F.countDistinct("function_guid").alias("unique_functions"),
        F.count_if(F.col("n") == 1).alias("unique_constraints"),
    )


def dump(db: DataFrame, function_guid: str | None = None) -> DataFrame:
    """JSON text of one object a function, in order; a function asked for and unknown has no constraints."""
    from namewright.functions.guid import dashed

    rows = nested(db if function_guid is None else db.filter(F.col("function_guid") == function_guid))
    if function_guid is not None:
        asked = db.sparkSession.createDataFrame([(function_guid,)], "function string")
        rows = asked.join(rows, "function", "left")
    shown = F.transform(
        F.coalesce("constraints", F.array().cast("array<struct<constraint:string,symbols:array<string>>>")),
        lambda c: F.struct(dashed(c["constraint"]).alias("constraint"), c["symbols"].alias("symbols")),
    )
    return rows.select("function", F.to_json(F.struct(dashed(F.col("function")).alias("function"), shown.alias("constraints"))).alias("json")).orderBy("function")


def _numbered(values: DataFrame, column: str, name: str, size: int = 1 << 20) -> DataFrame:
    """Distinct values numbered from 0 in order, without one task sorting them all.

    Values are sorted by range; counts of the partitions, one row each, give the
    number at which a partition begins.
    """
    ranged = values.select(column).dropna().distinct().repartitionByRange(column).sortWithinPartitions(column)
    # monotonically_increasing_id() has the partition in its upper bits and counts rows below.
    placed = ranged.withColumn("_id", F.monotonically_increasing_id())
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    from namewright.session import cut

    placed = cut(placed.select(column, part.alias("_part"), row.alias("_row")))
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").select(column, (F.col("_start") + F.col("_row")).alias(name))


def string_dictionary(db: DataFrame) -> DataFrame:
    """Each name with its number, in order."""
    return _numbered(db, "symbol", "id")


def constraint_dictionary(db: DataFrame) -> DataFrame:
    """Each constraint GUID with its number, in order."""
    return _numbered(db, "constraint_guid", "idx")


def list_offsets(db: DataFrame) -> DataFrame:
    """For each function, in order of GUID: constraints, names, and where both begin in flat lists."""
    sizes = db.groupBy("function_guid").agg(F.countDistinct("constraint_guid").alias("constraints"), F.count(F.lit(1)).alias("symbols"))
    # Sums before a row within ranges of GUIDs by first two digits, then over the at most 256 ranges.
    bucket = F.substring("function_guid", 1, 2)
    inside = Window.partitionBy("bucket").orderBy("function_guid").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("bucket", bucket)
    whole = rows.groupBy("bucket").agg(F.sum("constraints").alias("c"), F.sum("symbols").alias("s"))
    starts = whole.select("bucket", *[F.coalesce(F.sum(x).over(upto), F.lit(0)).alias(f"{x}0") for x in "cs"])
    begin = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    placed = rows.select("*", begin("constraints").alias("c1"), begin("symbols").alias("s1")).join(F.broadcast(starts), "bucket")
    return placed.select("function_guid", "constraints", "symbols", (F.col("c0") + F.col("c1")).alias("constraint_offset"), (F.col("s0") + F.col("s1")).alias("symbol_offset"))
