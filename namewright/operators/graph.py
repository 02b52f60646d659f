"""Reachability in the call graph, and families of chained unwind rows.

Loops are semi-naive: only newly reached rows are joined with the edges, and
each step is written and read back, so plans stay short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.session import cut

#: Steps after which what was reached so far is written as one table.
COMPACT = 8


def reachable(roots: DataFrame, calls: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Functions (binary_id, address) reached from roots over calls(binary_id, caller, target).

    failed(binary_id, address): functions that cannot be analysed are not reached
    and lead nowhere. Cycles end; roots need no edge.
    """
    edges = calls.select("binary_id", F.col("caller").alias("address"), F.col("target").alias("next")).dropna().distinct()
    key = ["binary_id", "address"]
    if failed is not None:
        roots = roots.join(failed.select(*key), key, "left_anti")
        edges = edges.join(failed.select("binary_id", F.col("address").alias("next")), ["binary_id", "next"], "left_anti")
    edges = cut(edges)
    front = cut(roots.select(*key).dropna().distinct())
    seen, steps = front, 0
    while not front.isEmpty():
        step = front.join(edges, key).select("binary_id", F.col("next").alias("address")).distinct()
        front = cut(step.join(seen, key, "left_anti"))
        seen, steps = seen.unionByName(front), steps + 1
        if steps % COMPACT == 0:
            seen = cut(seen)  # a long path must not make a plan of as many branches
    return seen


def last_rows(rows: DataFrame) -> DataFrame:
    """Unwind rows (binary_id, ordinal, start, end, chained_start): of rows with one start, the last."""
    last = F.max_by(F.struct("end", "chained_start"), "ordinal").alias("r")
    return rows.groupBy("binary_id", "start").agg(last).select("binary_id", "start", "r.end", "r.chained_start")


def chain_roots(rows: DataFrame) -> DataFrame:
    """Starts that chain to nothing, those of parents without a row included.

    A row that chains to any start, its own included, is no root.
    """
    starts = rows.select("binary_id", "start").unionByName(rows.select("binary_id", F.col("chained_start").alias("start"))).dropna().distinct()
    children = rows.filter("chained_start IS NOT NULL").select("binary_id", "start")
    return starts.join(children, ["binary_id", "start"], "left_anti")


def chain_ranges(rows: DataFrame) -> DataFrame:
    """The range of each root with all its descendants: (binary_id, start, end), in order of start.

    Roots without an own row have no range, nor have their children one, nor
    have rows that chain in a circle.

    Pointers double: after k rounds each row knows its ancestor 2^k steps up or its
    root, so a chain of any depth d takes about log2(d) rounds. A round that finds
    no root for any row is the last, since what is left leads to none.
    """
    rows = cut(last_rows(rows))
    spans = rows.select("binary_id", F.col("start").alias("at"), "start", "end")
    done = spans.join(rows.filter("chained_start IS NULL").select("binary_id", "start"), ["binary_id", "start"], "left_semi").select("binary_id", "at", F.col("start").alias("root"))
    up = rows.filter("chained_start IS NOT NULL").select("binary_id", F.col("start").alias("at"), F.col("chained_start").alias("up"))
    while True:
        found = cut(up.join(done.select("binary_id", F.col("at").alias("up"), "root"), ["binary_id", "up"]).select("binary_id", "at", "root"))
        if found.isEmpty():
            break
        done = cut(done.unionByName(found))
        # Rows whose ancestor has found no root yet take over its pointer, others keep theirs; what leads to no row ends here.
        rest = up.join(found.select("binary_id", "at"), ["binary_id", "at"], "left_anti")
        ahead = rest.select("binary_id", "at", "up").unionByName(found.select("binary_id", "at", F.col("at").alias("up"))).toDF("binary_id", "up", "far")
        up = cut(rest.join(ahead, ["binary_id", "up"]).select("binary_id", "at", F.col("far").alias("up")))
    family = done.join(spans.select("binary_id", "at", "end"), ["binary_id", "at"])
    return family.groupBy("binary_id", "root").agg(F.min("at").alias("start"), F.max("end").alias("end")).select("binary_id", "start", "end").orderBy("binary_id", "start")
