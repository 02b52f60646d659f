"""Naming functions by the database, round by round.

A function is named by its GUID alone if that has one name; else by a constraint
with one name, the least GUID where several disagree; else by the one name common
to all its constraints known to the database, if there are at least two. Names
found in a round make new constraints for the neighbours in the next; all reads
of a round see the state before it. A named function is left alone from then on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namewright.functions import guid as g
from namewright.operators.database import for_functions, summarised
from namewright.session import cut

KEY = ["binary_id", "address"]


def _nil(binary: bool) -> Column:
    return F.lit(bytes(16)) if binary else F.lit(g.NIL)


def _mask(half: int) -> Column:
    """Half of the 128 bits that stand for the constraints of a group: a set has all bits of those it holds."""
    hash_ = F.xxhash64("constraint_guid")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), hash_.bitwiseAND(63).cast("int"))
    return F.bit_or(F.when(hash_.bitwiseAND(64) == 64 * half, bit).otherwise(F.lit(0).cast("long")))


def tiers(hits: DataFrame, db: DataFrame, common: bool = True) -> DataFrame:
    """Names by tier for functions with hits(binary_id, address, function_guid, constraint_guid, n, only_symbol).

    Result: binary_id, address, nil_name, single_name, common_name, each null
    where the tier has none; the intersection is only taken for functions without
    a name from the tiers before, and not at all if common is false. A constraint
    that hits holds twice counts once.

    GUIDs are text or 16 bytes, the same in both tables; their orders agree.
    Functions with equal GUID and equal constraints ask the same question, which
    is answered once. A question meets the names of its smallest set only, and only
    those that may have all its constraints, by bits, leave that join; whether they
    do is then told by what each name holds. So the pairs of questions and names of
    their smallest sets, whose number grows faster than the tables, are never shuffled.
    """
    nil = F.col("constraint_guid") == _nil(isinstance(hits.schema["constraint_guid"].dataType, T.BinaryType))
    single = (F.col("n") == 1) & ~nil
    asked = hits.groupBy(*KEY, "function_guid").agg(
        F.max(F.when(nil, F.col("only_symbol"))).alias("nil_name"),
        F.min_by(F.when(single, F.col("only_symbol")), F.when(single, F.col("constraint_guid"))).alias("single_name"),
        F.sort_array(F.collect_set(F.when(~nil, F.col("constraint_guid")))).alias("seen"),
        F.min(F.when(~nil, F.struct("n", "constraint_guid"))).alias("least"),
    )
    if not common:
        return asked.select(*KEY, "nil_name", "single_name", F.lit(None).cast("string").alias("common_name"))
    asked = cut(asked)
    open_ = F.col("nil_name").isNull() & F.col("single_name").isNull() & (F.size("seen") >= 2)
    each = asked.filter(open_).groupBy("function_guid", "seen").agg(F.first("least.constraint_guid").alias("least"))
    each = each.select("function_guid", "seen", "least", F.explode("seen").alias("constraint_guid"))
    wanted = each.select("function_guid", "constraint_guid").distinct()
    held = db.join(wanted, ["function_guid", "constraint_guid"], "left_semi").groupBy("function_guid", "symbol")
    holders = cut(held.agg(F.collect_set("constraint_guid").alias("held"), _mask(0).alias("held0"), _mask(1).alias("held1")))
    questions = each.groupBy("function_guid", "seen").agg(F.first("least").alias("constraint_guid"), _mask(0).alias("seen0"), _mask(1).alias("seen1"))
    names = questions.join(holders.select("function_guid", "symbol", "held0", "held1", F.explode("held").alias("constraint_guid")), ["function_guid", "constraint_guid"])
    maybe = names.filter(" AND ".join(f"seen{i} & held{i} = seen{i}" for i in (0, 1))).select("function_guid", "seen", "symbol")
    answers = (
        maybe.join(holders.select("function_guid", "symbol", "held"), ["function_guid", "symbol"])
        .filter(F.size(F.array_except("seen", "held")) == 0)
        .groupBy("function_guid", "seen")
        .agg(F.count(F.lit(1)).alias("names"), F.min("symbol").alias("common_name"))
        .filter("names = 1")
        .drop("names")
    )
    # The answer of a question only goes to those that ask it: all others have a name, or too few constraints.
    joined = asked.withColumn("seen", F.when(open_, F.col("seen"))).join(answers, ["function_guid", "seen"], "left")
    return joined.select(*KEY, "nil_name", "single_name", "common_name")


@dataclass
class Matches:
    """named(binary_id, address, symbol_name, round, tier) and
    counts(binary_id, address, symbol_name, matched_constraints, total_constraints), one row a function."""

    named: DataFrame
    counts: DataFrame
    rounds: int


def match(functions: DataFrame, constraints: DataFrame, calls: DataFrame, db: DataFrame, max_rounds: int | None = None, progress=None) -> Matches:
    """Names for functions(binary_id, address, guid) with static constraints(binary_id, address, guid, a bag) and calls.

    matched_constraints: different constraints known to the database for the
    function's GUID; total_constraints: all constraints with repetitions, both as
    of the round that named the function, or the last one. Functions without GUID
    stay unnamed. Rounds end when one names nothing, or after max_rounds.

    The database is cut down to the GUIDs at hand first and its names are counted,
    so the first two tiers never spell out a set. A round looks only at unnamed functions
    next to newly named ones, and what it sees of them is written once: what
    earlier rounds saw stays where it was written. GUIDs travel as 16 bytes.
    """
    functions = cut(functions.select(*KEY, F.unhex("guid").alias("function_guid")))
    calls = cut(calls.select("binary_id", "caller", "target", "address"))
    db = cut(for_functions(db.select(F.unhex("function_guid").alias("function_guid"), F.unhex("constraint_guid").alias("constraint_guid"), "symbol"), functions))
    sums = cut(summarised(db))
    static = cut(constraints.select(*KEY, F.unhex("guid").alias("constraint_guid")).dropna().groupBy(*KEY, "constraint_guid").agg(F.count(F.lit(1)).alias("times")))
    known = functions.filter("function_guid IS NOT NULL")

    def hit(rows: DataFrame) -> DataFrame:
        return rows.join(known, KEY).join(sums, ["function_guid", "constraint_guid"])

    nil = known.select(*KEY, _nil(True).alias("constraint_guid"))
    hits = cut(hit(static.select(*KEY, "constraint_guid").unionByName(nil)))
    ends = F.array(F.struct(F.col("caller").alias("address"), F.col("target").alias("far"), F.lit("child").alias("side")), F.struct(F.col("target").alias("address"), F.col("caller").alias("far"), F.lit("parent").alias("side")))

    def seen(named: DataFrame, near: DataFrame) -> DataFrame:
        """A row for each call edge from near functions to a named one: the constraint its name makes, and the round it was named in."""
        far = named.select("binary_id", F.col("address").alias("far"), "round", g.symbol_calls(F.col("symbol_name")).alias("pair"))
        made = F.when(F.col("side") == "child", F.col("pair.child")).otherwise(F.col("pair.parent"))
        return calls.select("binary_id", F.inline(ends)).join(near.select(*KEY), KEY, "left_semi").join(far, ["binary_id", "far"]).select(*KEY, F.unhex(made).alias("constraint_guid"), "round")

    named, fresh, round_ = None, None, 0
    while max_rounds is None or round_ < max_rounds:
        round_ += 1
        if fresh is None:
            look = hits
        else:
            open_ = seen(fresh, known.join(named, KEY, "left_anti")).select(*KEY, "constraint_guid").distinct()
            new = cut(hit(open_))
            hits = hits.unionByName(new)
            look = hits.join(new.select(*KEY).distinct(), KEY, "left_semi")
        by_tier = tiers(look, db)
        name = F.coalesce("nil_name", "single_name", "common_name")
        tier = F.when(F.col("nil_name").isNotNull(), "nil").when(F.col("single_name").isNotNull(), "singleton").otherwise("intersection")
        fresh = cut(by_tier.select(*KEY, name.alias("symbol_name"), F.lit(round_).alias("round"), tier.alias("tier")).filter("symbol_name IS NOT NULL"))
        added = fresh.count()
        if progress:
            progress(round_, added)
        named = fresh if named is None else named.unionByName(fresh)
        if not added:
            break

    if named is None:
        named = functions.select(*KEY, F.lit(None).cast("string").alias("symbol_name"), F.lit(0).alias("round"), F.lit("").alias("tier")).limit(0)
    # Whatever was named in the first round has seen no names.
    later = functions.join(named.filter("round = 1"), KEY, "left_anti")
    return Matches(named, _counts(functions, static, named, seen(named, later), sums, round_), round_)


def _counts(functions: DataFrame, static: DataFrame, named: DataFrame, dynamic: DataFrame, sums: DataFrame, last: int) -> DataFrame:
    own = functions.join(named.select(*KEY, "symbol_name", F.col("round").alias("own_round")), KEY, "left").withColumn("own_round", F.coalesce("own_round", F.lit(last)))
    bag = static.select(*KEY, "constraint_guid", "times", F.lit(0).alias("round"))
    edges = dynamic.groupBy(*KEY, "constraint_guid", "round").agg(F.count(F.lit(1)).alias("times")).select(*KEY, "constraint_guid", "times", "round")
    visible = own.select(*KEY, "function_guid", "own_round").join(bag.unionByName(edges), KEY).filter("round < own_round")
    each = visible.groupBy(*KEY, "function_guid", "constraint_guid").agg(F.sum("times").alias("times"))
    in_db = sums.select("function_guid", "constraint_guid", F.lit(1).alias("hit"))
    per = each.join(in_db, ["function_guid", "constraint_guid"], "left").groupBy(*KEY).agg(F.count("hit").alias("matched_constraints"), F.sum("times").alias("total_constraints"))
    return own.select(*KEY, "symbol_name").join(per, KEY, "left").fillna(0, ["matched_constraints", "total_constraints"])


def summary(counts: DataFrame) -> DataFrame:
    """One row: functions and named functions."""
    return counts.agg(F.count(F.lit(1)).alias("functions"), F.count_if(F.col("symbol_name").isNotNull()).alias("matched"))
