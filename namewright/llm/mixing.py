"""A training mix whose sources reach target shares of its size.

Documents are aggregated by the set of sources they belong to. Token capacity
flows from these patterns to the sources' quotas at least cost, a further
repetition costing more than the one before; the flows then become repetitions
of documents in a seeded order. All amounts are whole tokens.
"""

from __future__ import annotations

import math
import sys
from collections import deque
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namewright.session import cut


class _Network:
    """Patterns, sources and what each pattern gives each of its sources."""

    def __init__(self, capacity: dict[tuple[str, ...], int], quota: dict[str, int], repeats: dict[str, int]) -> None:
        self.patterns, self.sources = sorted(p for p in capacity if capacity[p] > 0), sorted(quota)
        number = {s: i for i, s in enumerate(self.sources)}
        self.tokens = [capacity[p] for p in self.patterns]
        self.of = [[number[s] for s in p] for p in self.patterns]
        self.repeats = [repeats[s] for s in self.sources]
        self.most = [sum(self.repeats[s] for s in own) for own in self.of]
        self.given = [[0] * len(own) for own in self.of]
        self.used = [0] * len(self.patterns)
        self.missing = [quota[s] for s in self.sources]
        self.level = 0
        self.held: list[list[tuple[int, int]]] = [[] for _ in self.sources]
        for p, own in enumerate(self.of):
            for j, s in enumerate(own):
                self.held[s].append((p, j))

    def free(self, p: int) -> int:
        """What a pattern has left of its uses up to the present level."""
        return min(self.level, self.most[p]) * self.tokens[p] - self.used[p]

    def layers(self) -> bool:
        """Steps from sources that miss something, against the flow; whether anything free is in reach."""
        self.near_s, self.near_p = [-1] * len(self.sources), [-1] * len(self.patterns)
        queue, found = deque(), -1
        for s, missing in enumerate(self.missing):
            if missing:
                self.near_s[s] = 0
                queue.append(s)
        while queue:
            s = queue.popleft()
            step = self.near_s[s]
            if 0 <= found <= step:
                break
            most = self.repeats[s]
            for p, j in self.held[s]:
                if self.near_p[p] < 0 and self.given[p][j] < most * self.tokens[p]:
                    self.near_p[p] = step + 1
                    if self.free(p) > 0:
                        found = step + 1
                    elif found < 0:
                        for other, amount in zip(self.of[p], self.given[p]):
                            if amount and self.near_s[other] < 0:
                                self.near_s[other] = step + 2
                                queue.append(other)
        return found >= 0

    def take(self, s: int, want: int) -> int:
        """Up to so many tokens more for a source."""
        got, held, most = 0, self.held[s], self.repeats[s]
        while self.next_s[s] < len(held):
            p, j = held[self.next_s[s]]
            if self.near_p[p] == self.near_s[s] + 1 and (room := min(most * self.tokens[p] - self.given[p][j], want - got)) > 0:
                more = self.draw(p, room)
                self.given[p][j] += more
                got += more
                if got == want:
                    return got
            self.next_s[s] += 1
        return got

    def draw(self, p: int, want: int) -> int:
        """Up to so many tokens from a pattern: free ones, then those of sources that find others instead."""
        got = min(self.free(p), want)
        self.used[p] += got
        own, given = self.of[p], self.given[p]
        while got < want and self.next_p[p] < len(own):
            k = self.next_p[p]
            if given[k] and self.near_s[own[k]] == self.near_p[p] + 1:
                more = self.take(own[k], min(given[k], want - got))
                given[k] -= more
                got += more
                if got == want:
                    return got
            self.next_p[p] += 1
        return got

    def fill(self) -> None:
        """Route as much as the present level admits, by blocking flows."""
        while self.layers():
            self.next_s, self.next_p = [0] * len(self.sources), [0] * len(self.patterns)
            for s, missing in enumerate(self.missing):
                if missing:
                    self.missing[s] -= self.take(s, missing)

    def state(self) -> tuple:
        return [list(g) for g in self.given], list(self.used), list(self.missing), self.level


def least_cost_flow(capacity: dict[tuple[str, ...], int], quota: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens routed from each pattern to each source.

    The n-th use of a pattern's documents costs n, so that repetitions spread
    evenly and first uses come first; a pattern gives a source at most repeats
    times its tokens. As much as can be routed is routed, at the least cost.

    What patterns can give together is a polymatroid and the cost is convex and the
    same for all of a level, so levels can be filled one after another: with n uses
    of each pattern admitted, an augmenting flow never takes back a use. Levels that
    are used up wholly are taken in strides that double, so many repeats cost few
    steps. All numbers are whole, so the result is exact.
    """
    net = _Network(capacity, quota, repeats)
    before, stride = sys.getrecursionlimit(), 1
    sys.setrecursionlimit(max(before, 4 * len(net.sources) + 1000))  # a path passes each source once
    try:
        while any(net.missing):
            # Patterns whose further uses would reach a source that misses something: those the last search met.
            wanted = [p for p in range(len(net.patterns)) if net.near_p[p] >= 0] if net.level else list(range(len(net.patterns)))
            wanted = [p for p in wanted if net.most[p] > net.level]
            if not wanted:
                break
            stride = min([stride, *[net.most[p] - net.level for p in wanted]])
            saved, used = net.state() if stride > 1 else None, sum(net.used)
            net.level += stride
            net.fill()
            whole = sum(net.used) - used == stride * sum(net.tokens[p] for p in wanted)
            if not whole and saved:
                net.given, net.used, net.missing, net.level = saved
                net.layers()
                stride //= 2
            elif whole:
                stride *= 2
    finally:
        sys.setrecursionlimit(before)
    return {(p, net.sources[s]): x for p, own, given in zip(net.patterns, net.of, net.given) for s, x in zip(own, given) if x}


@dataclass
class Mix:
    """plan(source, target_share, max_repeats, tokens, quota, routed, short), one row a listed source;
    chosen(id, source, repeats, tokens): the documents of the mix."""

    plan: DataFrame
    chosen: DataFrame

    def report(self) -> DataFrame:
        """plan with the tokens and the share that the chosen documents really reach."""
        got = self.chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed"))
        rows = self.plan.join(got, "source", "left").fillna({"mixed": 0})
        # One row for each listed source.
        whole = rows.groupBy().agg(F.sum("mixed").alias("all"))
        return rows.join(F.broadcast(whole)).withColumn("reached_share", F.when(F.col("all") > 0, F.col("mixed") / F.col("all"))).drop("all")


def mix_sources(docs: DataFrame, targets: DataFrame, *, seed: int = 0, buckets: int = 4096) -> Mix:
    """The mix of documents for targets(source, target_share, max_repeats).

    docs(id, source, tokens): a document in several sources has a row for each.
    Sources are compared trimmed and in lower case; of targets alike so the one
    written least counts; rows of others, and rows without id or source, take no
    part; null or negative tokens are none, as are shares that are null, negative
    or no number; repeated rows count once, with the most tokens. The
    size aimed at is the tokens of all documents that take part, a quota the share
    of it as written in decimals, rounded up to whole tokens. A source without
    documents has nothing to route. Other columns are ignored. Every choice depends
    on seed and id alone.

    One shuffle by document finds its sources. The flow is solved on the driver, which
    holds one row for each target and for each combination of sources that
    occurs, however many; documents never go there. A pattern's documents are
    ordered by a seeded hash: running sums in hash buckets, then over the bucket
    sums, so that a source with a third of all documents is spread over all buckets.
    """
    spark = docs.sparkSession
    key = lambda c: F.lower(F.trim(c))
    wanted = targets.select(key(F.col("source")).alias("k"), "source", "target_share", "max_repeats").filter("k IS NOT NULL").groupBy("k").agg(F.min(F.struct("source", "target_share", "max_repeats")).alias("t"))
    share = lambda x: x if x and 0 < x < math.inf else 0.0
    listed = {r.k: (r.t.source, share(r.t.target_share), max(0, r.t.max_repeats or 0)) for r in wanted.toLocalIterator()}
    held = cut(
        docs.select("id", key(F.col("source")).alias("k"), F.greatest(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
        .filter("id IS NOT NULL")
        .join(wanted.select("k"), "k", "left_semi")
        .groupBy("id")
        .agg(F.sort_array(F.collect_set("k")).alias("pattern"), F.max("tokens").alias("tokens"))
    )
    capacity = {tuple(r.pattern): r.tokens for r in held.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).toLocalIterator()}
    total = sum(capacity.values())
    quota = {k: math.ceil(Fraction(str(x[1])) * total) for k, x in listed.items()}
    flow = least_cost_flow(capacity, quota, {k: x[2] for k, x in listed.items()})

    plan, spans = [], []
    routed, tokens = dict.fromkeys(listed, 0), dict.fromkeys(listed, 0)
    for (_, s), f in flow.items():
        routed[s] += f
    for p, n in capacity.items():
        for s in p:
            tokens[s] += n
    for k, (source, share, repeats) in listed.items():
        plan.append((source, float(share), repeats, tokens[k], quota[k], routed[k], routed[k] < quota[k]))
    begun = dict.fromkeys(capacity, 0)
    for (pattern, s), f in flow.items():
        spans.append((list(pattern), listed[s][0], begun[pattern], begun[pattern] + f, capacity[pattern]))
        begun[pattern] += f
    plan_df = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, tokens long, quota long, routed long, short boolean")
    span_df = spark.createDataFrame(spans, "pattern array<string>, source string, first long, last long, once long")

    # The first sixty bits of a digest: the same order on any engine.
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long")
    placed = held.select("id", "pattern", "tokens", place.alias("place")).withColumn("bucket", F.floor(F.col("place") / ((1 << 60) // buckets)))
    before = placed.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("sum"))
    upto = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("pattern", "bucket", F.coalesce(F.sum("sum").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(before, ["pattern", "bucket"]).withColumn("at", F.col("before") + F.col("inside"))
    # A pattern's documents follow each other again and again; each use that begins within a source's span is its own.
    uses = lambda end: F.when(F.col(end) > F.col("at"), F.expr(f"({end} - at + once - 1) div once")).otherwise(0)
    chosen = (
        at.join(span_df, "pattern")  # a row for each pattern and source of it
        .withColumn("repeats", uses("last") - uses("first"))
        .filter("repeats > 0")
        .select("id", "source", "repeats", "tokens")
    )
    return Mix(plan_df, chosen)
