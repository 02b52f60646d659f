"""All pairs of set-valued records whose sets overlap above a threshold.

Minwise signatures in bands propose pairs, exact set similarity decides. Records
with equal sets form one class and are compared once. A bucket that holds more
than a few classes is not paired off: its classes are told apart by the rarest
members of their sets, which loses no pair above the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.functions.arrow import changes, whole_groups
from namewright.operators.skew import heavy_values, is_any
from namewright.session import cut

#: Classes in a bucket that are paired off directly.
BUCKET = 8
#: Sets of more members are told apart by finer bands instead of pairs of members.
PAIRED = 64
#: Bands and rows of the first and the second refinement.
FINE = {1: (200, 6), 2: (500, 8)}
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.array([1, 2], np.uint64) * _MIX


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _sets(least: int):
    """Rows (id, item) sorted so, to one row for each id: two fingerprints of its set, and the set."""

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Without repeated rows, so that only sets themselves are held."""
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(changes(batch.column("id").to_numpy(), batch.column("item").to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(fresh(batches), "id"):
            ids, items = table.column("id").to_numpy(), table.column("item").to_numpy()
            keep = changes(ids, items)
            ids, items = ids[keep], items[keep]
            starts = np.flatnonzero(changes(ids))
            sizes = np.diff(np.append(starts, len(ids)))
            ok = sizes >= least
            if not ok.any():
                continue
            items, sizes, ids = items[np.repeat(ok, sizes)], sizes[ok], ids[starts[ok]]
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            words = items.view(np.uint64)
            prints = [np.add.reduceat(_mix(words + s), offsets[:-1]).view(np.int64) for s in _SALTS]
            yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, prints), _lists(offsets, items)], names=["id", "f1", "f2", "items"])

    return run


def _band_keys(words: np.ndarray, starts: np.ndarray, bands: int, rows: int, salt: int) -> Iterator[np.ndarray]:
    """The bucket keys of sets of words that begin at starts, band by band: a key mixes the least hashes of its rows."""
    seeds = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * _MIX + np.uint64(salt))
    for b in range(bands):
        key = np.full(len(starts), seeds[b * rows], np.uint64)
        for r in range(rows):
            key = _mix(key + np.minimum.reduceat(_mix(words ^ seeds[b * rows + r]), starts) + np.uint64(b + 1))
        yield key


def _flat(items: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All members of an array of lists, and where each list begins and how long it is; no list is empty."""
    offsets = items.offsets.to_numpy()
    return items.flatten().to_numpy(), (offsets[:-1] - offsets[0]).astype(np.int64), np.diff(offsets).astype(np.int64)


def _bands(bands: int, rows: int, salt: int = 0):
    """Rows (cls, items) to one row for each band: the key of its bucket, and cls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            members, starts, _ = _flat(batch.column("items"))
            for key in _band_keys(members.view(np.uint64), starts, bands, rows, salt):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("cls")], names=["key", "cls"])

    return run


def _pairs(bucket: int):
    """Rows (key, cls) sorted so, to pairs of one bucket (a < b, key null), or, of a large bucket, its rows (a = cls, b null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held, large = None, np.zeros(0, np.int64), False  # the bucket that may go on, and whether it is large already
        for batch in batches:
            key, cls = batch.column("key").to_numpy(), batch.column("cls").to_numpy()
            if not len(key):
                continue
            if key[0] != open_key:
                yield from emit(np.full(len(held), open_key, np.int64), held) if len(held) else ()
                held, large = held[:0], False
            if large:
                n = int((key == open_key).sum())
                yield rows(key[:n], cls[:n], None)
                key, cls = key[n:], cls[n:]
                if not len(key):
                    continue
                large = False
            key, cls = np.concatenate((np.full(len(held), open_key, np.int64) if len(held) else held, key)), np.concatenate((held, cls))
            start = int(np.flatnonzero(changes(key))[-1])
            yield from emit(key[:start], cls[:start])
            open_key, held = key[-1], np.unique(cls[start:])
            if len(held) > bucket:
                yield rows(np.full(len(held), open_key, np.int64), held, None)
                held, large = held[:0], True
        if len(held):
            yield from emit(np.full(len(held), open_key, np.int64), held)

    def emit(key: np.ndarray, cls: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key) < 2:
            return
        new = changes(key, cls)  # a class may have reached a bucket twice
        key, cls = key[new], cls[new]
        starts = np.flatnonzero(changes(key))
        sizes = np.diff(np.append(starts, len(key)))
        size = np.repeat(sizes, sizes)
        big = size > bucket
        if big.any():
            yield rows(key[big], cls[big], None)
        group = np.repeat(np.arange(len(starts)), sizes)
        for d in range(1, min(bucket, int(sizes.max()))):
            at = np.flatnonzero((group[d:] == group[:-d]) & ~big[d:])
            if len(at):
                yield rows(None, cls[at], cls[at + d])

    def rows(key, a, b) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([none if key is None else pa.array(key), pa.array(a), none if b is None else pa.array(b)], names=["key", "a", "b"])

    return run


def _refined(threshold: float, depth: int, common: list[int]):
    """Rows (key, cls, items) of large buckets to (finer key, cls).

    In one order of all members, common ones last, two sets with an overlap of at
    least n share depth of the first size - n + depth members: each of those gives
    a finer bucket. depth 2 takes pairs of them.
    """
    common_sorted = np.array(sorted(common), np.int64)
    place = np.array([common.index(x) + 1 for x in sorted(common)], np.int64)

    def keyed(key: np.ndarray, finer: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(_mix(finer + key.view(np.uint64)).view(np.int64)), pa.array(cls)], names=["key", "cls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, cls = batch.column("key").to_numpy(), batch.column("cls").to_numpy()
            members, starts, sizes = _flat(batch.column("items"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            if len(common_sorted):
                at = np.minimum(np.searchsorted(common_sorted, members), len(common_sorted) - 1)
                rank = np.where(common_sorted[at] == members, place[at], 0)
            else:
                rank = np.zeros(len(members), np.int64)
            ordered = members[np.lexsort((members, rank, row))].view(np.uint64)
            first = np.minimum(sizes, sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + depth)
            if depth == 1:
                inside = np.arange(len(ordered)) - np.repeat(starts, sizes) < np.repeat(first, sizes)
                yield keyed(key[row[inside]], _mix(ordered[inside]), cls[row[inside]])
                continue
            for n in np.unique(first).tolist():
                own = np.flatnonzero(first == n)
                block = max(1, 2_000_000 // max(1, n * n))
                for some in (own[i : i + block] for i in range(0, len(own), block)):
                    prefix = _mix(ordered[starts[some][:, None] + np.arange(n)])
                    i, j = np.triu_indices(n, 1)
                    yield keyed(np.repeat(key[some], len(i)), _mix(prefix[:, i] * np.uint64(3) + prefix[:, j]).ravel(), np.repeat(cls[some], len(i)))

    return run


def _finer(large: DataFrame, classes: DataFrame, threshold: float, depth: int, common: list[int]) -> DataFrame:
    """Rows (key, cls) of large buckets to (finer key, cls).

    Sets up to PAIRED / threshold members are told apart within each bucket by
    members. Of larger ones those would be too many: sets over PAIRED members take
    the bands of FINE, once however many large buckets they are in, which miss a pair of
    similarity s with a chance of (1 - s^rows)^bands, 7e-5 and 2e-4 at 0.6. Two
    similar sets always have one of both ways in common.
    """
    size, schema = F.size("items"), "key long, cls long"
    of = classes.select("cls", "items")
    small = large.join(of.filter(size <= PAIRED / threshold), "cls").select("key", "cls", "items").mapInArrow(_refined(threshold, depth, common), schema)
    big = of.filter(size > PAIRED).join(large.select("cls").distinct(), "cls", "left_semi").mapInArrow(_bands(*FINE[depth], salt=depth), schema)
    return small.unionByName(big)


@dataclass
class SimilarSets:
    """classes(cls, n): classes of equal sets, named by their least id; members(id, cls);
    pairs(a, b, common, size_a, size_b): classes a < b whose sets overlap enough."""

    classes: DataFrame
    members: DataFrame
    pairs: DataFrame

    def links(self) -> DataFrame:
        """One row for each record: id, cls and how many other records overlap enough, equal sets included."""
        n = self.classes.select("cls", "n")
        both = self.pairs.select("a", "b").unionByName(self.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        linked = both.join(n.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("other"))
        sums = n.join(linked, "cls", "left").select("cls", (F.col("n") - 1 + F.coalesce("other", F.lit(0))).alias("links"))
        return self.members.join(sums, "cls").select("id", "cls", "links")


def similar_sets(
    df: DataFrame,
    id_col: str,
    item_col: str,
    *,
    threshold: float = 0.6,
    least: int = 1,
    bands: int = 28,
    rows: int = 3,
    bucket: int = BUCKET,
) -> SimilarSets:
    """Classes of records with equal sets, and the pairs of classes with Jaccard similarity >= threshold.

    df has one row for each member of a record's set; ids are whole numbers, items
    anything that xxhash64 takes. Rows without id or item are ignored, repeated
    rows count once, sets under least members take no part, other columns are
    ignored whatever their names. An empty table gives empty results.

    Members are compared by a 64-bit hash: two different members of one pair of
    sets are taken for equal with a chance of about |A| |B| / 2^64. A pair of
    similarity s is proposed unless all bands miss it, a chance of
    (1 - s^rows)^bands; at the defaults 0.11 % at 0.6, 0.001 % at 0.7.

    To tell two tables from each other, give ids of disjoint ranges and filter the pairs.

    One shuffle by id brings a record's members together (8 bytes each); a set must
    fit in a task, its repeated rows need not. Equal
    sets collapse with map-side combining, so a class holding a third of all
    records costs one row a task. Bucket rows are two numbers. Buckets over bucket
    classes are refined by one, then two of the rarest members that any similar
    partner must share (large sets by finer bands), so that pairs come from small
    groups at any size; a group that this cannot split consists of sets which share
    all that it takes and is paired off by a join that splits skewed groups.
    """
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(item_col).alias("item")).filter("id IS NOT NULL AND item IS NOT NULL").select("id", F.xxhash64("item").alias("item"))
    # In small tables, too, common members come last: a list of any size only orders and routes.
    common, hot = heavy_values(base, "item", "id", share=1 / 1024, floor=256)
    common = common[::-1]
    if hot:  # a record with so many rows has its repeats dropped before they meet in one task
        base = base.filter(~is_any(F.col("id"), hot)).unionByName(base.filter(is_any(F.col("id"), hot)).distinct())
    sets = cut(base.repartition("id").sortWithinPartitions("id", "item").mapInArrow(_sets(least), "id long, f1 long, f2 long, items array<long>"))
    classes = cut(sets.groupBy("f1", "f2").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("n"), F.first("items").alias("items")))

    def paired(rows_: DataFrame) -> DataFrame:
        return cut(rows_.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(_pairs(bucket), "key long, a long, b long"))

    found = paired(classes.select("cls", "items").mapInArrow(_bands(bands, rows), "key long, cls long"))
    proposed = [found.filter("b IS NOT NULL").select("a", "b")]
    # At a threshold up to a half, small sets may share a single member, and pairs of members would lose them.
    for depth in (1, 2) if threshold > 0.5 else (1,):
        large = found.filter("b IS NULL").select("key", F.col("a").alias("cls"))
        if large.isEmpty():
            break
        finer = _finer(large, classes, threshold, depth, common)
        found = paired(finer)
        proposed.append(found.filter("b IS NOT NULL").select("a", "b"))
    else:
        rest = found.filter("b IS NULL").select("key", F.col("a").alias("cls"))
        if not rest.isEmpty():
            x, y = rest.select("key", F.col("cls").alias("a")), rest.select("key", F.col("cls").alias("b"))
            proposed.append(x.join(y, "key").filter("a < b").select("a", "b"))
    candidates = proposed[0]
    for p in proposed[1:]:
        candidates = candidates.unionByName(p)
    of = classes.select("cls", "items")
    both = (
        candidates.distinct()
        .join(of.select(F.col("cls").alias("a"), F.col("items").alias("x")), "a")
        .join(of.select(F.col("cls").alias("b"), F.col("items").alias("y")), "b")
        .select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), F.size("x").alias("size_a"), F.size("y").alias("size_b"))
    )
    pairs = cut(both.filter(F.col("common") >= F.lit(threshold) * (F.col("size_a") + F.col("size_b") - F.col("common")) - 1e-9))
    several = classes.filter("n > 1").select("f1", "f2", "cls")
    members = classes.filter("n = 1").select(F.col("cls").alias("id"), "cls").unionByName(sets.select("id", "f1", "f2").join(several, ["f1", "f2"]).select("id", "cls"))
    return SimilarSets(classes.select("cls", "n"), members, pairs)
