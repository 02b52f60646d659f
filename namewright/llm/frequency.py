"""How often every value or run of values occurs, and in how many records.

Suffix-sorted counting: every position of a record contributes the suffix that
starts there, cut to max_len values. Suffixes go to the task of their first
value, are sorted in reverse lexicographic order, and a stack with one level for
each prefix length sums occurrences and gathers records; a level closes when
the sort leaves its prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namewright.functions.arrow import changes, codes
from namewright.operators.skew import heavy_hashes, is_heavy
from namewright.session import cut


class _Level:
    """One level of the stack: an open prefix with its occurrences and its records.

    On the level of the longest prefix records come in order and are merely
    counted; on those below they are gathered as packed numbers.
    """

    def __init__(self, ordered: bool) -> None:
        self.ordered = ordered
        self.prefix: tuple | None = None
        self.clear()

    def clear(self) -> None:
        self.count = self.held = 0
        self.last: int | None = None
        self.records: list[np.ndarray] = []

    def add(self, records: np.ndarray) -> None:
        if self.ordered:
            self.held += int(changes(records).sum()) - (self.last == int(records[0]))
            self.last = int(records[-1])
            return
        self.records.append(np.unique(records))
        if len(self.records) > 64:
            self.records = [np.unique(np.concatenate(self.records))]

    def close(self) -> tuple | None:
        if self.prefix is None:
            return None
        held = self.held if self.ordered else len(np.unique(np.concatenate(self.records)))
        row = (*self.prefix, self.count, held)
        self.prefix = None
        self.clear()
        return row


def _count_prefixes(max_len: int, names: list[str], schema: pa.Schema):
    """The pass over one sorted partition: rows (t1 .. tn, record, place) to (t1 .. tn, occurrences, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = [_Level(k == max_len) for k in range(1, max_len + 1)]
        before: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            terms = [batch.column(i) for i in range(max_len)]
            ids = [codes(t) for t in terms]
            records = batch.column("record").to_numpy(zero_copy_only=False)
            places = [codes(batch.column("place")), codes(batch.column("place").is_null())]
            new = changes(*ids, records, *places)
            first = tuple(batch.column(c)[0].as_py() for c in [*names, "record", "place"])
            new[0] = first != before
            before = tuple(batch.column(c)[-1].as_py() for c in [*names, "record", "place"])
            closed: list[list] = [[] for _ in range(max_len + 2)]
            out: list[pa.RecordBatch] = []
            for k in range(1, max_len + 1):
                there = ids[k - 1] >= 0 if terms[k - 1].null_count else np.ones(batch.num_rows, bool)
                starts = np.flatnonzero(changes(*ids[:k]))
                ends = np.append(starts[1:], batch.num_rows)
                seen = np.concatenate(([0], np.cumsum(new)))
                level = stack[k - 1]
                for j in (0, len(starts) - 1) if len(starts) > 1 else (0,):
                    # Segments at the ends of a batch may go on in the batches around it.
                    s, e = starts[j], ends[j]
                    prefix = tuple(t[int(s)].as_py() for t in terms[:k]) if there[s] else None
                    if level.prefix != prefix and (row := level.close()):
                        for i, x in enumerate([*row[:k], *[None] * (max_len - k), *row[k:]]):
                            closed[i].append(x)
                    if prefix is not None:
                        level.prefix = prefix
                        level.count += int(seen[e] - seen[s])
                        level.add(records[s:e])
                whole = np.arange(1, len(starts) - 1)
                whole = whole[there[starts[whole]]]
                if len(whole):
                    segment = np.repeat(np.arange(len(starts)), ends - starts)
                    if k < max_len:  # records are in order only below the longest prefix
                        order = np.lexsort((records, segment))
                        fresh = changes(segment[order], records[order])
                    else:
                        fresh = changes(segment, records)
                    held = np.concatenate(([0], np.cumsum(fresh)))
                    at = pa.array(starts[whole])
                    columns = [t.take(at) if i < k else pa.nulls(len(whole), t.type) for i, t in enumerate(terms)]
                    columns += [pa.array(seen[ends[whole]] - seen[starts[whole]]), pa.array(held[ends[whole]] - held[starts[whole]])]
                    out.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema))
            if closed[0]:
                out.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(closed, schema)], schema=schema))
            yield from out
        rest = []
        for k, level in enumerate(stack, 1):
            if row := level.close():
                rest.append([*row[:k], *[None] * (max_len - k), *row[k:]])
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rest), schema)], schema=schema)

    return run


def term_counts(df: DataFrame, record: str, term: str, place: str, max_len: int = 1) -> DataFrame:
    """Occurrences and records of every run of up to max_len successive values.

    An occurrence is a distinct (record, term, place); a record's sequence is its
    occurrences by place and term, those without a place first. Result: t1 ..
    t<max_len> (null after the end of a shorter run), occurrences, records. Rows
    without record or term are ignored; records are whole numbers, terms bytes or
    text. Repeated rows count once, an empty table gives none, other columns are
    ignored whatever their names.

    One shuffle by first value. A value that holds a large share of all rows is
    spread over all tasks by record: the parts of one run then hold different
    records, so their counts add up, and only such runs are added up in a second
    shuffle. A task keeps one level for each length, and for open prefixes shorter
    than max_len the records as packed integers: at most as many as rows make a value
    heavy, of single values none. Runs longer than 1 first need each record's order: rows are sorted by
    range, so a long record takes several tasks, and the few rows that follow the
    end of each range are handed over.
    """
    base = df.select(F.col(record).cast("long").alias("record"), F.col(term).alias("t1"), F.col(place).cast("long").alias("place")).filter("record IS NOT NULL AND t1 IS NOT NULL")
    names = [f"t{i + 1}" for i in range(max_len)]
    if max_len > 1:
        base = _suffixes(base, names)
    base = base.select(*names, "record", "place")
    kind = base.schema["t1"].dataType
    term_type = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()
    schema = pa.schema([*[(n, term_type) for n in names], ("occurrences", pa.int64()), ("records", pa.int64())])
    spark_schema = T.StructType([*[T.StructField(n, kind) for n in names], T.StructField("occurrences", T.LongType()), T.StructField("records", T.LongType())])
    passes = _count_prefixes(max_len, names, schema)
    by = [*[F.col(n).desc_nulls_last() for n in names], "record", "place"]

    def counted(rows: DataFrame, *route) -> DataFrame:
        return rows.repartition(*route).sortWithinPartitions(*by).mapInArrow(passes, spark_schema)

    heavy = heavy_hashes(base, "t1")
    light = counted(base.filter(~is_heavy(F.col("t1"), heavy)), "t1")
    if not heavy:
        return light
    spread = counted(base.filter(is_heavy(F.col("t1"), heavy)), "t1", F.xxhash64("record"))
    return light.unionByName(spread.groupBy(*names).agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")))


def _suffixes(rows: DataFrame, names: list[str]) -> DataFrame:
    """Distinct rows (record, place, t1) with the next values of the record, null after its end.

    Rows are sorted by range into parts and written. A part's last rows are
    continued by the first rows of the parts after it, of which the driver gets
    len(names) - 1 each.
    """
    more = len(names) - 1
    order = [F.col("record"), F.col("place").asc_nulls_first(), F.col("t1")]
    ranged = rows.distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()  # the part in its upper bits, the row within it below
    ranged = cut(ranged.select("record", "place", "t1", F.shiftright(number, 33).cast("int").alias("part"), number.bitwiseAND((1 << 33) - 1).alias("row")))
    heads: dict[int, list] = {}
    for r in ranged.filter(F.col("row") < more).orderBy("part", "row").collect():
        heads.setdefault(r.part, []).append((r.record, r.place, r.t1))
    parts = sorted(heads)
    lent = []
    for i, part in enumerate(parts):
        after = [x for p in parts[i + 1 : i + 1 + more] for x in heads[p]][:more]
        lent += [(*x, part, (1 << 40) + n) for n, x in enumerate(after)]
    both = ranged.unionByName(rows.sparkSession.createDataFrame(lent, ranged.schema))
    within = Window.partitionBy("part").orderBy("row")
    follow = [F.when(F.lead("record", i).over(within) == F.col("record"), F.lead("t1", i).over(within)).alias(names[i]) for i in range(1, more + 1)]
    return both.select("record", "place", "t1", "row", *follow).filter(F.col("row") < 1 << 40).drop("row")


def marked(counts: DataFrame, records: int, common_share: float, rare: int = 1) -> DataFrame:
    """counts of single values with mark: 'rare' up to so many records, 'common' from a share of all records, else null.

    A value that is both is rare.
    """
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") >= F.lit(common_share * records - 1e-9), "common")
    return counts.withColumn("mark", mark)
