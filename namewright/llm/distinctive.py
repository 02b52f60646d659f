"""How distinctive a term is for each record that holds it.

Every term's occurrence counts over all records, those with none included, are
taken for a mixture of two Poisson rates: records that are about the term (the
elite) and records that merely mention it. Expectation-maximisation fits the
mixture to the term's histogram; the posterior of the elite part scores a count.
Beside it stands occurrences x ln(records / spread).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namewright.functions.arrow import changes, codes, whole_groups
from namewright.operators.skew import heavy_hashes, is_heavy, with_totals

ITERATIONS = 25


def fit_two_poisson(term: np.ndarray, count: np.ndarray, records: np.ndarray, total: int, rounds: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Share of the elite and its rate and the rest's rate, for each term.

    term: the histogram entries' term as 0, 1, ... in order; count: occurrences in
    a record; records: how many records have just so many; total: all records.
    Records without the term are entry 0 of every histogram. All terms are fitted
    at once.
    """
    starts = np.flatnonzero(changes(term))
    if not len(starts):
        return np.zeros(0), np.zeros(0), np.zeros(0)
    add = lambda x: np.add.reduceat(x, starts)
    n, k = records.astype(float), count.astype(float)
    held, mass = add(n), add(n * k)
    none = np.maximum(total - held, 0.0)
    share = np.clip(held / max(total, 1), 1e-12, 1 - 1e-9)
    high = mass / held
    low = np.maximum(0.1 * mass / max(total, 1), 1e-12)
    index = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(term))))
    for _ in range(rounds):
        r = elite_posterior(k, share[index], high[index], low[index])
        elite = np.maximum(add(n * r) + none * elite_posterior(0.0, share, high, low), 1e-300)
        rest = np.maximum(total - elite, 1e-300)
        share = np.clip(elite / max(total, 1), 1e-12, 1 - 1e-9)
        high = np.maximum(add(n * k * r) / elite, 1e-12)
        low = np.minimum(np.maximum(add(n * k * (1 - r)) / rest, 1e-12), high)
    return share, high, low


def elite_posterior(count, share, high, low):
    """Probability that a record with so many occurrences belongs to the elite."""
    odds = np.log1p(-share) - np.log(share) + high - low + count * (np.log(low) - np.log(high))
    return 1 / (1 + np.exp(np.clip(odds, -700, 700)))


def _scored(term_type: pa.DataType, total: int):
    """The pass over rows (term, record, place) sorted so: one row for each term and record."""
    schema = pa.schema([("term", term_type), ("record", pa.int64()), ("occurrences", pa.int64()), ("spread", pa.int64()), ("elite", pa.float64()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "term"):
            term, record = codes(table.column("term")), table.column("record").to_numpy()
            place = table.column("place")
            new = changes(term, record, codes(place), codes(place.is_null()))
            at = np.flatnonzero(new)
            pair = changes(term[at], record[at])
            first = np.flatnonzero(pair)
            occurrences = np.diff(np.append(first, len(at)))
            rows = at[first]
            t = np.cumsum(changes(term[rows])) - 1
            spread = np.bincount(t)[t]
            order = np.lexsort((occurrences, t))
            starts = changes(t[order], occurrences[order])
            cell = np.flatnonzero(starts)
            records = np.diff(np.append(cell, len(order)))
            share, high, low = fit_two_poisson(t[order][cell], occurrences[order][cell], records, total)
            elite = elite_posterior(occurrences, share[t], high[t], low[t])
            weight = occurrences * np.log(max(total, 1) / spread)
            columns = [table.column("term").combine_chunks().take(pa.array(rows)), pa.array(record[rows]), pa.array(occurrences), pa.array(spread), pa.array(elite), pa.array(weight)]
            yield from pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else c.cast(f.type) for c, f in zip(columns, schema)], schema=schema).to_batches(max_chunksize=50_000)

    return run


def distinctive_terms(df: DataFrame, record: str, term: str, place: str, total: int) -> DataFrame:
    """Scores of every term of every record.

    An occurrence is a distinct (record, term, place), null being one place.
    total: all records, also those without any term. Result: record, term,
    occurrences, spread (records holding the term), elite (two-Poisson posterior)
    and weight (occurrences x ln(total / spread)). Rows without record or term
    are ignored; records are whole numbers, terms bytes. Repeated rows count
    once, an empty table gives none, other columns are ignored.

    One shuffle by term, since a term's histogram and its rows are then in one
    place and no join follows. Terms with a large share of all rows, or with more
    rows than a task should hold (skew.CEILING), are counted where they are with
    map-side combining and their fitted histograms, one for each of the few such
    terms, are broadcast; their rows are shuffled by term and record.
    """
    base = df.select(F.col(term).alias("term"), F.col(record).cast("long").alias("record"), F.col(place).cast("long").alias("place")).filter("record IS NOT NULL AND term IS NOT NULL")
    kind = base.schema["term"].dataType
    columns = ["term", "record", "occurrences", "spread", "elite", "weight"]
    schema = T.StructType([T.StructField("term", kind), *[T.StructField(c, T.LongType()) for c in columns[1:4]], *[T.StructField(c, T.DoubleType()) for c in columns[4:]]])
    heavy = heavy_hashes(base, "term")
    light = base.filter(~is_heavy(F.col("term"), heavy)).repartition("term").sortWithinPartitions("term", "record", "place").mapInArrow(_scored(pa.binary(), total), schema)
    if not heavy:
        return light.select("record", "term", "occurrences", "spread", "elite", "weight")
    held = base.filter(is_heavy(F.col("term"), heavy)).distinct().groupBy("term", "record").agg(F.count(F.lit(1)).alias("occurrences"))
    cells = held.groupBy("term", "occurrences").agg(F.count(F.lit(1)).alias("records"))

    def fit(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("occurrences")
        fitted = fit_two_poisson(np.zeros(len(cells), int), cells.occurrences.to_numpy(), cells.records.to_numpy(), total)
        return pd.DataFrame({"term": cells.term.iloc[:1], "spread": [cells.records.sum()], **dict(zip(("share", "high", "low"), fitted))})

    # One row of five figures for each heavy term, of which there are at most as many as the list has.
    fitted = cells.groupBy("term").applyInPandas(fit, T.StructType([schema["term"], schema["spread"], *[T.StructField(c, T.DoubleType()) for c in ("share", "high", "low")]]))
    odds = F.expr("ln(1 - share) - ln(share) + high - low + occurrences * (ln(low) - ln(high))")
    dense = (
        held.join(F.broadcast(fitted), "term")
        .withColumn("elite", 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), odds)))))
        .withColumn("weight", F.col("occurrences") * F.log(F.lit(float(max(total, 1))) / F.col("spread")))
    )
    return light.unionByName(dense.select(*columns)).select("record", "term", "occurrences", "spread", "elite", "weight")


def most_distinctive(scores: DataFrame, least_terms: int, least_spread: int = 2, heavy: list[int] | None = None) -> DataFrame:
    """The terms of greatest weight of every record with enough terms; ties are all kept.

    Result: record, term, weight. All terms of a record count towards
    least_terms, but only those of at least least_spread records can be chosen.
    heavy: records with a large share of all rows, as heavy_hashes() lists them;
    their rows are not brought together.
    """
    fits = F.col("spread") >= least_spread
    rows = scores.select("record", F.when(fits, F.col("term")).alias("term"), F.when(fits, F.col("weight")).alias("weight"))
    best = with_totals(rows, "record", {"_terms": F.count(F.lit(1)), "_most": F.max("weight")}, heavy or [])
    return best.filter((F.col("_terms") >= least_terms) & (F.col("weight") == F.col("_most"))).select("record", "term", "weight")
