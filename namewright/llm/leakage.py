"""Documents that contain passages of held-out items.

The items form an inverted index whose terms are short runs of words. Every
passage of every document queries it with BM25 by block-max WAND. An item's scores
are taken in units of what its cheapest run of the required length scores, so
the threshold is 1 for all items and no item that shares such a run is missed.
Retrieved items are verified word by word.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.session import cut

#: Maximal runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Soft hyphen, zero-width space, zero-width no-break space: they vanish from inside words.
INVISIBLE = re.compile("[­​﻿]")

K1, B = 1.2, 0.75
#: Postings in a block of the index.
BLOCK = 32
#: Bytes of item text in one part of the index, which is some five times as large.
PART = 8 << 20
#: Parts that a worker keeps; of more, each is read again for each stretch of documents.
KEPT = 4
#: Characters of text that a task searches for at a time.
STRETCH = 4_000_000
END = 1 << 62
#: Scores of one item are sums in different orders; this far below the threshold still counts.
NEARLY = 1 - 1e-9


def words(text: str) -> list[str]:
    """The words of a text in lower case, without soft hyphens and zero-width spaces."""
    return WORD.findall(INVISIBLE.sub("", text).lower())


class _Numbers(dict):
    """64-bit hashes of words, kept while they are not too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        number = self[word] = xxhash.xxh3_64_intdigest(word)
        return number

    def of(self, text: str) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def runs(numbers: np.ndarray, span: int) -> np.ndarray:
    """A number for each run of span words; equal runs have equal numbers."""
    n = len(numbers) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(span):
        out = (out + numbers[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Cursor:
    """A place in one term's postings."""

    __slots__ = ("items", "scores", "best", "blocks", "at", "item")

    def __init__(self, items: list[int], scores: list[float], blocks: list[float]) -> None:
        self.items, self.scores, self.blocks = items, scores, blocks
        self.best, self.at, self.item = max(blocks), 0, items[0]

    def seek(self, item: int) -> None:
        """To the first posting of this item or a later one, by whole blocks first."""
        at, n = self.at, len(self.items)
        while at < n and self.items[min(at | (BLOCK - 1), n - 1)] < item:
            at = (at | (BLOCK - 1)) + 1
        while at < n and self.items[at] < item:
            at += 1
        self.at, self.item = at, self.items[at] if at < n else END

    def block(self, item: int) -> tuple[float, int]:
        """Best score and last item of the block that may hold this item."""
        b = self.at // BLOCK
        while b < len(self.blocks) and self.items[min((b + 1) * BLOCK, len(self.items)) - 1] < item:
            b += 1
        if b == len(self.blocks):
            return 0.0, END
        return self.blocks[b], self.items[min((b + 1) * BLOCK, len(self.items)) - 1]


class Index:
    """Some items by runs of words: terms in order, and for each its postings with scores and the best score of each block.

    Items of fewer than run words are left out. A score is BM25 divided by the
    least BM25 score of any run of that many words of the item.
    """

    def __init__(self, items: list[tuple[int, str]], run: int, span: int) -> None:
        self.run, self.span = run, span
        numbers = _Numbers()
        held = [(i, w) for i, w in ((i, numbers.of(t)) for i, t in items) if len(w) >= run]
        self.ids, self.words = [i for i, _ in held], [w for _, w in held]
        self.grams: dict[int, set[bytes]] = {}
        own = [runs(w, span) for w in self.words]
        lengths = np.array([len(t) for t in own], np.int64)
        item = np.repeat(np.arange(len(own)), lengths)
        every = np.concatenate(own) if own else np.zeros(0, np.uint64)
        order = np.lexsort((item, every))
        new = np.ones(len(order), bool)
        new[1:] = (every[order][1:] != every[order][:-1]) | (item[order][1:] != item[order][:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(order)))
        self.items, term = item[order][first], every[order][first]
        self.terms, self.starts, spread = np.unique(term, return_index=True, return_counts=True)
        idf = np.log(1 + (len(own) - spread + 0.5) / (spread + 0.5))
        damp = K1 * (1 - B + B * lengths / max(1.0, lengths.mean() if len(own) else 1.0))
        scores = np.repeat(idf, spread) * times * (K1 + 1) / (times + damp[self.items])
        # What each item's cheapest run scores: a run has run - span + 1 terms, of which equal ones count once.
        of_place = np.empty(len(order))
        of_place[order] = np.repeat(scores, times)
        need, least, at = run - span + 1, np.empty(len(own)), 0
        for n, t in enumerate(own):
            s = of_place[at : at + len(t)]
            at += len(t)
            if len(np.unique(t)) == len(t):
                sums = np.convolve(s, np.ones(need), "valid")
            else:
                sums = [sum(dict(zip(t[i : i + need].tolist(), s[i : i + need].tolist())).values()) for i in range(len(t) - need + 1)]
            least[n] = np.min(sums)
        self.scores = scores / least[self.items]
        self.best = np.maximum.reduceat(self.scores, self.starts) if len(self.starts) else np.zeros(0)

    def packed(self) -> bytes:
        """Its arrays alone: the class itself may reach a worker by value."""
        return pickle.dumps(vars(self))

    @classmethod
    def unpacked(cls, data: bytes) -> Index:
        made = cls.__new__(cls)
        vars(made).update(pickle.loads(data))
        return made

    def postings(self, term: int) -> tuple[list[int], list[float], list[float]]:
        """Items and scores of the term at a place in order, and the best score of each block."""
        s = slice(self.starts[term], self.starts[term + 1] if term + 1 < len(self.starts) else len(self.items))
        scores = self.scores[s].tolist()
        return self.items[s].tolist(), scores, [max(scores[i : i + BLOCK]) for i in range(0, len(scores), BLOCK)]

    def retrieve(self, terms: list[int], threshold: float = NEARLY) -> list[int]:
        """Block-max WAND: every item whose score for these distinct terms reaches the threshold."""
        cursors = [Cursor(*self.postings(t)) for t in terms]
        found: list[int] = []
        while True:
            cursors = sorted((c for c in cursors if c.item < END), key=lambda c: c.item)
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += c.best
                if total >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                return found
            item = cursors[pivot].item
            while pivot + 1 < len(cursors) and cursors[pivot + 1].item == item:
                pivot += 1
            ahead = cursors[: pivot + 1]
            blocks = [c.block(item) for c in ahead]
            if sum(b for b, _ in blocks) < threshold:
                # Nothing up to the first end of these blocks, or before another list begins, reaches it.
                after = min(min(last for _, last in blocks) + 1, cursors[pivot + 1].item if pivot + 1 < len(cursors) else END)
                for c in ahead:
                    c.seek(after)
            elif cursors[0].item == item:
                if sum(c.scores[c.at] for c in ahead) >= threshold:
                    found.append(item)
                for c in ahead:
                    c.seek(item + 1)
            else:
                for c in ahead:
                    c.seek(item)

    def runs_of(self, item: int) -> set[bytes]:
        """The runs of an item, word by word."""
        if item not in self.grams:
            w = self.words[item]
            self.grams[item] = {w[i : i + self.run].tobytes() for i in range(len(w) - self.run + 1)}
        return self.grams[item]

    def leaks(self, flat: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document's place, item id, different shared runs, the item's runs) for documents of words flat, each up to its end.

        A document's passages are twice a run long and begin a run apart, so each
        run lies wholly in one. Each is a query of all its indexed terms. WAND's
        first bound, the sum of the terms' best scores, is taken for all passages at once.
        """
        run, span = self.run, self.span
        term = runs(flat, span)
        if not len(term) or not len(self.terms):
            return
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        places = np.flatnonzero(self.terms[at] == term)
        doc = np.searchsorted(ends, places, side="right")
        inside = places + span <= ends[doc]  # no run goes on into the next document
        places, doc = places[inside], doc[inside]
        starts = np.concatenate(([0], ends[:-1]))
        local = places - starts[doc]
        lengths = ends - starts
        first_passage = np.concatenate(([0], np.cumsum(lengths // run + 1)))
        mine = first_passage[doc] + local // run
        also = (local % run <= run - span) & (local >= run)  # it lies in the passage before, too
        passage, where = np.concatenate((mine, mine[also] - 1)), np.concatenate((places, places[also]))
        bound = np.bincount(passage, weights=self.best[at[where]], minlength=1)
        reach = bound[passage] >= NEARLY
        order = np.lexsort((where[reach], passage[reach]))
        passage, where = passage[reach][order], where[reach][order]
        shared: dict[tuple[int, int], set[bytes]] = {}
        cuts = np.flatnonzero(np.diff(passage)) + 1
        for number, group in zip(passage[np.concatenate(([0], cuts))], np.split(where, cuts)) if len(where) else ():
            d = int(np.searchsorted(first_passage, number, side="right")) - 1
            start = int(starts[d] + (number - first_passage[d]) * run)
            for item in self.retrieve(np.unique(at[group]).tolist()):
                own = self.runs_of(item)
                for i in range(start, min(start + run, int(ends[d]) - run + 1)):
                    gram = flat[i : i + run].tobytes()
                    if gram in own:
                        shared.setdefault((d, item), set()).add(gram)
        for (d, item), grams in shared.items():
            yield d, self.ids[item], len(grams), len(self.runs_of(item))


def _parts(items: DataFrame, run: int, span: int, part: int) -> DataFrame:
    """The index of items(i, t) in parts of about so many bytes of text, made on the executors: one row each."""
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // part)

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("i").to_pylist(), table.column("t").to_pylist()))
        return pa.table({"index": pa.array([Index(rows, run, span).packed()], pa.binary())})

    placed = items.withColumn("part", F.pmod(F.xxhash64("i"), F.lit(max(n, 1))))
    return cut(placed.groupBy("part").applyInArrow(build, "index binary"))


def _search(parts: list):
    """The pass over documents (doc_id, text); parts: broadcast parts of the index."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("shared", pa.int64()), ("runs", pa.int64())])
    loaded: dict[int, Index] = {}

    def index(n: int) -> Index:
        if n in loaded:
            return loaded[n]
        made = Index.unpacked(parts[n].value)
        parts[n].__dict__.pop("_value", None)  # the bytes are not needed beside what they hold
        if n < KEPT:
            loaded[n] = made
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        ids, held, size = [], [], 0

        def found() -> Iterator[pa.RecordBatch]:
            flat, ends = np.concatenate(held), np.cumsum([len(h) for h in held])
            for n in range(len(parts)):
                rows = [(ids[d], item, shared, runs_) for d, item, shared, runs_ in index(n).leaks(flat, ends)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids.append(i)
                held.append(numbers.of(text))
                size += len(text)
                if size > STRETCH:
                    yield from found()
                    ids, held, size = [], [], 0
        if held:
            yield from found()

    return run


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    run: int = 12,
    span: int = 4,
    part: int = PART,
) -> DataFrame:
    """Documents and the items of which they contain at least run consecutive words.

    Result: doc_id, item_id, shared (different runs of so many words in both) and
    runs (those of the item), one row a pair. Ids are whole numbers. Words are
    maximal runs of letters and digits in lower case after soft hyphens and
    zero-width spaces are removed; they are compared by a 64-bit hash. Null ids or
    texts match nothing, nor do texts of fewer words; repeated items count once,
    several texts of one item each; repeated documents give repeated rows, one each;
    an empty table gives none; other columns are ignored whatever their names.

    Documents are scanned once, for any number of items, and never shuffled, so no
    source or copy can be too frequent. The index is made on the executors in parts
    of bounded size, goes through the driver part by part and is broadcast so:
    Spark keeps broadcast blocks on disk where memory ends, a task holds KEPT
    parts and the one it searches. A long text is searched whole.
    """
    rows = docs.select(F.col(doc_id).cast("long"), F.col(doc_text).cast("string")).dropna()
    rows = rows.toDF("doc_id", "text")
    held = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).dropna().distinct()
    context = docs.sparkSession.sparkContext
    parts = [context.broadcast(bytes(r["index"])) for r in _parts(held, run, span, part).toLocalIterator()]
    return rows.mapInArrow(_search(parts), "doc_id long, item_id long, shared long, runs long")
