"""Texts that were cut by a size limit or a broken transfer.

A limit of a field shows as a length at which far more of a source's texts end
than at the lengths around it: the hazard of ending there stands out. Texts of
such a length that end inside a sentence are cut. Transfers break at any length
and leave no such trace; there the received body tells, or, where no body is
kept, the last line itself. Pages known to be whole show what lines pages end with.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namewright.operators.skew import once
from namewright.session import cut

#: Lengths on either side that a length is held against.
AROUND = 64
#: False-discovery rate of significant lengths, and the least texts of such a length.
RATE, LEAST = 0.01, 3
#: Words of a last line that can show by itself that a sentence was under way.
WORDS = 3
#: Most words of an entry of a footer whose entries '|' sets apart.
ENTRY = 4
#: Characters that stand for a word in scripts without blanks.
PER_WORD = 4

# Marks of omission (also as they look after a wrong decoding), ends of
# sentences and what may close them, and signs that set the entries of menus and footers apart.
MARK = r"(((?<!\s)\s*+(\[\s*+(…|\.\.\.)\s*+\]|\(\s*+(…|\.\.\.)\s*+\)|…|(?<!\.)\.{3,}+|вЂ¦|â€¦|â\x80¦))+|(?<=[^\s�]\s)�)$"
MARKS = " \t\r.…[]()вЂ¦â€¦\x80�"
STOPS = ".!?。！？؟।｡．။"
CLOSERS = "\"'”’»)]」』）】》〉"
FRAME = r"^.{0,2}©"
MENU = r"[•·>]|( [-–] .*){2}|\S {2,}+\S.* {2}"
# No pattern here goes back over what it has read more than once a line, however long the line.
# Thai and Lao are left out: no mark ends their sentences, so their last lines tell nothing.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsKhmer}\p{IsMyanmar}"
HOST = r"(?<!\S)\S*\.[a-z]{2}\S*"
BLANK = " \n\r\t "


@dataclass
class Truncation:
    """limits(source, unit, length, texts, expected): significant lengths;
    found(id, source, reason): the cut texts, reason being limit, transfer or ending;
    rates(source, texts, cut, rate)."""

    limits: DataFrame
    found: DataFrame
    rates: DataFrame


def length_limits(lengths: DataFrame) -> DataFrame:
    """Lengths of lengths(source, unit, length) at which significantly many texts end.

    The hazard of a length is the share of a source's texts of at least that length
    that end there. It is tested against the hazard around it, from the side with
    more endings within AROUND lengths, with the Chernoff bound of the Poisson
    tail as p-value; Benjamini and Hochberg's rule holds the false-discovery rate
    at RATE over all sources, units and lengths. Result: source, unit, length,
    texts, at_risk, expected.

    Only counts by length are shuffled after map-side combining, so windows see a
    row for each distinct length of a source, never its texts.
    """
    ended = lengths.groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("texts"))
    by = Window.partitionBy("source", "unit").orderBy("length")
    side = lambda a, b: F.coalesce(F.sum("texts").over(by.rangeBetween(a, b)), F.lit(0))
    hazards = ended.select(
        "*",
        F.sum("texts").over(by.rangeBetween(Window.currentRow, Window.unboundedFollowing)).alias("at_risk"),
        F.greatest(side(-AROUND, -1), side(1, AROUND)).alias("near"),
    ).withColumn("expected", (F.col("near") + 1) / AROUND)
    d, m = F.col("texts"), F.col("expected")
    tested = hazards.withColumn("log_p", F.when(d > m, -(d * F.log(d / m) - d + m)).otherwise(0.0) / F.log(F.lit(10.0)))
    # Steps of a twentieth of a power of ten, rounded to the side of larger p; at most 20 * 400 of them.
    tested = tested.withColumn("step", F.least(F.floor(-F.col("log_p") * 20), F.lit(8000)))
    steps = tested.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.desc("step"))
    ranked = steps.select("step", F.sum("n").over(down).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
    bound = ranked.filter(F.pow(F.lit(10.0), -F.col("step") / 20) <= RATE * F.col("upto") / F.col("all")).agg(F.min("step").alias("least_step"))
    return tested.join(F.broadcast(bound)).filter((F.col("step") >= F.col("least_step")) & (d >= LEAST)).select("source", "unit", "length", "texts", "at_risk", "expected")


def _lengths(text: Column) -> dict[str, Column]:
    """Lengths of a text by unit. A character cut in two ends as one replacement character, here one byte."""
    whole = F.rtrim(text, F.lit("�"))
    return {"chars": F.length(text), "bytes": F.octet_length(whole) + F.least(F.length(text) - F.length(whole), F.lit(1))}


def _words(text: Column) -> Column:
    """Words of a text: those between blanks, or what the characters of scripts without blanks come to."""
    unspaced = F.length(F.regexp_replace(text, f"[^{UNSPACED}]", ""))
    return F.greatest(F.size(F.split(F.trim(text), r"\s+")), F.floor(unspaced / PER_WORD))


def _last_line(text: Column) -> Column:
    """The last line that is not blank, without a mark of omission at its end."""
    line = F.rtrim(F.substring_index(F.rtrim(text, F.lit(BLANK)), "\n", -1), F.lit(BLANK))
    # A mark lies wholly in what the characters of marks make up at the end of the line; one more character tells what it follows.
    tail = F.substring(line, F.greatest(F.lit(1), F.length(F.rtrim(line, F.lit(MARKS)))), F.length(line))
    return F.rtrim(F.substring(line, F.lit(1), F.length(line) - F.length(F.regexp_extract(tail, MARK, 0))), F.lit(BLANK))


def _ended(line: Column) -> Column:
    """Whether a line ends with the end of a sentence."""
    return F.right(F.rtrim(line, F.lit(CLOSERS)), F.lit(1)).isin(list(STOPS))


def _received(headers: Column, body: Column) -> tuple[Column, Column]:
    """Whether a received body ends early, and whether it is known to be whole; neither where nothing tells.

    A page ends early that never closes, as does anything shorter than the length
    declared for it. It is whole if it closes, or, being no page, has its declared length.
    """
    page = F.lower(F.decode(body, "ISO-8859-1"))
    after = F.substring_index(page, "</html", -1)
    # What a script or a comment holds is no closing tag; such a one ends after it without having begun there.
    outside = lambda a, b: F.contains(F.substring_index(after, b, 1), F.lit(a)) | ~F.contains(after, F.lit(b))
    opened = F.contains(page, F.lit("<html"))
    closed = F.contains(page, F.lit("</html")) & outside("<script", "</script") & outside("<!--", "-->")
    declared = F.expr("try_cast(regexp_extract(_headers, '(?im)^content-length:[ \\\\t]*([0-9]+)', 1) AS BIGINT)")
    plain = ~F.coalesce(F.lower(headers).contains("content-encoding"), F.lit(False))
    short = F.coalesce(plain & (declared > F.octet_length(body)), F.lit(False))
    broken = F.coalesce(opened & ~closed, F.lit(False)) | short
    whole = ~broken & (F.coalesce(opened & closed, F.lit(False)) | F.coalesce(plain & (declared == F.octet_length(body)) & (declared > 0), F.lit(False)))
    return broken, whole


def find_truncated(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", headers: str | None = "headers", body: str | None = "raw_bytes") -> Truncation:
    """Cut texts, the limits that cut them, and the share of cut texts by source.

    A text is cut if its last line, a mark of omission left aside, does not end
    with the end of a sentence, no page known to be whole ends with such a line
    (numbers and hosts apart), and

    - limit: it has a significant length of its source and does not look like a footer;
    - transfer: its received body ends early;
    - ending: nothing is known of its body, and the last line, or what follows the last
      '|' there, has words enough for a sentence and no signs of a menu. One or
      two words after a line break are no sign by themselves.

    A page is known to be whole if its body is and it has no significant length.
    Nothing is counted here: a text is judged alike in a table of any size, and
    copies do not matter. Copies tell nothing about limits either: texts alike but for hosts and
    numbers count once where lengths are judged here, while limits counts every
    row. Sources are compared trimmed and in lower case, a missing one is a source
    of its own, whose texts may have the limit of any. Null and blank texts are never cut; rows without id are ignored;
    repeated rows count each time; without headers or bodies the other signs decide; an empty
    table gives empty results; other columns are ignored whatever their names.

    Texts are never shuffled: one scan shuffles hashes of texts with their lengths,
    the other reads bodies, leaves flags and a hashed last line of texts that end
    without a sentence's end, and joins those with the significant lengths, a row for
    each source. Lines of whole pages are distinct before
    the join, so a line with a third of all pages meets one row.
    """
    t = F.col("_text")
    none = F.lit(None)
    base = docs.select(
        F.col(id).alias("id"),
        F.coalesce(F.lower(F.trim(F.col(source))), F.lit("")).alias("source"),
        F.col(text).cast("string").alias("_text"),
        (F.col(headers).cast("string") if headers else none.cast("string")).alias("_headers"),
        (F.col(body).cast("binary") if body else none.cast("binary")).alias("_body"),
    ).filter("id IS NOT NULL")

    plain = lambda c: F.regexp_replace(F.regexp_replace(c, HOST, "H"), "[0-9]+", "9")
    copy = F.xxhash64(plain(t)).alias("_copy")
    by_unit = F.explode(F.create_map(*[x for u in _lengths(t) for x in (F.lit(u), F.col(u))])).alias("unit", "length")
    sizes = base.filter(F.trim(t) != "").select("source", *[n.alias(u) for u, n in _lengths(t).items()], copy)
    limits = length_limits(sizes.select("source", by_unit))
    own = length_limits(sizes.distinct().select("source", by_unit))
    # A text without a source may come from any, so it is held against all limits.
    every_limit = own.select("source", "unit", "length").unionByName(own.select(F.lit("").alias("source"), "unit", "length"))
    # Written, so that the optimizer knows how small it is and sends it to the texts, not the texts to it.
    near = cut(every_limit.groupBy("source").agg(F.collect_set(F.struct("unit", F.col("length").cast("int").alias("length"))).alias("_limits")))

    at_limit = F.lit(False)
    for u in _lengths(t):
        at_limit = at_limit | F.coalesce(F.array_contains(F.col("_limits"), F.struct(F.lit(u).alias("unit"), F.col(u).alias("length"))), F.lit(False))
    broken, whole = _received(F.col("_headers"), F.col("_body"))
    entries = F.split(F.col("_end"), r"\|")
    last, several = F.substring_index(F.col("_end"), "|", -1), F.contains(F.col("_end"), F.lit("|"))
    framed = F.rlike(F.col("_end"), F.lit(FRAME)) | (several & F.forall(entries, lambda e: _words(e) <= ENTRY))
    sentence = (_words(last) >= F.when(several, F.lit(ENTRY + 1)).otherwise(F.lit(WORDS))) & ~F.rlike(F.col("_end"), F.lit(MENU))
    open_ = cut(
        base.withColumn("_end", once(_last_line(t)))
        .filter((F.col("_end") != "") & ~_ended(F.col("_end")))
        .select("id", "source", *[n.cast("int").alias(u) for u, n in _lengths(t).items()], F.xxhash64(plain(F.col("_end"))).alias("shape"), broken.alias("broken"), whole.alias("whole"), framed.alias("framed"), sentence.alias("sentence"))
        .join(near, "source", "left")
        .select("id", "source", "shape", at_limit.alias("at_limit"), "broken", "whole", "framed", "sentence")
    )
    reason = (
        F.when(F.col("at_limit") & ~F.col("framed"), "limit")
        .when(F.col("broken"), "transfer")
        .when(~F.col("whole") & F.col("sentence") & ~F.col("framed"), "ending")
    )
    endings = open_.filter("whole AND NOT at_limit").select("shape").distinct()
    found = open_.select("id", "source", "shape", reason.alias("reason")).filter("reason IS NOT NULL").join(endings, "shape", "left_anti").select("id", "source", "reason")

    every = base.groupBy("source").agg(F.count(F.lit(1)).alias("texts"))
    bad = found.groupBy("source").agg(F.count(F.lit(1)).alias("cut"))
    rates = every.join(bad, "source", "left").fillna({"cut": 0}).withColumn("rate", F.col("cut") / F.col("texts"))
    return Truncation(limits, found, rates)
