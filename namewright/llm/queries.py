"""The registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.functions.guid import guid_bytes, guid_hex
from namewright.llm import distinctive, frequency, heavy, leakage, mixing, similar, tokens, truncation
from namewright.operators.skew import heavy_hashes, once

#: Least size of a function's set in p2_found and p3_found.
LEAST = 5
#: Seed of the order in which pages are chosen for a mix.
SEED = 7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "function_constraints").select("function_id", once(guid_bytes(F.col("guid"))).alias("g"), "off")


def _functions(spark: SparkSession, sf_dir: str) -> int:
    """N: the distinct functions."""
    return _table(spark, sf_dir, "analyzed_functions").select("function_id").filter("function_id IS NOT NULL").distinct().count()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of functions with different bodies and largely the same constraints."""
    sets = similar.similar_sets(_constraints(spark, sf_dir), "function_id", "g", threshold=0.6, least=LEAST)
    bodies = (
        _table(spark, sf_dir, "analyzed_functions")
        .select(F.col("function_id").alias("id"), once(guid_bytes(F.col("guid"))).alias("body"))
        .filter("id IS NOT NULL AND body IS NOT NULL")
        .groupBy("id")
        .agg(F.min("body").alias("body"))
    )
    return different_bodies(sets, bodies)


def different_bodies(sets: similar.SimilarSets, bodies: DataFrame) -> DataFrame:
    """Pairs of records a < b with enough overlap and different, non-null bodies; bodies(id, body), one row an id.

    Copies that share set and body are one node, so pairs among them are never
    made; only pairs of the result are.
    """
    several = sets.classes.filter("n > 1").select("cls")
    linked = sets.pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(several).distinct()
    members = sets.members.join(linked, "cls", "left_semi").join(bodies, "id").select("cls", "body", "id")
    nodes = members.select("cls", "body").distinct()
    x, y = nodes.select("cls", F.col("body").alias("body_a")), nodes.select("cls", F.col("body").alias("body_b"))
    within = x.join(y, "cls").filter("body_a < body_b").select(F.col("cls").alias("a"), F.col("cls").alias("b"), "body_a", "body_b")
    across = sets.pairs.select("a", "b").join(x.withColumnRenamed("cls", "a"), "a").join(y.withColumnRenamed("cls", "b"), "b").filter("body_a <> body_b").select("a", "b", "body_a", "body_b")
    ids = lambda s: members.select(F.col("cls").alias(s), F.col("body").alias(f"body_{s}"), F.col("id").alias(f"id_{s}"))
    pairs = within.unionByName(across).join(ids("a"), ["a", "body_a"]).join(ids("b"), ["b", "body_b"])
    return pairs.select(F.least("id_a", "id_b").alias("function_id_a"), F.greatest("id_a", "id_b").alias("function_id_b"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function with a set of at least five constraints: its class of equal sets, and how many others overlap by 0.6."""
    links = similar.similar_sets(_constraints(spark, sf_dir), "function_id", "g", threshold=0.6, least=LEAST).links()
    return links.select(F.col("id").alias("function_id"), F.col("cls").alias("class_id"), "links")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.distinctive_terms(_constraints(spark, sf_dir), "function_id", "g", "off", _functions(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constraints of greatest weight of every function with at least five."""
    hot = heavy_hashes(_table(spark, sf_dir, "function_constraints").select("function_id"), "function_id")
    best = distinctive.most_distinctive(_scores(spark, sf_dir), LEAST, heavy=hot)
    return best.select(F.col("record").alias("function_id"), guid_hex(F.col("term")).alias("guid"))


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, spread, weight and two-Poisson posterior of every constraint of every function."""
    return _scores(spark, sf_dir).select(
        F.col("record").alias("function_id"), guid_hex(F.col("term")).alias("guid"), "occurrences", "spread", F.round("weight", 6).alias("weight"), F.round("elite", 6).alias("elite")
    )


def _counts(spark: SparkSession, sf_dir: str, max_len: int = 1) -> DataFrame:
    return frequency.term_counts(_constraints(spark, sf_dir), "function_id", "g", "off", max_len)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints too rare or too common to help matching."""
    rows = frequency.marked(_counts(spark, sf_dir), _functions(spark, sf_dir), 0.02)
    return rows.filter("mark IS NOT NULL").select(guid_hex(F.col("t1")).alias("guid"), "mark")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, functions and mark of every distinct constraint."""
    rows = frequency.marked(_counts(spark, sf_dir), _functions(spark, sf_dir), 0.02)
    return rows.select(guid_hex(F.col("t1")).alias("guid"), "occurrences", F.col("records").alias("functions"), "mark")


def p4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and functions of every constraint and every two successive ones."""
    rows = _counts(spark, sf_dir, 2)
    return rows.select(guid_hex(F.col("t1")).alias("first"), guid_hex(F.col("t2")).alias("second"), "occurrences", F.col("records").alias("functions"))


def _guids(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return _table(spark, sf_dir, table).select(once(guid_bytes(F.col("guid"))).alias("g"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GUIDs in at least 1 % of all rows of their table."""
    parts = [
        heavy.values_above(_guids(spark, sf_dir, table), "g", 0.01).select(F.lit(f"{table}.guid").alias("field"), guid_hex(F.col("value")).alias("guid"))
        for table in ("function_constraints", "analyzed_functions")
    ]
    return parts[0].unionByName(parts[1])


def p5_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most frequent GUIDs of either table with their counts."""
    parts = [
        heavy.top_values(_guids(spark, sf_dir, table), "g", 100).select(F.lit(f"{table}.guid").alias("field"), guid_hex(F.col("value")).alias("guid"), "n")
        for table in ("function_constraints", "analyzed_functions")
    ]
    return parts[0].unionByName(parts[1])


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that contain at least twelve consecutive words of an item."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and the largest part of an item found in one page, for every leaked item."""
    found = _leaks(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("pages"), F.max(F.col("shared") / F.col("runs")).alias("part"))
    return found.select("item_id", "pages", F.round("part", 6).alias("part"))


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    docs = tokens.with_tokens(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")
    return mixing.mix_sources(docs.withColumnRenamed("doc_id", "id"), _table(spark, sf_dir, "source_targets"), seed=SEED)


def _byte_mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    """The mix by bytes of text, which SQL can count, too."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.octet_length("text").alias("tokens"))
    return mixing.mix_sources(docs, _table(spark, sf_dir, "source_targets"), seed=SEED)


def _shares(mix: mixing.Mix) -> DataFrame:
    return mix.report().select("source", "target_share", "tokens", "mixed", F.round("reached_share", 6).alias("reached_share"), "short")


def _chosen(mix: mixing.Mix) -> DataFrame:
    return mix.chosen.select(F.col("id").alias("doc_id"), "source", "repeats", "tokens")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their share even at the allowed repeats."""
    return _mix(spark, sf_dir).plan.filter("short").select("source")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every listed source."""
    return _shares(_mix(spark, sf_dir))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the mix and how often each is used."""
    return _chosen(_mix(spark, sf_dir))


def p7_byte_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every listed source, sizes in bytes."""
    return _shares(_byte_mix(spark, sf_dir))


def p7_byte_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the mix by bytes and how often each is used."""
    return _chosen(_byte_mix(spark, sf_dir))


def _cut(spark: SparkSession, sf_dir: str) -> truncation.Truncation:
    return truncation.find_truncated(_table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose text was cut."""
    return _cut(spark, sf_dir).found.select(F.col("id").alias("doc_id"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, cut pages and their share by source."""
    return _cut(spark, sf_dir).rates.select("source", "texts", "cut", F.round("rate", 6).alias("rate"))


def p8_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut pages by source and by what shows that they were cut."""
    return _cut(spark, sf_dir).found.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("texts"))


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths at which significantly many texts of a source end."""
    return _cut(spark, sf_dir).limits.select("source", "unit", "length", "texts", "at_risk", F.round("expected", 6).alias("expected"))


_HEX = "lower(regexp_replace(guid, '[^0-9A-Fa-f]', '', 'g'))"
_OCC = f"""
occ AS (SELECT DISTINCT function_id, {_HEX} AS guid, off FROM function_constraints
        WHERE guid IS NOT NULL AND {_HEX} <> repeat('0', 32)),
n AS (SELECT count(DISTINCT function_id) AS n FROM analyzed_functions),
tf AS (SELECT function_id, guid, count(*) AS occurrences FROM occ GROUP BY ALL),
spread AS (SELECT guid, count(*) AS functions, sum(occurrences)::BIGINT AS occurrences FROM tf GROUP BY ALL)
"""

_P2 = f"""
WITH {_OCC},
body AS (SELECT function_id, min({_HEX}) AS body FROM analyzed_functions WHERE guid IS NOT NULL AND {_HEX} <> repeat('0', 32) GROUP BY ALL),
sets AS (SELECT function_id, count(*) AS n, list(guid) AS items FROM tf GROUP BY ALL HAVING count(*) >= 5),
ranked AS (SELECT function_id, guid, n, row_number() OVER (PARTITION BY function_id ORDER BY functions, guid) AS r
           FROM tf JOIN sets USING (function_id) JOIN spread USING (guid)),
prefix AS (SELECT function_id, guid FROM ranked WHERE r <= n - ceil(0.6 * n - 1e-9) + 1),
cand AS (SELECT DISTINCT x.function_id AS a, y.function_id AS b FROM prefix x JOIN prefix y USING (guid) WHERE x.function_id < y.function_id),
both_ AS (SELECT a, b, len(list_intersect(x.items, y.items)) AS c, x.n AS na, y.n AS nb
          FROM cand JOIN sets x ON a = x.function_id JOIN sets y ON b = y.function_id),
linked AS (SELECT a, b FROM both_ WHERE c >= 0.6 * (na + nb - c) - 1e-9)
"""

SQL = {
    "p2_found": f"""{_P2} SELECT a AS function_id_a, b AS function_id_b FROM linked
        JOIN body x ON x.function_id = a JOIN body y ON y.function_id = b WHERE x.body <> y.body""",
    "p2_links": f"""{_P2}, keyed AS (SELECT function_id, list_sort(items) AS key FROM sets)
        SELECT function_id, min(function_id) OVER (PARTITION BY key) AS class_id,
               (SELECT count(*) FROM linked WHERE a = function_id OR b = function_id) AS links FROM keyed""",
    "p3_found": f"""WITH {_OCC},
        w AS (SELECT function_id, guid, functions, tf.occurrences * ln(n::DOUBLE / functions) AS weight,
                     count(*) OVER (PARTITION BY function_id) AS size FROM tf JOIN spread USING (guid), n),
        m AS (SELECT *, max(weight) OVER (PARTITION BY function_id) AS most FROM w WHERE functions >= 2)
        SELECT function_id, guid FROM m WHERE size >= 5 AND weight >= most - 1e-9""",
    "p4_found": f"""WITH {_OCC}
        SELECT guid, CASE WHEN functions = 1 THEN 'rare' ELSE 'common' END AS mark FROM spread, n
        WHERE functions = 1 OR functions >= 0.02 * n - 1e-9""",
    "p4_counts": f"""WITH {_OCC}
        SELECT guid, occurrences, functions,
               CASE WHEN functions = 1 THEN 'rare' WHEN functions >= 0.02 * n - 1e-9 THEN 'common' END AS mark FROM spread, n""",
    "p4_runs": f"""WITH {_OCC},
        s AS (SELECT function_id, guid, lead(guid) OVER (PARTITION BY function_id ORDER BY off NULLS FIRST, guid) AS next FROM occ)
        SELECT guid AS first, NULL AS second, count(*) AS occurrences, count(DISTINCT function_id) AS functions FROM s GROUP BY guid
        UNION ALL
        SELECT guid, next, count(*), count(DISTINCT function_id) FROM s WHERE next IS NOT NULL GROUP BY guid, next""",
    **{
        f"p5_{kind}": " UNION ALL ".join(
            f"""SELECT * FROM (SELECT '{table}.guid' AS field, {_HEX} AS guid{count} FROM {table}
                WHERE guid IS NOT NULL AND {_HEX} <> repeat('0', 32) GROUP BY 2 {rest.format(table=table)})"""
            for table in ("function_constraints", "analyzed_functions")
        )
        for kind, count, rest in (
            ("found", "", "HAVING count(*) * 100 >= (SELECT count(*) FROM {table})"),
            ("top", ", count(*) AS n", "ORDER BY count(*) DESC, 2 LIMIT 100"),
        )
    },
}

def _em_sql(rounds: int) -> str:
    """The two-Poisson fit of every term, one CTE for each round; fit{rounds} has the term's share, high and low."""
    posterior = lambda k, p: f"1 / (1 + exp(greatest(-700, least(700, ln(1 - {p}share) - ln({p}share) + {p}high - {p}low + ({k}) * (ln({p}low) - ln({p}high))))))"
    out = """
cells AS MATERIALIZED (SELECT guid, occurrences::DOUBLE AS k, count(*)::DOUBLE AS m FROM tf GROUP BY ALL),
tot AS MATERIALIZED (SELECT n::DOUBLE AS n FROM n),
fit0 AS MATERIALIZED (SELECT guid, greatest(n - sum(m), 0) AS none_, greatest(1e-12, least(1 - 1e-9, sum(m) / n)) AS share, sum(m * k) / sum(m) AS high, greatest(0.1 * sum(m * k) / n, 1e-12) AS low
         FROM cells, tot GROUP BY guid, n)"""
    for i in range(rounds):
        out += f""",
e{i} AS (SELECT c.guid, any_value(none_) AS none_, greatest(sum(m * r) + any_value(none_ * p0), 1e-300) AS elite, sum(m * k * r) AS up, sum(m * k * (1 - r)) AS down
  FROM (SELECT c.*, none_, {posterior("k", "f.")} AS r, {posterior("0", "f.")} AS p0 FROM cells c JOIN fit{i} f USING (guid)) c GROUP BY c.guid),
f{i} AS (SELECT guid, none_, greatest(1e-12, least(1 - 1e-9, elite / n)) AS share, greatest(up / elite, 1e-12) AS high, greatest(down / greatest(n - elite, 1e-300), 1e-12) AS low FROM e{i}, tot),
fit{i + 1} AS MATERIALIZED (SELECT guid, none_, share, high, least(low, high) AS low FROM f{i})"""
    return out + f""",
scored AS (SELECT function_id, tf.guid, tf.occurrences, functions AS spread, tf.occurrences * ln(n::DOUBLE / functions) AS weight, {posterior("tf.occurrences", "f.")} AS elite
  FROM tf JOIN spread USING (guid) JOIN fit{rounds} f USING (guid), n)"""


_P6 = r"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(lower(regexp_replace(text, '[\x{AD}\x{200B}\x{FEFF}]', '', 'g')), '[\p{L}\p{N}]+') AS words FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(lower(regexp_replace(text, '[\x{AD}\x{200B}\x{FEFF}]', '', 'g')), '[\p{L}\p{N}]+') FROM eval_items WHERE text IS NOT NULL),
g AS (SELECT DISTINCT kind, id, unnest([array_to_string(words[i : i + 11], ' ') FOR i IN range(1, len(words) - 10)]) AS gram FROM w WHERE len(words) >= 12),
pairs AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared FROM g d JOIN g i ON d.gram = i.gram AND d.kind = 0 AND i.kind = 1 GROUP BY ALL)
"""
_P7 = f"""
WITH t AS (SELECT lower(trim(source)) AS k, source, target_share, max_repeats FROM source_targets),
d AS (SELECT doc_id, lower(trim(source)) AS k, strlen(coalesce(text, ''))::BIGINT AS tokens FROM documents WHERE doc_id IS NOT NULL),
cap AS (SELECT k, coalesce(sum(d.tokens), 0)::BIGINT AS once FROM t LEFT JOIN d USING (k) GROUP BY ALL),
plan AS (SELECT t.*, once, ceil(target_share::DECIMAL(19, 15) * (SELECT sum(once) FROM cap)::DECIMAL(19, 0))::BIGINT AS quota FROM t JOIN cap USING (k)),
routed AS (SELECT *, least(quota, max_repeats * once)::BIGINT AS routed FROM plan),
placed AS (SELECT d.*, source, once, routed, (sum(tokens) OVER (PARTITION BY k ORDER BY md5('{SEED}:' || doc_id)[:15], doc_id ROWS UNBOUNDED PRECEDING) - tokens)::BIGINT AS begins FROM d JOIN routed USING (k)),
chosen AS (SELECT doc_id, k, source, (routed - begins + once - 1) // once AS repeats, tokens FROM placed WHERE routed > begins)
"""
_AROUND = """(PARTITION BY source, unit ORDER BY length RANGE BETWEEN {} AND {})"""
_LENGTHS = """(SELECT source, 'chars' AS unit, length(text) AS length FROM {0}
      UNION ALL SELECT source, 'bytes', strlen(whole) + least(length(text) - length(whole), 1) FROM {0})"""


def _limits_sql(p: str, lengths: str) -> str:
    """Significant lengths of a subquery with source, unit and length, as {p}limits."""
    return f"""
{p}e AS (SELECT source, unit, length, count(*) AS texts FROM {lengths} GROUP BY ALL),
{p}h AS (SELECT *, sum(texts) OVER {_AROUND.format("CURRENT ROW", "UNBOUNDED FOLLOWING")}::BIGINT AS at_risk,
        (greatest(coalesce(sum(texts) OVER {_AROUND.format("64 PRECEDING", "1 PRECEDING")}, 0), coalesce(sum(texts) OVER {_AROUND.format("1 FOLLOWING", "64 FOLLOWING")}, 0)) + 1) / 64.0::DOUBLE AS expected FROM {p}e),
{p}t AS (SELECT *, least(floor(CASE WHEN texts > expected THEN texts * ln(texts / expected) - texts + expected ELSE 0 END / ln(10) * 20), 8000) AS step FROM {p}h),
{p}r AS (SELECT step, sum(count(*)) OVER (ORDER BY step DESC) AS upto, sum(count(*)) OVER () AS every FROM {p}t GROUP BY step),
{p}b AS (SELECT min(step) AS least FROM {p}r WHERE pow(10, -step / 20) <= 0.01 * upto / every),
{p}limits AS (SELECT source, unit, length, texts, at_risk, expected FROM {p}t, {p}b WHERE step >= {p}b.least AND texts >= 3)
"""


_PLAIN = r"regexp_replace(regexp_replace({0}, '(^|\s)\S*\.[a-z]{{2}}\S*', '\1H', 'g'), '[0-9]+', '9', 'g')"
_BLANK = r"(' ' || chr(10) || chr(13) || chr(9) || ' ')"
_LINE_WORDS = r"greatest(len(regexp_split_to_array(trim({0}), '\s+')), length(regexp_replace({0}, '[^\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Khmer}}\p{{Myanmar}}]', '', 'g')) // 4)"
_DOCS = r"""
d AS (SELECT doc_id, coalesce(lower(trim(source)), '') AS source, text, rtrim(text, '�') AS whole, headers, raw_bytes FROM documents WHERE doc_id IS NOT NULL),
dt AS (SELECT * FROM d WHERE trim(text) <> '')
"""
_P8 = f"WITH {_DOCS}, {_limits_sql('', _LENGTHS.format('dt'))}"
_P8_CUT = rf"""
WITH {_DOCS}, od AS (SELECT DISTINCT source, length(text) AS n, strlen(whole) + least(length(text) - length(whole), 1) AS m, {_PLAIN.format("text")} AS copy FROM dt),
{_limits_sql("own_", "(SELECT source, 'chars' AS unit, n AS length FROM od UNION ALL SELECT source, 'bytes', m FROM od)")},
near AS (SELECT source, unit, length FROM own_limits UNION SELECT '', unit, length FROM own_limits),
l1 AS (SELECT *, rtrim(split_part(rtrim(text, {_BLANK}), chr(10), -1), {_BLANK}) AS line FROM dt),
l2 AS (SELECT *, rtrim(left(line, length(line) - length(regexp_extract(line,
  '(((\s*(\[\s*(…|\.\.\.)\s*\]|\(\s*(…|\.\.\.)\s*\)|…|\.\.\.+|вЂ¦|â€¦|â\x{{80}}¦))+|(^|[^\s�]\s)�)$)', 1)) + CASE WHEN regexp_matches(line, '[^\s�]\s�$') THEN 2 ELSE 0 END), {_BLANK}) AS line_end FROM l1),
l3 AS (SELECT *, lower(raw_bytes::VARCHAR) AS page, try_cast(nullif(regexp_extract(headers, '(?im)^content-length:[ \t]*([0-9]+)', 1), '') AS BIGINT) AS declared,
  coalesce(NOT contains(lower(headers), 'content-encoding'), true) AS plain, octet_length(raw_bytes) AS n FROM l2
  WHERE line_end <> '' AND NOT contains('.!?。！？؟।｡．။', right('x' || rtrim(line_end, '"''”’»)]」』）】》〉'), 1))),
l4 AS (SELECT *, split_part(page, '</html', -1) AS after, contains(page, '<html') AS opened FROM l3),
l5 AS (SELECT *, contains(page, '</html') AND (contains(split_part(after, '</script', 1), '<script') OR NOT contains(after, '</script'))
  AND (contains(split_part(after, '-->', 1), '<!--') OR NOT contains(after, '-->')) AS closed FROM l4),
l6 AS (SELECT *, coalesce(opened AND NOT closed, false) OR coalesce(plain AND declared > n, false) AS broken FROM l5),
l7 AS (SELECT *, NOT broken AND (coalesce(opened AND closed, false) OR coalesce(plain AND declared = n AND n > 0, false)) AS is_whole,
  EXISTS (SELECT 1 FROM near WHERE near.source = l6.source AND ((unit = 'chars' AND near.length = length(l6.text)) OR (unit = 'bytes' AND near.length = strlen(whole) + least(length(l6.text) - length(whole), 1)))) AS at_limit,
  {_PLAIN.format("line_end")} AS shape, contains(line_end, '|') AS several, string_split(line_end, '|') AS entries FROM l6),
l8 AS (SELECT *, regexp_matches(line_end, '^.{{0,2}}©') OR (several AND len(list_filter(entries, lambda e: {_LINE_WORDS.format("e")} > 4)) = 0) AS framed,
  {_LINE_WORDS.format("entries[-1]")} >= CASE WHEN several THEN 5 ELSE 3 END AND NOT regexp_matches(line_end, '[•·>]|( [-–] .*){{2}}|\S {{2,}}\S.* {{2}}') AS sentence FROM l7),
found AS (SELECT doc_id, source FROM l8 WHERE ((at_limit AND NOT framed) OR broken OR (NOT is_whole AND sentence AND NOT framed))
  AND shape NOT IN (SELECT shape FROM l8 WHERE is_whole AND NOT at_limit))
"""
SQL |= {
    "p3_scores": f"""WITH {_OCC}, {_em_sql(distinctive.ITERATIONS)}
        SELECT function_id, guid, occurrences, spread, round(weight, 6) AS weight, round(elite, 6) AS elite FROM scored""",
    "p8_limits": f"{_P8} SELECT source, unit, length, texts, at_risk, round(expected, 6) AS expected FROM limits",
    "p8_found": f"{_P8_CUT} SELECT doc_id FROM found",
    "p8_rates": f"""{_P8_CUT} SELECT source, texts, coalesce(cut, 0) AS cut, round(coalesce(cut, 0) / texts, 6) AS rate
        FROM (SELECT source, count(*) AS texts FROM d GROUP BY ALL) LEFT JOIN (SELECT source, count(*) AS cut FROM found GROUP BY ALL) USING (source)""",
    "p8_reasons": f"""{_P8_CUT} SELECT source, CASE WHEN at_limit AND NOT framed THEN 'limit' WHEN broken THEN 'transfer' ELSE 'ending' END AS reason, count(*) AS texts
        FROM found JOIN l8 USING (doc_id, source) GROUP BY ALL""",
    "p7_found": f"{_P7} SELECT source FROM routed WHERE routed < quota",
    "p7_byte_mix": f"{_P7} SELECT doc_id, source, repeats, tokens FROM chosen",
    "p7_byte_shares": f"""{_P7}, got AS (SELECT k, sum(tokens * repeats)::BIGINT AS mixed FROM chosen GROUP BY ALL)
        SELECT source, target_share, once AS tokens, coalesce(mixed, 0) AS mixed, round(coalesce(mixed, 0) / (SELECT sum(mixed) FROM got), 6) AS reached_share, routed < quota AS short
        FROM routed LEFT JOIN got USING (k)""",
    "p6_found": f"{_P6} SELECT doc_id, item_id FROM pairs",
    "p6_items": f"""{_P6} SELECT item_id, count(DISTINCT doc_id) AS pages, round(max(shared / runs), 6) AS part FROM pairs
        JOIN (SELECT id AS item_id, count(*) AS runs FROM g WHERE kind = 1 GROUP BY ALL) USING (item_id) GROUP BY item_id""",
}

QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_links, p3_found, p3_scores, p4_found, p4_counts, p4_runs, p5_found, p5_top, p6_found, p6_items, p7_found, p7_shares, p7_mix, p7_byte_shares, p7_byte_mix, p8_found, p8_rates, p8_reasons, p8_limits)
}
