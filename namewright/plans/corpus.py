"""A corpus of two binaries made from the order tables: labelled 'ref' and changed 'tgt'.

Parts are functions, all order lines are calls, all orders are references to
data, of which some are no string constants. In 'tgt' a tenth of the bodies differ and a fifth of
the calls lead elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.functions import guid as g
from namewright.operators import constraints as c
from namewright.operators import database
from namewright.session import cut

BINARIES = ("ref", "tgt")


@dataclass
class Corpus:
    functions: DataFrame  # binary_id, address, name, block1, block2, guid
    calls: DataFrame  # binary_id, caller, target, address
    data_refs: DataFrame  # binary_id, entry_point, address, target, is_readonly, estimated_size, bytes_hex

    def only(self, binary_id: str) -> Corpus:
        keep = F.col("binary_id") == binary_id
        return Corpus(self.functions.filter(keep), self.calls.filter(keep), self.data_refs.filter(keep))

    def written(self) -> Corpus:
        """The same tables written once, for plans that read them several times."""
        return Corpus(cut(self.functions), cut(self.calls), cut(self.data_refs))

    @property
    def labels(self) -> DataFrame:
        return self.functions.select("binary_id", "address", "name")

    def static(self) -> DataFrame:
        return c.static_constraints(self.functions, self.calls, self.data_refs)

    def labelled(self) -> DataFrame:
        return c.labelled_constraints(self.functions, self.labels, self.calls, self.data_refs)


def load(spark: SparkSession, sf_dir: str) -> Corpus:
    """Both binaries of the tables in a folder."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    both = F.explode(F.array(*map(F.lit, BINARIES))).alias("binary_id")
    changed = F.when((F.col("binary_id") == "tgt") & (F.col("p_partkey") % 10 == 0), "x").otherwise("")
    part = read("part")
    functions = (
        part.select("*", both)
        .select(
            "binary_id",
            F.col("p_partkey").alias("address"),
            F.concat("p_name", F.lit("#"), (F.col("p_partkey") % 97).cast("string")).alias("name"),
            g.text_hex(F.col("p_brand")).alias("block1"),
            g.text_hex(F.concat("p_type", (F.col("p_size") % 4).cast("string"), changed)).alias("block2"),
        )
        .withColumn("guid", g.function_guid(F.concat(g.block_guid(F.col("block1")), g.block_guid(F.col("block2")))))
    )
    n = part.select(F.count(F.lit(1)).alias("n"))  # one row
    moved = F.when((F.col("binary_id") == "tgt") & (F.col("l_orderkey") % 5 == 0), 1).otherwise(0)
    # Few lines call all over the program; the rest call one of nine library functions, which so have most of the calls.
    anywhere = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") <= 2) & (F.col("l_quantity") <= 10)
    target = F.when(anywhere, (F.col("l_suppkey") * 20 + F.col("l_orderkey") + moved) % F.col("n")).otherwise(F.floor(F.col("l_partkey") / (1 + 6 * (F.col("l_linenumber") % 3))) % 9)
    calls = (
        read("lineitem")
        .join(F.broadcast(n))
        .select("*", both)
        .select("binary_id", F.col("l_partkey").alias("caller"), target.alias("target"), (F.col("l_linenumber") * 16).cast("long").alias("off"))
        .distinct()
        .select("binary_id", "caller", "target", (F.col("caller") + F.col("off")).alias("address"))
    )
    o = F.col("o_orderkey")
    data = (
        read("orders")
        .join(F.broadcast(n))
        .select("*", both)
        .select(
            "binary_id",
            (o % F.col("n")).alias("entry_point"),
            o.alias("target"),
            # Some references are to data that can be written, have a size of their own, or lead to no string.
            (o % 5 != 3).alias("is_readonly"),
            F.when(o % 7 == 2, F.lit(8)).alias("estimated_size"),
            F.when(o % 13 != 6, g.text_hex(F.concat("o_orderpriority", "o_orderstatus"))).alias("bytes_hex"),
        )
        .withColumn("address", F.col("entry_point") + 8)
    )
    return Corpus(functions, calls, data)


def reference_db(corpus: Corpus) -> DataFrame:
    """The name database of the labelled binary."""
    ref = corpus.only("ref")
    return database.build(ref.functions, ref.labelled())


_V5 = """concat(substr(d, 1, 12), '5', substr(d, 14, 3), translate(substr(d, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substr(d, 18, 15))"""


def v5_sql(namespace: str, payload: str) -> str:
    """The UUIDv5 text of a hex payload in SQL."""
    return f"(SELECT {_V5} FROM (SELECT sha1(unhex(concat('{g.NAMESPACES[namespace]}', {payload}))) AS d))"


def _hex(text: str) -> str:
    return f"hex(encode({text}))"


def _symbol(side: str, name: str) -> str:
    return v5_sql(f"symbol_{side}_call", v5_sql("symbol", _hex(name)))


#: The corpus in SQL: fn, call, data, con (static), db.
SQL = f"""
both_ AS (SELECT unnest(['ref', 'tgt']) AS binary_id),
n AS (SELECT count(*) AS n FROM part),
fn AS MATERIALIZED (
  SELECT binary_id, address, name, block1, block2, {v5_sql("function", f"concat({v5_sql('basic_block', 'block1')}, {v5_sql('basic_block', 'block2')})")} AS guid
  FROM (SELECT binary_id, p_partkey AS address, p_name || '#' || (p_partkey % 97)::VARCHAR AS name, {_hex('p_brand')} AS block1,
               {_hex("p_type || (p_size % 4)::VARCHAR || CASE WHEN binary_id = 'tgt' AND p_partkey % 10 = 0 THEN 'x' ELSE '' END")} AS block2 FROM part, both_)),
call AS MATERIALIZED (
  SELECT DISTINCT binary_id, l_partkey AS caller, (l_linenumber * 16)::BIGINT AS off,
    CASE WHEN l_returnflag = 'R' AND l_linenumber <= 2 AND l_quantity <= 10 THEN (l_suppkey * 20 + l_orderkey + CASE WHEN binary_id = 'tgt' AND l_orderkey % 5 = 0 THEN 1 ELSE 0 END) % n
         ELSE l_partkey // (1 + 6 * (l_linenumber % 3)) % 9 END AS target
  FROM lineitem, both_, n),
data AS MATERIALIZED (
  SELECT binary_id, o_orderkey % n AS address, o_orderpriority || o_orderstatus AS s, o_orderkey % 5 <> 3 AS is_readonly,
         CASE WHEN o_orderkey % 7 = 2 THEN 8 END AS size, o_orderkey % 13 <> 6 AS is_string FROM orders, both_, n),
ids AS MATERIALIZED (SELECT binary_id, address, {v5_sql("child_call", "guid")} AS cc, {v5_sql("parent_call", "guid")} AS pc, {_symbol("child", "name")} AS scc, {_symbol("parent", "name")} AS spc FROM fn),
cc AS (SELECT c.binary_id, caller AS address, i.cc AS guid, off FROM call c JOIN ids i ON c.binary_id = i.binary_id AND c.target = i.address),
pc AS (SELECT c.binary_id, target AS address, i.pc AS guid, off FROM call c JOIN ids i ON c.binary_id = i.binary_id AND c.caller = i.address),
dc AS (SELECT binary_id, address, {v5_sql("data_const", _hex("s"))} AS guid, 8::BIGINT AS off FROM data WHERE is_readonly AND size IS NULL AND is_string),
scc AS (SELECT c.binary_id, caller AS address, i.scc AS guid, off FROM call c JOIN ids i ON c.binary_id = i.binary_id AND c.target = i.address),
spc AS (SELECT c.binary_id, target AS address, i.spc AS guid, off FROM call c JOIN ids i ON c.binary_id = i.binary_id AND c.caller = i.address),
con AS MATERIALIZED (SELECT * FROM cc UNION ALL SELECT * FROM pc UNION ALL SELECT * FROM dc),
lab AS (SELECT * FROM con UNION ALL SELECT * FROM scc UNION ALL SELECT * FROM spc),
db AS MATERIALIZED (
  SELECT guid AS function_guid, '{g.NIL}' AS constraint_guid, name AS symbol FROM fn WHERE binary_id = 'ref'
  UNION
  SELECT f.guid, l.guid, f.name FROM fn f JOIN lab l USING (binary_id, address) WHERE binary_id = 'ref')
"""


def _round_sql(r: int) -> str:
    """One synchronous round after the names so far, named{r - 1}."""
    return f"""
named{r}a AS MATERIALIZED (SELECT *, {_symbol("child", "name")} AS scc, {_symbol("parent", "name")} AS spc FROM named{r - 1}),
obs{r} AS MATERIALIZED (
  SELECT DISTINCT address, guid FROM con WHERE binary_id = 'tgt'
  UNION SELECT caller, m.scc FROM call JOIN named{r}a m ON target = m.address WHERE binary_id = 'tgt'
  UNION SELECT target, m.spc FROM call JOIN named{r}a m ON caller = m.address WHERE binary_id = 'tgt'
  UNION SELECT address, '{g.NIL}' FROM fn WHERE binary_id = 'tgt'),
hit{r} AS MATERIALIZED (
  SELECT o.address, f.guid AS fg, o.guid AS cg, a.n, a.only_symbol FROM obs{r} o JOIN fn f ON f.binary_id = 'tgt' AND f.address = o.address
  JOIN agg a ON a.function_guid = f.guid AND a.constraint_guid = o.guid WHERE o.address NOT IN (SELECT address FROM named{r}a)),
tier{r} AS MATERIALIZED (
  SELECT address, any_value(fg) AS fg, max(only_symbol) FILTER (cg = '{g.NIL}') AS nil_name,
         arg_min(only_symbol, cg) FILTER (n = 1 AND cg <> '{g.NIL}') AS single_name, count(*) FILTER (cg <> '{g.NIL}') AS k FROM hit{r} GROUP BY address),
inter{r} AS MATERIALIZED (
  SELECT address, min(symbol) AS common_name FROM (
    SELECT t.address, d.symbol FROM tier{r} t JOIN hit{r} h ON h.address = t.address AND h.cg <> '{g.NIL}'
    JOIN db d ON d.function_guid = h.fg AND d.constraint_guid = h.cg
    WHERE nil_name IS NULL AND single_name IS NULL AND k >= 2 GROUP BY t.address, d.symbol, k HAVING count(*) = k)
  GROUP BY address HAVING count(*) = 1),
new{r} AS MATERIALIZED (
  SELECT address, nil_name, single_name, common_name, coalesce(nil_name, single_name, common_name) AS name, {r} AS round FROM tier{r} LEFT JOIN inter{r} USING (address)),
named{r} AS MATERIALIZED (SELECT * FROM named{r - 1} UNION ALL SELECT address, name, round FROM new{r} WHERE name IS NOT NULL)
"""


#: Rounds of matching 'tgt' against the database of 'ref'; the third one adds nothing on the driver's tables.
ROUNDS = 4
MATCH_SQL = f"""{SQL},
agg AS MATERIALIZED (SELECT function_guid, constraint_guid, count(*) AS n, CASE WHEN count(*) = 1 THEN min(symbol) END AS only_symbol FROM db GROUP BY ALL),
named0 AS (SELECT NULL::BIGINT AS address, NULL::VARCHAR AS name, NULL::INT AS round WHERE false),
{", ".join(_round_sql(r) for r in range(1, ROUNDS + 1))}
"""
