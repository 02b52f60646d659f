"""The registered queries of the core, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright import streaming
from namewright.functions import guid as g
from namewright.functions.guid import guid_bytes, guid_hex
from namewright.functions.numbers import parse_number
from namewright.operators import blocks, constraints, database, graph, matching, procedures, ranges
from namewright.operators.skew import key_quantiles, once
from namewright.plans import corpus, images, pipeline
from namewright.session import cut, new_path
from namewright.sources import discovery, fold, pdb, pe


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sized(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """(k, size) of each field: repeated rows of a key collapsed, null keys kept for the total."""
    functions = (
        _table(spark, sf_dir, "analyzed_functions")
        .filter("function_id IS NOT NULL")
        .groupBy("function_id")
        .agg(F.max(guid_bytes(F.col("guid"))).alias("g"), F.max("size").alias("size"))
        .select(guid_hex(F.col("g")).alias("k"), "size")
    )
    # A key is one labelled symbol; all three parts are compared as they are.
    labels = (
        _table(spark, sf_dir, "labelled_functions")
        .groupBy("binary_id", "producer_idx", "symbol_idx")
        .agg(F.max(F.trim("name")).alias("k"), F.max("size").alias("size"))
        .select("k", "size")
    )
    return {"analyzed_functions.guid": functions, "labelled_functions.name": labels}


def _quantiles(spark: SparkSession, sf_dir: str, only_heavy: bool) -> DataFrame:
    parts = []
    for field, rows in _sized(spark, sf_dir).items():
        rows = cut(rows)
        found = key_quantiles(rows, "k", "size", (0.5, 0.95))
        if only_heavy:
            found = found.filter(F.col("n") * 100 >= rows.count())
        parts.append(found.select(F.lit(field).alias("field"), F.col("k").alias("key_value"), "n", "n_values", F.col("q0").alias("p50"), F.col("q1").alias("p95")))
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of at least 1 % of the functions and names of at least 1 % of the labelled symbols."""
    return _quantiles(spark, sf_dir, True).select("field", "key_value")


def p1_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions, and the median and 95th percentile of their sizes, for every body and every name."""
    return _quantiles(spark, sf_dir, False)


_HEX = "lower(regexp_replace(guid, '[^0-9A-Fa-f]', '', 'g'))"
_SIZED = f"""
sized AS (
  SELECT 'analyzed_functions.guid' AS field, max(CASE WHEN {_HEX} <> repeat('0', 32) THEN {_HEX} END) AS key_value, max(size) AS size
  FROM analyzed_functions WHERE function_id IS NOT NULL GROUP BY function_id
  UNION ALL
  SELECT 'labelled_functions.name', max(trim(name)), max(size) FROM labelled_functions GROUP BY binary_id, producer_idx, symbol_idx)
"""

SQL = {
    "p1_found": f"""WITH {_SIZED}, total AS (SELECT field, count(*) AS n FROM sized GROUP BY ALL)
        SELECT field, key_value FROM sized JOIN total USING (field) WHERE key_value IS NOT NULL
        GROUP BY field, key_value, total.n HAVING count(*) * 100 >= total.n""",
    "p1_quantiles": f"""WITH {_SIZED}
        SELECT field, key_value, count(*) AS n, count(size) AS n_values,
               quantile_disc(size, 0.5) AS p50, quantile_disc(size, 0.95) AS p95
        FROM sized WHERE key_value IS NOT NULL GROUP BY ALL""",
}



# --- fingerprints and constraints of the corpus --------------------------------


def guid_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GUIDs of all functions from their blocks."""
    return corpus.load(spark, sf_dir).functions.select("binary_id", "address", "guid")


def guid_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GUIDs of all names, also in the dashed form."""
    names = corpus.load(spark, sf_dir).labels.select("name").distinct()
    return names.select("name", g.symbol_guid(F.col("name")).alias("guid"), g.dashed(g.symbol_guid(F.col("name"))).alias("dashed"))


def guid_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraint GUIDs of all functions in one spelling."""
    rows = _table(spark, sf_dir, "function_constraints").select("function_id", guid_hex(guid_bytes(F.col("guid"))).alias("guid"), "off")
    return rows.filter("guid IS NOT NULL").distinct()


def _con(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = corpus.load(spark, sf_dir)
        made = {
            "child_call": lambda: constraints.child_calls(c.functions, c.calls),
            "parent_call": lambda: constraints.parent_calls(c.functions, c.calls),
            "symbol_child": lambda: constraints.symbol_child_calls(c.labels, c.calls),
            "symbol_parent": lambda: constraints.symbol_parent_calls(c.labels, c.calls),
            "data_const": lambda: constraints.data_constants(c.data_refs),
        }[kind]()
        return made.select("binary_id", "address", "guid", "off")

    query.__name__ = f"constraint_{kind}"
    return query


def constraint_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each constraint of each function once, names included."""
    return constraints.distinct_constraints(corpus.load(spark, sf_dir).labelled())


def constraint_analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of 'tgt' left when those of every seventh address cannot be analysed."""
    c = corpus.load(spark, sf_dir).only("tgt")
    known = c.functions.filter(F.col("address") % 7 != 0)
    return constraints.analysed(known, c.calls).select("address", "guid")


# --- the database ---------------------------------------------------------------


def _db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.reference_db(corpus.load(spark, sf_dir))


def db_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The database of 'ref'."""
    return _db(spark, sf_dir)


def db_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The database of all labelled functions with the constraints recorded for them."""
    return _recorded_db(spark, sf_dir)


def _recorded_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "labelled_functions").select("binary_id", "address", "producer_idx", "symbol_idx", F.trim("name").alias("name"))
    first = procedures.first_names(names.filter("name <> ''"))
    bodies = _bodies(spark, sf_dir)
    return database.build(bodies.join(first, ["binary_id", "address"]), _recorded(spark, sf_dir))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "analyzed_functions").select("binary_id", "address", once(guid_bytes(F.col("guid"))).alias("g")).filter("g IS NOT NULL")
    return rows.groupBy("binary_id", "address").agg(guid_hex(F.min("g")).alias("guid"))


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "function_constraints").select("binary_id", "address", once(guid_bytes(F.col("guid"))).alias("g"), "off").filter("g IS NOT NULL").distinct()
    return rows.select("binary_id", "address", guid_hex(F.col("g")).alias("guid"), "off")


def db_nested_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints and names of each function in the nested form."""
    rows = database.nested(_db(spark, sf_dir))
    total = F.aggregate("constraints", F.lit(0).cast("long"), lambda n, c: n + F.size(c["symbols"]))
    return rows.select("function", F.size("constraints").cast("long").alias("constraints"), total.alias("symbols"))


def db_nested_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints and names of all functions, nested and taken apart again."""
    return database.flat(database.nested(_db(spark, sf_dir)))


def db_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a build."""
    return database.statistics(_db(spark, sf_dir), 1)


def db_unique_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and constraints that have one name."""
    return database.summarised(_db(spark, sf_dir)).filter("n = 1").select("function_guid", "constraint_guid", "only_symbol")


def db_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The function GUIDs in order."""
    return database.functions(_db(spark, sf_dir))


def _first_guid(spark: SparkSession, sf_dir: str) -> str:
    return corpus.load(spark, sf_dir).only("ref").functions.filter("address = 1").first().guid


def db_lookup_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is known of the GUID of the function at address 1."""
    return database.lookup(_db(spark, sf_dir), _first_guid(spark, sf_dir))


def db_lookup_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is known of an unknown GUID."""
    return database.lookup(_db(spark, sf_dir), "44" * 16)


def db_lookup_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of each constraint of the function at address 1, joined."""
    sets = database.lookup_sets(_db(spark, sf_dir), _first_guid(spark, sf_dir))
    return sets.select("constraint_guid", F.array_join("symbols", ",").alias("symbols"))


def db_semi_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the database about functions of 'tgt'."""
    c = corpus.load(spark, sf_dir)
    return database.for_functions(corpus.reference_db(c), c.only("tgt").functions.select(F.col("guid").alias("function_guid")))


def dump_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The database as JSON objects."""
    return database.dump(_db(spark, sf_dir))


def dump_json_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown function still has an object, without constraints."""
    return database.dump(_db(spark, sf_dir), "44" * 16)


def string_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names numbered in order."""
    return database.string_dictionary(_db(spark, sf_dir))


def constraint_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraint GUIDs numbered in order."""
    return database.constraint_dictionary(_db(spark, sf_dir))


def prefix_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each function's constraints and names begin in flat lists."""
    return database.list_offsets(_db(spark, sf_dir))


# --- matching -------------------------------------------------------------------


def _match(spark: SparkSession, sf_dir: str, rounds: int | None = None) -> matching.Matches:
    c = corpus.load(spark, sf_dir).written()
    target = c.only("tgt")
    return matching.match(target.functions, target.static(), target.calls, cut(corpus.reference_db(c)), rounds)


def _tiers(spark: SparkSession, sf_dir: str, common: bool = False) -> DataFrame:
    c = corpus.load(spark, sf_dir).written()
    db, target = cut(corpus.reference_db(c)), c.only("tgt")
    nil = target.functions.select("binary_id", "address", F.lit(g.NIL).alias("guid"))
    seen = constraints.distinct_constraints(target.static()).unionByName(nil).withColumnRenamed("guid", "constraint_guid")
    known = target.functions.select("binary_id", "address", F.col("guid").alias("function_guid"))
    hits = seen.join(known, ["binary_id", "address"]).join(database.summarised(db), ["function_guid", "constraint_guid"])
    return matching.tiers(hits, db, common)


def match_nil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by GUID alone."""
    return _tiers(spark, sf_dir).filter("nil_name IS NOT NULL").select("address", "nil_name")


def match_singleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by one constraint, where the GUID has several."""
    return _tiers(spark, sf_dir).filter("nil_name IS NULL AND single_name IS NOT NULL").select("address", "single_name")


def match_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names common to all constraints, where the tiers before have none."""
    return _tiers(spark, sf_dir, common=True).filter("common_name IS NOT NULL").select("address", "common_name")


def match_round1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names after one round."""
    return _match(spark, sf_dir, 1).named.select("address", "symbol_name")


def match_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names when no round adds any."""
    return _match(spark, sf_dir).named.select("address", "symbol_name", "round")


def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and counts of constraints of every function."""
    return _match(spark, sf_dir).counts.select("address", "symbol_name", "matched_constraints", "total_constraints")


def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and named functions."""
    return matching.summary(_match(spark, sf_dir).counts)


def match_named_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named functions with their GUID, as a symbol file takes them."""
    c = corpus.load(spark, sf_dir).only("tgt")
    return c.functions.select("binary_id", "address", "guid").join(_match(spark, sf_dir).named.select("binary_id", "address", "symbol_name"), ["binary_id", "address"]).select("address", "guid", "symbol_name")


def match_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all analysed functions by the constraints recorded for them."""
    calls = spark.createDataFrame([], "binary_id string, caller long, target long, address long")
    found = matching.match(_bodies(spark, sf_dir), _recorded(spark, sf_dir), calls, _recorded_db(spark, sf_dir))
    return found.counts


def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of all functions, read back from text."""
    rows = _table(spark, sf_dir, "analyzed_functions").select("function_id", "address").distinct()
    text = F.when(F.col("function_id") % 2 == 0, F.concat(F.lit("0x"), F.lower(F.hex("address")))).otherwise(F.col("address").cast("string"))
    return rows.select("function_id", parse_number(text).alias("address"))


def function_size_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of all functions with their GUIDs, each function once."""
    rows = _table(spark, sf_dir, "analyzed_functions").select("function_id", "size", guid_bytes(F.col("guid")).alias("g"))
    return rows.groupBy("function_id").agg(F.max("size").alias("size"), guid_hex(F.max("g")).alias("guid"))


def binary_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each executable once, as registered last, with the identity of its symbol file."""
    rows = _table(spark, sf_dir, "binaries")
    last = F.max_by(F.struct("path", "image_base", "bitness", "time_date_stamp", "pdb_guid", "pdb_age"), F.struct("ingested_at", "path")).alias("b")
    b = rows.groupBy("binary_id").agg(last)
    return b.select("binary_id", "b.path", "b.image_base", "b.bitness", "b.time_date_stamp", guid_hex(guid_bytes(F.col("b.pdb_guid"))).alias("pdb_guid"), "b.pdb_age")


def discovery_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered executables that have a symbol file; here those with a known identity count as having one."""
    rows = _table(spark, sf_dir, "binaries").select("path", "pdb_guid").filter("lower(path) LIKE '%.exe'")
    symbols = rows.filter("pdb_guid IS NOT NULL").select(F.regexp_replace("path", r"(?i)\.exe$", ".pdb").alias("path"))
    return discovery.paired(rows.select("path").distinct(), symbols)


def _stream(spark: SparkSession, functions: DataFrame) -> DataFrame:
    """functions as a stream of files."""
    path = new_path(spark, "arriving")
    functions.write.parquet(path)
    return spark.readStream.schema(functions.schema).option("maxFilesPerTrigger", 2).parquet(path)


def stream_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by GUID alone of functions of 'tgt' that arrive file by file."""
    c = corpus.load(spark, sf_dir)
    out = new_path(spark, "named")
    stream = _stream(spark, c.only("tgt").functions.select("binary_id", "address", "guid"))
    streaming.name_stream(stream, corpus.reference_db(c), out, new_path(spark, "state")).awaitTermination()
    return spark.read.schema("binary_id string, address long, guid string, symbol_name string").parquet(out).select("address", "symbol_name")


def stream_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by all tiers of functions of 'tgt' that arrive with their constraints."""
    c = corpus.load(spark, sf_dir)
    target, out = c.only("tgt"), new_path(spark, "named")
    known = constraints.distinct_constraints(target.static()).groupBy("binary_id", "address").agg(F.collect_list("guid").alias("constraints"))
    rows = target.functions.select("binary_id", "address", "guid").join(known, ["binary_id", "address"], "left")
    db = cut(corpus.reference_db(c))
    streaming.name_stream_by_constraints(_stream(spark, rows), db, out, new_path(spark, "state")).awaitTermination()
    return spark.read.parquet(out).select("address", "symbol_name", "tier")


# --- procedures, graph, ranges, blocks --------------------------------------------


def first_symbol_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One name an address of all labelled functions."""
    names = _table(spark, sf_dir, "labelled_functions").select("binary_id", "address", "producer_idx", "symbol_idx", F.trim("name").alias("name"))
    return procedures.first_names(names.filter("address IS NOT NULL"))


def procedure_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedures with an address, of two producers read as one."""
    rows = _table(spark, sf_dir, "labelled_functions").select("binary_id", "symbol_idx", F.trim("name").alias("name"), F.col("address").alias("rva"), F.when(F.col("size").isNull(), "data").otherwise("proc").alias("kind"), "producer_idx")
    both = procedures.union_producers(rows.filter("producer_idx = 0").drop("producer_idx"), [rows.filter("producer_idx > 0").drop("producer_idx")])
    return procedures.procedures(both).select("binary_id", "producer_idx", "symbol_idx", "name", "rva")


def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of 'ref' reached from every fiftieth, but for those of every ninth address, which fail."""
    c = corpus.load(spark, sf_dir).only("ref")
    roots = c.functions.filter(F.col("address") % 50 == 0).select("binary_id", "address")
    failed = c.functions.filter(F.col("address") % 9 == 4).select("binary_id", "address")
    return graph.reachable(roots, c.calls, failed).select("address")


def _unwind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unwind rows from orders: every key a start; some chain to a smaller key, some to no row, some to themselves."""
    o = F.col("o_orderkey")
    parent = F.when(o % 7 == 1, o - 1).when(o % 7 == 2, F.floor(o / 2)).when(o % 101 == 5, -o).when(o % 103 == 3, o)
    rows = _table(spark, sf_dir, "orders").select(F.lit("x").alias("binary_id"), o.alias("ordinal"), o.alias("start"), (o + 1 + o % 5).alias("end"), parent.alias("chained_start"))
    return rows


def chain_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of unwind rows that chain to nothing."""
    return graph.chain_roots(graph.last_rows(_unwind(spark, sf_dir))).select("start")


def chain_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of roots with their chained rows."""
    return graph.chain_ranges(_unwind(spark, sf_dir)).select("start", "end")


def _layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sections of every binary, two of which overlap, and its functions by relative address."""
    sections = spark.createDataFrame(
        [(1, ".text", 0x1000, 0x6000, 0x5800, 0x400, 0x60000020), (2, ".rdata", 0x7000, 0x3000, 0x3000, 0x5C00, 0x40000040), (3, ".data", 0x9000, 0x4000, 0x1000, 0x8C00, 0xC0000040), (4, ".bss", 0xD000, 0x3000, 0, 0, 0xC0000080)],
        "idx int, name string, virtual_address long, virtual_size long, size_of_raw_data long, pointer_to_raw_data long, characteristics long",
    )
    binaries = _table(spark, sf_dir, "binaries").groupBy("binary_id").agg(F.max_by("image_base", "ingested_at").alias("image_base"))
    sections = binaries.select("binary_id").join(F.broadcast(sections))  # four rows a binary
    functions = _table(spark, sf_dir, "analyzed_functions").groupBy("function_id").agg(F.min("binary_id").alias("binary_id"), F.min("address").alias("address"), F.max("size").alias("size"))
    return functions.join(binaries, "binary_id").select("binary_id", "function_id", "size", (F.col("address") - F.col("image_base")).alias("rva")), sections


def range_join_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File offsets of all functions, or why there is none."""
    return ranges.file_offsets(*_layout(spark, sf_dir)).select("function_id", "file_offset", "error")


def address_writable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether functions lie in a section that can be written."""
    return ranges.with_writable(*_layout(spark, sf_dir)).select("function_id", "writable")


def functions_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with their section and the offset in it."""
    return ranges.by_section(*_layout(spark, sf_dir)).select("function_id", "section_idx", "section_name", "section_offset")


def section_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and bytes of code of each section."""
    return ranges.section_modules(*_layout(spark, sf_dir)).select("binary_id", "section_idx", "functions", "code_size")


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block boundaries from order lines: an order is a function, its lines start or end blocks."""
    rows = _table(spark, sf_dir, "lineitem").select(F.lit("x").alias("binary_id"), F.col("l_orderkey").alias("entry_point"), (F.col("l_partkey") % 64).alias("addr"), (F.col("l_suppkey") % 2).cast("int").alias("kind"))
    ends = rows.groupBy("binary_id", "entry_point").agg(F.max("addr").alias("max_address"))
    return rows.join(ends, ["binary_id", "entry_point"])


def block_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic blocks of boundaries."""
    return blocks.sweep(_bounds(spark, sf_dir)).select("entry_point", "start", "end")


def _instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions from order lines: kinds, registers and targets by their keys."""
    l = F.col  # noqa: E741
    k, s = l("l_partkey") % 6, l("l_suppkey")
    reg = lambda n: F.element_at(F.array(*map(F.lit, ("RAX", "EAX", "RDI", "R8D"))), (n % 4 + 1).cast("int"))
    none = F.lit(None).cast("string")
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey")).select(
        F.lit("x").alias("binary_id"),
        l("l_orderkey").alias("entry_point"),
        (l("l_orderkey") + l("l_linenumber") * 8).alias("ip"),
        F.unhex(F.substring(F.sha1(l("l_partkey").cast("string")), 1, 6)).alias("bytes"),
        F.when(k == 0, "Mov").when(k == 1, "Call").when(k == 2, "Jmp").when(k == 3, "Lea").when(k == 4, "Je").otherwise("Ret").alias("mnemonic"),
        F.when(k == 0, F.array(F.lit("Register"), F.lit("Register"))).when((k == 1) & (s % 3 == 0), F.array(F.lit("Memory"))).when(k.isin(1, 2, 4), F.array(F.lit("NearBranch64"))).when(k == 3, F.array(F.lit("Register"), F.lit("Memory"))).otherwise(F.array().cast("array<string>")).alias("op_kinds"),
        F.when(k == 0, reg(s)).alias("reg0"),
        F.when(k == 0, reg(s + l("l_partkey") % 2)).alias("reg1"),
        F.when(k.isin(1, 2, 4), l("l_orderkey") + s % 100).alias("branch_target"),
        F.when((k == 3) & (s % 4 == 0), "RIP").when((k == 3) & (s % 4 == 1), "RBX").otherwise(none).alias("mem_base"),
        F.when((k == 3) & (s % 4 == 2), "RCX").otherwise(none).alias("mem_index"),
        (s % 5).alias("mem_disp"),
        F.when(s % 8 == 3, "GS").otherwise(none).alias("segment_prefix"),
    )


def byte_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions as they enter the hash."""
    code = _code(spark, sf_dir)
    return code.select("entry_point", "ip", "code")


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _instructions(spark, sf_dir)
    bounds = rows.select("binary_id", "entry_point").distinct().select("*", F.col("entry_point").alias("first"), (F.col("entry_point") + 50).alias("past"))
    return blocks.normalised(rows, bounds)


def data_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions that refer to data."""
    return _instructions(spark, sf_dir).filter(blocks.is_data_reference()).select("entry_point", "ip")


def function_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of functions by their last instruction."""
    return blocks.function_sizes(_instructions(spark, sf_dir)).select("entry_point", "size")


def block_guid_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GUIDs of functions with one block a line, in order of address."""
    code = _code(spark, sf_dir)
    spans = code.select("binary_id", "entry_point", F.col("ip").alias("start"), (F.col("ip") + 8).alias("end"))
    return blocks.function_guids(blocks.block_guids(code, spans)).select("address", "guid")


# --- files --------------------------------------------------------------------------


def _paths(files: DataFrame) -> DataFrame:
    return pe.headers(files).select("binary_id", "path")


def _named(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table of all analysed functions of the made executables, by path."""
    files = cut(images.files(spark, sf_dir))
    return getattr(pe.tables(pe.analysed(files)), table).join(_paths(files), "binary_id").select("path", *columns)


def img_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of executables, of either width, and which cannot be read."""
    rows = pe.headers(images.files(spark, sf_dir, "mixed"))
    return rows.select("path", "image_base", "bitness", "timestamp", "pdb_guid", "pdb_age", F.col("error").isNotNull().alias("damaged"))


def img_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section tables."""
    rows = pe.headers(images.files(spark, sf_dir))
    return rows.select("path", F.inline("sections"))


def img_unwind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unwind rows in the order of the file, and what they chain to."""
    rows = pe.headers(images.files(spark, sf_dir))
    return rows.select("path", F.inline("runtime_functions")).drop("unwind")


def img_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of functions with the unwind rows chained to them."""
    rows = img_unwind(spark, sf_dir).withColumnRenamed("path", "binary_id")
    return graph.chain_ranges(rows).select(F.col("binary_id").alias("path"), "start", "end")


def img_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions reached from the unwind rows, with size and GUID of their normalised code."""
    return _named(spark, sf_dir, "functions", "address", "size", "guid")


def img_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic blocks of functions."""
    return _named(spark, sf_dir, "blocks", "entry_point", "start", "end")


def img_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, and jumps that leave a function for another."""
    return _named(spark, sf_dir, "calls", "caller", "address", "target")


def img_data_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to data with size, and strings where they lead to one."""
    return _named(spark, sf_dir, "data_refs", "entry_point", "address", "target", "is_readonly", "estimated_size", "bytes_hex")


def img_disassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions of each block, counted."""
    files = cut(images.files(spark, sf_dir))
    t = pe.tables(pe.analysed(files))
    shown = pipeline.disassembly(t.instructions, t.blocks).join(_paths(files), "binary_id")
    return shown.groupBy("path", "entry_point", "start").agg(F.count(F.lit(1)).alias("instructions"))


def pdb_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedures of written symbol files, read again."""
    rows = pdb.procedures(images.files(spark, sf_dir, "pdb"))
    return rows.select("path", "producer_idx", "symbol_idx", "name", "rva", "len", F.col("error").isNotNull().alias("damaged"))


def pdb_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity and sections of written symbol files, and whether they may be replaced."""
    return pdb.identities(images.files(spark, sf_dir, "pdb")).select("path", "guid", "age", "signature", "replaceable", "sections", "modules", "publics", "found")


def _fold(spark: SparkSession, sf_dir: str):
    """The database of 'ref' written as one file; a reader of it."""
    spark.dataSource.register(fold.FoldSource)
    path = new_path(spark, "fold")
    _db(spark, sf_dir).coalesce(1).write.format("fold").mode("overwrite").save(path)
    return lambda **options: spark.read.format("fold").options(**options).load(path)


def fold_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The database written as a file and read again in spans."""
    return _fold(spark, sf_dir)(span="100")


def fold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One function of the file, found by binary search."""
    return _fold(spark, sf_dir)(function=_first_guid(spark, sf_dir)).select("constraint_guid", "symbol")


def fold_lookup_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown function of the file has no rows."""
    return _fold(spark, sf_dir)(function="44" * 16).select("constraint_guid", "symbol")


_C = f"WITH RECURSIVE {corpus.SQL}"
_M = f"WITH RECURSIVE {corpus.MATCH_SQL}"
_LAST = corpus.ROUNDS
_SECTION = """
s AS (SELECT * FROM (VALUES (1, '.text', 4096, 24576, 22528, 1024, 1610612768), (2, '.rdata', 28672, 12288, 12288, 23552, 1073741888), (3, '.data', 36864, 16384, 4096, 35840, 3221225536), (4, '.bss', 53248, 12288, 0, 0, 3221225600))
      t(idx, name, va, vs, raw, ptr, flags)),
b AS (SELECT binary_id, arg_max(image_base, ingested_at) AS base FROM binaries GROUP BY ALL),
f AS (SELECT function_id, min(binary_id) AS binary_id, min(address) AS address, max(size) AS size FROM analyzed_functions GROUP BY function_id),
p AS (SELECT f.*, address - base AS rva FROM f JOIN b USING (binary_id)),
j AS (SELECT p.*, (SELECT min(idx) FROM s WHERE rva >= va AND rva < va + vs) AS idx FROM p)
"""
_UNWIND = """
u AS (SELECT o_orderkey AS start, o_orderkey + 1 + o_orderkey % 5 AS "end",
        CASE WHEN o_orderkey % 7 = 1 THEN o_orderkey - 1 WHEN o_orderkey % 7 = 2 THEN o_orderkey // 2 WHEN o_orderkey % 101 = 5 THEN -o_orderkey WHEN o_orderkey % 103 = 3 THEN o_orderkey END AS parent FROM orders),
roots AS (SELECT start FROM (SELECT start FROM u UNION SELECT parent FROM u WHERE parent IS NOT NULL) WHERE start NOT IN (SELECT start FROM u WHERE parent IS NOT NULL)),
fam AS (SELECT start AS root, start AS here FROM roots WHERE start IN (SELECT start FROM u) UNION SELECT root, u.start FROM fam JOIN u ON u.parent = here)
"""
_BOUNDS = """
r AS (SELECT l_orderkey AS entry_point, l_partkey % 64 AS addr, l_suppkey % 2 AS kind FROM lineitem),
m AS (SELECT entry_point, max(addr) AS max_address FROM r GROUP BY ALL),
e AS (SELECT *, coalesce(lead(addr) OVER (PARTITION BY entry_point ORDER BY addr, kind), max_address) AS "end" FROM (SELECT DISTINCT * FROM r JOIN m USING (entry_point)))
"""
_INS = """
l AS (SELECT l_orderkey AS e, l_linenumber AS ln, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
ins AS (SELECT e AS entry_point, e + ln * 8 AS ip, substr(sha1(p::VARCHAR), 1, 6) AS bytes, p % 6 AS k, s, p,
  CASE s % 4 WHEN 0 THEN 'RAX' WHEN 1 THEN 'EAX' WHEN 2 THEN 'RDI' ELSE 'R8D' END AS reg0, CASE (s + p % 2) % 4 WHEN 0 THEN 'RAX' WHEN 1 THEN 'EAX' WHEN 2 THEN 'RDI' ELSE 'R8D' END AS reg1,
  CASE WHEN p % 6 IN (1, 2, 4) THEN e + s % 100 END AS target,
  CASE WHEN p % 6 = 3 THEN s % 4 = 0 OR (s % 4 = 3 AND s % 5 <> 0 AND s % 8 <> 3) WHEN p % 6 = 1 AND s % 3 = 0 THEN s % 5 <> 0 AND s % 8 <> 3 ELSE false END AS mem FROM l),
code AS (SELECT entry_point, ip, CASE WHEN k = 0 AND reg0 = reg1 AND reg0 IN ('RAX', 'RDI') THEN ''
  WHEN (k = 1 AND s % 3 <> 0) OR (k = 2 AND (target < entry_point OR target >= entry_point + 50)) OR mem THEN '000000' ELSE bytes END AS code FROM ins)
"""
_REC = f"""
names AS (SELECT binary_id, address, first(n ORDER BY producer_idx, symbol_idx, n) AS name FROM
  (SELECT *, trim(name) AS n FROM labelled_functions WHERE trim(name) <> '') GROUP BY binary_id, address),
bodies AS (SELECT binary_id, address, min({_HEX}) AS guid FROM analyzed_functions WHERE guid IS NOT NULL AND {_HEX} <> repeat('0', 32) GROUP BY ALL),
rec AS (SELECT DISTINCT binary_id, address, {_HEX} AS cg FROM function_constraints WHERE guid IS NOT NULL AND {_HEX} <> repeat('0', 32))
"""

_DASHED = "(substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12))"

SQL |= {
    "guid_function": f"{_C} SELECT binary_id, address, guid FROM fn",
    "guid_symbol": f"""{_C}, s AS (SELECT DISTINCT name FROM fn), v AS (SELECT name, {corpus.v5_sql("symbol", "hex(encode(name))")} AS guid FROM s)
        SELECT name, guid, substr(guid, 1, 8) || '-' || substr(guid, 9, 4) || '-' || substr(guid, 13, 4) || '-' || substr(guid, 17, 4) || '-' || substr(guid, 21, 12) AS dashed FROM v""",
    "guid_normalise": f"SELECT DISTINCT function_id, {_HEX} AS guid, off FROM function_constraints WHERE guid IS NOT NULL AND {_HEX} <> repeat('0', 32)",
    **{f"constraint_{k}": f"{_C} SELECT binary_id, address, guid, off FROM {t}" for k, t in (("child_call", "cc"), ("parent_call", "pc"), ("symbol_child", "scc"), ("symbol_parent", "spc"), ("data_const", "dc"))},
    "constraint_union_distinct": f"{_C} SELECT DISTINCT binary_id, address, guid FROM lab",
    "constraint_analysed": f"""{_C} SELECT address, guid FROM fn WHERE binary_id = 'tgt' AND address % 7 <> 0
        AND address NOT IN (SELECT caller FROM call WHERE binary_id = 'tgt' AND target NOT IN (SELECT address FROM fn WHERE address % 7 <> 0))""",
    "db_build": f"{_C} SELECT * FROM db",
    "db_nested_round_trip": f"{_C} SELECT * FROM db",
    "db_corpus": f"""WITH {_REC}
        SELECT guid AS function_guid, '{g.NIL}' AS constraint_guid, name AS symbol FROM bodies JOIN names USING (binary_id, address)
        UNION SELECT guid, cg, name FROM bodies JOIN names USING (binary_id, address) JOIN rec USING (binary_id, address)""",
    "db_nested_sizes": f"{_C} SELECT function_guid AS function, count(DISTINCT constraint_guid) AS constraints, count(*) AS symbols FROM db GROUP BY ALL",
    "db_stats": f"""{_C} SELECT 1::BIGINT AS processed_files, 0::BIGINT AS failed_files, count(DISTINCT function_guid) AS unique_functions,
        count(*) FILTER (n = 1) AS unique_constraints FROM (SELECT function_guid, constraint_guid, count(*) AS n FROM db GROUP BY ALL)""",
    "db_unique_constraints": f"{_C} SELECT function_guid, constraint_guid, min(symbol) AS only_symbol FROM db GROUP BY ALL HAVING count(*) = 1",
    "db_functions": f"{_C} SELECT DISTINCT function_guid FROM db",
    "db_lookup_hit": f"{_C} SELECT constraint_guid, symbol FROM db WHERE function_guid = (SELECT guid FROM fn WHERE binary_id = 'ref' AND address = 1)",
    "db_lookup_miss": f"{_C} SELECT constraint_guid, symbol FROM db WHERE function_guid = repeat('44', 16)",
    "db_lookup_sets": f"""{_C} SELECT constraint_guid, string_agg(symbol, ',' ORDER BY symbol) AS symbols FROM db
        WHERE function_guid = (SELECT guid FROM fn WHERE binary_id = 'ref' AND address = 1) GROUP BY ALL""",
    "db_semi_prefetch": f"{_C} SELECT * FROM db WHERE function_guid IN (SELECT guid FROM fn WHERE binary_id = 'tgt')",
    "dump_json": f"""{_C},
        c AS (SELECT function_guid, constraint_guid, string_agg(to_json(symbol)::VARCHAR, ',' ORDER BY symbol) AS names FROM db GROUP BY ALL)
        SELECT function_guid AS function, '{{"function":"' || {_DASHED.format("function_guid")} || '","constraints":[' ||
          string_agg('{{"constraint":"' || {_DASHED.format("constraint_guid")} || '","symbols":[' || names || ']}}', ',' ORDER BY constraint_guid) || ']}}' AS json FROM c GROUP BY function_guid""",
    "dump_json_miss": """SELECT repeat('44', 16) AS function, '{"function":"44444444-4444-4444-4444-444444444444","constraints":[]}' AS json""",
    "string_dictionary": f"{_C} SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS id FROM (SELECT DISTINCT symbol FROM db)",
    "constraint_dictionary": f"{_C} SELECT constraint_guid, row_number() OVER (ORDER BY constraint_guid) - 1 AS idx FROM (SELECT DISTINCT constraint_guid FROM db)",
    "prefix_offsets": f"""{_C}, z AS (SELECT function_guid, count(DISTINCT constraint_guid) AS constraints, count(*) AS symbols FROM db GROUP BY ALL)
        SELECT *, (sum(constraints) OVER w - constraints)::BIGINT AS constraint_offset, (sum(symbols) OVER w - symbols)::BIGINT AS symbol_offset FROM z
        WINDOW w AS (ORDER BY function_guid ROWS UNBOUNDED PRECEDING)""",
    "match_recorded": f"""WITH {_REC},
        db AS (SELECT guid AS fg, '{g.NIL}' AS cg, name FROM bodies JOIN names USING (binary_id, address)
               UNION SELECT guid, cg, name FROM bodies JOIN names USING (binary_id, address) JOIN rec USING (binary_id, address)),
        agg AS (SELECT fg, cg, count(*) AS n, CASE WHEN count(*) = 1 THEN min(name) END AS only_name FROM db GROUP BY ALL),
        obs AS (SELECT binary_id, address, guid AS fg, '{g.NIL}' AS cg FROM bodies UNION ALL SELECT binary_id, address, guid, cg FROM bodies JOIN rec USING (binary_id, address)),
        hit AS (SELECT * FROM obs JOIN agg USING (fg, cg)),
        tier AS (SELECT binary_id, address, fg, max(only_name) FILTER (cg = '{g.NIL}') AS a, arg_min(only_name, cg) FILTER (n = 1 AND cg <> '{g.NIL}') AS b,
                   count(*) FILTER (cg <> '{g.NIL}') AS k FROM hit GROUP BY ALL),
        inter AS (SELECT binary_id, address, min(name) AS c FROM (
            SELECT t.binary_id, t.address, d.name FROM tier t JOIN hit h ON h.binary_id = t.binary_id AND h.address = t.address AND h.cg <> '{g.NIL}'
            JOIN db d ON d.fg = h.fg AND d.cg = h.cg WHERE a IS NULL AND b IS NULL AND k >= 2 GROUP BY t.binary_id, t.address, d.name, t.k HAVING count(*) = t.k) GROUP BY ALL HAVING count(*) = 1),
        total AS (SELECT binary_id, address, count(*) AS n FROM (SELECT DISTINCT binary_id, address, {_HEX} AS cg, off FROM function_constraints WHERE guid IS NOT NULL AND {_HEX} <> repeat('0', 32)) GROUP BY ALL)
        SELECT b.binary_id, b.address, coalesce(t.a, t.b, i.c) AS symbol_name, coalesce(t.k, 0) AS matched_constraints, coalesce(n.n, 0) AS total_constraints
        FROM bodies b LEFT JOIN tier t USING (binary_id, address) LEFT JOIN inter i USING (binary_id, address) LEFT JOIN total n USING (binary_id, address)""",
    "number_parse": "SELECT DISTINCT function_id, address FROM analyzed_functions",
    "function_size_lookup": f"""SELECT function_id, max(size) AS size, max(CASE WHEN {_HEX} <> repeat('0', 32) THEN {_HEX} END) AS guid FROM analyzed_functions GROUP BY function_id""",
    "binary_latest": """SELECT binary_id, path, image_base, bitness, time_date_stamp, lower(regexp_replace(pdb_guid, '[^0-9A-Fa-f]', '', 'g')) AS pdb_guid, pdb_age
        FROM binaries QUALIFY row_number() OVER (PARTITION BY binary_id ORDER BY ingested_at DESC NULLS LAST, path DESC) = 1""",
    "discovery_pairs": r"""WITH e AS (SELECT DISTINCT path, regexp_replace(path, '\.[^./\\]*$', '') AS stem, pdb_guid FROM binaries WHERE lower(path) LIKE '%.exe')
        SELECT DISTINCT path FROM e WHERE stem IN (SELECT stem FROM e WHERE pdb_guid IS NOT NULL)""",
    "match_nil": f"{_M} SELECT address, nil_name FROM new1 WHERE nil_name IS NOT NULL",
    "match_singleton": f"{_M} SELECT address, single_name FROM new1 WHERE nil_name IS NULL AND single_name IS NOT NULL",
    "match_intersection": f"{_M} SELECT address, common_name FROM new1 WHERE common_name IS NOT NULL",
    "stream_names": f"{_M} SELECT address, nil_name AS symbol_name FROM new1 WHERE nil_name IS NOT NULL",
    "stream_tiers": f"""{_M} SELECT address, name AS symbol_name, CASE WHEN nil_name IS NOT NULL THEN 'nil' WHEN single_name IS NOT NULL THEN 'singleton' ELSE 'intersection' END AS tier
        FROM new1 WHERE name IS NOT NULL""",
    "match_round1": f"{_M} SELECT address, name AS symbol_name FROM named1",
    "match_fixpoint": f"{_M} SELECT address, name AS symbol_name, round FROM named{_LAST}",
    "match_named_info": f"{_M} SELECT m.address, guid, m.name AS symbol_name FROM named{_LAST} m JOIN fn f ON f.binary_id = 'tgt' AND f.address = m.address",
    "match_summary": f"{_M} SELECT count(*) AS functions, count(m.name) AS matched FROM fn f LEFT JOIN named{_LAST} m ON f.address = m.address WHERE binary_id = 'tgt'",
    "match_counts": f"""{_M}, ni AS MATERIALIZED (SELECT *, {corpus._symbol("child", "name")} AS scc, {corpus._symbol("parent", "name")} AS spc FROM named{_LAST}),
        me AS (SELECT f.address, f.guid AS fg, m.name, coalesce(m.round, 99) AS round FROM fn f LEFT JOIN named{_LAST} m ON f.address = m.address WHERE binary_id = 'tgt'),
        seen AS (
          SELECT address, guid, 0 AS r FROM con WHERE binary_id = 'tgt'
          UNION ALL SELECT caller, m.scc, m.round FROM call JOIN ni m ON target = m.address WHERE binary_id = 'tgt'
          UNION ALL SELECT target, m.spc, m.round FROM call JOIN ni m ON caller = m.address WHERE binary_id = 'tgt'),
        vis AS (SELECT me.address, fg, s.guid FROM me JOIN seen s ON s.address = me.address AND s.r < me.round)
        SELECT me.address, me.name AS symbol_name,
          (SELECT count(DISTINCT v.guid) FROM vis v JOIN agg a ON a.function_guid = v.fg AND a.constraint_guid = v.guid WHERE v.address = me.address) AS matched_constraints,
          (SELECT count(*) FROM vis v WHERE v.address = me.address) AS total_constraints FROM me""",
    "first_symbol_wins": """SELECT binary_id, address, first(n ORDER BY producer_idx NULLS FIRST, symbol_idx NULLS FIRST, n NULLS FIRST) AS name
        FROM (SELECT *, trim(name) AS n FROM labelled_functions WHERE address IS NOT NULL) GROUP BY ALL""",
    "procedure_filter": """SELECT binary_id, CASE WHEN producer_idx = 0 THEN 0 ELSE 1 END AS producer_idx, symbol_idx, trim(name) AS name, address AS rva
        FROM labelled_functions WHERE producer_idx IS NOT NULL AND size IS NOT NULL AND address IS NOT NULL""",
    "reachability": f"""{_C}, ok AS (SELECT address FROM fn WHERE binary_id = 'ref' AND address % 9 <> 4),
        reach AS (SELECT address FROM ok WHERE address % 50 = 0 UNION SELECT target FROM reach JOIN call ON caller = address AND binary_id = 'ref' WHERE target IN (SELECT address FROM ok))
        SELECT address FROM reach""",
    "chain_roots": f"WITH RECURSIVE {_UNWIND} SELECT start FROM roots",
    "chain_ranges": f"""WITH RECURSIVE {_UNWIND} SELECT min(u.start) AS start, max(u."end") AS "end" FROM fam JOIN u ON u.start = here GROUP BY root""",
    "range_join_section": f"""WITH {_SECTION} SELECT function_id, CASE WHEN raw > 0 THEN ptr + rva - va END AS file_offset,
        CASE WHEN raw > 0 THEN NULL ELSE 'not mapped' END AS error FROM j LEFT JOIN s USING (idx)""",
    "address_writable": f"WITH {_SECTION} SELECT function_id, coalesce(flags & 2147483648 <> 0, false) AS writable FROM j LEFT JOIN s USING (idx)",
    "functions_by_section": f"WITH {_SECTION} SELECT function_id, idx AS section_idx, name AS section_name, rva - va AS section_offset FROM j JOIN s USING (idx)",
    "section_modules": f"WITH {_SECTION} SELECT binary_id, idx AS section_idx, count(*) AS functions, sum(size)::BIGINT AS code_size FROM j JOIN s USING (idx) GROUP BY ALL",
    "block_sweep": f"""WITH {_BOUNDS} SELECT entry_point, addr AS start, "end" FROM e WHERE kind = 1 AND "end" <> addr""",
    "byte_normalise": f"WITH {_INS} SELECT * FROM code",
    "data_references": f"WITH {_INS} SELECT entry_point, ip FROM ins WHERE k = 3 AND mem",
    "function_sizes": f"WITH {_INS} SELECT entry_point, max(ip) + 3 - entry_point AS size FROM ins GROUP BY entry_point",
    "block_guid_concat": f"""WITH {_INS}, bb AS (SELECT entry_point, ip, {corpus.v5_sql("basic_block", "code")} AS guid FROM code),
        c AS (SELECT entry_point, string_agg(guid, '' ORDER BY ip) AS all_ FROM bb GROUP BY ALL)
        SELECT entry_point AS address, {corpus.v5_sql("function", "all_")} AS guid FROM c""",
}

_I = f"WITH {images.SQL}"
_PDB = f"""{_I}, sym AS (SELECT 's' || s || '.pdb' AS path, k, name || '#' || p AS name, cnt FROM p0)"""
SQL |= {
    "img_headers": f"""{_I} SELECT path, CASE WHEN s % 10 = 3 THEN NULL WHEN s % 10 = 7 THEN {images.BASE & 0xFFFFFFFF} ELSE {images.BASE} END AS image_base, CASE WHEN s % 10 = 3 THEN NULL WHEN s % 10 = 7 THEN 32 ELSE 64 END AS bitness,
        CASE WHEN s % 10 <> 3 THEN 1000000 + s END AS timestamp, CASE WHEN s % 10 <> 3 THEN md5('s' || s) END AS pdb_guid, CASE WHEN s % 10 <> 3 THEN s % 9 + 1 END AS pdb_age, s % 10 = 3 AS damaged FROM img""",
    "img_sections": f"""{_I}, x AS (
          SELECT path, 1 AS idx, '.text' AS name, {images.TEXT} AS virtual_address, 64 * cnt AS n, {images.FLAGS[".text"]} AS characteristics FROM img
          UNION ALL SELECT path, 2, '.rdata', rdata, debug_at + 60, {images.FLAGS[".rdata"]} FROM img
          UNION ALL SELECT path, 3, '.data', data, 4 * cnt, {images.FLAGS[".data"]} FROM img
          UNION ALL SELECT path, 4, '.pdata', pdata, 12 * ((cnt + 1) // 2), {images.FLAGS[".pdata"]} FROM img)
        SELECT path, idx, name, virtual_address, n AS virtual_size, n AS size_of_raw_data, virtual_address AS pointer_to_raw_data, characteristics FROM x""",
    "img_unwind": f"""{_I} SELECT path, k // 2 AS ordinal, place AS start, place + len AS "end", CASE WHEN k % 4 = 2 THEN place - 128 END AS chained_start FROM pt WHERE k % 2 = 0""",
    "img_ranges": f"""{_I} SELECT path, min(place) AS start, max(place + len) AS "end" FROM pt WHERE k % 2 = 0 GROUP BY path, k // 4""",
    "img_functions": f"{_I} {images.FUNCTION_SQL}",
    "img_blocks": f"""{_I} SELECT path, place AS entry_point, start, "end" FROM blk""",
    "img_calls": f"""{_I} SELECT path, place AS caller, place + call_at AS address, {images.BASE + images.TEXT} + 64 * ((k + 1) % cnt) AS target FROM pt
        UNION ALL SELECT path, place, place + branch_end + 2, place + 320 FROM pt WHERE jumps""",
    "img_data_refs": f"""{_I}, h AS (SELECT *, {images._ASCII} AS h FROM pt)
        SELECT path, place AS entry_point, place + lea_at AS address, {images.BASE} + rdata + 128 * k AS target, true AS is_readonly, NULL AS estimated_size,
               lower(CASE WHEN odd = 0 AND length(h) > 8 THEN h WHEN odd = 1 AND length(h) > 4 THEN regexp_replace(h, '(..)', '\\100', 'g') END) AS bytes_hex FROM h
        UNION ALL SELECT path, place, place + extra_at, {images.BASE} + data + 4 * k, false, 4, NULL FROM pt WHERE p % 3 = 0""",
    "img_disassembly": f"""{_I} SELECT path, place AS entry_point, place AS start, 7 + CASE WHEN extra > 0 THEN 1 ELSE 0 END AS instructions FROM pt
        UNION ALL SELECT path, place, place + branch_end, 1 FROM pt UNION ALL SELECT path, place, place + branch_end + 2, CASE WHEN jumps THEN 1 ELSE 2 END FROM pt""",
    "pdb_procedures": f"""{_PDB} SELECT path, 1 AS producer_idx, 2 * k AS symbol_idx, name, {images.TEXT} + 64 * k AS rva, 40 AS len, false AS damaged FROM sym""",
    "pdb_identity": f"""{_I} SELECT 's' || s || '.pdb' AS path, md5('s' || s) AS guid, s % 9 + 1 AS age, 1000000 + s AS signature, true AS replaceable,
        '.text {images.TEXT} ' || 64 * cnt AS sections, '.text_module' AS modules, cnt AS publics, cnt AS found FROM img""",
    "fold_round_trip": f"{_C} SELECT * FROM db",
    "fold_lookup": f"{_C} SELECT constraint_guid, symbol FROM db WHERE function_guid = (SELECT guid FROM fn WHERE binary_id = 'ref' AND address = 1)",
    "fold_lookup_miss": f"{_C} SELECT constraint_guid, symbol FROM db WHERE function_guid = repeat('44', 16)",
}

QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_quantiles, guid_function, guid_symbol, guid_normalise, *map(_con, ("child_call", "parent_call", "symbol_child", "symbol_parent", "data_const")),
        constraint_union_distinct, constraint_analysed, db_build, db_corpus, db_nested_sizes, db_nested_round_trip, db_stats, db_unique_constraints, db_functions,
        db_lookup_hit, db_lookup_miss, db_lookup_sets, db_semi_prefetch, dump_json, dump_json_miss, string_dictionary, constraint_dictionary, prefix_offsets,
        match_nil, match_singleton, match_intersection, match_round1, match_fixpoint, match_counts, match_summary, match_named_info, match_recorded, stream_names, stream_tiers, number_parse, function_size_lookup, binary_latest, discovery_pairs,
        first_symbol_wins, procedure_filter, reachability, chain_roots, chain_ranges, range_join_section, address_writable, functions_by_section, section_modules,
        block_sweep, byte_normalise, data_references, function_sizes, block_guid_concat,
        img_headers, img_sections, img_unwind, img_ranges, img_functions, img_blocks, img_calls, img_data_refs, img_disassembly, pdb_procedures, pdb_identity, fold_round_trip, fold_lookup, fold_lookup_miss,
    )
}
