"""Naming functions as they arrive.

The reference behaviour is batch only; this applies it to each micro-batch of a
stream of functions, so that new binaries are named against a fixed database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from namewright.functions.guid import NIL
from namewright.operators.database import summarised
from namewright.operators.matching import KEY, tiers
from namewright.session import cut, scratch


def name_stream(functions: DataFrame, db: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Names by GUID alone for a stream of functions(binary_id, address, guid), appended as Parquet.

    A stream-static join on the GUIDs with one name: stateless, so late rows need
    no watermark and a restart goes on from the checkpoint.
    """
    single = cut(summarised(db.filter(F.col("constraint_guid") == NIL)).filter("n = 1").select(F.col("function_guid").alias("guid"), F.col("only_symbol").alias("symbol_name")))
    named = functions.join(single, "guid").select("binary_id", "address", "guid", "symbol_name")
    return named.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def name_stream_by_constraints(functions: DataFrame, db: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Names by all three tiers for a stream of functions(binary_id, address, guid, constraints array of GUIDs).

    Each micro-batch asks the database like a first round of matching: a function
    arrives with what is known of it, so nothing is kept between batches. A batch
    replaces its own folder batch=N below path, so one that is repeated after a
    failure leaves no row twice. Result: binary_id, address, symbol_name, tier, batch.
    """
    sums = cut(summarised(db))

    @scratch()
    def name(batch: DataFrame, number: int) -> None:
        observed = F.explode(F.concat(F.coalesce("constraints", F.array().cast("array<string>")), F.array(F.lit(NIL)))).alias("constraint_guid")
        seen = batch.select(*KEY, F.col("guid").alias("function_guid"), observed)
        found = tiers(seen.join(sums, ["function_guid", "constraint_guid"]), db)
        tier = F.when(F.col("nil_name").isNotNull(), "nil").when(F.col("single_name").isNotNull(), "singleton").otherwise("intersection")
        named = found.select(*KEY, F.coalesce("nil_name", "single_name", "common_name").alias("symbol_name"), tier.alias("tier")).filter("symbol_name IS NOT NULL")
        named.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return functions.writeStream.foreachBatch(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
