"""Addresses and the sections that hold them.

sections(binary_id, idx, name, virtual_address, virtual_size, size_of_raw_data,
pointer_to_raw_data, characteristics) has a few rows a binary: the equi-join is
on binary_id, the range is a filter within it, so no row meets sections of
another binary. Ranges are half-open; the first section by idx wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WRITABLE = 0x80000000
#: More sections than this in all are joined by shuffle instead of being broadcast.
BROADCAST_ROWS = 200_000


def with_section(rows: DataFrame, sections: DataFrame, how: str = "inner") -> DataFrame:
    """rows(binary_id, rva, ...) with section, the first one that holds rva (null without one if how is 'left').

    The few sections of a binary travel as one array on one row, so a row of the
    big side is joined once and never multiplied.
    """
    packed = sections.groupBy("binary_id").agg(
        F.sort_array(F.collect_list(F.struct("idx", "name", "virtual_address", "virtual_size", "size_of_raw_data", "pointer_to_raw_data", "characteristics"))).alias("_sections")
    )
    if sections.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        packed = F.broadcast(packed)
    inside = lambda s: (F.col("rva") >= s["virtual_address"]) & (F.col("rva") < s["virtual_address"] + s["virtual_size"])
    out = rows.join(packed, "binary_id", "left").withColumn("section", F.get(F.filter("_sections", inside), 0)).drop("_sections")
    return out.filter("section IS NOT NULL") if how == "inner" else out


def file_offsets(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """rows with file_offset; null and an error where no section holds the address or its section has no file data."""
    out = with_section(rows, sections, "left")
    delta = F.col("rva") - F.col("section.virtual_address")
    ok = F.col("section").isNotNull() & (F.col("section.size_of_raw_data") > 0)
    return out.select(*rows.columns, F.when(ok, F.col("section.pointer_to_raw_data") + delta).alias("file_offset"), F.when(~F.coalesce(ok, F.lit(False)), "not mapped").alias("error"))


def with_writable(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """rows with writable: by the section's flag; false outside all sections."""
    flag = F.col("section.characteristics").bitwiseAND(WRITABLE) != 0
    return with_section(rows, sections, "left").select(*rows.columns, F.coalesce(flag, F.lit(False)).alias("writable"))


def by_section(functions: DataFrame, sections: DataFrame) -> DataFrame:
    """functions(binary_id, rva, ...) with section_idx, section_name and the offset within it; those in none are dropped."""
    return with_section(functions, sections).select(
        *functions.columns, F.col("section.idx").alias("section_idx"), F.substring("section.name", 1, 8).alias("section_name"), (F.col("rva") - F.col("section.virtual_address")).alias("section_offset")
    )


def section_modules(functions: DataFrame, sections: DataFrame) -> DataFrame:
    """Functions and bytes of code for each section that has any."""
    return by_section(functions, sections).groupBy("binary_id", "section_idx", "section_name").agg(F.count(F.lit(1)).alias("functions"), F.sum("size").alias("code_size"))
