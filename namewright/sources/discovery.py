"""Finding executables and their symbol files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./\\]*$", "")


def listing(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Paths below a folder whose name fits; the content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreMissingFiles", "true")
    return files.load(folder).select("path", "length")


def paired(executables: DataFrame, symbols: DataFrame) -> DataFrame:
    """Paths of executables with a symbol file beside them, named alike but for the suffix."""
    beside = symbols.select(_stem(F.col("path")).alias("stem")).distinct()
    return executables.withColumn("stem", _stem(F.col("path"))).join(beside, "stem", "left_semi").drop("stem")


def directory(spark: SparkSession, folder: str) -> DataFrame:
    """Executables below a folder that have a symbol file: path, length."""
    return paired(listing(spark, folder, "*.[eE][xX][eE]"), listing(spark, folder, "*.pdb"))


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The named files with their content, whatever lies beside them."""
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def with_symbol_path(binaries: DataFrame) -> DataFrame:
    """binaries(path, ...) with the path where their symbol file would be."""
    return binaries.withColumn("pdb_path", F.concat(_stem(F.col("path")), F.lit(".pdb")))
