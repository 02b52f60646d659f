"""Command line: gen-db, analyze and dump-db."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from namewright.operators import database, matching
from namewright.plans.pipeline import Analyzer, DatabaseBuilder
from namewright.plans.progress import Text
from namewright.sources.fold import FoldSource


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="python -m namewright", description=__doc__)
    top.add_argument("--magic", help="marker of database files of other tools")
    sub = top.add_subparsers(dest="command", required=True)
    gen = sub.add_parser("gen-db", help="build a name database from executables with symbol files")
    gen.add_argument("-e", "--exe", nargs="+", required=True, metavar="PATH", help="executables, or folders to search")
    gen.add_argument("-d", "--database", required=True, help="file to write; a Parquet folder if it ends in .parquet")
    run = sub.add_parser("analyze", help="name the functions of an executable")
    run.add_argument("--exe", required=True)
    run.add_argument("--database")
    run.add_argument("--generate-pdb", action="store_true", help="write a symbol file beside the executable; needs --database")
    dump = sub.add_parser("dump-db", help="print a database as JSON")
    dump.add_argument("-d", "--database", required=True)
    dump.add_argument("-o", "--output")
    dump.add_argument("-f", "--function", help="only this function GUID")
    return top


def _load(spark: SparkSession, path: str, magic: str | None) -> DataFrame:
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    read = spark.read.format("fold")
    return (read.option("magic", magic) if magic else read).load(path)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=os.environ.get("NAMEWRIGHT_LOG", "WARNING").upper())
    if args.command == "analyze" and args.generate_pdb and not args.database:
        parser().error("--generate-pdb needs --database")
    spark = spark or SparkSession.builder.appName("namewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.dataSource.register(FoldSource)
    if args.command == "gen-db":
        builder = DatabaseBuilder(spark)
        for path in args.exe:
            (builder.add_directory if os.path.isdir(path) else builder.add_executable)(path)
        built = builder.build(Text())
        if args.database.endswith(".parquet"):
            built.db.repartitionByRange("function_guid").sortWithinPartitions("function_guid", "constraint_guid").write.mode("overwrite").parquet(args.database)
        else:
            out = built.db.coalesce(1).write.format("fold").mode("overwrite")
            (out.option("magic", args.magic) if args.magic else out).save(args.database)
        built.stats.show(truncate=False)
    elif args.command == "analyze":
        analyzer = Analyzer(spark, [args.exe], _load(spark, args.database, args.magic) if args.database else None)
        result = analyzer.analyze(Text())
        if result.matches is None:
            print(f"{result.functions.count()} functions")
        else:
            r = matching.summary(result.matches).first()
            print(f"{r.matched} of {r.functions} functions named")
            if args.generate_pdb:
                path = os.path.splitext(args.exe)[0] + ".pdb"
                print(f"{analyzer.write_symbols(result, path)} names in {path}")
    else:
        wanted = args.function.replace("-", "").lower() if args.function else None
        rows = database.dump(_load(spark, args.database, args.magic), wanted)
        out = open(args.output, "w") if args.output else sys.stdout
        try:
            out.write("[")
            for i, r in enumerate(rows.toLocalIterator()):
                out.write(("," if i else "") + r.json)
            out.write("]\n")
        finally:
            if args.output:
                out.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
