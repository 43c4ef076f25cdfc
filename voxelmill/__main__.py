"""python -m voxelmill: lists the queries, or runs one over a folder of tables and writes what it gives."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> int:
    from .plans import catalog

    known = catalog.queries()
    parser = argparse.ArgumentParser(prog="voxelmill", description=__doc__)
    parser.add_argument("query", nargs="?", choices=sorted(known), metavar="QUERY", help="without one, the queries are listed")
    parser.add_argument("--tables", help="folder of the tables' Parquet files")
    parser.add_argument("--out", help="folder to write Parquet to; without one, the first rows are shown")
    said = parser.parse_args(args)
    if said.query is None:
        print(*sorted(known), sep="\n")
        return 0
    if not said.tables:
        parser.error("a query needs --tables")
    result = known[said.query](SparkSession.builder.getOrCreate(), said.tables.rstrip("/"))
    if said.out:
        result.write.mode("error").parquet(said.out)
    else:
        result.show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
