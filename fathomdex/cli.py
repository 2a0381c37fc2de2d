"""python -m fathomdex.cli dump|restore --catalog ROOT --path PATH [--index PATTERN] [--target INDEX]"""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="fathomdex")
    p.add_argument("command", choices=("dump", "restore"))
    p.add_argument("--catalog", required=True, help="root folder of the catalog")
    p.add_argument("--path", required=True, help="folder of the dump")
    p.add_argument("--index", default="_all", help="indices to dump")
    p.add_argument("--target", help="index that all rows are restored to")
    o = p.parse_args(args)

    from pyspark.sql import SparkSession

    from .sources import files
    from .sources.catalog import Catalog

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    catalog = Catalog.load(spark, o.catalog)
    if o.command == "dump":
        n = files.dump({i: catalog.frame(i) for i in catalog.resolve(o.index)}, o.path)
    else:
        n = files.restore(catalog, o.path, o.target)
        catalog.save()
    print(f"{o.command}: {n} documents")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
