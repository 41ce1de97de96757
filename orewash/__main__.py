"""Command line: ``python -m orewash {silver,gold,load,all}`` (or the same file through spark-submit)."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession

from orewash.plans.jobs import Layout, gold_job, run_all, silver_job
from orewash.sinks.warehouse import load_warehouse


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="orewash", description=__doc__)
    parser.add_argument("job", choices=["silver", "gold", "load", "all"])
    parser.add_argument("--root", default=".", help="folder of the layers, unless given one by one")
    for layer in fields(Layout):
        parser.add_argument(f"--{layer.name}", help=f"folder of the {layer.name} layer")
    parser.add_argument("--database", default="orewash_gold")
    parser.add_argument("--location", help="folder of the database")
    parser.add_argument("--one-header", action="store_true", help="all .csv files of a dataset share one header")
    parser.add_argument("--skip-damaged", action="store_true", help="pass over unreadable files")
    parser.add_argument("--partial", action="store_true", help="merge user histories by last non-null value")
    parser.add_argument("--stringly", action="store_true", help="store silver as text")
    parser.add_argument("--flag-uncastable", action="store_true", help="refuse rows with a value that cannot be read as its type")
    parser.add_argument("--drift", action="store_true", help="keep what columns the files lack or have beyond the canonical ones")
    parser.add_argument("--ledger", help="folder of finished steps; an 'all' run passes over those that are done")
    args = parser.parse_args(argv)

    default = Layout.under(args.root)
    layout = Layout(*(getattr(args, f.name) or getattr(default, f.name) for f in fields(Layout)))
    switches = ("one_header", "skip_damaged", "partial", "stringly", "flag_uncastable", "drift")
    options = {n: getattr(args, n) for n in switches}
    spark = SparkSession.builder.appName(f"orewash-{args.job}").getOrCreate()
    if args.job == "silver":
        silver_job(spark, layout, **options)
    elif args.job == "gold":
        gold_job(spark, layout, stringly=args.stringly)
    elif args.job == "load":
        load_warehouse(spark, layout.gold, args.database, args.location)
    else:
        run_all(spark, layout, args.database, args.location, args.ledger, **options)


if __name__ == "__main__":
    main()
