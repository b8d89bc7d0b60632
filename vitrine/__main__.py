"""Command line: load the marts, produce the report, run read-only SQL.

    python -m vitrine init   [--replace]
    python -m vitrine load   --raw DIR [--jdbc-url URL --jdbc-driver CLASS]
    python -m vitrine report SOURCE --out DIR [--date YYYY-MM-DD]
    python -m vitrine sql    SOURCE "SELECT ..." [--limit N | --out DIR]

SOURCE is ``--raw DIR`` (``vendas``, ``clientes``, ``produtos`` and
``preco_competidores`` Parquet datasets), ``--testdata DIR`` (the driver's
TPC-H-like tables, mapped), ``--catalog`` (the loaded gold tables) or
``--jdbc-url URL`` (a warehouse). ``init`` creates the gold tables; with
``--replace`` it drops existing ones. ``load`` creates absent tables and keeps the
old rows of a table whose new rows are refused. ``sql`` writes the whole result to
``--out``, or shows its first rows and says if there are more. Under spark-submit
the active session (and its cluster settings) is used.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    from vitrine.session import build_session
    return build_session()


def _marts(spark, args):
    from vitrine.plans.marts import build_marts
    if args.testdata:
        from vitrine.sources.testdata import raw_from_testdata
        return build_marts(raw_from_testdata(spark, args.testdata))
    from vitrine.sources.raw import read_raw
    return build_marts(read_raw(spark, args.raw))


def _source(spark, args):
    """Marts built here, or a source that stands in for them."""
    from vitrine.sources.warehouse import MartSource
    options = {"driver": args.jdbc_driver} if args.jdbc_driver else {}
    if args.jdbc_url or args.catalog:
        return MartSource(spark, jdbc_url=args.jdbc_url, jdbc_options=options, catalog=args.catalog)
    return MartSource(spark, marts=_marts(spark, args))


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="vitrine")
    sub = parser.add_subparsers(dest="cmd", required=True)
    init = sub.add_parser("init")
    init.add_argument("--replace", action="store_true", help="drop existing gold tables first")
    for name in ("load", "report", "sql"):
        p = sub.add_parser(name)
        source = p.add_mutually_exclusive_group(required=True)
        source.add_argument("--raw")
        source.add_argument("--testdata")
        if name != "load":
            source.add_argument("--catalog", action="store_true")
        (p if name == "load" else source).add_argument("--jdbc-url")
        p.add_argument("--jdbc-driver")
        if name == "report":
            p.add_argument("--out", required=True)
            p.add_argument("--date", type=dt.date.fromisoformat)
        if name == "sql":
            p.add_argument("query")
            p.add_argument("--limit", type=int, default=20, help="rows to show")
            p.add_argument("--out", help="folder for the whole result (Parquet)")
    return parser


def main(argv: list[str] | None = None) -> int:
    from vitrine.operators.materialize import discard_all, materialized_paths
    from vitrine.sources import tables

    args = _parser().parse_args(argv)
    spark = _session()
    before = materialized_paths()
    try:
        if args.cmd == "init":
            print(json.dumps({"created": tables.create_gold_tables(spark, replace=args.replace)}))
        elif args.cmd == "load":
            marts = _marts(spark, args)
            if args.jdbc_url:
                props = {"driver": args.jdbc_driver} if args.jdbc_driver else {}
                counts = {t: tables.full_refresh_jdbc(df, t, args.jdbc_url, props)
                          for t, df in tables.mart_frames(marts).items()}
            else:
                tables.create_gold_tables(spark)
                counts = tables.load_marts(marts)
            print(json.dumps(counts))
        elif args.cmd == "report":
            from vitrine.plans import reports
            sections = reports.run_report(spark, _source(spark, args))
            for name, df in sections.items():
                print(f"## {name}")
                df.show(truncate=False)
            reports.write_report(sections, args.out, args.date)
        else:
            _show(_source(spark, args).query_readonly(args.query), args)
    finally:
        discard_all(spark, materialized_paths() - before)
    return 0


def _show(df, args) -> None:
    if args.out:
        df.write.mode("errorifexists").parquet(args.out)
        print(f"whole result in {args.out}")
        return
    shown = df.limit(args.limit + 1)
    if len(shown.take(args.limit + 1)) > args.limit:
        print(f"first {args.limit} rows, there are more (--limit, or --out for the whole result):")
    df.show(args.limit, truncate=False)


if __name__ == "__main__":
    sys.exit(main())
