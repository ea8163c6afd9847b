"""Run one report from the command line.

    python -m boxlens q07 --tables /data/boxlens --year 2023 --out /data/out/q07
    python -m boxlens q17 --tpch /root/testdata/sf0.01 --year 1995 \\
        --set high_error_threshold=0 --set min_high_error_weeks=2 --show 20
    python -m boxlens --list

``--tables`` reads the four tables written by ``Tables.write`` (parquet under
one root); ``--tpch`` derives them from TPC-H style files; ``--catalog``
takes ``boxes=db.t1,errors=db.t2,picks=db.t3,date_dim=db.t4`` and
``--columns`` an optional JSON mapping of our column names to the source
ones, e.g. ``{"boxes": {"customer_id": "customer_fk"}}``.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
from decimal import Decimal

from boxlens.params import AnalysisParams
from boxlens.plans import REPORTS
from boxlens.session import get_session
from boxlens.sources.tables import Tables


def _coerce(params: AnalysisParams, key: str, raw: str):
    fields = {f.name: f for f in dataclasses.fields(params)}
    if key not in fields:
        raise SystemExit(f"unknown parameter {key!r}; known: {', '.join(sorted(fields))}")
    current = getattr(params, key)
    if isinstance(current, bool):
        return raw.lower() in ("1", "true", "yes")
    if isinstance(current, int):
        return int(raw)
    if isinstance(current, Decimal):
        return Decimal(raw)
    if isinstance(current, tuple):
        return tuple(int(x) for x in raw.split(","))
    return raw


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="boxlens", description=__doc__,
                                 formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("report", nargs="?", help="report id, e.g. q07 (see --list)")
    src = ap.add_mutually_exclusive_group()
    src.add_argument("--tables", help="root folder of the four parquet tables")
    src.add_argument("--tpch", help="folder of TPC-H style parquet files to derive the tables from")
    src.add_argument("--catalog", help="name=table pairs, comma separated")
    ap.add_argument("--columns", help="JSON: per table, our column name -> source column name")
    ap.add_argument("--year", default="2023")
    ap.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="override a parameter")
    ap.add_argument("--out", help="write the result as parquet here")
    ap.add_argument("--show", type=int, default=0, help="print this many rows")
    ap.add_argument("--master", default=None)
    ap.add_argument("--list", action="store_true", help="list the reports")
    args = ap.parse_args(argv)

    if args.list or not args.report:
        for name, fn in REPORTS.items():
            print(f"{name:4s} {fn.__name__:34s} {(fn.__doc__ or '').strip().splitlines()[0]}")
        return 0
    if args.report not in REPORTS:
        raise SystemExit(f"unknown report {args.report!r}")

    params = AnalysisParams(year=args.year)
    for item in args.set:
        key, _, raw = item.partition("=")
        params = params.with_(**{key: _coerce(params, key, raw)})

    spark = get_session(master=args.master)
    if args.tables:
        tables = Tables.from_parquet(spark, args.tables)
    elif args.tpch:
        tables = Tables.from_tpch(spark, args.tpch)
    elif args.catalog:
        columns = json.loads(args.columns) if args.columns else None
        tables = Tables.from_catalog(
            spark, dict(kv.split("=", 1) for kv in args.catalog.split(",")), columns=columns
        )
    else:
        raise SystemExit("give --tables, --tpch or --catalog")

    result = REPORTS[args.report](tables, params)
    if args.out:
        result.write.mode("overwrite").parquet(args.out)
    if args.show or not args.out:
        result.show(args.show or 20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
