"""python -m meterlake list | debug PROVIDER [PLAN] | export [--json | --csv] [--provider KEY]

Exit codes of export: 0, 10 from 90 % of a window, 11 from 100 %, 20 without a reading; 1 on errors.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators.report import CSV_COLUMNS, EXIT_CODES
from .settings import SettingsError, load
from .sources import logs


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("meterlake")
    out.add_argument("--home", default=os.path.expanduser("~"), help="folder below which the tools keep their logs")
    out.add_argument("--settings", help="a settings file; its absence means the defaults")
    out.add_argument("--now", type=int, help="the instant to ask at, in epoch seconds")
    sub = out.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    debug = sub.add_parser("debug")
    debug.add_argument("provider", choices=list(logs.PROVIDERS))
    debug.add_argument("plan", nargs="?")
    export = sub.add_parser("export")
    kind = export.add_mutually_exclusive_group()
    kind.add_argument("--json", action="store_true")
    kind.add_argument("--csv", action="store_true")
    export.add_argument("--provider", choices=list(logs.PROVIDERS))
    return out


def run(spark: SparkSession, args: argparse.Namespace, out=sys.stdout) -> int:
    now = args.now if args.now is not None else int(time.time())
    roots = logs.discovered(args.home)
    if args.command == "list":
        for key, root in roots.items():
            print(f"{key}\t{logs.access(root)}\t{root[0]}", file=out)
        return EXIT_CODES["ok"]
    if args.command == "debug" or args.provider:
        roots = {args.provider: roots[args.provider]}
    engine = Engine.open(spark, roots, now, load(args.settings or f"{args.home}/.meterlake.json"))
    if args.command == "debug":
        engine = engine.set_plan(args.provider, args.plan) if args.plan else engine
        for r in engine.windows().orderBy("window_minutes").collect():
            print(f"{r.limit_id}\t{r.window_minutes}\t{r.used_percent}\t{r.confidence}\t{r.resets_at}\t{r.projected_percent}", file=out)
        for r in engine.store.errors().orderBy("path", "seq").limit(3).collect():
            print(r.message, file=sys.stderr)
        engine.close()
        return EXIT_CODES["ok"]
    if args.csv:
        # Rows are written as they come, sorted by Spark; the cells are escaped already.
        print(",".join(CSV_COLUMNS), file=out)
        for r in engine.csv().orderBy("provider", "dimension", F.col("start").cast("bigint"), "label").toLocalIterator():
            print(",".join(r), file=out)
    else:
        print(engine.json(), file=out)
    code = engine.exit_code()
    engine.close()
    return code


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("meterlake").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        code = run(spark, args)
    except (SettingsError, OSError) as e:
        print(e, file=sys.stderr)
        code = EXIT_CODES["error"]
    spark.stop()
    sys.exit(code)


if __name__ == "__main__":
    main()
