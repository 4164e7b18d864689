"""Command line: ``python -m gatecrest.cli [scan|check|version] PATH [-l LEVEL] [-j] [-o FILE] [-s] [-q] [-d] [-n N]``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from gatecrest.api import Engine
from gatecrest.plans import report as R
from gatecrest.sources.files import TooManyFiles

COMMANDS = ("scan", "report", "analyze", "check", "version")


class Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        print(message, file=sys.stderr)
        raise SystemExit(3)


def parser() -> Parser:
    p = Parser(prog="gatecrest")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("-l", "--level", choices=("critical", "warning", "info"), default="info")
    p.add_argument("-j", "--json", action="store_true")
    p.add_argument("-o", "--output")
    p.add_argument("-s", "--summary", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-d", "--dashboard", action="store_true")
    p.add_argument("-n", "--max-files", type=int)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: nothing above info; 1: warnings; 2: critical findings; 3: files failed, or wrong usage."""
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in COMMANDS and not argv[0].startswith("-"):
        argv.insert(0, "scan")
    try:
        o = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if o.command == "version":
        print(R.VERSION)
        return 0
    if not os.path.exists(o.path):
        print(f"{o.path} doesn't exist", file=sys.stderr)
        return 3
    spark = spark or SparkSession.builder.appName("gatecrest").getOrCreate()
    engine = Engine(spark, max_files=o.max_files)
    try:
        a = engine.analyse_directory(o.path) if os.path.isdir(o.path) else engine.analyse_file(o.path)
    except TooManyFiles as e:
        print(e, file=sys.stderr)
        return 3
    r = R.report(a, o.level)
    text = R.as_json(r, o.path, file_limit=o.max_files) if o.json else R.dashboard(a) if o.dashboard else R.as_text(r, o.summary or o.command == "check", o.quiet)
    if o.output:
        with open(o.output, "w") as f:
            f.write(text + "\n")
    else:
        print(text)
    return r.exit_code


if __name__ == "__main__":
    raise SystemExit(main())
