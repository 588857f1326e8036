"""``python -m alignforge.plans.cli REFERENCE QUERY``: align two files by position.

Defaults, then the config file (-c), then options given on the command line.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import fields
from pathlib import Path

from pyspark.sql import SparkSession

from alignforge.plans.config import AlgoConfig, RunConfig, SWConfig
from alignforge.plans.run import run_comparison


def parse(argv: list[str] | None = None):
    p = argparse.ArgumentParser(prog="alignforge")
    p.add_argument("reference")
    p.add_argument("query")
    p.add_argument("-c", "--config", help="JSON file with any of the options")
    p.add_argument("-o", "--output", help="folder for results and log")
    for f in [*fields(SWConfig), *fields(AlgoConfig), *fields(RunConfig)]:
        kind = (lambda s: s.lower() in ("1", "true", "yes")) if f.type in ("bool", bool) else {"int": int, "str": str}[f.type]
        p.add_argument(f"--{f.name}", type=kind, default=None)
    a = p.parse_args(argv)
    given = json.loads(Path(a.config).read_text()) if a.config else {}
    given |= {k: v for k, v in vars(a).items() if v is not None and k not in ("reference", "query", "config", "output")}
    pick = lambda kind: kind(**{f.name: given[f.name] for f in fields(kind) if f.name in given})
    return a, pick(SWConfig), pick(AlgoConfig), pick(RunConfig)


def main(argv: list[str] | None = None) -> int:
    args, sw, algo, run = parse(argv)
    spark = SparkSession.builder.appName("alignforge").getOrCreate()
    print(json.dumps(run_comparison(spark, args.reference, args.query, sw, algo, run, args.output)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
