"""Command line: list and check datasets, run experiments and guards; exit code 1 on violations and failures."""

from __future__ import annotations

import argparse
import json
import sys

from .sources.registry import Registry


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ctxloom")
    p.add_argument("--registry", default="configs")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    info = sub.add_parser("info")
    info.add_argument("name")
    sub.add_parser("verify")
    query = sub.add_parser("query")
    query.add_argument("name")
    query.add_argument("data")
    run = sub.add_parser("run")
    run.add_argument("names", nargs="*")
    run.add_argument("--out")
    guard = sub.add_parser("guard")
    guard.add_argument("name", choices=["pit", "folds", "repeated"])
    guard.add_argument("path")
    guard.add_argument("--keys", default="")
    a = p.parse_args(args)
    registry = Registry(a.registry)
    if a.command == "list":
        print("\n".join(registry.names()))
    elif a.command == "info":
        d = registry.info(a.name)
        print(json.dumps({"name": d.name, "path": d.path, "target": d.target, "time_col": d.time_col}))
    elif a.command == "verify":
        found = registry.verify()
        print(json.dumps(found))
        return int(not all(found.values()))
    elif a.command == "run":
        from .operators.runner import run_registered

        wanted = a.names or [n for n in registry.names() if "experiment" in registry.info(n).settings]
        done = run_registered(session(), registry, wanted, a.out)
        print("\n".join(f"{r.name} {r.improvement:.2f} %" for r in done))
        return int(len(done) < len(wanted))
    elif a.command == "query":
        from .catalog import queries

        queries()[a.name](session(), a.data).show(50, False)
    else:
        from .operators import guards

        df = session().read.parquet(a.path)
        bad = {"pit": lambda: guards.pit_violations(df), "folds": lambda: guards.fold_violations(df), "repeated": lambda: guards.repeated_keys(df, a.keys.split(","))}[a.name]()
        found = guards.report(bad)
        print(json.dumps(found, default=str))
        return int(not found["pass"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
