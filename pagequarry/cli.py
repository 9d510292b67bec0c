"""Command line over the same pipelines."""

from __future__ import annotations

import argparse
import json
import logging
import runpy
import sys

from . import config as conf
from .errors import QuarryError
from .plans.library import plan_library, plan_names
from .operators.movie import unknown_aliases
from .sources.files import existing_below, scan_files
from .sources.registry import SOURCES, counts, fetch, listing, trusted_union

log = logging.getLogger("pagequarry")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagequarry")
    p.add_argument("--config")
    modes = p.add_subparsers(dest="mode", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--source", action="append", dest="sources", help="a Python file that registers sources")
    shared.add_argument("--node-mapping", action="append")
    shared.add_argument("--multi-source", action="store_true", default=None)
    shared.add_argument("--multi-source-max-sources", type=int)
    shared.add_argument("--output")
    shared.add_argument("--multi-folder", choices=["first", "hard", "soft"])
    shared.add_argument("--max-depth", type=int)
    shared.add_argument("--input-name-rule", action="append", dest="input_name_rules")
    name = modes.add_parser("name", parents=[shared], help="the record for a name, as XML")
    name.add_argument("name")
    for mode, text in (("file", "plan for one file"), ("dir", "plan for a directory"), ("watch", "plans for files as they settle")):
        m = modes.add_parser(mode, parents=[shared], help=text)
        m.add_argument("input")
        m.add_argument("--apply", metavar="ROOT", help="carry the plan out below this directory")
        if mode == "watch":
            m.add_argument("--state", metavar="DIR", help="where the state of the watched directory is kept between runs")
            m.add_argument("--seconds", type=float, help="stop after some time")
    modes.add_parser("scripts", parents=[shared], help="list the sources")
    return p


def main(argv: list[str] | None = None) -> int:
    args = vars(_parser().parse_args(argv))
    try:
        return _run(args)
    except QuarryError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code


def warn_unknown(spark, settings: conf.Settings) -> None:
    """Logs aliases of the priorities that no source has."""
    for what, wanted in (("images", settings.priority_images), ("details", settings.priority_details)):
        if wanted:
            rows = spark.createDataFrame(list(enumerate(wanted)), "ord int, alias string")
            if found := [r.alias for r in unknown_aliases(rows, listing(spark, SOURCES)).collect()]:
                log.warning("priority of %s names sources that there are not: %s", what, ", ".join(found))


def _run(args: dict) -> int:
    import os

    from pyspark.sql import SparkSession

    mode = args.pop("mode")
    config = conf.load(args.pop("config"))
    call = {k: v for k, v in args.items() if k in conf._KINDS}
    settings = conf.resolve(config, "dir" if mode == "scripts" else mode, call)
    paths = conf.all_sources(config) + (args.get("sources") or []) if mode == "scripts" else conf.expand(settings.sources)
    for path in dict.fromkeys(paths):
        runpy.run_path(path)
    spark = SparkSession.builder.appName("pagequarry").getOrCreate()
    if mode == "scripts":
        listed = listing(spark, SOURCES)
        for r in [*counts(listed).toJSON().collect(), *listed.orderBy("ord").toJSON().collect()]:
            print(r)
        return 0
    warn_unknown(spark, settings)
    if mode == "name":
        print(plan_names(spark.createDataFrame([(args["name"], args["name"], None)], "entity_id string, name string, path string"), SOURCES, settings).first().nfo)
        return 0
    root = os.path.abspath(args["input"])
    if mode == "watch":
        from .streaming.local import watch_directory

        return watch_directory(spark, root, SOURCES, settings, args["apply"], args["seconds"], args["state"])
    files = scan_files(spark, os.path.dirname(root) if mode == "file" else root, 0 if mode == "file" else settings.max_depth)
    existing = existing_below(spark, args["apply"]) if args["apply"] else None
    done = plan_library(files, SOURCES, settings, only=root if mode == "file" else None, existing=existing)
    if args["apply"]:
        from .plans.writer import carry_out_groups

        trusted, wrong = trusted_union(SOURCES), False
        done = carry_out_groups(done.actions, args["apply"], existing, done.records, lambda url: fetch(url, trusted), keep_going=False, workers=settings.fetch_threads)
        for group, steps, error in done.orderBy("group_id").toLocalIterator():
            print(json.dumps({"group": group, "steps": steps, "error": error}))
            wrong = wrong or error is not None
        return int(wrong)
    for r in done.actions.orderBy("group_id", "step").toJSON().toLocalIterator():
        print(r)
    return 0


if __name__ == "__main__":
    sys.exit(main())
