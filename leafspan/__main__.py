"""python -m leafspan build|sections|parse|retrieve-tree|retrieve|compare: JSON lines to standard output."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.sql import SparkSession

from leafspan import api
from leafspan.config import Settings, settings
from leafspan.operators import trees
from leafspan.sources import tables


def arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="leafspan")
    sub = top.add_subparsers(dest="command", required=True)
    commands = {"build": ["source", "target"], "sections": ["source"], "parse": ["query"], "retrieve-tree": ["index", "query"], "retrieve": ["index", "query"], "compare": ["actual", "expected"]}
    for name, positional in commands.items():
        p = sub.add_parser(name)
        for a in positional:
            p.add_argument(a)
        p.add_argument("--env-file")
        p.add_argument("--layout", default="auto", choices=["auto", "h1_forest", "page_per_page"])
        p.add_argument("--outline")
        p.add_argument("--profile")
        for f in dataclasses.fields(Settings):
            p.add_argument("--" + f.name.replace("_", "-"), default=None, dest=f.name)
    return top.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    options = settings({f.name: getattr(a, f.name) for f in dataclasses.fields(Settings)}, env_file=a.env_file)
    spark = SparkSession.builder.appName("leafspan").getOrCreate()
    profile = tables.read_profile(json.dumps(tables.read_json(spark, tables.existing(spark, a.profile)))) if a.profile else None
    if a.command == "build":
        api.build_index(spark, a.source, a.target, options=options, layout=a.layout, outline=a.outline)
    elif a.command == "parse":
        print(json.dumps(dataclasses.asdict(api.parse_query(spark, a.query, profile)), ensure_ascii=False))
    else:
        if a.command == "retrieve":
            rows = api.retrieve_evidence(spark, a.index, a.query, options=options, profile=profile).orderBy("evidence_rank")
        elif a.command == "retrieve-tree":
            rows = api.retrieve_tree(spark, a.index, a.query, options=options, profile=profile).orderBy("doc_rank", "local_rank")
        elif a.command == "sections":
            outline = tables.read_outline(spark, a.outline) if a.outline else None
            rows = api.section_table(tables.read_markdown(spark, tables.existing(spark, a.source)), a.layout, outline).orderBy("doc_id", "node_id")
        else:
            rows = trees.comparison_report(*[spark.read.json(p) for p in (a.actual, a.expected)])
        for line in rows.toJSON().toLocalIterator():
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
