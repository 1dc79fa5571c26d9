"""python -m canopy [-l LANGUAGE] [-f FILE] [-w WORKERS] [-p] [QUERY] PATH...

A query may name its language itself. Languages without a parser here need the tree of each file,
printed with points, in a file of the same name with .tree added.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

from canopy import sink
from canopy.errors import QueryError


def main(argv: list[str] | None = None) -> int:
    from canopy.sources.parse import SUFFIXES

    p = argparse.ArgumentParser("canopy", description="Query the trees of source files and web pages.")
    p.add_argument("-l", "--language", choices=sorted(SUFFIXES), help="by default the one that the query names")
    p.add_argument("-f", "--from-file", help="read the query from this file")
    p.add_argument("-w", "--workers", type=int, default=1, help="threads")
    p.add_argument("-s", "--semantics", choices=("compat", "denotational"), default="compat")
    p.add_argument("-p", "--progress", action="store_true", help="show how far each stage is")
    p.add_argument("-v", "--version", action="version", version="0.1")
    p.add_argument("rest", nargs="+", metavar="QUERY/PATH")
    try:
        args = p.parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 5
    paths = list(args.rest)
    if args.from_file:
        with open(args.from_file, encoding="utf-8") as f:
            text = f.read()
    else:
        text = paths.pop(0)
    if not paths:
        return 5
    from pyspark.sql import SparkSession

    from canopy.engine import TreeEngine
    from canopy.errors import UnsupportedQueryError
    from canopy.sources.exported import ENDING, exported, with_trees
    from canopy.sources.parse import PARSERS, parsed, scan_files

    shown = str(args.progress).lower()
    spark = SparkSession.builder.master(f"local[{args.workers}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", shown).getOrCreate()
    held = None
    try:
        query = TreeEngine(spark, args.semantics).compile(text)
        language = args.language or query.language
        if language not in SUFFIXES:
            raise UnsupportedQueryError(f"no known language: {language}")
        began = time.perf_counter_ns()
        folders, files = ([x for x in paths if os.path.isdir(x) == want] for want in (True, False))
        found = [scan_files(spark, xs, language, explicit) for xs, explicit in ((folders, False), (files, True)) if xs]
        texts = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        if language not in PARSERS:
            printed = folders + [x + ENDING for x in files if os.path.exists(x + ENDING)]
            texts = with_trees(texts, spark, printed) if printed else texts.selectExpr("*", "cast(null as string) AS tree")
        texts = held = texts.cache()
        if language not in PARSERS and (bare := texts.where("tree is null").count()):
            raise UnsupportedQueryError(f"no parser for {language} here, and {bare} files have no {ENDING} file beside them")
        texts.count()
        read = time.perf_counter_ns() - began
        print(sink.document(query, parsed(texts, language) if language in PARSERS else exported(texts), read))
    except QueryError as e:
        print(f"error: {e}", file=sys.stderr)
        return 4
    finally:
        # the next run in this session may find other texts in the same files
        if held is not None:
            held.unpersist()
    return 0


if __name__ == "__main__":
    sys.exit(main())
