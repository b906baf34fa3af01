"""The command line: index, search, query, similar, recent, clusters."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .errors import SearchError
from .operators.search import Engine
from .plans.index import Index, resolve_index
from .plans.output import FORMATS, render
from .sources.parsers import parse


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    out.add_argument("--output", choices=list(FORMATS), default="plain")
    out.add_argument("--index", help="index folder; else the nearest one above, else the one at home")
    verbs = out.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("index", help="bring the index up to date with a folder")
    v.add_argument("path")
    v.add_argument("--full", action="store_true", help="read all files again")
    v = verbs.add_parser("search", help="ranked text search")
    v.add_argument("text")
    v.add_argument("--limit", type=int, default=10)
    v.add_argument("--context-size", type=int, default=150)
    v.add_argument("--full-content", action="store_true")
    v = verbs.add_parser("query", help="filter expression, such as: type:contract amount:>1M")
    v.add_argument("expression")
    v.add_argument("--limit", type=int, default=10)
    v = verbs.add_parser("similar", help="documents like a file")
    v.add_argument("file")
    v.add_argument("--threshold", type=int)
    v.add_argument("--limit", type=int, default=10)
    v = verbs.add_parser("recent", help="documents modified lately")
    v.add_argument("--since", default="7d")
    v.add_argument("--limit", type=int, default=20)
    v = verbs.add_parser("clusters", help="groups of like documents")
    v.add_argument("path", nargs="?")
    v.add_argument("--bits", type=int, default=4, help="number of bands, 2 to 64: more bands, looser groups")
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    """The text that a call prints."""
    if args.verb == "index":
        folder = args.index or os.path.join(os.path.abspath(args.path), ".sparkloom")
        stats = Index(spark, folder).update(args.path, args.full)
        return f"added {stats.added}, skipped {stats.skipped}, removed {stats.removed}, errors {stats.errors}"
    index = Index(spark, resolve_index(args.index))
    engine = Engine(index.docs(), postings=index.postings())
    match args.verb:
        case "search":
            found = engine.search(args.text, args.limit, args.context_size, args.full_content)
        case "query":
            found = engine.query(args.expression, args.limit)
        case "similar":
            path = os.path.abspath(args.file)
            text = None
            if index.doc_id_for_path(path).isEmpty():
                with open(path, "rb") as f:
                    text = parse(path, f.read())[0]
            found = engine.similar(path, text, args.threshold, args.limit)
        case "recent":
            found = engine.recent(args.since, args.limit)
        case "clusters":
            rows = engine.clusters(args.bits, args.path and os.path.abspath(args.path)).collect()  # 20 rows at most
            return "\n".join(f"cluster of {r['size']}: " + ", ".join(r["members"]) + (f" and {r['more']} more" if r["more"] else "") for r in rows)
    return render(found, args.output)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sparkloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(run(spark, args))
    except SearchError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
