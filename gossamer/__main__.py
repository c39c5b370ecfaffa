"""python -m gossamer COMMAND: a thin front over the facade and the named queries."""

from __future__ import annotations

import argparse

from gossamer import __version__
from gossamer.api import CrawlAnalytics
from gossamer.session import get_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gossamer", description=__doc__)
    parser.add_argument("--data", default=".", help="folder of Parquet tables")
    parser.add_argument("--master", default=None)
    parser.add_argument("--rows", type=int, default=25)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    for name in ("stats", "domains", "documents", "graph", "crawls"):
        commands.add_parser(name)
    crawl = commands.add_parser("crawl")
    crawl.add_argument("seeds", nargs="+")
    crawl.add_argument("--max-depth", type=int, default=3)
    crawl.add_argument("--max-pages", type=int, default=None)
    recrawl = commands.add_parser("recrawl")
    recrawl.add_argument("--now", required=True)
    recrawl.add_argument("--age-hours", type=float, default=24.0)
    query = commands.add_parser("query")
    query.add_argument("name")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    spark = get_session(master=args.master)
    api = CrawlAnalytics(spark, args.data)
    if args.command == "crawl":
        df = api.crawl(args.seeds, args.max_depth, args.max_pages)
    elif args.command == "recrawl":
        df = api.recrawl(args.now, args.age_hours * 3600, args.rows)
    elif args.command == "query":
        from gossamer.plans import QUERIES

        df = QUERIES[args.name](spark, args.data)
    else:
        df = getattr(api, args.command)()
    df.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
