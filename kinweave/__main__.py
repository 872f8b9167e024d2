"""Command line: python -m kinweave path A B, metrics, compare, subgraph, search, explore, serve.

A graph is a folder as `sources.tables.write_graph` leaves it.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import render
from .sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinweave", description="Questions to a similarity graph")
    p.add_argument("--data-path", default=str(Path.home() / ".kinweave"), help="folder of the graph's tables")
    sub = p.add_subparsers(dest="command", required=True)
    path = sub.add_parser("path", help="shortest path between two entities, by name")
    path.add_argument("a")
    path.add_argument("b")
    path.add_argument("-m", "--min-match", type=float, default=0.0, help="least similarity of a connection, 0 to 1")
    path.add_argument("-t", "--top-related", type=int, default=80, help="strongest connections of each entity that count")
    path.add_argument("-w", "--weighted", action="store_true", help="best similarity instead of fewest steps")
    path.add_argument("-u", "--hide-urls", action="store_true")
    path.add_argument("-i", "--show-ids", action="store_true")
    path.add_argument("-s", "--show-similarity", action="store_true")
    path.add_argument("--no-color", action="store_true")
    path.add_argument("-v", "--verbose", action="store_true", help="say what was searched and how long it took")
    path.add_argument("-q", "--quiet", action="store_true", help="the names only")
    path.add_argument("--json", action="store_true")
    search = sub.add_parser("search", help="entities whose name holds a text")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=10)
    explore = sub.add_parser("explore", help="an entity's neighbourhood, by name")
    explore.add_argument("name")
    explore.add_argument("--budget", type=int, default=100)
    explore.add_argument("--weighted", action="store_true")
    explore.add_argument("--reverse", action="store_true")
    metrics = sub.add_parser("metrics", help="statistics of the graph, as JSON")
    metrics.add_argument("--output")
    compare = sub.add_parser("compare", help="the graph against a part of it, as JSON")
    compare.add_argument("--sub-path", required=True, help="folder of the part's tables")
    compare.add_argument("--output")
    subgraph = sub.add_parser("subgraph", help="write a random-walk sample of the graph")
    subgraph.add_argument("output")
    subgraph.add_argument("--seed", type=int, default=456)
    subgraph.add_argument("--share", type=float, default=0.2)
    serve = sub.add_parser("serve", help="answer over HTTP")
    serve.add_argument("--port", type=int, default=3050)
    return p


def _dicts(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def _report(tables_: dict[str, DataFrame]) -> dict:
    out = {k: _dicts(df) for k, df in tables_.items()}
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}


def _say(text: str, output: str | None = None) -> None:
    if output:
        Path(output).write_text(text)
    else:
        print(text)


def _path(lib: api.Library, args: argparse.Namespace) -> int:
    began = time.perf_counter()
    try:
        a, b = api.resolve(lib, args.a, args.b)
    except LookupError as e:
        print(e.args[0], file=sys.stderr)
        return 1
    got = api.path_with_stats(lib, a, b, "dijkstra" if args.weighted else "bfs", args.min_match, args.top_related)
    stats, seconds = got["search_stats"].first(), time.perf_counter() - began
    if args.json:
        print(render.path_json(got["path"], f"{args.a} -> {args.b}", stats["artists_visited"], seconds).first()["json"])
        return 0
    steps = got["path"].collect()
    paint = (lambda x: x) if args.no_color or not sys.stdout.isatty() else (lambda x: f"\033[1m{x}\033[0m")
    if not steps:
        print(f"No path from {args.a} to {args.b}")
    else:
        print(paint(" → ".join(r["name"] or str(r["id"]) for r in steps)))
        if not args.quiet:
            for r in steps:
                shown = [f"{r['step'] + 1}. {r['name']}"]
                if args.show_similarity and r["step"]:
                    shown.append(f"[{r['similarity']:.3f}]")
                shown += [str(r["id"])] * args.show_ids + [r["url"] or ""] * (not args.hide_urls)
                print("  ".join(shown))
    if args.verbose:
        print(f"{stats['artists_visited']:,} entities visited in {seconds:.3f} s; at most {args.top_related} connections each, similarity from {args.min_match}")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("kinweave").getOrCreate()
    g = tables.read_graph(spark, args.data_path)
    lib = api.Library(g["edges"], g["entities"])
    if args.command == "path":
        return _path(lib, args)
    if args.command == "search":
        _say("\n".join(f"{r['id']}  {r['name']}" for r in api.search(lib, args.query, args.limit).collect()))
    elif args.command == "explore":
        try:
            (ident,) = api.resolve(lib, args.name)
        except LookupError as e:
            print(e.args[0], file=sys.stderr)
            return 1
        got = api.explore(lib, ident, "dijkstra" if args.weighted else "bfs", budget=args.budget, reverse=args.reverse)
        _say(json.dumps(_report(got), indent=1))
    elif args.command == "metrics":
        _say(json.dumps(_report(api.metric_report(lib)), indent=1), args.output)
    elif args.command == "compare":
        part = tables.read_graph(spark, args.sub_path)
        _say(json.dumps(_report(api.compare_report(g["edges"], part["edges"])), indent=1), args.output)
    elif args.command == "subgraph":
        got = api.subgraph(lib, args.share, args.seed)
        named = g["entities"].join(got["nodes"], "id", "left_semi")
        tables.write_graph(got["edges"], named, args.output)
        tables.write_metrics(got["stats"].withColumn("seed", F.lit(args.seed)), f"{args.output}/stats")
    else:
        from .serve import serve

        serve(lib, args.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
