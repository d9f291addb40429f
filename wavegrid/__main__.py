"""Command line: ``python -m wavegrid queries | lenses | scales | run QUERY FOLDER | notes WAV... | render PICTURES OUT``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wavegrid", description="signals, pictures and series as DataFrames")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="list the registered queries")
    sub.add_parser("lenses", help="list image and motion lenses as JSON").add_argument("--folder", help="load further lenses from a folder")
    sub.add_parser("scales", help="list scales by base")
    run = sub.add_parser("run", help="run a query over a folder of tables and print its rows")
    run.add_argument("query"), run.add_argument("folder"), run.add_argument("--rows", type=int, default=20)
    words = sub.add_parser("notes", help="print the notes of recordings in words")
    words.add_argument("wav", nargs="+")
    render = sub.add_parser("render", help="encode, decode, notate and decode again every picture of a folder")
    render.add_argument("pictures"), render.add_argument("out"), render.add_argument("--rows", type=int, default=200), render.add_argument("--cols", type=int, default=400)
    render.add_argument("--sr", type=int, default=22050), render.add_argument("--bpm", type=float, default=120), render.add_argument("--voice", default="vibes")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "queries":
        from wavegrid.plans import catalog

        for name in sorted(catalog.queries()):
            print(name + ("" if name in catalog.oracle_sql() else "  (no SQL)"))
    elif args.command == "lenses":
        from wavegrid.operators import plugins

        if args.folder:
            plugins.discover(args.folder)
        print(plugins.listing())
    elif args.command == "scales":
        from wavegrid.functions import tables

        for base, scales in ((10, tables.SCALES), (60, tables.RATIO_SCALES)):
            print(f"base {base}: {', '.join(sorted(scales))}")
    else:
        from wavegrid.session import local_session

        return work(local_session("wavegrid"), args)
    return 0


def work(spark, args: argparse.Namespace) -> int:
    """The commands that need a session."""
    if args.command == "run":
        from wavegrid.plans import catalog

        if args.query not in catalog.queries():
            print(f"unknown query {args.query}", file=sys.stderr)
            return 2
        catalog.queries()[args.query](spark, args.folder).show(args.rows, truncate=False)
    elif args.command == "notes":
        from wavegrid.operators import note_finder
        from wavegrid.sources import wav

        for r in note_finder.describe(wav.read(spark, args.wav)).orderBy("stem").toLocalIterator():
            print(f"{r.stem}: {r.words}")
    else:
        from wavegrid.operators import stages
        from wavegrid.sources import images

        def keep(stage, table):
            table.write.mode("overwrite").parquet(f"{args.out}/{stage}")
            return spark.read.parquet(f"{args.out}/{stage}")

        grids = images.grids(spark, args.pictures, args.rows, args.cols).withColumnRenamed("stem", "name")
        made = stages.render(grids, keep, args.sr, args.rows, args.cols, args.bpm, args.voice)
        for stage, table in made.items():
            failed = table.where("error is not null").count() if "error" in table.columns else 0
            print(f"{stage}: {table.count()} jobs, {failed} failed")
    return 0


if __name__ == "__main__":
    sys.exit(main())
