"""Command line: scan a catalogue of tables and print or save the graph."""

from __future__ import annotations

import argparse

from weftline.model import ScanConfig
from weftline.service import LineageService
from weftline.session import local_session
from weftline.sources.catalog import from_spark_catalog, saved_graph
from weftline.sources.store import log_report, scan_report


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="weftline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    serve = commands.add_parser("serve", help="scan, save and report")
    serve.add_argument("--project", required=True)
    serve.add_argument("--target", help="dataset.table to trace back from")
    serve.add_argument("--dataset", action="append", default=[], dest="datasets")
    serve.add_argument("--depth", type=int)
    serve.add_argument("--all", action="store_true", help="scan the whole project")
    serve.add_argument("--data-dir", default="data")
    serve.add_argument("--tables", help="directory of nodes, edges and shared_nodes tables; Spark's catalogue if not given")
    serve.add_argument("--no-scan", action="store_true")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    args = parse_args(argv)
    spark = local_session()
    errors: list[str] = []

    def catalogue():
        if args.tables:
            saved = saved_graph(spark, args.tables)
            return saved.nodes, saved.columns
        nodes, columns, failed = from_spark_catalog(spark)
        errors[:] = failed
        return nodes, columns

    service = LineageService(spark, args.data_dir, args.project, catalogue, args.no_scan)
    if not args.no_scan and (args.target or args.datasets or args.all):
        service.scan(ScanConfig(args.target, tuple(args.datasets), args.depth))
        log_report(service.current, errors)
    print("No graph yet" if service.current is None else scan_report(service.current, errors))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
