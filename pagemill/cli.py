"""Command line: convert, markdown (md), text, json, info, extract, version. Exit codes: 0, 1 failure, 2 with warnings."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import api
from .plans import sinks


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="pagemill", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for names in (("convert",), ("markdown", "md"), ("text",), ("json",), ("info",), ("extract",)):
        own = commands.add_parser(names[0], aliases=names[1:])
        own.add_argument("input")
        own.add_argument("-o", "--output")
        own.add_argument("--pages", default="all")
        own.add_argument("--password", default="")
        own.add_argument("--cleanup", choices=["minimal", "standard", "aggressive", "none"], default="standard")
        own.add_argument("--frontmatter", action="store_true")
        own.add_argument("--page-markers", action="store_true")
        own.add_argument("--keep-ocr-text", action="store_true")
        own.add_argument("--formats", default="markdown,text,json")
        own.add_argument("--pretty", action="store_true")
    commands.add_parser("version")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _arguments().parse_args(argv)
    if args.command == "version":
        print(api.version())
        return 0
    builder = api.Pdf(SparkSession.builder.getOrCreate()).with_pages(args.pages).with_password(args.password).with_cleanup(None if args.cleanup == "none" else args.cleanup)
    builder = builder.with_frontmatter(args.frontmatter)._render(page_markers=args.page_markers).with_ocr_suppression(not args.keep_ocr_text)
    found = builder.parse(args.input).persist()
    failed = False
    for r in found.errors().toLocalIterator():  # a partition at a time, however many there are
        failed = True
        print(f"{r.doc_id}: {r.error_class}: {r.error_message}", file=sys.stderr)
    command = {"md": "markdown"}.get(args.command, args.command)
    if command in ("convert", "extract"):
        write = sinks.write_files if command == "convert" else sinks.write_tables
        write(found.rows, args.output or "out", args.formats.split(","), found.options).show(truncate=False)
    elif command == "info":
        for row in found.info().toLocalIterator():
            print(api.dumps(row.asDict(True)))
    else:
        made = {"markdown": found.to_markdown, "text": found.to_text, "json": lambda: found.to_json(args.pretty)}[command]()
        if args.output:
            made.write.mode("overwrite").parquet(args.output)
        else:
            for row in made.toLocalIterator():
                print(row[1])
    if found.document().limit(1).count() == 0:
        return 1
    return 2 if failed or found.quality().where("warning is not null").limit(1).count() else 0


if __name__ == "__main__":
    sys.exit(main())
