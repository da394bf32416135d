"""Command line: ``python -m glyphmill scan FILE ...`` and ``python -m glyphmill compare A B``, each with ``--json``.

Ends with 0, with 1 if compared files differ, with 2 if a file can't be read.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import compare, scan
from glyphmill.sources import sinks


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="glyphmill")
    kinds = parser.add_subparsers(dest="what", required=True)
    for name, files in (("scan", "+"), ("compare", 2)):
        kind = kinds.add_parser(name)
        kind.add_argument("files", nargs=files)
        kind.add_argument("--json", action="store_true")
    given = parser.parse_args(argv)
    try:
        contents = [Path(f).read_bytes() for f in given.files]
    except OSError as e:
        print(f"cannot read: {e}", file=sys.stderr)
        return 2
    if given.what == "compare":
        return _compare(contents, given.json)
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    reports = scan.reports(spark.createDataFrame(list(zip(given.files, contents)), "id string, content binary"), "id", "content")
    if given.json:
        for row in reports.select(F.to_json(F.struct("*"), {"writeNonAsciiCharacterAsCodePoint": "true"}).alias("j")).toLocalIterator():
            print(row.j)
    else:
        for row in reports.toLocalIterator():
            print(sinks.report_text(row))
    return 0


def _compare(contents: list[bytes], as_json: bool) -> int:
    a, b = contents
    rows = [] if a == b else [dict(zip(compare.CHAR_SCHEMA.names, r)) for r in compare.char_differences(a.decode("utf-8", "replace"), b.decode("utf-8", "replace"))]
    if as_json:
        print(json.dumps({"byte_identical": a == b, "char_differences": rows}, ensure_ascii=True))
    else:
        print("equal" if a == b else sinks.difference_text([_Row(r) for r in rows]))
    return int(a != b)


class _Row:
    def __init__(self, values: dict) -> None:
        self.__dict__.update(values)


if __name__ == "__main__":
    sys.exit(main())
