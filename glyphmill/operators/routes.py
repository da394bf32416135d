"""Transport routes: what a text looks like after each, measured against its source."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from glyphmill.functions import text as T
from glyphmill.functions.chartables import BIDI, CONFUSABLE_MARKS, HOMOGLYPHS, INVISIBLE, SPACES, TAGS, TYPOGRAPHIC, VARIATION


@F.pandas_udf(BinaryType())
def json_escaped_route(content: pd.Series) -> pd.Series:
    r"""Through JSON with \u escapes and back; null if it isn't UTF-8."""

    def one(data: bytes | None) -> bytes | None:
        try:
            return None if data is None else json.loads(json.dumps({"content": bytes(data).decode()}))["content"].encode()
        except UnicodeDecodeError:
            return None

    return content.map(one)


def routes(content: Column) -> dict[str, Column]:
    """What each route makes of the bytes. The clipboard belongs to a platform and gives nothing here."""
    return {
        "binary_write": content,
        "shell_redirect": content,
        "clipboard": F.lit(None).cast("binary"),
        "pty": T.terminal_route(content),
        "text_rewrite": T.text_route(content),
        "json_raw": T.json_route(content),
        "json_escaped": json_escaped_route(content),
    }


def run_routes(probes: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, route, content): every probe through every route."""
    made = probes.select(F.col(id_col).alias("id"), *(c.alias(f"_{name}") for name, c in routes(F.col(content_col)).items()))
    names = list(routes(F.lit(None).cast("binary")))
    return made.select("id", F.explode(F.array(*(F.struct(F.lit(n).alias("route"), F.col(f"_{n}").alias("content")) for n in names))).alias("x")).select("id", "x.route", "x.content")


def evaluate(results: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, route, sha256, bytes_len, byte_delta, identical_to_source) of results (id, route, content) against sources (id, source).

    Where a route gave nothing, or a source is unknown, the comparison is null. Repeated result rows count once.
    """
    rows = results.select("id", "route", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes_len")).distinct()
    from_ = sources.select("id", F.sha2("source", 256).alias("_sha"), F.octet_length("source").cast("long").alias("_n"))
    return rows.join(from_, "id", "left").select("id", "route", "sha256", "bytes_len", (F.col("bytes_len") - F.col("_n")).alias("byte_delta"), (F.col("sha256") == F.col("_sha")).alias("identical_to_source"))


def ascii_control() -> bytes:
    """A plain probe: all printable characters in order, runs of blanks of every length up to a tab's width, and each kind of line end that ASCII has."""
    printable = bytes(range(0x20, 0x7F))
    blanks = b"".join(b"|" + b" " * k for k in range(9)) + b"|\t|"
    return b"".join(line + end for line, end in ((printable, b"\n"), (blanks, b"\n"), (printable[::-1], b"\r\n"), (b"last line", b"\n")))


def unicode_probe() -> bytes:
    """A probe of the scanner's own tables: of each kind of code point some, spread over it, and a word in two normal forms."""
    kinds = {"invisible": INVISIBLE, "bidi": BIDI, "space": SPACES, "selector": VARIATION, "tag": TAGS, "typographic": TYPOGRAPHIC, "mark": CONFUSABLE_MARKS, "letter": frozenset(map(ord, HOMOGLYPHS))}
    lines = []
    for name, points in kinds.items():
        ordered = sorted(points)
        lines.append(name + " " + "".join(f"<{chr(cp)}>" for cp in ordered[:: -(-len(ordered) // 8)]))
    word = "".join(map(chr, (0x6B, 0xF4, 0x148, 0x1D6)))
    lines += [form + " " + unicodedata.normalize(form, word) for form in ("NFD", "NFC")]
    return "".join(line + "\n" for line in lines).encode()


def probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ascii_control", ascii_control()), ("unicode_probe", unicode_probe())], "id string, content binary")
