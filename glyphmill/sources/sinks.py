"""Sinks: JSON lines with a check after writing, report documents, and reports for a terminal."""

from __future__ import annotations

import platform
import unicodedata

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from glyphmill import __version__
from glyphmill.operators.compare import shown
from glyphmill.operators.records import verified, violations
from glyphmill.operators.scan import CONTEXT_CAP, POSITION_CAP

NOTE = "No hidden characters found doesn't show that no statistical mark is there. Results don't establish who or what wrote a text."


def write_manifest(records: DataFrame, path: str) -> int:
    """Write verified records as JSON lines, read them back, verify again; gives their number, or raises."""
    verified(records).write.mode("errorifexists").option("ignoreNullFields", True).json(path)
    back = records.sparkSession.read.schema(records.schema).json(path)
    found = violations(back).first()
    if found.bad_sha or found.bad_length or found.bad_text or found.records != records.count():
        raise ValueError(f"the manifest does not reproduce: {found}")
    return found.records


def write_reports(reports: DataFrame, path: str) -> None:
    """One ASCII JSON document a line, with versions and caps."""
    head = F.struct(F.lit("glyphmill " + __version__).alias("generator"), F.lit(unicodedata.unidata_version).alias("unidata_version"), F.lit(POSITION_CAP).alias("position_cap"), F.lit(NOTE).alias("note"))
    line = F.to_json(F.struct(head.alias("header"), F.struct(*map(F.col, reports.columns)).alias("report")), {"writeNonAsciiCharacterAsCodePoint": "true"})
    reports.select(line.alias("value")).write.mode("errorifexists").text(path)


def write_analysis(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def summary_text(tables: dict[str, DataFrame], categories: tuple[str, ...] = ("invisible", "bidi", "tag", "variation_selector", "nonascii_space", "typographic")) -> str:
    """An analysis for a terminal: rates of each group, the pooled bound, offenders against ASCII. One row for each group is read."""
    rates: dict[str, dict[str, float]] = {}
    for r in tables["bucket_rates"].where(F.col("category").isin(*categories)).collect():
        rates.setdefault(r.grp, {})[r.category] = r.per_1k
    out = ["flagged characters per 1,000", " ".join(["group".ljust(24), *(c[:14].rjust(14) for c in categories)])]
    out += [" ".join([shown(g).ljust(24), *(str(row.get(c)).rjust(14) for c in categories)]) for g, row in sorted(rates.items())]
    p = tables["pooled_hidden"].first()
    out.append(f"hidden characters: {p.hidden} in {p.total_chars}; 95% upper bound {p.wilson_upper_per_1k_chars} per 1,000")
    bad = tables["ascii_violations"].groupBy("grp").agg(F.sum("n").alias("n")).orderBy("grp").collect()
    out += [f"ASCII-only texts of {shown(r.grp)}: {r.n} other characters" for r in bad]
    return "\n".join([*out, NOTE])


def report_text(report: Row, positions: int = 20, contexts: int = 5) -> str:
    """A scan report of one document, in ASCII only."""
    out = [f"document: {shown(str(report.id))}", f"sha256:   {report.sha256}", f"size:     {report.utf8_bytes} bytes, {report.char_count} characters"]
    out += [f"{k}: {v}" for k, v in report.summary.asDict().items()]
    for bucket, found in report.buckets.items():
        if found:
            out.append(f"== {bucket}: {len(found)} distinct, {sum(e['count'] for e in found)} in all")
        for e in found:
            out.append(f"  {e['codepoint']} {e['name']} x{e['count']} at {e['positions'][:positions]}{' ...' if e['count'] > positions else ''}")
            out += [f"    {c}" for c in (e["contexts"] or [])[: min(contexts, CONTEXT_CAP)]]
    out += [f"hidden payload: {shown(p)}" for p in report.hidden_tag_payloads] + list(report.notes) + [NOTE]
    return "\n".join(out)


def difference_text(rows: list[Row], most: int = 50) -> str:
    """Differences of a pair, in ASCII only."""
    out = [f"{len(rows)} differences"]
    for r in rows[:most]:
        out += [f"[{r.n}] {r.op} a[{r.a_start}:{r.a_end}] b[{r.b_start}:{r.b_end}] {r.classification}", f"  a: {r.a_context}", f"  b: {r.b_context}"]
    return "\n".join(out)


def environment(spark: SparkSession) -> DataFrame:
    """One row: versions of what computes the results, and whether settings are present; no values of settings."""
    row = (__version__, platform.python_version(), spark.version, unicodedata.unidata_version, spark.conf.get("spark.sql.session.timeZone"), bool(spark.conf.get("spark.checkpoint.dir", None)))
    return spark.createDataFrame([row], "package string, python string, spark string, unidata string, time_zone string, has_checkpoint_dir boolean")


def source_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of the source files under a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(root)
    return raw.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("sha256"))
