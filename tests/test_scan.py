"""Positive and negative controls of the scanner, built from code points."""

import unicodedata

import pytest

from glyphmill.functions.chartables import BIDI, HOMOGLYPHS, INVISIBLE, ascii_equivalent
from glyphmill.operators import scan


def chars(spec):
    return "".join(chr(int(x, 16)) for x in spec.split())


FIXTURES = {
    **{f"invisible_{cp:04X}": f"A bridge of stone{chr(cp)} over the mill stream.\n" for cp in sorted(INVISIBLE)},
    "bom": chars("FEFF") + "leading",
    "bidi": "x".join(map(chr, sorted(BIDI))),
    "tags": "visible\n" + chars("E0001") + "".join(chr(0xE0000 + ord(c)) for c in "seven blue doors") + chars("E007F") + "\nvisible\n",
    "selectors": chars("2714 FE0F") + " a" + chars("E0100") + " " + chars("2764 FE0E"),
    "combining": "e" + chars("301") + " a" + chars("308") + " x" + chars("20DD") + " " + chars("915 93E"),
    "homoglyphs": f"p{chars('430')}yp{chars('430')}l s{chars('43E')}me b{chars('3BF')}dy ha{chars('3BD')}e " + chars("43F 440 438 432 435 442"),
    "typographic": chars("2018 2019 201C 201D 2013 2014 2026 2010 2011 201A 201E"),
    "mixed": "caf" + chars("E9") + " cafe" + chars("301"),
    "cap": "a" * 250 + "\n",
    "plain": "Printable ASCII, a\ttab, one CRLF line\r\nand LF.\n",
    "accented": "Où est Dvořák ? Émile.",
    "empty": "",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, v.encode(), "clash") for k, v in FIXTURES.items()] + [("broken", b"ok \xc3( no", "clash"), ("nil", None, "clash")], "id string, content binary, ch string")


@pytest.fixture(scope="module")
def reports(docs):
    return {r.id: r for r in scan.reports(docs, "id", "content").collect()}


def found(report, bucket):
    return {e["cp"]: e for e in report.buckets[bucket]}


def test_invisible_characters(reports):
    for cp in INVISIBLE:
        r = reports[f"invisible_{cp:04X}"]
        assert set(found(r, "invisible_zero_width")) == {cp} and not r.buckets["typographic"]
        assert r.summary.has_invisible_characters and r.summary.any_suspicious
        assert f"stone[[U+{cp:04X}]] over" in found(r, "invisible_zero_width")[cp]["contexts"][0]
    assert "Leading U+FEFF byte-order mark present." in reports["bom"].notes


def test_bidi_tags_selectors_marks(reports):
    assert set(found(reports["bidi"], "bidi_controls")) == set(BIDI)
    assert list(reports["tags"].hidden_tag_payloads) == ["[TAG-LANG]seven blue doors[TAG-END]"]
    assert set(found(reports["selectors"], "variation_selectors")) == {0xFE0F, 0xFE0E, 0xE0100} and not reports["selectors"].buckets["combining_marks"]
    assert {e["category"] for e in reports["combining"].buckets["combining_marks"]} == {"Mn", "Mc", "Me"}


def test_homoglyphs_only_in_mixed_words(reports):
    r = reports["homoglyphs"]
    flagged = found(r, "confusable_homoglyph")
    assert set(flagged) == {0x430, 0x43E, 0x3BF, 0x3BD} and flagged[0x430]["mixed_script_word_occurrences"] == 2
    assert set(found(r, "other_non_ascii")) == {int(x, 16) for x in "43F 440 438 432 435 442".split()}
    assert len(HOMOGLYPHS) == 50 and ascii_equivalent(chr(0x430)) == "a"


def test_typographic_accented_and_plain_text(reports):
    r = reports["typographic"]
    assert len(r.buckets["typographic"]) == 11 and not r.summary.any_suspicious
    r = reports["accented"]
    assert not r.summary.any_suspicious and found(r, "typographic")[0xC9]["ascii_equiv"] == "E"
    for name in ("plain", "empty"):
        r = reports[name]
        assert not any(r.buckets.values()) and r.summary.is_pure_ascii and r.summary.is_printable_ascii_plus_newline_tab and not r.notes


def test_normal_forms_and_decoding(reports):
    n = reports["mixed"].normalization
    assert n.mixed and not n.nfc_is and not n.nfd_is and len(n.nfkd_sha256) == 64
    assert not reports["accented"].normalization.mixed
    r = reports["broken"]
    assert not r.utf8_valid and (r.decode_error.byte_offset, r.decode_error.bad_bytes_hex) == (3, "C3") and "FILE IS NOT VALID UTF-8" in r.notes
    assert "nil" not in reports


def test_position_cap(spark):
    one = scan.inventory(spark.createDataFrame([(1, "a" * 250 + "\n")], "id int, text string"), "id", "text").where("ch = 'a'").first()
    assert (one.n, len(one.positions), one.positions[:3], one.positions_capped) == (250, 200, [0, 1, 2], True)


def test_rates_keep_zeros_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "x\u200by"), ("a", None), ("b", "")], "g string, text string")
    rows = {(r.grp, r.category): r for r in scan.group_rates(df, df.g, "text").collect()}
    assert len(rows) == 20 and rows["a", "invisible"].n == 1 and rows["a", "tag"].n == 0 and rows["b", "tag"].per_1k is None
    assert scan.group_rates(df.limit(0), df.g, "text").count() == 0 and scan.document_flags(df.limit(0), "g", "text").count() == 0


def test_unassigned_and_private_code_points(spark):
    df = spark.createDataFrame([(1, chr(0xE000) + chr(0x378))], "id int, text string")
    got = {r.cp: (r.bucket, r.category) for r in scan.entries(df, "id", "text").collect()}
    assert got == {0xE000: ("control_characters", "Co"), 0x378: ("other_non_ascii", "Cn")}
    one = scan.file_flags(df, "id", "text").first()
    assert one.flagged == {"unexpected_control": 1, "other_nonascii": 1} and (one.chars, one.bytes, one.pure_ascii) == (2, 5, False)
    assert unicodedata.unidata_version


def test_rows_stay_rows(spark):
    """Nulls, repeats, clashing names, long texts: one row out for each in, entries in the order of code points, no shuffle."""
    rows = [(1, "b\u200ba", "x"), (1, "b\u200ba", "x"), (2, None, "y"), (3, "", "z"), (4, "é\u200b" * 700_000, "w")]
    df = spark.createDataFrame(rows, "id int, text string, found string").drop("found")
    got = scan.with_found(df, "text")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    found = got.collect()
    assert len(found) == 5 and [[e.cp for e in r.found] for r in found[:4]] == [[0x61, 0x62, 0x200B]] * 2 + [[], []]
    assert [(e.n, len(e.positions)) for e in found[4].found] == [(700_000, 200)] * 2
    totals = {(r.id, r.bucket): (r.distinct, r.occurrences) for r in scan.bucket_totals(df.where("id = 4"), "id", "text").collect()}
    assert totals == {(4, "invisible_zero_width"): (1, 700_000), (4, "typographic"): (1, 700_000)}
    assert scan.reports(df.select("id", df.text.cast("binary").alias("content")).limit(0), "id", "content").count() == 0
