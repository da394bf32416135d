"""Code point sets, and a table with one row for each assigned code point.

The sets are fixed values. Two taxonomies exist side by side: the scanner's, in which a letter may depend on
the word it stands in, and the one of group rates, which looks at a single character only.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from glyphmill.storage import materialise


def _points(spec: str) -> frozenset[int]:
    """Code points of "200B 202A-202E ..."."""
    out: set[int] = set()
    for part in spec.split():
        a, _, b = part.partition("-")
        out.update(range(int(a, 16), int(b or a, 16) + 1))
    return frozenset(out)


# Fixed values.
INVISIBLE = _points("00AD 061C 180E 200B-200D 2060-2064 FEFF")
BIDI = _points("200E 200F 202A-202E 2066-2069")
VARIATION = _points("FE00-FE0F E0100-E01EF")
TAGS = _points("E0000-E007F")
SPACES = _points("00A0 1680 2000-200A 2028 2029 202F 205F 3000")
PLAIN_CONTROLS = _points("09 0A 0D")
TYPOGRAPHIC = _points("2010-2015 2018-201F 2026")
TYPOGRAPHIC_RATES = TYPOGRAPHIC | _points("2032 2033")
CONFUSABLE_MARKS = _points("00B4 02BC 037E 0589 05C3 2032 2033 2044 2215")
FULL_WIDTH = _points("FF01-FF5E FFE0-FFE6")
#: Letters that look like a Latin one, as "letter Latin" pairs.
HOMOGLYPHS = {
    pair[0]: pair[1]
    for pair in (
        "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw АA ВB ЕE КK МM НH ОO РP СC ТT ХX ЅS ІI ЈJ "
        "αa ιi κk νv οo ρp υu χx ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
    ).split()
}
HOMOGLYPHS_RATES = frozenset("аеорсухοναεіј")
#: Nearest plain forms.
PLAIN_FORMS = {
    "'": "2018-201B 2032 00B4 02BC",
    '"': "201C-201F 2033",
    "-": "2010-2013 00AD",
    "--": "2014 2015",
    "...": "2026",
    " ": "00A0 202F 205F 3000 1680 2000-200A",
    "\n": "2028 2029",
    ";": "037E",
    ":": "0589 05C3",
    "/": "2044 2215",
}
BUCKETS = ("tag_characters", "variation_selectors", "bidi_controls", "invisible_zero_width", "space_variants", "control_characters", "combining_marks", "confusable_homoglyph", "typographic", "other_non_ascii")
SUSPICIOUS = frozenset(BUCKETS) - {"combining_marks", "typographic", "other_non_ascii"}
RATE_BUCKETS = ("invisible", "bidi", "tag", "variation_selector", "nonascii_space", "typographic", "homoglyph_letter", "combining", "unexpected_control", "other_nonascii")
HIDDEN_RATE_BUCKETS = RATE_BUCKETS[:5]


@functools.lru_cache(maxsize=1)
def plain_forms() -> dict[str, str]:
    """Character to nearest plain form: punctuation, spaces and look-alike letters."""
    return {chr(cp): form for form, spec in PLAIN_FORMS.items() for cp in _points(spec)} | HOMOGLYPHS


def ascii_equivalent(ch: str) -> str | None:
    """Nearest ASCII form: the fixed one, else the compatibility form, else the letter without its marks."""
    if ch < "\x80":
        return None
    if ch in plain_forms():
        return plain_forms()[ch]
    folded = unicodedata.normalize("NFKC", ch)
    if folded != ch and folded.isascii():
        return folded
    bare = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
    return bare if bare and bare != ch and bare.isascii() else None


def is_latin(ch: str) -> bool:
    if ch < "\x80":
        return ch.isalpha()
    return unicodedata.category(ch)[0] == "L" and unicodedata.name(ch, "").startswith("LATIN")


def scanner_bucket(cp: int, category: str, latin: bool) -> str | None:
    """The scanner's bucket of a character on its own; look-alike letters in mixed words are promoted later."""
    by_set = (("tag_characters", TAGS), ("variation_selectors", VARIATION), ("bidi_controls", BIDI), ("invisible_zero_width", INVISIBLE))
    for name, points in by_set:
        if cp in points:
            return name
    if cp != 0x20 and (category[0] == "Z" or cp in SPACES):
        return "space_variants"
    if category in ("Cf", "Co", "Cs") or category == "Cc" and cp not in PLAIN_CONTROLS:
        return "control_characters"
    if category[0] == "M":
        return "combining_marks"
    if cp in CONFUSABLE_MARKS or cp in FULL_WIDTH:
        return "confusable_homoglyph"
    if cp in TYPOGRAPHIC:
        return "typographic"
    if cp < 0x80:
        return None
    return "typographic" if latin else "other_non_ascii"


def rate_bucket(cp: int, category: str) -> str | None:
    """The bucket for group rates."""
    if cp < 0x80:
        return "unexpected_control" if cp < 0x20 and cp not in PLAIN_CONTROLS else None
    for name, points in (("invisible", INVISIBLE), ("bidi", BIDI), ("tag", TAGS), ("variation_selector", VARIATION)):
        if cp in points:
            return name
    if category[0] == "Z":
        return "nonascii_space"
    if cp in TYPOGRAPHIC_RATES:
        return "typographic"
    if chr(cp) in HOMOGLYPHS_RATES:
        return "homoglyph_letter"
    if category[0] == "M":
        return "combining"
    return "unexpected_control" if category in ("Cc", "Cf", "Co", "Cs") else "other_nonascii"


@functools.lru_cache(maxsize=1)
def _rows() -> pd.DataFrame:
    rows = []
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        category = unicodedata.category(ch)
        if category in ("Cs", "Cn", "Co") and cp not in TAGS and cp not in VARIATION:
            continue
        latin = is_latin(ch)
        rows.append((cp, ch, f"U+{cp:04X}", unicodedata.name(ch, f"<unnamed / not in UCD {unicodedata.unidata_version}>"), category, unicodedata.combining(ch), latin, ch.encode().hex(" ").upper(), ascii_equivalent(ch), scanner_bucket(cp, category, latin), rate_bucket(cp, category), HOMOGLYPHS.get(ch)))
    return pd.DataFrame(rows, columns=["cp", "ch", "label", "name", "category", "combining", "is_latin", "utf8_hex", "ascii_equiv", "bucket", "rate_bucket", "homoglyph_of"])


SCHEMA = "cp int, ch string, label string, name string, category string, combining int, is_latin boolean, utf8_hex string, ascii_equiv string, bucket string, rate_bucket string, homoglyph_of string"
_frames: dict[str, DataFrame] = {}


def characters(spark: SparkSession) -> DataFrame:
    """One row for each assigned code point that isn't for private use: about 150,000 rows, whatever the data.

    Of code points without a row the category is Cn, Co or Cs; see ``scan`` for how they are filled in.
    """
    app = spark.sparkContext.applicationId
    if app not in _frames:
        _frames[app] = materialise(spark.createDataFrame(_rows(), SCHEMA).coalesce(1), "characters")
    return _frames[app]


def flagged_characters(spark: SparkSession) -> DataFrame:
    """The rows that the group rates put into a bucket of their own (not ``other_nonascii``): about 3,000 rows."""
    rows = _rows()
    return spark.createDataFrame(rows[rows.rate_bucket.notna() & (rows.rate_bucket != "other_nonascii")][["ch", "rate_bucket"]], "ch string, rate_bucket string")
