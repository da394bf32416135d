"""Column expressions on text: words, sentences, code points, escapes, encodings. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str methods see it, for Java and RE2.
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
WORD = rf"{LETTERS}(?:'{LETTERS})*"
SENTENCE_BREAK = rf"(?<=[.!?])[\"'’”)]*{SPACE}+(?=[A-Z0-9\"'‘“(])"
#: Names of punctuation classes and their characters (fixed values).
PUNCTUATION = {
    "comma": ",", "period": ".", "semicolon": ";", "colon": ":", "question": "?", "exclamation": "!", "em_dash": "—", "en_dash": "–",
    "hyphen_minus": "-", "ellipsis_char": "…", "curly_quote": "‘’“”", "straight_quote": "'\"", "paren_open": "(", "paren_close": ")",
}


def _lit(x: str | Column) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def strip(text: Column) -> Column:
    """Without white space at either end, as Python's str.strip."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def words(text: Column) -> Column:
    """Runs of letters; apostrophes between letters join them."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def sentences(text: Column) -> Column:
    """Heuristic sentences: split after . ! ? and closing marks before a capital, digit or opening mark; each holds a letter."""
    parts = F.transform(F.split(strip(text), SENTENCE_BREAK), strip)
    return F.filter(parts, lambda s: s.rlike(r"\p{L}"))


def normal(text: Column) -> Column:
    """Lower case, single blanks: the form of which character n-grams are taken."""
    return F.regexp_replace(F.lower(strip(text)), rf"{SPACE}+", " ")


def characters(text: Column) -> Column:
    """Array of code points; the empty text has none."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def code_point(ch: Column) -> Column:
    return F.ascii(ch)


def label(cp: Column) -> Column:
    return F.format_string("U+%04X", cp)


def utf8_hex(ch: Column) -> Column:
    return F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)(?!$)", "$1 ")


def count_of(text: Column, chars: str) -> Column:
    """How many of these characters the text holds."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def punctuation_counts(text: Column) -> Column:
    """Array of (category, n), zeros included."""
    return F.array(*(F.struct(F.lit(k).alias("category"), count_of(text, v).cast("long").alias("n")) for k, v in PUNCTUATION.items()))


def escaped(text: Column) -> Column:
    r"""Printable ASCII as it is (a backslash doubled), everything else as \uXXXX or \UXXXXXXXX."""

    def one(ch: Column) -> Column:
        cp = F.ascii(ch)
        return F.when(ch == "\\", F.lit("\\\\")).when(cp.between(0x20, 0x7E), ch).when(cp > 0xFFFF, F.format_string("\\U%08X", cp)).otherwise(F.format_string("\\u%04X", cp))

    plain = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.when(text.rlike(r"[^\x20-\x7E]"), F.array_join(F.transform(characters(text), one), "")).otherwise(plain)


def context(text: Column, pos: Column, radius: int = 30) -> Column:
    """Escaped surroundings of the character at ``pos`` (from 0), which is shown by its label."""
    before = F.substring(text, F.greatest(pos - radius, F.lit(0)) + 1, F.least(pos, F.lit(radius)))
    after = F.substring(text, pos + 2, F.lit(radius))
    return F.concat(escaped(before), F.lit("[["), label(F.ascii(F.substring(text, pos + 1, F.lit(1)))), F.lit("]]"), escaped(after))


def tag_payloads(text: Column) -> Column:
    """Runs of tag characters, decoded to what they hide."""

    def one(ch: Column) -> Column:
        v = F.ascii(ch) - 0xE0000
        return F.when(v == 1, F.lit("[TAG-LANG]")).when(v == 0x7F, F.lit("[TAG-END]")).when(v.between(0x20, 0x7E), F.char(v)).otherwise(F.format_string("[TAG-%02X]", v))

    runs = F.regexp_extract_all(text, F.lit(r"[\x{E0000}-\x{E007F}]+"), F.lit(0))
    return F.transform(runs, lambda run: F.array_join(F.transform(characters(run), one), ""))


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def is_plain(text: Column) -> Column:
    """Printable ASCII, tabs and line ends only."""
    return ~text.rlike(r"[^\x20-\x7E\t\n\r]")


def ascii_offenders(text: Column) -> Column:
    """Characters that an ASCII-only text must not hold: all but line feeds and printable ASCII (a tab counts)."""
    return F.regexp_extract_all(text, F.lit(r"[^\x0A\x20-\x7E]"), F.lit(0))


def base64(content: Column) -> Column:
    """Base64 in one line."""
    return F.regexp_replace(F.base64(content), r"\s", "")


def terminal_route(content: Column) -> Column:
    """What a terminal's line discipline makes of the bytes: CR before each LF, whatever the encoding."""
    return F.encode(F.replace(F.decode(content, "ISO-8859-1"), F.lit("\n"), F.lit("\r\n")), "ISO-8859-1")


def text_route(content: Column) -> Column:
    """Decoded and encoded again; null if it isn't UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.encode(F.decode(content, "UTF-8"), "UTF-8"))


def json_route(content: Column) -> Column:
    """Through JSON and back; null if it isn't UTF-8."""
    doc = F.to_json(F.struct(F.decode(content, "UTF-8").alias("content")))
    return F.when(F.is_valid_utf8(content.cast("string")), F.encode(F.from_json(doc, "content string")["content"], "UTF-8"))


def marker_places(text: Column, marks: str) -> Column:
    """Places (from 0) of the characters ``marks``."""
    places = F.transform(characters(text), lambda c, k: F.when(c.isin(*marks), k))
    return F.filter(places, lambda k: k.isNotNull())
