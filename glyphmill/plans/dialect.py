"""Pieces of DuckDB SQL that say what the column expressions say."""

from __future__ import annotations

# Fixed values, stated here once more and not taken from the engine, so that a wrong or missing entry there shows.
Z = 1.959963984540054
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
INVISIBLE = (0xAD, 0x61C, 0x180E, 0x200B, 0x200C, 0x200D, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF)
BIDI = (0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069)
SPACES = (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
TYPOGRAPHIC = (*range(0x2010, 0x2016), *range(0x2018, 0x2020), 0x2026)
TYPOGRAPHIC_RATES = (*TYPOGRAPHIC, 0x2032, 0x2033)
CONFUSABLE_MARKS = (0xB4, 0x2BC, 0x37E, 0x589, 0x5C3, 0x2032, 0x2033, 0x2044, 0x2215)
HOMOGLYPHS = "аеорсухѕіјһԁԛԝАВЕКМНОРСТХЅІЈαικνορυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
HOMOGLYPHS_RATES = "аеорсухοναεіј"
PUNCTUATION = {"comma": ",", "period": ".", "semicolon": ";", "colon": ":", "question": "?", "exclamation": "!", "em_dash": "—", "en_dash": "–", "hyphen_minus": "-", "ellipsis_char": "…", "curly_quote": "‘’“”", "straight_quote": "'\"", "paren_open": "(", "paren_close": ")"}

CUT = "chr(57344)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def inside(ch: str, points) -> str:
    return f"unicode({ch}) in ({', '.join(map(str, sorted(points)))})"


def words(t: str) -> str:
    letters = r"[\p{L}\p{Nl}\p{No}]+"
    return f"regexp_extract_all({t}, {q(letters + "(?:'" + letters + ")*")})"


def chars(t: str) -> str:
    return f"regexp_extract_all({t}, '(?s).')"


def strip(t: str) -> str:
    return f"regexp_replace({t}, {q(rf'\A{SPACE}+|{SPACE}+\z')}, '', 'g')"


def sentences(t: str) -> str:
    pattern = rf"([.!?])[\"'’”)]*{SPACE}+([A-Z0-9\"'‘“(])"
    split = f"string_split(regexp_replace({strip(t)}, {q(pattern)}, '\\1' || {CUT} || '\\2', 'g'), {CUT})"
    return f"list_filter(list_transform({split}, lambda s: {strip('s')}), lambda s: regexp_matches(s, '\\p{{L}}'))"


def count_of(t: str, marks: str) -> str:
    return f"(length({t}) - length(translate({t}, {q(marks)}, '')))"


def wilson(c: str, n: str) -> tuple[str, str]:
    z2 = Z * Z
    p = f"({c}::double / nullif({n}, 0))"
    denom, centre = f"(1 + {z2} / nullif({n}, 0))", f"({p} + {z2} / nullif(2 * {n}, 0))"
    half = f"({Z} * sqrt(({p} * (1 - {p}) + {z2} / nullif(4 * {n}, 0)) / nullif({n}, 0)))"
    return f"case when {n} = 0 then 0.0 else greatest(0.0, ({centre} - {half}) / {denom}) end", f"case when {n} = 0 then 0.0 else least(1.0, ({centre} + {half}) / {denom}) end"


def rates(c: str, n: str) -> str:
    lo, hi = wilson(c, n)
    return f"round(coalesce({c}::double / nullif({n}, 0), 0.0) * 1000, 6) as rate_per_1000, round(({lo}) * 1000, 6) as ci95_lo, round(({hi}) * 1000, 6) as ci95_hi"


def wilson_upper(c: str, n: str, z: float = 1.96) -> str:
    p = f"({c}::double / nullif({n}, 0))"
    return f"(({p} + {z * z} / (2 * nullif({n}, 0)) + {z} * sqrt({p} * (1 - {p}) / nullif({n}, 0) + {z * z} / (4.0 * {n} * {n}))) / (1 + {z * z} / nullif({n}, 0)))"


def skewness(x: str) -> str:
    m1, m2, m3 = (f"avg({'*'.join([f'({x})::double'] * k)})" for k in (1, 2, 3))
    return f"case when count({x}) < 3 then null when stddev_pop({x}) = 0 then 0.0 else ({m3} - 3 * {m1} * {m2} + 2 * {m1} * {m1} * {m1}) / pow(greatest({m2} - {m1} * {m1}, 0.0), 1.5) end"


def describe(x: str) -> str:
    return f"count({x}) as n, round(avg({x}), 6) as mean, round(stddev_pop({x}), 6) as sd, median({x}::double) as median, min({x})::double as min, max({x})::double as max, round({skewness(x)}, 6) as skewness"


def pearson(x: str, y: str) -> str:
    sd = f"(stddev_pop({x}) * stddev_pop({y}))"
    return f"case when count({x}) < 2 or {sd} = 0 then null else covar_pop({x}, {y}) / {sd} end"


def rate_bucket(ch: str) -> str:
    low = f"unicode({ch}) < 32 and unicode({ch}) not in (9, 10, 13)"
    parts = [
        (f"unicode({ch}) < 128", f"case when {low} then 'unexpected_control' end"), (inside(ch, INVISIBLE), "'invisible'"), (inside(ch, BIDI), "'bidi'"), (f"unicode({ch}) between 917504 and 917631", "'tag'"),
        (f"unicode({ch}) between 65024 and 65039 or unicode({ch}) between 917760 and 917999", "'variation_selector'"), (f"regexp_matches({ch}, '\\p{{Z}}')", "'nonascii_space'"), (inside(ch, TYPOGRAPHIC_RATES), "'typographic'"),
        (f"{ch} in ({', '.join(map(q, sorted(HOMOGLYPHS_RATES)))})", "'homoglyph_letter'"), (f"regexp_matches({ch}, '\\p{{M}}')", "'combining'"), (f"regexp_matches({ch}, '\\p{{C}}')", "'unexpected_control'"),
    ]
    return "case " + " ".join(f"when {a} then {b}" for a, b in parts) + " else 'other_nonascii' end"


def latin(ch: str) -> str:
    return f"(regexp_matches({ch}, '\\p{{Latin}}') and regexp_matches({ch}, '\\p{{L}}') and unicode({ch}) not between 65281 and 65374 and {ch} not in ('ª', 'º'))"


def scanner_bucket(ch: str) -> str:
    parts = [
        (f"unicode({ch}) between 917504 and 917631", "'tag_characters'"), (f"unicode({ch}) between 65024 and 65039 or unicode({ch}) between 917760 and 917999", "'variation_selectors'"), (inside(ch, BIDI), "'bidi_controls'"), (inside(ch, INVISIBLE), "'invisible_zero_width'"),
        (f"{ch} <> ' ' and (regexp_matches({ch}, '\\p{{Z}}') or {inside(ch, SPACES)})", "'space_variants'"), (f"regexp_matches({ch}, '\\p{{C}}') and unicode({ch}) not in (9, 10, 13)", "'control_characters'"), (f"regexp_matches({ch}, '\\p{{M}}')", "'combining_marks'"),
        (f"{inside(ch, CONFUSABLE_MARKS)} or unicode({ch}) between 65281 and 65374 or unicode({ch}) between 65504 and 65510", "'confusable_homoglyph'"), (inside(ch, TYPOGRAPHIC), "'typographic'"), (f"unicode({ch}) < 128", "null"), (latin(ch), "'typographic'"),
    ]
    return "case " + " ".join(f"when {a} then {b}" for a, b in parts) + " else 'other_non_ascii' end"


def is_homoglyph(ch: str) -> str:
    return f"{ch} in ({', '.join(map(q, HOMOGLYPHS))})"


def punctuation_union(select: str) -> str:
    """A union of ``select`` with {name} and {marks} for each punctuation class."""
    return " union all ".join(select.format(name=name, count=count_of("text", marks)) for name, marks in PUNCTUATION.items())
