"""The character scanner: what code points a document holds, where, and of which kind."""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, MapType, StringType, StructField, StructType

from glyphmill.functions import text as T
from glyphmill.functions.chartables import BUCKETS, HIDDEN_RATE_BUCKETS, HOMOGLYPHS, RATE_BUCKETS, SUSPICIOUS, ascii_equivalent, flagged_characters, is_latin, rate_bucket, scanner_bucket
from glyphmill.functions.stats import wilson_upper

POSITION_CAP = 200
CONTEXT_CAP = 20
CONTEXT_RADIUS = 30
_PRIVATE = "cp between 57344 and 63743 or cp between 983040 and 1048573 or cp between 1048576 and 1114109"


def code_points_of(pattern: str) -> np.ndarray:
    """The code points that match a character class, as a bit table; ``\\x{...}`` names one."""
    python = re.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern))
    return np.packbits(np.fromiter((python.match(chr(cp)) is not None for cp in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))


_bits = functools.lru_cache(maxsize=32)(code_points_of)


@functools.lru_cache(maxsize=1)
def _kinds_of_letters() -> bytes:
    """Of each code point: 1 for letters and marks, 2 more for Latin letters, 4 more for look-alike letters. Compressed, for it goes with each task."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        if unicodedata.category(ch)[0] in "LM":
            out[cp] = 1 + 2 * is_latin(ch) + 4 * (ch in HOMOGLYPHS)
    return zlib.compress(out.tobytes())


@functools.lru_cache(maxsize=1 << 16)
def _properties(cp: int) -> tuple:
    """label, name, category, utf8_hex, ascii_equiv, bucket"""
    ch = chr(cp)
    category = unicodedata.category(ch)
    raw = ch.encode("utf-8", "surrogatepass").hex(" ").upper()
    return f"U+{cp:04X}", unicodedata.name(ch, f"<unnamed / not in UCD {unicodedata.unidata_version}>"), category, raw, ascii_equivalent(ch), scanner_bucket(cp, category, is_latin(ch))


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1 ... size[k] of them, for all k in a row."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _places(key: np.ndarray, pos: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Different keys in order, how often each is there, and the first ``cap`` of its places."""
    order = np.argsort(key, kind="stable")
    keys, first, n = np.unique(key[order], return_index=True, return_counts=True)
    kept = np.minimum(n, cap)
    offsets = np.r_[0, np.cumsum(kept)].astype(np.int32)
    return keys, n, pa.ListArray.from_arrays(pa.array(offsets), pa.array(pos[order][_spread(first, kept)].astype(np.int32)))


PLACES = "cp int, ch string, n bigint, positions array<int>, positions_capped boolean"
ENTRY = PLACES + ", label string, name string, category string, utf8_hex string, ascii_equiv string, bucket string, mixed bigint, places array<int>"


def _entries(texts: list[str | None], wanted: np.ndarray | None, cap: int, letters: np.ndarray | None) -> tuple[np.ndarray, pa.StructArray]:
    """The entries of some texts, one after another, and where those of each text begin."""
    sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    pos = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(wanted[points]) if wanted is not None else np.arange(len(points))
    keys, n, positions = _places(row[at] << 21 | points[at], pos[at], cap)
    cps = keys & (1 << 21) - 1
    columns = {"cp": pa.array(cps.astype(np.int32)), "ch": pa.array(list(map(chr, cps.tolist())), pa.string()), "n": pa.array(n), "positions": positions, "positions_capped": pa.array(n > cap)}
    if letters is not None:
        mixed, places, promoted = _mixed(letters[points], points, row, pos, keys, cap)
        props = [_properties(cp) for cp in cps.tolist()]
        for k, name in enumerate(("label", "name", "category", "utf8_hex", "ascii_equiv")):
            columns[name] = pa.array([p[k] for p in props], pa.string())
        columns["bucket"] = pa.array(["confusable_homoglyph" if up and p[5] in ("typographic", "other_non_ascii") else p[5] for p, up in zip(props, promoted)], pa.string())
        columns |= {"mixed": mixed, "places": places}
    return np.searchsorted(keys >> 21, np.arange(len(texts) + 1)), pa.StructArray.from_arrays(list(columns.values()), list(columns))


def _mixed(kinds: np.ndarray, points: np.ndarray, row: np.ndarray, pos: np.ndarray, keys: np.ndarray, cap: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Of each key (text, code point): how often it is a look-alike letter in a word that holds a Latin one, and where.

    Words are runs of letters and marks.
    """
    promoted = np.zeros(len(keys), bool)
    if not (kinds & 4).any():
        return pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.list_(pa.int32())), promoted
    inside = kinds > 0
    begins = inside & np.r_[True, ~inside[:-1] | (row[1:] != row[:-1])]
    word = np.cumsum(begins) - 1
    latin = np.zeros(int(word[-1]) + 1, bool)
    latin[word[(kinds & 2) > 0]] = True
    hit = np.flatnonzero(((kinds & 4) > 0) & latin[np.maximum(word, 0)])
    found, n, places = _places(row[hit] << 21 | points[hit], pos[hit], cap)
    to = np.searchsorted(keys, found)
    known = (to < len(keys)) & (keys[np.minimum(to, len(keys) - 1)] == found) if len(keys) else np.zeros(len(found), bool)
    slot = np.full(len(keys), -1, np.int64)
    slot[to[known]] = np.flatnonzero(known)
    promoted = slot >= 0
    take = pa.array(slot, mask=~promoted)
    return pa.array(n, pa.int64()).take(take), places.take(take), promoted


#: Characters of texts taken at once; a longer text is taken alone.
BLOCK = 1 << 21


def _scan(text_at: int, bits: bytes | None, cap: int, kinds: bytes | None):
    def run(batches):
        letters = np.frombuffer(zlib.decompress(kinds), np.uint8) if kinds else None
        wanted = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)[: sys.maxunicode + 1] if bits is not None else None
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            start, size = 0, 0
            for k in range(len(texts)):
                size += len(texts[k] or "")
                if k + 1 == len(texts) or size + len(texts[k + 1] or "") > BLOCK:
                    offsets, found = _entries(texts[start : k + 1], wanted, cap, letters)
                    part = batch.slice(start, k + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), found)], [*batch.schema.names, "found"])
                    start, size = k + 1, 0

    return run


def with_found(rows: DataFrame, text_col: str, of: str | None = None, cap: int = POSITION_CAP, full: bool = True) -> DataFrame:
    """``rows`` with ``found``: each row's distinct characters, all or those of the class ``of``, with their first places.

    With ``full`` also their properties and the final bucket: a look-alike letter found in a word that also
    holds a Latin one is confusable throughout its text. A row is a document and stays one: nothing is
    shuffled, and no array is longer than ``cap`` or the number of different characters. Null texts have none.
    """
    bits = _bits(of).tobytes() if of else None
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_scan(rows.columns.index(text_col), bits, cap, _kinds_of_letters() if full else None), f"{schema}, found array<struct<{(ENTRY if full else PLACES).replace(' ', ':').replace(',:', ',')}>>")


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")


def inventory(docs: DataFrame, id_col: str, text_col: str, of: str | None = None, cap: int = POSITION_CAP) -> DataFrame:
    """(id, ch, n, positions, positions_capped): each document's distinct characters with their first places."""
    rows = _documents(docs, id_col, text_col)
    rows = rows.where(F.col("text").rlike(of)) if of else rows
    return with_found(rows, "text", of, cap, full=False).select("id", F.explode("found").alias("e")).select("id", "e.ch", "e.n", "e.positions", "e.positions_capped")


ODD = r"[^\x20-\x7E\t\n\r]"


def mixed_script(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ch, mixed, places, n): look-alike letters in words that also hold a Latin letter, and how often each is there in all."""
    letters = "[" + "".join(HOMOGLYPHS) + "]"
    found = with_found(_documents(docs, id_col, text_col).where(F.col("text").rlike(letters)), "text", letters)
    return found.select("id", F.explode("found").alias("e")).where("e.mixed is not null").select("id", "e.ch", "e.mixed", "e.places", "e.n")


def flagged(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with ``found`` of the characters that fall into a bucket; rows without an odd character aren't looked into."""
    odd = F.col(text_col).rlike(ODD)
    none = F.array().cast(f"array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>")
    hits = with_found(rows.where(odd), text_col, ODD).withColumn("found", F.filter("found", lambda e: e["bucket"].isNotNull()))
    return hits.unionByName(rows.where(F.coalesce(~odd, F.lit(True))).withColumn("found", none))


def entries(docs: DataFrame, id_col: str, text_col: str, flagged_only: bool = True) -> DataFrame:
    """One row for each document and character, with properties and final bucket; those in no bucket are left out unless ``flagged_only`` is off."""
    rows = _documents(docs, id_col, text_col)
    found = flagged(rows, "text") if flagged_only else with_found(rows, "text")
    return found.select("id", F.explode("found").alias("e")).select("id", "e.*")


def bucket_totals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bucket, distinct, occurrences) of the flagged characters of each document."""

    def total(name: str) -> Column:
        own = F.filter("found", lambda e: e["bucket"] == name)
        return F.struct(F.lit(name).alias("bucket"), F.size(own).cast("long").alias("distinct"), F.aggregate(own, F.lit(0).cast("long"), lambda n, e: n + e["n"]).alias("occurrences"))

    each = flagged(_documents(docs, id_col, text_col), "text").where(F.size("found") > 0).select("id", F.explode(F.array(*map(total, BUCKETS))).alias("b"))
    return each.where("b.distinct > 0").select("id", "b.*")


def contexts(docs: DataFrame, id_col: str, text_col: str, of: str, cap: int = CONTEXT_CAP, radius: int = CONTEXT_RADIUS) -> DataFrame:
    """(id, ch, pos, context): escaped surroundings of the first places of each character of the class ``of``."""
    found = with_found(_documents(docs, id_col, text_col).where(F.col("text").rlike(of)), "text", of, cap, full=False)
    each = found.select("id", "text", F.explode("found").alias("e")).select("id", "text", "e.ch", F.explode("e.positions").alias("pos"))
    return each.select("id", "ch", "pos", T.context(F.col("text"), F.col("pos"), radius).alias("context"))


FLAGS = {
    "has_tag_characters": "tag_characters", "has_variation_selectors": "variation_selectors", "has_bidi_controls": "bidi_controls", "has_invisible_characters": "invisible_zero_width", "has_space_variants": "space_variants",
    "has_unexpected_controls": "control_characters", "has_combining_marks": "combining_marks", "has_confusable_homoglyphs": "confusable_homoglyph", "has_typographic_characters": "typographic",
}


def _flags(found: Column, text: Column) -> dict[str, Column]:
    """The scanner's flags of a row."""
    buckets = F.transform(found, lambda e: e["bucket"])
    has = {name: F.array_contains(buckets, bucket) for name, bucket in FLAGS.items()}
    return {"is_pure_ascii": T.is_ascii(text), "is_printable_ascii_plus_newline_tab": T.is_plain(text), **has, "any_suspicious": F.arrays_overlap(buckets, F.array(*map(F.lit, sorted(SUSPICIOUS))))}


def document_flags(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each document with a text: the scanner's flags, and whether it is ASCII or plain."""
    rows = flagged(_documents(docs, id_col, text_col), "text")
    return rows.select("id", *(c.alias(k) for k, c in _flags(F.col("found"), F.col("text")).items()))


def file_flags(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(id, chars, bytes, flagged, pure_ascii, more): a document's size and its flagged characters by rate bucket, as a map."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *more).where("text is not null")
    odd = F.regexp_extract_all("text", F.lit(ODD), F.lit(0))
    return rows.select(*(c for c in rows.columns if c != "text"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), rate_counts(odd).alias("flagged"), T.is_ascii(F.col("text")).alias("pure_ascii"))


@F.pandas_udf(MapType(StringType(), IntegerType()))
def rate_counts(chars: pd.Series) -> pd.Series:
    """How many of the characters are in each bucket of the group rates."""
    bucket = functools.lru_cache(maxsize=1 << 16)(lambda c: rate_bucket(ord(c), unicodedata.category(c)))
    return pd.Series([None if x is None else dict(Counter(b for b in map(bucket, x) if b)) for x in chars])


def group_rates(docs: DataFrame, group: Column, text_col: str, upper_z: float = 1.96) -> DataFrame:
    """(grp, category, n, total_chars, per_1k, wilson_upper_per_1k): every group with every category, zeros included.

    Only flagged characters are taken out of a text; they are counted by group and character before the
    buckets are looked up. Groups without any character have null rates.
    """
    spark = docs.sparkSession
    rows = docs.select(group.alias("grp"), F.col(text_col).alias("text")).where("text is not null")
    totals = rows.groupBy("grp").agg(F.sum(F.length("text").cast("long")).alias("total_chars"))
    odd = r"[^\x20-\x7E\t\n\r]"
    chars = rows.where(F.col("text").rlike(odd)).select("grp", F.explode(F.regexp_extract_all("text", F.lit(odd), F.lit(0))).alias("ch"))
    counted = chars.groupBy("grp", "ch").agg(F.count(F.lit(1)).alias("n"))
    known = counted.join(F.broadcast(flagged_characters(spark)), "ch", "left").withColumn("cp", F.ascii("ch"))
    category = F.coalesce("rate_bucket", F.when(F.expr(_PRIVATE), "unexpected_control").when(F.col("cp") > 0x7F, "other_nonascii"))
    found = known.select("grp", category.alias("category"), "n").where("category is not null").groupBy("grp", "category").agg(F.sum("n").alias("n"))
    grid = totals.select("grp", "total_chars", F.explode(F.array(*map(F.lit, RATE_BUCKETS))).alias("category"))
    full = grid.join(found, ["grp", "category"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select("grp", "category", "n", "total_chars", F.round(F.try_divide(1000.0 * F.col("n"), F.col("total_chars")), 6).alias("per_1k"), F.round(1000 * wilson_upper(F.col("n"), F.col("total_chars"), upper_z), 6).alias("wilson_upper_per_1k"))


def pooled_hidden(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: hidden characters of all kinds over all texts, their rate and its upper bound."""
    rates = group_rates(docs, F.lit("all"), text_col).where(F.col("category").isin(*HIDDEN_RATE_BUCKETS))
    one = rates.agg(F.sum("n").alias("hidden"), F.max("total_chars").alias("total_chars"))
    return one.select("hidden", "total_chars", F.round(F.try_divide(1000.0 * F.col("hidden"), F.col("total_chars")), 8).alias("observed_rate_per_1k"), F.round(1000 * wilson_upper(F.col("hidden"), F.col("total_chars")), 8).alias("wilson_upper_per_1k_chars"))


def ascii_violations(docs: DataFrame, group: Column, text_col: str) -> DataFrame:
    """(grp, codepoint, n): offenders against an ASCII-only instruction, tab and CR included."""
    rows = docs.select(group.alias("grp"), F.explode(T.ascii_offenders(F.col(text_col))).alias("ch"))
    return rows.groupBy("grp", "ch").agg(F.count(F.lit(1)).alias("n")).select("grp", T.label(F.ascii("ch")).alias("codepoint"), "n")


def _forms(text: str) -> dict:
    out = {}
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        norm = text if text.isascii() else unicodedata.normalize(form, text)
        data = norm.encode()
        out |= {f"{form.lower()}_is": norm == text, f"{form.lower()}_chars": len(norm), f"{form.lower()}_bytes": len(data), f"{form.lower()}_sha256": hashlib.sha256(data).hexdigest()}
    return out | {"mixed": not out["nfc_is"] and not out["nfd_is"]}


FORMS = StructType([*(StructField(f"{f}_{k}", t) for f in ("nfc", "nfd", "nfkc", "nfkd") for k, t in (("is", BooleanType()), ("chars", IntegerType()), ("bytes", IntegerType()), ("sha256", StringType()))), StructField("mixed", BooleanType())])
ERROR = StructType([StructField("byte_offset", IntegerType()), StructField("reason", StringType()), StructField("bad_bytes_hex", StringType())])


@F.pandas_udf(FORMS)
def normal_forms(text: pd.Series) -> pd.DataFrame:
    """Whether a text is in each of the four normal forms, and its size and hash in each; mixed if neither composed nor decomposed."""
    return pd.DataFrame([_forms(t if t is not None else "") for t in text], columns=FORMS.names)


def decode_error(content: bytes | None) -> tuple[int | None, str | None, str | None]:
    try:
        (content or b"").decode("utf-8")
    except UnicodeDecodeError as e:
        return e.start, e.reason, (content or b"")[e.start : e.end].hex(" ").upper()
    return None, None, None


@F.pandas_udf(ERROR)
def decode_errors(content: pd.Series) -> pd.DataFrame:
    """Place, reason and bytes of the first decoding error; meant for rows that is_valid_utf8 has turned down."""
    return pd.DataFrame([decode_error(c) for c in content], columns=["byte_offset", "reason", "bad_bytes_hex"])


def decoded(docs: DataFrame, content_col: str) -> DataFrame:
    """``docs`` with ``utf8_valid``, a ``text`` (lossy where invalid) and ``decode_error``, null where valid."""
    raw = F.col(content_col).cast("string")
    valid = F.is_valid_utf8(raw)
    rows = docs.withColumn("utf8_valid", valid).withColumn("text", F.make_valid_utf8(raw))
    good = rows.where("utf8_valid or utf8_valid is null").withColumn("decode_error", F.lit(None).cast(ERROR))
    return good.unionByName(rows.where("not utf8_valid").withColumn("decode_error", decode_errors(F.col(content_col))))


def reports(docs: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """One nested report for each document: hash, size, decoding, flags, entries by bucket, payloads, normal forms, notes. Nothing is shuffled."""
    rows = decoded(docs.select(F.col(id_col).alias("id"), F.col(content_col).alias("content")), "content").where("content is not null")
    out = flagged(rows, "text").withColumn("forms", normal_forms("text"))

    def entry(e: Column) -> Column:
        around = F.transform(F.slice(F.coalesce(e["places"], e["positions"]), 1, CONTEXT_CAP), lambda p: T.context(F.col("text"), p, CONTEXT_RADIUS))
        fields = {"codepoint": "label", "count": "n", "mixed_script_word_positions": "places", "mixed_script_word_occurrences": "mixed"}
        names = ("cp", "codepoint", "name", "category", "utf8_hex", "count", "positions", "positions_capped", "bucket", "ascii_equiv")
        more = [e["ascii_equiv"].isNotNull().alias("differs_from_ascii"), around.alias("contexts"), *(e[fields[k]].alias(k) for k in list(fields)[2:])]
        return F.struct(*(e[fields.get(k, k)].alias(k) for k in names), *more)

    every = F.transform("found", entry)  # by code point
    of = lambda bucket: F.filter("entries", lambda e: e["bucket"] == bucket)
    buckets = F.map_from_arrays(F.array(*map(F.lit, BUCKETS)), F.array(*map(of, BUCKETS)))
    flags = _flags(F.col("found"), F.col("text"))
    flags["is_printable_ascii_plus_newline_tab"] &= F.col("utf8_valid")
    tags = F.col("summary.has_tag_characters")
    notes = F.array_compact(F.array(F.when(~F.col("utf8_valid"), "FILE IS NOT VALID UTF-8"), F.when(F.startswith("text", F.lit("\ufeff")), "Leading U+FEFF byte-order mark present."), F.when(tags, "UNICODE TAG CHARACTERS PRESENT")))  # fixed values
    summary = F.struct(*(flags[k].alias(k) for k in (*FLAGS, "is_pure_ascii", "is_printable_ascii_plus_newline_tab", "any_suspicious")), F.col("forms.mixed").alias("has_mixed_normalization"))
    out = out.withColumn("entries", every).withColumn("summary", summary)
    return out.select(
        "id", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("utf8_bytes"), F.length("text").alias("char_count"), "utf8_valid", "decode_error", "summary",
        buckets.alias("buckets"), F.when(tags, T.tag_payloads(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("hidden_tag_payloads"), F.col("forms").alias("normalization"), notes.alias("notes"),
    )
