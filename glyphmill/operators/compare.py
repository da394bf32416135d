"""Pairs of documents: similarity, and differences byte by byte and character by character."""

from __future__ import annotations

import difflib
import unicodedata
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from glyphmill.functions import text as T
from glyphmill.functions.chartables import BIDI, INVISIBLE, TAGS, VARIATION, plain_forms

MAX_DIFFS, MAX_BYTES, MAX_CHARS, RADIUS = 500, 64, 50, 30
_HIDDEN = INVISIBLE | BIDI | TAGS | VARIATION


def shown(text: str) -> str:
    r"""Escaped as in ``functions.text.escaped``."""
    return "".join("\\\\" if c == "\\" else c if " " <= c <= "~" else f"\\u{ord(c):04X}" if ord(c) < 0x10000 else f"\\U{ord(c):08X}" for c in text)


def _invisible(text: str) -> bool:
    return all(ord(c) in _HIDDEN or unicodedata.category(c) == "Cf" for c in text)


def kind_of(a: str, b: str, before_a: str, before_b: str, at_end_a: bool, at_end_b: bool) -> str:
    """The first of the difference kinds that fits segments ``a`` and ``b``.

    ``before_*`` is the character before a segment, with which a mark may compose; ``at_end_*`` tells whether
    a line or the text ends after it.
    """
    used = set(a) | set(b)
    if used and used <= set("\r\n"):
        return "line-ending"
    if used and used <= set(" \t") and at_end_a and at_end_b:
        return "trailing-whitespace"
    if (not a or not b) and _invisible(a or b):
        return "invisible-character"
    if a and b and a != b and [c for c in a if not _invisible(c)] == [c for c in b if not _invisible(c)]:
        return "invisible-character"
    plain = plain_forms()
    if a != b and "".join(plain.get(c, c) for c in a) == "".join(plain.get(c, c) for c in b):
        return "typographic-substitution"
    for form in ("NFC", "NFD"):
        n = lambda s, form=form: unicodedata.normalize(form, s)
        if n(before_a + a) == n(before_b + b) or a and b and n(a) == n(b):
            return "normalization"
    return "other"


def _cut(data: bytes, a: int, b: int) -> str:
    return shown(data[a:b].decode("utf-8", "replace"))


#: Elements of the two sides, multiplied, up to which a stretch is matched one by one; longer ones are first cut at lines that stand once in either.
MATCHED = 1 << 24


def _common(a, b) -> int:
    """How many elements are equal from the start on."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def _anchors(a, b) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of lines that stand once in either side, in the order of both."""
    end = b"\n" if isinstance(a, bytes) else "\n"

    def once(x) -> dict:
        at, seen = 0, {}
        for line in x.split(end):
            seen[line] = None if line in seen else at
            at += len(line) + 1
        return {line: place for line, place in seen.items() if place is not None and line}

    there = once(b)
    pairs = [(i, there[line], len(line)) for line, i in once(a).items() if line in there]
    ends, links, back = [], [], [-1] * len(pairs)  # the longest run that ascends in b
    for k, (_, j, _) in enumerate(pairs):
        at = bisect_left(ends, j)
        back[k] = links[at - 1] if at else -1
        ends[at : at + 1], links[at : at + 1] = [j], [k]
    out, k = [], links[-1] if links else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _opcodes(a, b):
    """Differing opcodes. Common ends are cut off first, and long stretches at lines that both hold once, so the quadratic match sees only what lies between."""
    head = _common(a, b)
    tail = _common(a[head:][::-1], b[head:][::-1])
    a_end, b_end = len(a) - tail, len(b) - tail
    if (a_end - head) * (b_end - head) <= MATCHED:
        found = difflib.SequenceMatcher(None, a[head:a_end], b[head:b_end], autojunk=False).get_opcodes()
        yield from ((op, i + head, j + head, k + head, m + head) for op, i, j, k, m in found if op != "equal")
        return
    i = k = 0
    between = _anchors(a[head:a_end], b[head:b_end])
    if not between:
        yield "replace", head, a_end, head, b_end
        return
    for x, y, n in [*between, (a_end - head, b_end - head, 0)]:
        part_a, part_b = a[head + i : head + x], b[head + k : head + y]
        if part_a != part_b:
            yield from ((op, p + head + i, q + head + i, r + head + k, t + head + k) for op, p, q, r, t in _opcodes(part_a, part_b))
        i, k = x + n, y + n


def byte_differences(a: bytes, b: bytes):
    for n, (op, i, j, k, m) in enumerate(_opcodes(a, b)):
        if n == MAX_DIFFS:
            yield n, "truncated", *[None] * 10
            return
        more = lambda x: x[:MAX_BYTES].hex(" ").upper() + (" ..." if len(x) > MAX_BYTES else "")
        yield n, op, i, j, k, m, more(a[i:j]), more(b[k:m]), _cut(a, i, min(j, i + MAX_BYTES)), _cut(b, k, min(m, k + MAX_BYTES)), _cut(a, max(0, i - RADIUS), j + RADIUS), _cut(b, max(0, k - RADIUS), m + RADIUS)


def char_differences(a: str, b: str):
    for n, (op, i, j, k, m) in enumerate(_opcodes(a, b)):
        if n == MAX_DIFFS:
            yield n, "truncated", *[None] * 11
            return
        ends = [x >= len(t) or t[x] in "\r\n" for t, x in ((a, j), (b, m))]
        kind = kind_of(a[i:j], b[k:m], a[max(0, i - 1) : i], b[max(0, k - 1) : k], *ends)
        points = lambda s: [(f"U+{ord(c):04X}", unicodedata.name(c, "<unnamed>")) for c in s[:MAX_CHARS]]
        yield n, op, i, j, k, m, points(a[i:j]), points(b[k:m]), shown(a[i : min(j, i + MAX_CHARS)]), shown(b[k : min(m, k + MAX_CHARS)]), shown(a[max(0, i - RADIUS) : j + RADIUS]), shown(b[max(0, k - RADIUS) : m + RADIUS]), kind


POINT = StructType([StructField("codepoint", StringType()), StructField("name", StringType())])


def _schema(*names: str) -> StructType:
    kinds = {"n": IntegerType(), "a_start": IntegerType(), "a_end": IntegerType(), "b_start": IntegerType(), "b_end": IntegerType(), "a_codepoints": ArrayType(POINT), "b_codepoints": ArrayType(POINT)}
    return StructType([StructField(x, kinds.get(x, StringType())) for x in ("n", "op", "a_start", "a_end", "b_start", "b_end", *names)])


@udtf(returnType=_schema("a_hex", "b_hex", "a_decoded", "b_decoded", "a_context", "b_context"))
class ByteDiff:
    """Table function: the differing stretches of two byte strings."""

    def eval(self, a: bytes, b: bytes):
        if a is not None and b is not None and bytes(a) != bytes(b):
            yield from byte_differences(bytes(a), bytes(b))


CHAR_SCHEMA = _schema("a_codepoints", "b_codepoints", "a_escaped", "b_escaped", "a_context", "b_context", "classification")


@udtf(returnType=CHAR_SCHEMA)
class CharDiff:
    """Table function: the differing stretches of two texts, each with its kind."""

    def eval(self, a: bytes, b: bytes):
        if a is not None and b is not None and bytes(a) != bytes(b):
            yield from char_differences(bytes(a).decode("utf-8", "replace"), bytes(b).decode("utf-8", "replace"))


def register(spark: SparkSession) -> None:
    spark.udtf.register("byte_diff", ByteDiff)
    spark.udtf.register("char_diff", CharDiff)


def differences(pairs: DataFrame, by: str = "char") -> DataFrame:
    """Of (id, a, b) bytes: one row for each difference. Equal pairs are told by their hashes and never compared."""
    register(pairs.sparkSession)
    fn = {"char": "char_diff", "byte": "byte_diff"}[by]
    differing = pairs.where("a is not null and b is not null and sha2(a, 256) <> sha2(b, 256)")
    return pairs.sparkSession.sql(f"select p.id, d.* from {{pairs}} p, lateral {fn}(p.a, p.b) d", pairs=differing)


def comparison(pairs: DataFrame) -> DataFrame:
    """One row for each pair (id, a, b): hashes, sizes, whether identical, and the sorted set of difference kinds."""
    kinds = differences(pairs).where("classification is not null").groupBy("id").agg(F.sort_array(F.collect_set("classification")).alias("classifications"), F.count(F.lit(1)).alias("char_diffs"))
    rows = pairs.select("id", F.sha2("a", 256).alias("sha256_a"), F.sha2("b", 256).alias("sha256_b"), F.octet_length("a").alias("bytes_a"), F.octet_length("b").alias("bytes_b"))
    out = rows.join(kinds, "id", "left")
    return out.select("id", "sha256_a", "sha256_b", "bytes_a", "bytes_b", (F.col("sha256_a") == F.col("sha256_b")).alias("byte_identical"), F.coalesce("classifications", F.array().cast("array<string>")).alias("classifications"), F.coalesce("char_diffs", F.lit(0)).alias("char_diffs"))


@F.pandas_udf(DoubleType())
def similarity_ratio(a, b):
    """difflib's ratio of two texts; quadratic, for texts of a few thousand characters."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b)])


def word_jaccard(a, b):
    """Jaccard similarity of the sets of lower-cased words; null if both are empty."""
    x, y = (F.array_distinct(F.transform(T.words(F.coalesce(t, F.lit(""))), F.lower)) for t in (a, b))
    return F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)))


def repeat_pairs(docs: DataFrame, pairs: DataFrame, keys: list[str], item: str, text_col: str = "text") -> DataFrame:
    """Of docs with one row by keys and item: both texts of each pair (item_a, item_b), where either is there."""
    a = docs.join(pairs.withColumnRenamed("item_a", item), item).select(*keys, F.col(item).alias("item_a"), "item_b", F.col(text_col).alias("text_a"))
    b = docs.join(pairs.withColumnRenamed("item_b", item), item).select(*keys, "item_a", F.col(item).alias("item_b"), F.col(text_col).alias("text_b"))
    return a.join(b, [*keys, "item_a", "item_b"], "full")


def flagged_count(text):
    """How many characters fall into a bucket of the group rates."""
    return F.length(F.regexp_replace(text, r"[\t\n\r\x20-\x7F]", ""))


def repeat_similarity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Identity, lengths and word Jaccard of pairs of texts; a missing text is empty, and named so in ``status``."""
    a, b = (F.coalesce(f"text_{x}", F.lit("")) for x in "ab")
    status = F.when(F.col("text_a").isNull() | F.col("text_b").isNull(), "incomplete").otherwise("complete")
    return pairs.select(*keys, "item_a", "item_b", status.alias("status"), (a == b).alias("identical"), F.length(a).alias("chars_a"), F.length(b).alias("chars_b"), flagged_count(a).alias("flagged_a"), flagged_count(b).alias("flagged_b"), F.round(word_jaccard(a, b), 6).alias("word_jaccard"))
