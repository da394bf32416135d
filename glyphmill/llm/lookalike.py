"""One consistent form for texts that look the same but are written in other characters.

Texts are exploded into positioned code points, column-wise within each Arrow batch. Decomposition and
look-alike mappings, tables of bounded size that go to all executors once, are joined to them by code
point; combining marks are put in order of their class, composed again with the letter before them, and
the texts are rebuilt. Letters of look-alike pairs take their Latin form, full-width and joined forms
their plain one, every space becomes U+0020, and characters without width go.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.storage import materialise

# Letters that look like a Latin one, as "letter Latin" pairs.
CYRILLIC = "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw АA ВB ЕE КK МM НH ОO РP СC ТT ХX ЅS ІI ЈJ ҺH ԚQ ԜW ҮY ӀI ѵv ѴV үy"
GREEK = "οo νv αa ιi κk ρp υu χx ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ϲc ͿJ ϺM"
LATIN = "ɑa ɡg"
#: Decompositions that only change the width of a character or join several.
TAGS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")
VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
WIDTHLESS = {0x34F, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
LIMIT = 1 << 20


def lookalikes() -> dict[str, str]:
    return {pair[0]: pair[1] for pair in f"{CYRILLIC} {GREEK} {LATIN}".split()}


def _image(ch: str, alike: dict[str, str]) -> str:
    """What a single code point is written as: fully decomposed, plain, Latin where it looks so."""
    cp, kind = ord(ch), unicodedata.category(ch)
    if kind == "Zs":
        return " "
    if cp in WIDTHLESS or kind == "Cf" and cp not in VISIBLE_FORMAT or kind == "Cc" and ch not in "\t\n\v\f\r\x85":
        return ""
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0].startswith("<"):
        whole = "".join(chr(int(x, 16)) for x in parts[1:])
        joined = parts[0] == "<compat>" and len(whole) > 1 and all(c.isalpha() for c in whole)
        plain = parts[0] in TAGS or joined
        return "".join(_image(c, alike) for c in whole) if plain else ch
    if 0xAC00 <= cp < 0xD7A4:
        return unicodedata.normalize("NFD", ch)
    if parts:
        return "".join(_image(chr(int(x, 16)), alike) for x in parts)
    return alike.get(ch, ch)


@functools.lru_cache(maxsize=1)
def mapping() -> dict[str, np.ndarray]:
    """``source`` code points with their image (``start``, ``size`` in ``image``), marks with their class, and composing pairs."""
    alike, source, start, size, image, marks, classes, pairs, whole = lookalikes(), [], [], [], [], [], [], [], []
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if (c := unicodedata.combining(ch)) > 0:
            marks.append(cp)
            classes.append(c)
        if (to := _image(ch, alike)) != ch:
            source.append(cp)
            start.append(len(image))
            size.append(len(to))
            image += map(ord, to)
        two = unicodedata.decomposition(ch).split()
        if 0xAC00 <= cp < 0xD7A4:
            d = unicodedata.normalize("NFD", ch)
            two = [hex(ord(unicodedata.normalize("NFC", d[:-1]))), hex(ord(d[-1]))]
        if len(two) == 2 and not two[0].startswith("<") and unicodedata.normalize("NFC", ch) == ch:
            pairs.append(int(two[0], 16) << 21 | int(two[1], 16))
            whole.append(cp)
    order = np.argsort(np.array(pairs))
    return {"source": np.array(source, np.uint32), "start": np.array(start, np.int64), "size": np.array(size, np.int64), "image": np.array(image, np.uint32), "marks": np.array(marks, np.uint32), "classes": np.array(classes, np.uint8), "pairs": np.array(pairs, np.int64)[order], "whole": np.array(whole, np.uint32)[order]}


class Rewriter:
    """The joins by code point, over arrays of many texts at once."""

    def __init__(self, tables: dict[str, np.ndarray]) -> None:
        self.t = tables
        self.slot = np.full(sys.maxunicode + 1, -1, np.int32)
        self.slot[tables["source"]] = np.arange(len(tables["source"]))
        self.ccc = np.zeros(sys.maxunicode + 1, np.uint8)
        self.ccc[tables["marks"]] = tables["classes"]

    def _map(self, points: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self.slot[points]
        hit = slot >= 0
        if not hit.any():
            return points, text
        size = np.ones(len(points), np.int64)
        size[hit] = self.t["size"][slot[hit]]
        out = np.repeat(points, size)
        first = np.cumsum(size) - size
        h = np.flatnonzero(hit & (size > 0))
        n = size[h]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(first[h], n) + within] = self.t["image"][np.repeat(self.t["start"][slot[h]], n) + within]
        return out, np.repeat(text, size)

    def _order(self, points: np.ndarray, text: np.ndarray) -> np.ndarray:
        c = self.ccc[points]
        if not c.any():
            return points
        fresh = np.r_[True, text[1:] != text[:-1]]
        at = np.flatnonzero(c)
        group = np.cumsum((c == 0) | fresh)[at]
        points[at] = points[at[np.lexsort((c[at], group))]]
        return points

    def _composed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The composed code point of each pair, 0 if there is none."""
        key = left.astype(np.int64) << 21 | right
        at = np.minimum(np.searchsorted(self.t["pairs"], key), len(self.t["pairs"]) - 1)
        return np.where(self.t["pairs"][at] == key, self.t["whole"][at], 0)

    def _compose(self, points: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A round composes, of each letter, the first mark that can be; marks before that one are left for good."""
        passed = np.zeros(len(points), bool)
        while len(points) > 1:
            c = self.ccc[points]
            place = np.arange(len(points))
            fresh = np.r_[True, text[1:] != text[:-1]]
            begin = np.maximum.accumulate(np.where((c == 0) | fresh, place, 0))
            before = np.r_[c[:1], c[:-1]]
            letter = c == 0
            free = ~fresh & ~passed & np.where(letter, False, (begin == place - 1) | (before < c)) & letter[begin]
            beside = ~fresh & letter & np.r_[False, letter[:-1]]
            at = np.flatnonzero(free | beside)
            owner = np.where(letter[at], at - 1, begin[at])
            new = self._composed(points[owner], points[at])
            ok = new > 0
            at, owner, new = at[ok], owner[ok], new[ok]
            if not len(at):
                break
            owner, first = np.unique(owner, return_index=True)
            at, new = at[first], new[first]
            clash = np.isin(owner, at)  # a letter that is itself taken in this round waits
            at, owner, new = at[~clash], owner[~clash], new[~clash]
            points = points.copy()
            points[owner] = new
            done = np.zeros(len(points), np.int64)
            done[owner] = at
            passed |= (place < done[begin]) & ~letter
            keep = np.ones(len(points), bool)
            keep[at] = False
            points, text, passed = points[keep], text[keep], passed[keep]
        return points, text

    def __call__(self, texts: list[str]) -> list[str]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        text = np.repeat(np.arange(len(texts)), lengths)
        points, text = self._map(points, text)
        points, text = self._compose(self._order(points.copy(), text), text)
        whole = points.tobytes().decode("utf-32-le", "surrogatepass")
        ends = np.searchsorted(text, np.arange(len(texts)), side="right").tolist()
        return [whole[a:b] for a, b in zip([0, *ends], ends)]


_rewriter: Rewriter | None = None


def _rewrite(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _rewriter
        if _rewriter is None:
            _rewriter = Rewriter(tables.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            forms: list[str | None] = list(texts)
            waiting: list[int] = []
            size = 0
            for k, x in enumerate([*texts, None]):
                if x and not (x.isascii() and x.replace("\t", " ").replace("\n", " ").isprintable()):
                    waiting.append(k)
                    size += len(x)
                if waiting and (size > LIMIT or k == len(texts)):
                    for at, form in zip(waiting, _rewriter([texts[w] for w in waiting])):
                        forms[at] = form
                    waiting, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(forms, pa.string())], ["id", "text", "form"])

    return run


def uniform_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``id_col``, ``text_col``, form): each text and its consistent form; the form of null is null, of empty empty.

    One row comes out for each that goes in; other columns are ignored.
    """
    kind = df.select(id_col).schema[0].dataType.simpleString()
    tables = df.sparkSession.sparkContext.broadcast(mapping())
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_rewrite(tables), f"id {kind}, text string, form string").select(F.col("id").alias(id_col), F.col("text").alias(text_col), "form")


def _form_keys(df: DataFrame, id_col: str, text_col: str, least_visible: int) -> DataFrame:
    forms = uniform_texts(df, id_col, text_col).toDF("id", "text", "form").where("id is not null and form is not null")
    seen = forms.where(F.length(F.regexp_replace("form", r"\s", "")) >= least_visible)
    return materialise(seen.select("id", F.unhex(F.md5("text")).alias("stored"), F.unhex(F.md5("form")).alias("form")), "forms")


def look_classes(df: DataFrame, id_col: str, text_col: str, *, least_visible: int = 20) -> DataFrame:
    """(``id_col``, class_id, stored_id, spellings, records): one row for each record, its class of texts that look the same,
    that of equal texts, and how many different texts and records the first has.

    The form without the pairs: linear in the records, however many look the same. Texts with fewer than
    ``least_visible`` characters that aren't white space, null texts and null ids are in no class; a repeated row counts once.
    """
    keys = _form_keys(df, id_col, text_col, least_visible).distinct()
    variants = keys.groupBy("form", "stored").agg(F.count(F.lit(1)).alias("n")).groupBy("form").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("records"))
    name = lambda c: F.lower(F.hex(c))
    return keys.join(variants, "form").select(F.col("id").alias(id_col), name("form").alias("class_id"), name("stored").alias("stored_id"), "spellings", "records")


def hidden_pairs(df: DataFrame, id_col: str, text_col: str, *, least_visible: int = 20) -> DataFrame:
    """(id_a, id_b), smaller first: records whose texts differ as stored but have the same form.

    The form must have ``least_visible`` characters that aren't white space. Null texts and null ids are
    in no pair; a repeated row counts once. Only forms that are stored in several ways are joined.
    """
    keys = _form_keys(df, id_col, text_col, least_visible)
    several = keys.groupBy("form").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select("form")
    rows = keys.join(several, "form", "left_semi").distinct()
    a, b = (rows.select("form", F.col("id").alias(f"id_{x}"), F.col("stored").alias(f"stored_{x}")) for x in "ab")
    return a.join(b, "form").where("id_a < id_b and stored_a <> stored_b").select("id_a", "id_b").distinct()
