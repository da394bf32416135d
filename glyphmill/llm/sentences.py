"""Sentence units with their places, for texts of any language and script.

A pushdown automaton runs over the marks of a text. Its stack holds the open quotations and brackets; no
mark inside one ends a unit. A second stack holds the open list levels, by indent: in a block with several
items each begins a unit, the mark before it ends none, and lines below it belong to it. Marks that never close within their block of lines aren't opened. At a full
stop, a trie of abbreviations, read backwards, tells whether it may end a sentence. Texts are compared in
a form of equal length in which look-alike letters are Latin and full-width ones plain; characters
without width are stepped over.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.lookalike import lookalikes

# Abbreviations by what may follow. After NEVER a unit goes on; after NUMBER if a number follows; after UNIT it goes on in lower
# case; after LIST it ends, unless a word goes on that joins clauses.
NUMBER = "Nr nr No no Nos nos Fig fig Figs figs Abb Vol vol Bd pp Kap Art"
NEVER = "Mr Mrs Ms Mme Mlle MM Dr Dra Prof St Sr Sra Srta mr mrs ms mme mlle mm dr dra prof st sr sra srta Hr Fr vs approx aprox ca vgl env ex ej z.B d.h i.e e.g u.a o.a cf viz Jr Gen Col Capt Lt Sgt Rev Hon Ed ed Mt Ste т.е т.к т.д т.п p г гг им ул стр рис см डॉ श्री d h z u o i e т е"
UNIT = "lb lbs min kg km cm mm oz ft in sec hr hrs Std Min Sek m g"
LIST = "etc usw a.m p.m A.M P.M др тд usf uvm bzw"
JOINING = frozenset("and or but when while as until because if that which who so than to in on at of for with by from before after und oder aber et ou mais y o pero и или".split())
MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())
SPEECH = frozenset("said says say asked asks shouted shouts replied replies answered cried called whispered added wrote told explained rief ruft sagte sagt fragte fragt antwortete meinte flüsterte dit demande demanda répond répondit cria écrie s'écrie dijo dice preguntó pregunta respondió gritó сказал сказала спросил спросила ответил ответила крикнул крикнула".split())
SPEECH_SIGNS = ("说", "問", "问", "道", "答", "喊", "叫")
ENDS, FULL = ".!?…", "。！？｡．।॥؟۔‽⸮።᙮᠃⁇⁈⁉"
PAIRS = {"«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "〈": "〉", "‹": "›"}
QUOTES = "«“„「『\"‹"
CLOSERS = frozenset("»”“」』)]）】》〉›\"’'")
EVENT = re.compile(r"[.!?…。！？｡．।॥؟۔‽⸮።᙮᠃⁇⁈⁉«»“”„「」『』()\[\]（）【】《》〈〉‹›\"]|(?<=[฀-๿])\s+(?=\S)")
BLANK_LINE = re.compile(r"[^\S\n]*\n(?:[^\S\n]*\n)+[^\S\n]*")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
ITEM = re.compile(r"^([ \t]*)([-*•‣◦▪]|\(?\d{1,3}[.)]|\(?[a-z]\))[ \t]+(?=\S)", re.MULTILINE)


@functools.lru_cache(maxsize=1)
def plain_table() -> dict[int, str]:
    """Single characters as they are compared: full-width ones plain, look-alike letters Latin."""
    table = {ord(a): b for a, b in lookalikes().items()}
    for cp in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]:
        table[cp] = chr(cp - 0xFEE0)
    return table


@functools.lru_cache(maxsize=1)
def abbreviations() -> dict:
    """A trie of the abbreviations, backwards; the key "" holds what may follow."""
    trie: dict = {}
    for kind, words in (("never", NEVER), ("number", NUMBER), ("unit", UNIT), ("list", LIST)):
        for word in words.split():
            for form in {word, word[0].upper() + word[1:]} if len(word) > 2 and word.isalpha() else {word}:
                node = trie
                for ch in reversed(form.translate(plain_table())):
                    node = node.setdefault(ch, {})
                node.setdefault("", kind)
    return trie


@functools.lru_cache(maxsize=4096)
def _widthless(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or "\ufe00" <= ch <= "\ufe0f"


@functools.lru_cache(maxsize=4096)
def _pictured(ch: str) -> bool:
    cp = ord(ch)
    return 0x1F000 <= cp < 0x1FB00 or 0x2600 <= cp < 0x27C0 or 0x2B00 <= cp < 0x2C00


@functools.lru_cache(maxsize=4096)
def _marks(ch: str) -> bool:
    return unicodedata.category(ch)[0] == "M"


def _abbreviation(s: str, dot: int) -> str | None:
    """What may follow the abbreviation that ends at the full stop, if one does."""
    node, k, found, letters = abbreviations(), dot - 1, None, 0
    while k >= 0:
        ch = s[k]
        if _widthless(ch):
            k -= 1
            continue
        if ch not in node:
            break
        node, letters = node[ch], letters + 1
        k -= 1
        if "" in node:
            j = k
            while j >= 0 and (_widthless(s[j])):
                j -= 1
            if j < 0 or not (s[j].isalnum() or _marks(s[j]) or s[j] == "." and j and s[j - 1].isalnum() and letters == 1):
                found = node[""]
    if found is None:
        k = dot - 1
        while k >= 0 and (_widthless(s[k]) or _marks(s[k])):
            k -= 1
        j = k - 1
        while j >= 0 and _widthless(s[j]):
            j -= 1
        if k >= 0 and s[k].isupper() and (j < 0 or not s[j].isalnum() and not _marks(s[j])):
            return "never"  # an initial
    return found


def _next(s: str, k: int, end: int) -> int:
    """The next place from k on that is neither blank nor without width."""
    while k < end and (s[k].isspace() or _widthless(s[k])):
        k += 1
    return k


def _word_at(s: str, k: int, end: int) -> str:
    out = []
    while k < end and (s[k].isalnum() or _widthless(s[k]) or _marks(s[k]) or s[k] in "'’"):
        if not _widthless(s[k]):
            out.append(s[k])
        k += 1
    return unicodedata.normalize("NFC", "".join(out))


def _matched(s: str, start: int, end: int) -> dict[int, int]:
    """Opening and closing marks of the block that belong to each other."""
    stack: list[tuple[str, int]] = []
    waiting: Counter[str] = Counter()
    match: dict[int, int] = {}
    for m in EVENT.finditer(s, start, end):
        ch, at = m[0], m.start()
        closes = waiting[ch] > 0 and not (ch in PAIRS and stack[-1][0] != ch)
        if closes:
            while True:  # what stays open inside is dropped
                closer, opened = stack.pop()
                waiting[closer] -= 1
                if closer == ch:
                    break
            match[opened] = at
        elif ch in PAIRS or ch == '"':
            stack.append((PAIRS.get(ch, ch), at))
            waiting[stack[-1][0]] += 1
    return match


def _speech(s: str, k: int, end: int) -> bool:
    """Whether what follows a quotation that began the unit is its speech tag."""
    if k >= end:
        return False
    ch = s[k]
    if ch in ",;，、—–-:" or ch.islower() or ch in "とっ":
        return True
    if ch in QUOTES:
        return False
    stop = k
    while stop < end and s[stop] not in ".!?…。！？।؟«“„「\"":
        stop += 1
    part = s[k:stop]
    if any(x in part for x in SPEECH_SIGNS):
        return True
    shown = "".join(c for c in part if not _widthless(c))
    return any(w.lower().replace("’", "'") in _speech_plain() for w in WORD.findall(shown))


@functools.lru_cache(maxsize=1)
def _speech_plain() -> frozenset[str]:
    return frozenset(w.translate(plain_table()).lower() for w in SPEECH)


def _items(s: str, start: int, end: int) -> dict[int, int]:
    """Where the items of the lists in the block begin, and where their text does.

    An item opens a level if its line starts the block or follows the end of a sentence or a colon, and a level
    holds items of one kind of mark only; a level with a single item is no list.
    """
    levels: list[tuple[int, str, list[tuple[int, int]]]] = []
    found: dict[int, int] = {}

    def close(least: int) -> None:
        while levels and levels[-1][0] >= least:
            items = levels.pop()[2]
            if len(items) > 1:
                found.update(items)

    for m in ITEM.finditer(s, start, end):
        if m.start() > start and s[m.start() - 1] != "\n":
            continue
        indent, kind = len(m[1].expandtabs()), re.sub(r"\w+", "1", m[2])
        close(indent + 1)
        if levels and levels[-1][0] == indent and levels[-1][1] == kind:
            levels[-1][2].append((m.start(2), m.end()))
            continue
        before = s[start : m.start()].rstrip()[-1:]
        if not before or levels or before in ENDS + FULL + ":：" or before in CLOSERS:
            if levels and levels[-1][0] == indent:
                close(indent)
            levels.append((indent, kind, [(m.start(2), m.end())]))
    close(0)
    return found


class _Block:
    """The automaton over one block of lines, from ``start`` to ``end``; ``out`` gets (start, end) of its units."""

    def __init__(self, s: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
        self.s, self.end, self.out, self.unit = s, end, out, _next(s, start, end)
        self.match = _matched(s, start, end)
        items = _items(s, start, end) if "\n" in s[start:end] else {}
        self.items, self.ends = sorted(items), items

    def cut(self, at: int) -> None:
        """End the unit at ``at``, after marks, closing signs and pictures that belong to it."""
        s, k = self.s, at
        while True:
            j = k
            while j < self.end and (s[j].isspace() and s[j] != "\n" or _widthless(s[j])):
                j += 1
            if j < self.end and _pictured(s[j]):
                k = j + 1
                while k < self.end and (_widthless(s[k]) or 0x1F3FB <= ord(s[k]) <= 0x1F3FF):
                    k += 1
            elif k < self.end and s[k] in CLOSERS and k not in self.match and not (s[k] == '"' and k + 1 < self.end and s[k + 1].isalnum()):
                k += 1
            else:
                break
        self.out.append((self.unit, k))
        self.unit = self.at = _next(s, k, self.end)

    def run(self) -> None:
        s, end = self.s, self.end
        self.at, k_item = self.unit, 0
        while self.at < end:
            m = EVENT.search(s, self.at, end)
            while k_item < len(self.items) and self.items[k_item] < self.at:
                k_item += 1
            if k_item < len(self.items) and (not m or self.items[k_item] <= m.start()):
                self.item(self.items[k_item])
                continue
            if not m:
                break
            ch, k = m[0], m.start()
            if ch in PAIRS or ch == '"':
                if k in self.match:
                    self.quoted(k, self.match[k])
                else:
                    self.at = k + 1
            elif ch[0].isspace():
                self.blank(k, m.end())
            elif ch in ENDS or ch in FULL:
                self.mark(k)
            else:
                self.at = k + 1
        if self.unit < end:
            self.out.append((self.unit, end))

    def item(self, at: int) -> None:
        """The next item of a list: it begins a unit, and its mark ends none."""
        if self.unit < at:
            self.out.append((self.unit, at))
        self.unit, self.at = at, self.ends[at]

    def quoted(self, start: int, close: int) -> None:
        """A whole quotation or bracket: the unit may end after it, if a mark ends what stands in it."""
        s, first = self.s, start == self.unit
        inner = close - 1
        while inner > start and (s[inner].isspace() or _widthless(s[inner]) or s[inner] in CLOSERS):
            inner -= 1
        self.at = close + 1
        if s[inner] not in ENDS and s[inner] not in FULL:
            return
        if s[inner] == "." and _abbreviation(s, inner) == "never":
            return
        k = _next(s, close + 1, self.end)
        if k < self.end and (s[k] in ENDS or s[k] in FULL):
            return
        if s[start] not in QUOTES:
            if first and not (k < self.end and (s[k].islower() or s[k] in ",;:，、")):
                self.cut(close + 1)
            return
        if first:
            if not _speech(s, k, self.end):
                self.cut(close + 1)
        elif k >= self.end or not (s[k] in ",;:，、—–-" or s[k] in "とっ" or s[k].islower() and _word_at(s, k, self.end) in JOINING or s[k] == ")"):
            self.cut(close + 1)

    def mark(self, k: int) -> None:
        s, end, last = self.s, self.end, k + 1
        while last < end and (s[last] in ENDS or s[last] in FULL or _widthless(s[last]) and last + 1 < end and s[last + 1] in ENDS + FULL):
            last += 1
        run = s[k:last]
        self.at = last
        n = last
        while n < end and _widthless(s[n]):
            n += 1
        if n >= end:
            return self.cut(last)
        spaced, follows = s[n].isspace(), _next(s, n, end)
        while follows < end and (s[follows] in CLOSERS and follows not in self.match and s[follows] != '"'):
            follows = _next(s, follows + 1, end)
        ch = s[follows] if follows < end else ""
        opener = ch in PAIRS or ch == '"' or ch in "¿¡"
        if any(c in FULL for c in run):
            if run in "．." and s[k - 1 : k].isdigit() and ch.isdigit() and not spaced:
                return None
            return self.cut(last) if ch not in ",，、" else None
        if not spaced and s[n] not in CLOSERS and not _pictured(s[n]):
            before = s[k - 1] if k else " "
            if run == "." or run == "…" or run == "...":
                if not (ch.isupper() or opener or ch and not ch.islower() and ch.isalpha()) or before.isupper() and run == ".":
                    return None
                if run == "." and (before.isdigit() or _abbreviation(s, k)):
                    return None
                return self.cut(last)
            return None if ch in ",;:)" else self.cut(last)
        if ch and ch in ",;:":
            return None
        if run == ".":
            kind = _abbreviation(s, k)
            if kind == "never" and ch:
                return None
            if kind == "number" and ch.isdigit():
                return None
            if kind is None and ch.isupper() and self.initial(k):
                return None
            if kind == "unit" and (ch.islower() or ch.isdigit()):
                return None
            if kind == "list" and ch.islower() and _word_at(s, follows, end) in JOINING:
                return None
            if s[k - 1 : k].isdigit() and ch.isalpha() and _word_at(s, follows, end) in _months():
                return None
        elif set(run) <= {".", "…"} and len(run) > 1 and ch.islower():
            return None
        elif run == "…" and ch.islower() and s[k - 1 : k].isspace():
            return None
        self.cut(last)

    def initial(self, dot: int) -> bool:
        """Whether the unit so far is a single letter, as if an initial had lost its capital."""
        k, shown = self.unit, ""
        while k < dot and len(shown) < 2:
            shown += "" if _widthless(self.s[k]) else self.s[k]
            k += 1
        return len(shown) == 1 and shown.isalpha()

    def blank(self, k: int, last: int) -> None:
        """A blank after Thai: it ends a unit, unless a number stands next to it."""
        s, follows, before = self.s, _next(self.s, last, self.end), k - 1
        while before > self.unit and _widthless(s[before]):
            before -= 1
        self.at = last
        if s[before].isdigit() or follows >= self.end or s[follows].isdigit() or "\n" in s[k:last] and not "฀" <= s[follows] <= "๿":
            return
        if s[follows] in ENDS or s[follows] in CLOSERS and s[follows] != '"' or s[follows] == "ๆ":
            return
        self.cut(k)


@functools.lru_cache(maxsize=1)
def _months() -> frozenset[str]:
    return frozenset(w.translate(plain_table()) for w in MONTHS)


def _trimmed(text: str, start: int, end: int) -> tuple[int, int] | None:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return (start, end) if any(not c.isspace() and not _widthless(c) for c in text[start : min(end, start + 64)]) or any(not c.isspace() and not _widthless(c) for c in text[start:end]) else None


def units(text: str | None, by_line: bool = False) -> list[tuple[int, int]]:
    """(start, end) of each unit. With ``by_line`` each line that isn't blank is one."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    if by_line:
        at = 0
        for line in text.split("\n"):
            out.append((at, at + len(line)))
            at += len(line) + 1
    else:
        s = text if text.isascii() else text.translate(plain_table())
        at = 0
        for m in BLANK_LINE.finditer(text):
            _Block(s, at, m.start(), out).run()
            at = m.end()
        _Block(s, at, len(text), out).run()
    return [x for a, b in out if (x := _trimmed(text, a, b))]


def _units(line_categories: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            for k, (text, category) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = units(text, category in line_categories)
                rows += [k] * len(found)
                starts += [a for a, _ in found]
                ends += [b for _, b in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["id", "start", "end"])

    return run


def sentence_units(df: DataFrame, id_col: str, text_col: str, category_col: str | None = None, line_categories: tuple[str, ...] = ("list", "source_code", "json_schema")) -> DataFrame:
    """(``id_col``, start, end): the units of each text, without white space at their edges; offsets count code points.

    In texts whose category is one of ``line_categories`` each line that isn't blank is a unit. Null, empty
    and blank texts, and texts of invisible characters, have none. Repeated rows give their units each
    time; other columns are ignored.
    """
    kind = df.select(id_col).schema[0].dataType.simpleString()
    category = F.col(category_col) if category_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), category.alias("category"))
    return rows.mapInArrow(_units(frozenset(line_categories)), f"id {kind}, start long, end long").select(F.col("id").alias(id_col), "start", "end")
