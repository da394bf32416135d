"""Words, sentences, n-grams, punctuation and vocabulary of groups of documents."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType

from glyphmill.functions import text as T
from glyphmill.functions.stats import describe, rate_columns, two_proportion_z
from glyphmill.operators.ordered import OWN, beside, neighbours, running_total
from glyphmill.storage import materialise

PROSE = ("factual_prose", "informal_social", "technical_explanation", "ascii_only", "accented", "quoted_speech", "repeat_of_S01", "repeat_of_M01", "repeat_of_L01")
NOT_PROSE = ("list", "source_code", "json_schema")
#: Words often named as typical of generated text (fixed values).
MARKER_TERMS = tuple(
    "delve tapestry boundless vibrant testament underscore underscores moreover furthermore crucial intricate nuanced landscape realm navigate foster fosters robust seamless comprehensive invaluable paramount meticulous unwavering multifaceted holistic leverage leveraging pivotal elevate unlock unlocking journey essentially notably crucially ultimately certainly".split()
)


def grouped(docs: DataFrame, group: Column, text_col: str = "text", *more: Column) -> DataFrame:
    return docs.select(group.alias("grp"), F.col(text_col).alias("text"), *more).where("text is not null")


def sample_sizes(docs: DataFrame, group: Column, prose: Column, text_col: str = "text") -> DataFrame:
    """Files, characters and words of each group, and of its prose also sentences."""
    rows = grouped(docs, group, text_col, F.coalesce(prose, F.lit(False)).alias("prose"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.groupBy("grp").agg(
        F.count(F.lit(1)).alias("files"), n(F.length("text")).alias("chars"), n(F.size(T.words(F.col("text")))).alias("words"), n(F.col("prose").cast("int")).alias("prose_files"),
        n(F.when(F.col("prose"), F.length("text"))).alias("prose_chars"), n(F.when(F.col("prose"), F.size(T.sentences(F.col("text"))))).alias("prose_sentences"),
    )


def word_counts(docs: DataFrame, group: Column, order_col: str, text_col: str = "text") -> DataFrame:
    """(grp, word, n, first): lower-cased words with their count and the place (document, number) of their first occurrence."""
    rows = grouped(docs, group, text_col, F.col(order_col).alias("doc"))
    each = rows.select("grp", "doc", F.posexplode(T.words(F.col("text"))).alias("k", "w")).withColumn("word", F.lower("w"))
    return each.groupBy("grp", "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "k")).alias("first"))


def top_words(docs: DataFrame, group: Column, order_col: str, k: int = 25, text_col: str = "text") -> DataFrame:
    """The ``k`` most frequent words of each group; ties go by first occurrence. With vocabulary and totals."""
    counts = word_counts(docs, group, order_col, text_col)
    totals = counts.groupBy("grp").agg(F.sum("n").alias("total_words"), F.count(F.lit(1)).alias("vocab_size"))
    order = Window.partitionBy("grp").orderBy(F.desc("n"), "first")
    best = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return best.join(totals, "grp").select("grp", "place", "word", "n", "total_words", "vocab_size", F.round(F.col("n") / F.col("total_words") * 1000, 6).alias("rate_per_1000"))


def _distinctive(grams: DataFrame, least: int, k: int) -> DataFrame:
    """Of (grp, gram, n, first): the grams whose rate exceeds its mean rate in the other groups most; ties by first occurrence."""
    grams = materialise(grams, "grams")
    totals = grams.groupBy("grp").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"))
    groups = totals.agg(F.count(F.lit(1)).alias("groups"))
    rated = grams.join(totals, "grp").withColumn("rate", F.col("n") / F.col("total"))  # Spark broadcasts the groups while they are few
    rated = rated.withColumn("all_rates", F.sum("rate").over(Window.partitionBy("gram")))
    rows = rated.where(F.col("n") >= least).crossJoin(F.broadcast(groups))
    others = F.coalesce(F.try_divide(F.col("all_rates") - F.col("rate"), F.col("groups") - 1), F.lit(0.0))
    rows = rows.withColumn("excess", F.round(F.col("rate") - others, 12))
    order = Window.partitionBy("grp").orderBy(F.desc("excess"), "first")
    best = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return best.select("grp", "place", "gram", "n", F.col("total").alias("total_ngrams"), F.col("distinct").alias("distinct_ngrams"), F.round(F.col("rate") * 1000, 6).alias("rate_per_1000"), F.round(F.col("excess") * 1000, 6).alias("excess_per_1000"))


def _first(doc: str, k: str, kind: DataType) -> Column:
    """A place (document, number) to take the least of. Those of whole numbers are packed into one decimal, which a hash aggregate can keep; others need a sort."""
    if isinstance(kind, (IntegerType, LongType)):
        return F.col(doc).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col(k).cast("decimal(10,0)")
    return F.struct(doc, k)


def _following(n: int) -> list[Column]:
    """The heads of the next n documents, within the blocks of ``ordered.neighbours``."""
    return [F.lead("head", k).over(beside()) for k in range(1, n + 1)]


def word_ngrams(docs: DataFrame, group: Column, order_col: str, n: int, text_col: str = "text") -> DataFrame:
    """(grp, gram, n, first): n words in a row over a group's words, on through the documents in their order.

    Grams inside a document need nothing but it; those over seams are made of first and last words only.
    """
    rows = grouped(docs, group, text_col, F.col(order_col).alias("doc")).select("grp", "doc", F.transform(T.words(F.col("text")), F.lower).alias("w")).where(F.size("w") > 0)
    gram = lambda w, k: F.array_join(F.slice(w, k, n), " ")
    inner = rows.where(F.size("w") >= n).select("grp", "doc", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda k: gram(F.col("w"), k))).alias("k", "gram"))
    each = inner.select("grp", "gram", F.struct("doc", "k").alias("first"))
    if n > 1:
        ends = rows.select("grp", "doc", F.slice("w", 1, n - 1).alias("head"), F.slice("w", F.greatest(F.size("w") - (n - 2), F.lit(1)), n - 1).alias("tail"), F.size("w").alias("size"))
        numbered = running_total(ends, ["grp"], ["doc"], F.lit(1), "at")
        none = F.array().cast("array<string>")
        joined = F.concat("tail", F.slice(F.concat(*(F.coalesce(h, none) for h in _following(n - 1))), 1, n - 1))
        seams = neighbours(numbered, n).withColumn("w", joined).where(OWN)
        seams = seams.select("grp", "doc", "size", F.size("tail").alias("own"), "w").where(F.size("w") >= n)
        over = seams.select("grp", "doc", "size", "own", F.posexplode(F.transform(F.sequence(F.lit(1), F.least(F.col("own"), F.size("w") - (n - 1))), lambda k: gram(F.col("w"), k))).alias("k", "gram"))
        each = each.unionByName(over.select("grp", "gram", F.struct("doc", (F.col("size") - F.col("own") + F.col("k")).alias("k")).alias("first")))
    kind = each.schema["first"].dataType["doc"].dataType
    return each.select("grp", "gram", "first.doc", "first.k").groupBy("grp", "gram").agg(F.count(F.lit(1)).alias("n"), F.min(_first("doc", "k", kind)).alias("first"))


#: Characters counted at once; a longer text is cut into overlapping pieces.
BLOCK = 1 << 21


def _count_block(texts: list[str], n: int, place: np.ndarray, most: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different grams of some texts, how often each is there, and the number of its first start among all characters.

    Only starts whose place in their text is below ``most`` count.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))
    starts = np.flatnonzero((left >= n) & (place < most[row]))
    there = np.zeros(sys.maxunicode + 1, bool)
    there[points] = True
    code = (np.cumsum(there) - 1)[points]
    bits = max(1, int(there.sum() - 1).bit_length())
    if bits * n <= 63:
        key = code[starts]
        for j in range(1, n):
            key = key << bits | code[starts + j]
    else:
        key = np.unique(np.stack([code[starts + j] for j in range(n)]), axis=1, return_inverse=True)[1].ravel()
    number, different = pd.factorize(key)
    count = np.bincount(number, minlength=len(different))
    first = np.empty(len(different), np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]  # of equals the first is written last
    at = starts[first]
    whole = points[at[:, None] + np.arange(n)].tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[k : k + n] for k in range(0, len(whole), n)], count, at


def _count_grams(n: int):
    """Of batches (grp, doc, at, most, t): (grp, gram, n, doc, k), grams counted and first places found for each batch and group."""

    def run(batches):
        for batch in batches:
            order = pc.sort_indices(batch, sort_keys=[("grp", "ascending"), ("doc", "ascending"), ("at", "ascending")])
            batch = batch.take(order)
            groups, docs, offsets, mosts, texts = (c.to_pylist() for c in batch.columns)
            start = 0
            while start < len(texts):
                pieces, size, k, shift = [], 0, start, 0
                while k < len(texts) and groups[k] == groups[start] and size < BLOCK:
                    piece = texts[k][shift : shift + BLOCK]
                    pieces.append((k, shift, piece))
                    size += len(piece)
                    if shift + BLOCK < len(texts[k]):  # a longer text gives several blocks of its own
                        yield from _block(batch, pieces, offsets, mosts, n)
                        pieces, size = [], 0
                        shift += BLOCK - n + 1
                    else:
                        k, shift = k + 1, 0
                yield from _block(batch, pieces, offsets, mosts, n)
                start = k

    def _block(batch, pieces, offsets, mosts, n):
        if not pieces:
            return
        rows = np.array([k for k, _, _ in pieces])
        texts = [t for _, _, t in pieces]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        shifts = np.array([s for _, s, _ in pieces])
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(shifts, sizes)
        grams, count, at = _count_block(texts, n, place, np.array([mosts[k] for k in rows], np.int64))
        which = np.searchsorted(np.cumsum(sizes), at, side="right")
        took = pa.array(rows[which])
        k = place[at] + np.array([offsets[k] for k in rows], np.int64)[which]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(took), pa.array(grams, pa.string()), pa.array(count), batch.column(1).take(took), pa.array(k)], ["grp", "gram", "n", "doc", "k"])

    return run


def counted_grams(rows: DataFrame, n: int) -> DataFrame:
    """Of (grp, doc, at, most, t): (grp, gram, n, first) of all n characters in a row of the texts ``t`` that begin below ``most``; a text's places begin at ``at``.

    Grams are counted in each batch before they are shuffled.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    each = rows.select("grp", "doc", F.col("at").cast("long").alias("at"), F.col("most").cast("long").alias("most"), "t").where(F.length("t") >= n)
    counted = each.mapInArrow(_count_grams(n), f"grp {kinds['grp']}, gram string, n long, doc {kinds['doc']}, k long")
    return counted.groupBy("grp", "gram").agg(F.sum("n").alias("n"), F.min(_first("doc", "k", rows.schema["doc"].dataType)).alias("first"))


def char_ngrams(docs: DataFrame, group: Column, order_col: str, n: int, text_col: str = "text") -> DataFrame:
    """(grp, gram, n, first): n characters in a row of a group's joined texts in normal form.

    Texts meet at the seams only, where one blank is left of those that meet, and none at a group's start and
    end. First and last characters tell this, so whole texts stay where they are, but for those with a blank at an end.
    """
    rows = grouped(docs, group, text_col, F.col(order_col).alias("doc")).select("grp", "doc", F.regexp_replace(F.lower("text"), rf"{T.SPACE}+", " ").alias("t")).where("t <> ''")
    blank = F.lit(" ")
    starts, closes = F.startswith("t", blank), F.endswith("t", blank)
    ends = rows.select("grp", "doc", F.substring("t", 1, n + 1).alias("head"), F.substring(F.concat(F.lit(" " * n), "t"), -n - 1, n + 1).alias("tail"), F.length("t").alias("size"), (F.col("t") == blank).alias("void"), starts.alias("starts"), closes.alias("closes"))
    placed = running_total(materialise(ends, "ends"), ["grp"], ["doc"], (~F.col("void")).cast("int"), "at")  # texts are read once for it
    voids = placed.where("void").groupBy("grp", "at").agg(F.min("doc").alias("between"))  # blank texts, the first before each other text
    full = placed.where("not void").drop("void").join(voids, ["grp", "at"], "left")
    # of the blanks that meet, the first is kept
    before = F.lag("closes").over(beside())
    full = neighbours(full, n + 1).withColumn("lead", (F.col("starts") & (before.isNull() | before | F.col("between").isNotNull())).cast("int"))
    full = full.withColumn("filler", F.when(before.isNotNull() & ~before, F.col("between"))).withColumn("trail", (F.col("closes") & F.lead("at").over(beside()).isNull()).cast("int"))
    size = F.col("size") - F.col("lead") - F.col("trail")
    filled = F.when(F.col("filler").isNotNull(), " ").otherwise("")
    own = F.substring(F.col("head"), F.col("lead") + 1, F.least(size, F.lit(n)))
    full = full.withColumn("own_head", own).withColumn("head", F.concat(filled, own)).withColumn("left", size)
    after = F.concat(F.lit(""), *(F.coalesce(h, F.lit("")) for h in _following(n - 1)))
    full = full.withColumn("after", F.substring(after, 1, n - 1)).where(OWN)
    seams = materialise(full.select("grp", "doc", "starts", "closes", "lead", "trail", "filler", "own_head", "after", "left", "tail"), "seams")
    odd = rows.where(starts | closes).join(seams.where("starts or closes").select("grp", "doc", "lead", "left"), ["grp", "doc"]).select("grp", "doc", F.substring(F.col("t"), F.col("lead") + 1, F.col("left")).alias("t"))
    whole = rows.where(~(starts | closes)).unionByName(odd)
    texts = whole.select("grp", "doc", F.lit(0).alias("at"), F.lit(1 << 62).alias("most"), "t")
    fillers = seams.where("filler is not null").select("grp", F.col("filler").alias("doc"), F.lit(0).alias("at"), F.lit(1).alias("most"), F.substring(F.concat(blank, "own_head", "after"), 1, n).alias("t"))
    if n > 1:
        taken = F.least(F.col("left"), F.lit(n - 1))
        tail = F.substring(F.col("tail"), F.lit(n + 2) - F.col("trail") - taken, taken)
        over = seams.select("grp", "doc", (F.col("left") - taken).alias("at"), taken.alias("most"), F.concat(tail, "after").alias("t"))
        texts = texts.unionByName(over)
    return counted_grams(texts.unionByName(fillers), n)


def distinctive_words(docs: DataFrame, group: Column, order_col: str, n: int, k: int = 12, text_col: str = "text") -> DataFrame:
    return _distinctive(word_ngrams(docs, group, order_col, n, text_col), 3 if n <= 2 else 2, k)


def distinctive_characters(docs: DataFrame, group: Column, order_col: str, n: int, k: int = 12, text_col: str = "text") -> DataFrame:
    return _distinctive(char_ngrams(docs, group, order_col, n, text_col), 5, k)


def punctuation(docs: DataFrame, keys: dict[str, Column], text_col: str = "text") -> DataFrame:
    """(keys, category, n, chars): counts of the punctuation classes, zeros included, in one pass and one shuffle of sums."""
    rows = docs.select(*(c.alias(k) for k, c in keys.items()), F.col(text_col).alias("text")).where("text is not null")
    sums = rows.groupBy(*keys).agg(F.sum(F.length("text").cast("long")).alias("chars"), *(F.sum(T.count_of(F.col("text"), chars).cast("long")).alias(f"_{name}") for name, chars in T.PUNCTUATION.items()))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("category"), F.col(f"_{name}").alias("n")) for name in T.PUNCTUATION)))
    return sums.select(*keys, "chars", each.alias("x")).select(*keys, "x.category", "x.n", "chars")


def punctuation_rates(docs: DataFrame, keys: dict[str, Column], text_col: str = "text") -> DataFrame:
    counted = punctuation(docs, keys, text_col)
    return counted.select(*keys, "category", "n", "chars", *rate_columns(F.col("n"), F.col("chars")))


def punctuation_z(docs: DataFrame, group: Column, control: Column, text_col: str = "text", categories: tuple[str, ...] = ("comma", "period", "curly_quote", "em_dash", "semicolon")) -> DataFrame:
    """(grp, category, n, chars, control_n, control_chars, z): each group against the documents of ``control``."""
    rows = punctuation(docs.where(~F.coalesce(control, F.lit(False))), {"grp": group}, text_col).where(F.col("category").isin(*categories))
    other = punctuation(docs.where(control), {"one": F.lit(1)}, text_col).select("category", F.col("n").alias("control_n"), F.col("chars").alias("control_chars"))
    joined = rows.join(F.broadcast(other), "category")
    return joined.select("grp", "category", "n", "chars", "control_n", "control_chars", F.round(two_proportion_z(F.col("n"), F.col("chars"), F.col("control_n"), F.col("control_chars")), 6).alias("z"))


def sentence_lengths(docs: DataFrame, group: Column, order_col: str, text_col: str = "text") -> DataFrame:
    """(grp, doc, k, words): the number of words of each sentence."""
    rows = grouped(docs, group, text_col, F.col(order_col).alias("doc"))
    each = rows.select("grp", "doc", F.posexplode(T.sentences(F.col("text"))).alias("k", "s"))
    return each.select("grp", "doc", "k", F.size(T.words(F.col("s"))).alias("words"))


def sentence_statistics(docs: DataFrame, group: Column, order_col: str, text_col: str = "text") -> DataFrame:
    return sentence_lengths(docs, group, order_col, text_col).groupBy("grp").agg(*describe(F.col("words")))


def entropy(docs: DataFrame, group: Column, text_col: str = "text") -> DataFrame:
    """(grp, chars, bits_per_char): Shannon entropy of a group's characters; 0 for no characters."""
    rows = grouped(docs, group, text_col)
    counted = counted_grams(rows.select("grp", F.lit(0).alias("doc"), F.lit(0).alias("at"), F.lit(1 << 62).alias("most"), F.col("text").alias("t")), 1)
    bits = counted.groupBy("grp").agg(F.sum("n").alias("chars"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    every = rows.select("grp").distinct().join(bits, "grp", "left")
    return every.select("grp", F.coalesce("chars", F.lit(0)).alias("chars"), F.round(F.coalesce(F.log2("chars") - F.col("s") / F.col("chars"), F.lit(0.0)), 6).alias("bits_per_char"))


def vocabulary(docs: DataFrame, group: Column, text_col: str = "text") -> DataFrame:
    """(grp, n_words, vocab_size, mean_word_length, ttr)"""
    each = grouped(docs, group, text_col).select("grp", F.explode(T.words(F.col("text"))).alias("w"))
    counted = each.groupBy("grp", F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("w")).alias("chars"))
    sums = counted.groupBy("grp").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("vocab_size"), F.sum("chars").alias("chars"))
    return sums.select("grp", "n_words", "vocab_size", F.round(F.col("chars") / F.col("n_words"), 6).alias("mean_word_length"), F.round(F.col("vocab_size") / F.col("n_words"), 6).alias("ttr"))


def matched_vocabulary(docs: DataFrame, group: Column, order_col: str, counts_for_size: Column, text_col: str = "text") -> DataFrame:
    """(grp, n_words_used, vocab_size, ttr) of each group's first N words; N is the least size of the groups of ``counts_for_size``."""
    rows = grouped(docs, group, text_col, F.col(order_col).alias("doc"), counts_for_size.alias("counts"))
    sizes = rows.select("grp", "doc", "counts", F.size(T.words(F.col("text"))).alias("size")).where("size > 0")
    placed = running_total(sizes, ["grp"], ["doc"], F.col("size"), "before")  # sizes travel, words don't
    least = placed.where("counts").groupBy("grp").agg(F.sum("size").alias("n")).agg(F.min("n").alias("least"))
    begun = placed.crossJoin(F.broadcast(least)).where("before < least").select("grp", "doc", (F.col("least") - F.col("before")).cast("int").alias("left"))
    first = begun.join(rows.select("grp", "doc", "text"), ["grp", "doc"]).select("grp", F.explode(F.slice(T.words(F.col("text")), F.lit(1), F.col("left"))).alias("w"))
    counted = first.groupBy("grp", F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("grp").agg(F.sum("n").alias("n_words_used"), F.count(F.lit(1)).alias("vocab_size")).withColumn("ttr", F.round(F.col("vocab_size") / F.col("n_words_used"), 6))


def marker_rates(docs: DataFrame, group: Column, terms: tuple[str, ...] = MARKER_TERMS, text_col: str = "text") -> DataFrame:
    """(grp, term, n, words, rates): every group with every term and with COMBINED, zeros included."""
    each = grouped(docs, group, text_col).select("grp", F.explode(T.words(F.col("text"))).alias("w")).groupBy("grp", F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    totals = each.groupBy("grp").agg(F.sum("n").alias("words"))
    found = each.where(F.col("word").isin(*terms)).select("grp", F.col("word").alias("term"), "n")
    found = found.unionByName(found.groupBy("grp").agg(F.sum("n").alias("n")).withColumn("term", F.lit("COMBINED")))
    grid = totals.select("grp", "words", F.explode(F.array(*map(F.lit, [*terms, "COMBINED"]))).alias("term"))
    full = grid.join(found, ["grp", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select("grp", "term", "n", "words", *rate_columns(F.col("n"), F.col("words")))


def spread_across(docs: DataFrame, group: Column, prompt: Column, text_col: str = "text") -> DataFrame:
    """(prompt, groups, mean, sd): word counts of a prompt's answers across groups; repeats are left out by the caller."""
    per = docs.where(F.col(text_col).isNotNull()).select(group.alias("grp"), prompt.alias("prompt"), F.size(T.words(F.col(text_col))).alias("n")).where("prompt is not null")
    each = per.groupBy("prompt", "grp").agg(F.avg("n").alias("n"))
    return each.groupBy("prompt").agg(F.count(F.lit(1)).alias("groups"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("sd"))


def spread_within(docs: DataFrame, group: Column, band: Column, text_col: str = "text") -> DataFrame:
    """(grp, band, statistics of word counts)"""
    per = docs.where(F.col(text_col).isNotNull()).select(group.alias("grp"), band.alias("band"), F.size(T.words(F.col(text_col))).alias("n")).where("band is not null")
    return per.groupBy("grp", "band").agg(*describe(F.col("n"))).withColumnRenamed("n", "texts")


def typography(docs: DataFrame, group: Column, dialogue: Column, text_col: str = "text") -> DataFrame:
    """(grp, scope, files, chars, typographic, per_1k) for all texts and for dialogue only."""
    marks = "".join(chr(c) for c in [*range(0x2010, 0x2016), *range(0x2018, 0x2020), 0x2026, 0x2032, 0x2033])
    rows = grouped(docs, group, text_col, F.coalesce(dialogue, F.lit(False)).alias("dialogue")).withColumn("typo", T.count_of(F.col("text"), marks))
    scoped = rows.select("grp", F.length("text").alias("chars"), "typo", F.explode(F.when(F.col("dialogue"), F.array(F.lit("all"), F.lit("dialogue_only"))).otherwise(F.array(F.lit("all")))).alias("scope"))
    sums = scoped.groupBy("grp", "scope").agg(F.count(F.lit(1)).alias("files"), F.sum("chars").alias("chars"), F.sum("typo").alias("typographic"))
    return sums.withColumn("per_1k", F.round(F.try_divide(1000.0 * F.col("typographic"), F.col("chars")), 4))
