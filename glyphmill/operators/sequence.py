"""Ordered sequences: lags, gaps, periodicity, and the sequences the resampling tests take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.functions.stats import pearson
from glyphmill.operators.lexical import grouped
from glyphmill.operators.ordered import running_total
from glyphmill.storage import materialise

LAGS = (1, 2, 3, 5, 8)
PERIODS = (2, 3, 4, 5, 6, 7, 8, 10, 12)
MARKERS = {"comma": ",", "period": ".", "all_terminal_punct": ".!?"}


def sentence_sequences(docs: DataFrame, id_col: str, text_col: str = "text", *more: Column) -> DataFrame:
    """(id, more, x): the array of sentence lengths in words of each document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *more).where("text is not null")
    return rows.select(*(c for c in rows.columns if c != "text"), F.transform(T.sentences(F.col("text")), lambda s: F.size(T.words(s))).alias("x"))


def lag_correlation(seqs: DataFrame, lags: tuple[int, ...] = LAGS, cap: int | None = None, margin: int = 5) -> DataFrame:
    """(id, n, lag, r) of arrays x: correlation of x[:-lag] and x[lag:]; null where a side is constant.

    All elements count, or the first ``cap``, and a sequence needs more than ``lag + margin`` of them. Each
    array is paired with itself in place; no sorting is needed.
    """
    capped = seqs.select("id", (F.slice("x", 1, cap) if cap else F.col("x")).alias("x")).withColumn("n", F.size("x"))
    each = capped.select("id", "n", "x", F.explode(F.array(*map(F.lit, lags))).alias("lag")).where(F.col("n") > F.greatest(F.col("lag") + margin, F.col("lag") + 1))
    pairs = each.select("id", "n", "lag", F.explode(F.arrays_zip(F.slice("x", F.lit(1), F.col("n") - F.col("lag")).alias("a"), F.slice("x", F.col("lag") + 1, F.col("n") - F.col("lag")).alias("b"))).alias("p"))
    return pairs.groupBy("id", "n", "lag").agg(F.round(pearson(F.col("p.a").cast("double"), F.col("p.b").cast("double")), 6).alias("r"))


def group_words(docs: DataFrame, group: Column, order_col: str, text_col: str = "text") -> DataFrame:
    """(grp, before, x): the lengths of the words of each group's joined texts, in pieces, and how many words stand before each.

    Texts are joined without a separator, so words at seams run together. What can run together are the runs of
    letters and apostrophes at the ends of texts: only these travel; a text's other words stay in its row.
    """
    run = rf"^(?:{T.LETTERS[:-1]}|')*"
    rows = grouped(docs, group, text_col, F.col(order_col).alias("doc")).where("text <> ''")
    rows = rows.withColumn("head", F.regexp_extract("text", run, 0)).withColumn("solid", F.length("head") == F.length("text"))
    rows = rows.withColumn("tail", F.when(F.col("solid"), "").otherwise(F.reverse(F.regexp_extract(F.reverse("text"), run, 0))))
    middle = F.substring(F.col("text"), F.length("head") + 1, F.length("text") - F.length("head") - F.length("tail"))
    lengths = lambda t: F.transform(T.words(t), F.length)
    pieces = materialise(rows.select("grp", "doc", "head", "tail", "solid", F.when(F.col("solid"), F.array().cast("array<int>")).otherwise(lengths(middle)).alias("x")), "words")
    # a seam: the tail of a text, the texts that are a single run after it, and the head of the next
    seams = running_total(pieces.select("grp", "doc", "head", "tail", "solid"), ["grp"], ["doc"], (~F.col("solid")).cast("int"), "seam")
    own = F.struct("doc", F.lit(0).alias("side"), F.col("head").alias("t"))
    parts = seams.select("grp", F.explode(F.when(F.col("solid"), F.array(F.struct(F.col("seam"), own.alias("p")))).otherwise(F.array(F.struct(F.col("seam"), own.alias("p")), F.struct((F.col("seam") + 1).alias("seam"), F.struct("doc", F.lit(1).alias("side"), F.col("tail").alias("t")).alias("p"))))).alias("s")).select("grp", "s.seam", "s.p")
    joined = parts.where("p.t <> ''").groupBy("grp", "seam").agg(F.array_sort(F.collect_list("p")).alias("p"))
    of_seam = joined.select("grp", F.element_at("p", 1)["doc"].alias("doc"), F.element_at("p", 1)["side"].alias("first"), lengths(F.array_join(F.transform("p", lambda v: v["t"]), "")).alias("x"))
    # in its document a seam that begins with a head stands before the text's other words, one that begins with a tail after them
    every = of_seam.select("grp", "doc", (F.col("first") * 2).alias("side"), "x").unionByName(pieces.select("grp", "doc", F.lit(1).alias("side"), "x")).where(F.size("x") > 0)
    return running_total(every, ["grp"], ["doc", "side"], F.size("x"), "before").select("grp", "before", "x")


def word_pairs(docs: DataFrame, group: Column, order_col: str, lags: tuple[int, ...] = LAGS, margin: int = 20, text_col: str = "text") -> DataFrame:
    """(grp, lag, a, b, c): how often a word of length b stands ``lag`` words after one of length a, over a group's joined words.

    Inside a piece its array is paired with itself; only the ends of pieces meet others, by an equi-join. Groups
    with no more than ``lag + margin`` words have none.
    """
    words = group_words(docs, group, order_col, text_col).withColumn("size", F.size("x"))
    n = words.groupBy("grp").agg(F.sum("size").cast("long").alias("n"))
    each = words.select("grp", "before", "x", "size", F.explode(F.array(*map(F.lit, lags))).alias("lag"))
    rest = F.col("size") - F.col("lag")
    inside = each.where(rest > 0).select("grp", "lag", F.explode(F.arrays_zip(F.slice("x", F.lit(1), rest).alias("a"), F.slice("x", F.col("lag") + 1, rest).alias("b"))).alias("p")).select("grp", "lag", "p.a", "p.b")
    start = F.greatest(F.lit(0), rest)
    last = each.select("grp", "lag", (F.col("before") + start + F.col("lag")).alias("to"), F.posexplode(F.slice("x", start + 1, F.col("size"))).alias("k", "a")).select("grp", "lag", (F.col("to") + F.col("k")).alias("to"), "a")
    first = words.select("grp", "before", F.posexplode(F.slice("x", 1, max(lags))).alias("k", "b")).select("grp", (F.col("before") + F.col("k")).alias("to"), "b")
    pairs = inside.unionByName(last.join(first, ["grp", "to"]).select("grp", "lag", "a", "b"))
    counted = pairs.groupBy("grp", "lag", "a", "b").agg(F.count(F.lit(1)).alias("c"))
    return counted.join(n, "grp").where(F.col("n") > F.col("lag") + margin).drop("n")


def word_lag_correlation(docs: DataFrame, group: Column, order_col: str, lags: tuple[int, ...] = LAGS, margin: int = 20, text_col: str = "text") -> DataFrame:
    """(grp, n, lag, r) over a group's joined words."""
    a, b, c = (F.col(x).cast("double") for x in "abc")
    total = lambda x: F.sum(x * c)
    m = word_pairs(docs, group, order_col, lags, margin, text_col).groupBy("grp", "lag").agg(F.sum("c").alias("k"), total(a).alias("sa"), total(b).alias("sb"), total(a * b).alias("ab"), total(a * a).alias("aa"), total(b * b).alias("bb"))
    spread = F.sqrt(F.expr("k * aa - sa * sa")) * F.sqrt(F.expr("k * bb - sb * sb"))
    return m.select("grp", (F.col("k") + F.col("lag")).alias("n"), "lag", F.round(F.try_divide(F.expr("k * ab - sa * sb"), spread), 6).alias("r"))


def marker_gaps(docs: DataFrame, group: Column, order_col: str, markers: dict[str, str] = MARKERS, text_col: str = "text") -> DataFrame:
    """(marker, grp, place, gap): distances between neighbouring marks of each set in a group's joined texts; the place is that of the later mark.

    Inside a document gaps come from its own places; at a seam the first mark meets the last one before it.
    """
    rows = grouped(docs, group, text_col, F.col(order_col).alias("doc")).where("text <> ''")
    rows = rows.select("grp", "doc", F.length("text").alias("chars"), *(T.marker_places(F.col("text"), marks).alias(f"_{name}") for name, marks in markers.items()))
    placed = running_total(rows, ["grp"], ["doc"], F.col("chars").cast("long"), "before")
    each = placed.select("grp", "doc", "before", F.explode(F.array(*(F.struct(F.lit(name).alias("marker"), F.col(f"_{name}").alias("places")) for name in markers))).alias("m"))
    each = each.select("grp", "doc", F.col("m.marker").alias("marker"), F.transform("m.places", lambda p: p.cast("long") + F.col("before")).alias("places")).where(F.size("places") > 0)
    numbered = running_total(each, ["grp", "marker"], ["doc"], F.lit(1), "nth")
    last = numbered.select("grp", "marker", (F.col("nth") + 1).alias("nth"), F.element_at("places", -1).alias("_last"))
    joined = numbered.join(last, ["grp", "marker", "nth"], "left")
    both = F.when(F.col("_last").isNull(), F.col("places")).otherwise(F.concat(F.array("_last"), "places"))
    pairs = joined.select("marker", "grp", both.alias("p")).where(F.size("p") > 1)
    gaps = pairs.select("marker", "grp", F.explode(F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("a"), F.slice("p", F.lit(2), F.size("p") - 1).alias("b"))).alias("g"))
    return gaps.select("marker", "grp", F.col("g.b").alias("place"), (F.col("g.b") - F.col("g.a")).alias("gap"))


def gap_chi2(gaps: DataFrame, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """(grp ..., k, n_gaps, chi2): deviation of gap mod k from the uniform, null below 5k gaps. Zero counts are kept; other columns name a sequence."""
    keys = [c for c in gaps.columns if c not in ("gap", "place", "at")]
    counts = gaps.groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("c"))
    each = counts.select(*keys, "gap", "c", F.explode(F.array(*map(F.lit, periods))).alias("k"))
    residues = each.groupBy(*keys, "k", (F.col("gap") % F.col("k")).alias("r")).agg(F.sum("c").alias("o"))
    sums = residues.groupBy(*keys, "k").agg(F.sum("o").alias("n_gaps"), F.sum(F.col("o") * F.col("o")).alias("oo"))
    # sum (o-e)^2/e over all k residues is k/n * sum o^2 - n
    chi2 = F.col("oo") * F.col("k") / F.col("n_gaps") - F.col("n_gaps")
    return sums.select(*keys, "k", "n_gaps", F.when(F.col("n_gaps") >= 5 * F.col("k"), F.round(chi2, 6)).alias("chi2"))


def cap_first(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key, with ``was_capped``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("_k", F.row_number().over(w)).withColumn("was_capped", total > n).where(F.col("_k") <= n).drop("_k")
