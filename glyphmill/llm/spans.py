"""Long passages that stand in several records, letter for letter or with small edits.

Seeds: of every ``length - k + 1`` k-mers in a row the one with the least hash, so that each exact span of
``length`` characters holds a seed at the same place in both texts. Shared seeds of a pair of texts are
chained in order, with gap costs, through a Fenwick tree; every seed ends up in one chain. Chains are
aligned: each seed is stretched along its diagonal to the longest exact run, and a chain's whole reach is
a fuzzy passage. Equal texts are one text here.

Which texts are paired: all that share a seed, as long as no more than ``hot`` texts hold it. The texts of
a more frequent seed are a class; each is paired with the class's representative, and so it is with that of
each span of ``length`` characters around such a seed that it shares. So the work is linear in the places
of a frequent passage, any two of its texts are linked by one representative, and every exact span is found
by a chain of its own. All pairs, however found, are chained at all seeds they share. A pair's texts travel
only as far as its seeds reach: an exact run ends less than ``length`` characters beyond its outermost seed.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.words import mix
from glyphmill.storage import materialise

_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Code points hashed at once; longer texts are taken in overlapping blocks.
BLOCK = 1 << 21


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def kmer_hashes(points: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` code points from each place on, by doubling; the last ones overlap."""
    n = len(points) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, have = mix(points.astype(np.uint64)), 1
    with np.errstate(over="ignore"):
        while have < size:
            step = min(have, size - have)
            h = mix(h[: len(h) - step] * _STEP + h[step:])
            have += step
    return h


def least_places(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash, the leftmost of equals, in each run of ``window`` hashes."""
    key = (h & ~np.uint64((1 << 22) - 1)) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have < window:
        step = min(have, window - have)
        key = np.minimum(key[: len(key) - step], key[step:])
        have += step
    return key & np.uint64((1 << 22) - 1)


def text_seeds(text: str, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    points, found, hashes = code_points(text), [], []
    for start in range(0, max(1, len(points) - length + 1), BLOCK):
        part = points[start : start + BLOCK + length - 1]
        h = kmer_hashes(part, k)
        at = np.unique(least_places(h, length - k + 1)).astype(np.int64)
        found.append(at + start)
        hashes.append(h[at])
    at, h = np.concatenate(found), np.concatenate(hashes)
    at, first = np.unique(at, return_index=True)
    return at, h[first]


def _seed(k: int, length: int):
    """Each text's seeds: their different hashes, and the places of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            rids, hashes, places = [], [], []
            for text in batch.column(1).to_pylist():
                at, h = text_seeds(text, k, length)
                order = np.argsort(h, kind="stable")
                different, first = np.unique(h[order], return_index=True)
                rids.append(rid)
                rid += 1
                hashes.append(different.view(np.int64))
                places.append([x.tolist() for x in np.split(at[order], first[1:])])
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), batch.column(0), batch.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.list_(pa.int64())))], ["rid", "digest", "text", "hashes", "places"])

    return run


def steps(places: list[int], k: int) -> list[tuple[int, int, int]]:
    """Sorted places as progressions (first, step, number), with steps of ``k`` at most; others stand alone."""
    out, i = [], 0
    while i < len(places):
        j, step = i, places[i + 1] - places[i] if i + 1 < len(places) else k + 1
        while step <= k and j + 1 < len(places) and places[j + 1] - places[j] == step:
            j += 1
        out.append((places[i], step if j > i else 0, j - i + 1))
        i = j + 1
    return out


def crossed(pa: list[int], pb: list[int], k: int, most: int = 1024) -> dict[tuple[int, int], int]:
    """Anchors of one seed's places in two texts, with the number of seeds for which each stands.

    Where a seed follows itself at the same step in both texts, all its anchors on a diagonal lie in one
    exact run. If there are over ``most`` in all, the first and the last of each diagonal stand for them.
    """
    if len(pa) * len(pb) <= most:
        return dict.fromkeys(((i, j) for i in pa for j in pb), 1)
    out: dict[tuple[int, int], int] = {}
    for x, d, n in steps(sorted(pa), k):
        for y, e, m in steps(sorted(pb), k):
            if d != e or not d:
                out |= dict.fromkeys(((x + s * d, y + t * e) for s in range(n) for t in range(m)), 1)
                continue
            for s in range(1 - m, n):
                i, j = max(s, 0), max(-s, 0)
                c = min(n - i, m - j) - 1
                out[x + (i + c) * d, y + (j + c) * d] = 1
                out[x + i * d, y + j * d] = max(1, c)
    return out


def chain(anchors: list[tuple[int, int]], k: int, gap: float, seeds: dict[tuple[int, int], int] | None = None) -> list[list[int]]:
    """Anchors (place in a, place in b, sorted) as chains of indexes, best first; each anchor is in one.

    A chain's score is ``k`` for each anchor, or each of its ``seeds``, less ``gap`` for each character between neighbours on either
    side. With the gaps' sum taken from the ends, the best forerunner is a prefix maximum over b.
    """
    ends = sorted({b for _, b in anchors})
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(ends) + 1)
    score, back = [0.0] * len(anchors), [-1] * len(anchors)
    ranks = [bisect_left(ends, b) + 1 for _, b in anchors]
    i = 0
    while i < len(anchors):
        j = i
        while j < len(anchors) and anchors[j][0] == anchors[i][0]:
            best, x = (float("-inf"), -1), ranks[j] - 1
            while x:
                best = max(best, tree[x])
                x -= x & -x
            linked = best[0] - gap * sum(anchors[j]) if best[1] >= 0 else 0.0
            own = k * seeds[anchors[j]] if seeds else k
            score[j], back[j] = (own + linked, best[1]) if linked > 0 else (float(own), -1)
            j += 1
        for t in range(i, j):  # equal places in a don't follow each other
            mine, x = (score[t] + gap * sum(anchors[t]), t), ranks[t]
            while x < len(tree):
                if tree[x] < mine:
                    tree[x] = mine
                x += x & -x
        i = j
    used, chains = [False] * len(anchors), []
    for t in sorted(range(len(anchors)), key=lambda t: -score[t]):
        one = []
        while t >= 0 and not used[t]:
            used[t] = True
            one.append(t)
            t = back[t]
        if one:
            chains.append(one[::-1])
    return chains


def _same(a: str, i: int, b: str, j: int, most: int) -> int:
    """Number of equal characters from a[i] and b[j] on, ``most`` at most."""
    done, step = 0, 64
    while done < most:
        step = min(step, most - done)
        if a[i + done : i + done + step] == b[j + done : j + done + step]:
            done += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2 if step > 1 else 1
            most = min(most, done + 2 * step)
    return done


def align(a: str, b: str, anchors: list[tuple[int, int]], k: int, gap: float, length: int, seeds: dict[tuple[int, int], int] | None = None) -> list[tuple[int, int, int, int, bool]]:
    """(a_start, a_end, b_start, b_end, exact): exact runs of ``length`` or more, and the reach of chains as long."""
    ra, rb, out = a[::-1], b[::-1], []
    seen: dict[int, list[tuple[int, int]]] = {}  # the runs in a of each diagonal, by place; chains come by score
    for one in chain(anchors, k, gap, seeds):
        reach: list[tuple[int, int, int, int]] = []
        for t in one:
            i, j = anchors[t]
            runs = seen.setdefault(i - j, [])
            at = bisect_left(runs, (i + 1, 0)) - 1
            if a[i : i + k] != b[j : j + k] or at >= 0 and runs[at][1] >= i + k:
                continue
            left = _same(ra, len(a) - i, rb, len(b) - j, min(i, j))
            right = _same(a, i + k, b, j + k, min(len(a) - i, len(b) - j) - k)
            run = (i - left, i + k + right, j - left, j + k + right)
            insort(runs, run[:2])
            reach.append(run)
            if run[1] - run[0] >= length:
                out.append((*run, True))
        if len(reach) > 1:
            whole = (min(r[0] for r in reach), max(r[1] for r in reach), min(r[2] for r in reach), max(r[3] for r in reach))
            if min(whole[1] - whole[0], whole[3] - whole[2]) >= length:
                out.append((*whole, False))
    return out


def _align(k: int, gap: float, length: int):
    """``a`` and ``b`` are the parts of the texts from ``at_a`` and ``at_b`` on; the seeds' places are those in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y, shared, at_a, at_b, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                seeds: dict[tuple[int, int], int] = {}
                for p in shared:
                    seeds |= crossed([v - at_a for v in p["pa"]], [v - at_b for v in p["pb"]], k)
                rows += [(x, y, i + at_a, j + at_a, m + at_b, n + at_b, exact) for i, j, m, n, exact in align(a, b, sorted(seeds), k, gap, length, seeds)]
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.bool_())], ["rid_a", "rid_b", "a_start", "a_end", "b_start", "b_end", "exact"])

    return run


def _around(k: int, length: int):
    """Hashes of all spans of ``length`` that hold a seed at one of the given places: (rid, rank, hash), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, rank, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                h = kmer_hashes(code_points(text), length)
                mark = np.zeros(len(h) + 1, np.int64)
                at = np.asarray([x for of in places for x in of], np.int64)
                np.add.at(mark, np.maximum(0, at + k - length), 1)
                np.add.at(mark, np.minimum(len(h), at + 1), -1)
                found = np.unique(h[np.flatnonzero(np.cumsum(mark[:-1]) > 0)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), rid, np.int64)), pa.array(np.full(len(found), rank, np.int64)), pa.array(found.view(np.int64))], ["rid", "rank", "hash"])

    return run


def merged(intervals: DataFrame, key: str) -> DataFrame:
    """Union of the intervals (start, end) of each key, as longest stretches; touching ones become one."""
    order = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.select(key, "start", "end").distinct().withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1))
    return rows.withColumn("part", F.sum("new").over(order)).groupBy(key, "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


@dataclass
class SharedSpans:
    """``passages`` (rid_a, rid_b, a_start, a_end, b_start, b_end, exact) of pairs of different texts,
    ``classes`` (hash, rid, places, representative): the texts of each seed that more than ``hot`` texts hold,
    ``texts`` (rid, digest, chars), ``members`` (id, digest)."""

    passages: DataFrame
    classes: DataFrame
    texts: DataFrame
    members: DataFrame
    length: int

    def stretches(self) -> DataFrame:
        """(id, start, end): longest stretches of each record that lie in exact spans shared with another record."""
        p = self.passages.where("exact").select(F.explode(F.array(F.struct(F.col("rid_a").alias("rid"), F.col("a_start").alias("start"), F.col("a_end").alias("end")), F.struct(F.col("rid_b").alias("rid"), F.col("b_start").alias("start"), F.col("b_end").alias("end")))).alias("x")).select("x.*")
        of_texts = merged(p, "rid").join(self.texts, "rid").select("digest", "start", "end")
        copied = self.members.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        whole = self.texts.join(copied, "digest").select("digest", F.lit(0).cast("long").alias("start"), F.col("chars").alias("end"))
        parts = of_texts.join(copied, "digest", "left_anti").unionByName(whole)
        return parts.join(self.members, "digest").select("id", "start", "end")

    def coverage(self) -> DataFrame:
        """(id, chars, shared_chars, shared_part) of each record that is long enough to share a span."""
        shared = self.stretches().groupBy("id").agg(F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
        rows = self.members.join(self.texts, "digest").join(shared, "id", "left")
        return rows.select("id", "chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), (F.coalesce("shared_chars", F.lit(0)) / F.col("chars")).alias("shared_part"))


def _both_ways(pairs: DataFrame, one: str, other: str) -> DataFrame:
    return pairs.where(F.col(one) != F.col(other)).select(F.least(one, other).alias("rid_a"), F.greatest(one, other).alias("rid_b"))


def shared_spans(records: DataFrame, id_col: str, text_col: str, *, length: int = 200, k: int = 64, hot: int = 64, gap: float = 0.05) -> SharedSpans:
    """Passages of ``length`` or more characters that stand in more than one record.

    Rows that repeat an id with the same text are one record. Records with a null id or text, or with fewer
    than ``length`` characters, share nothing. Repeats within one record don't count. An empty table gives
    empty results, other columns are ignored. The texts of a seed that more than ``hot`` texts hold are
    linked by representatives, the others directly; stretches and coverage are the same for any ``hot``.
    """
    if not 1 <= k <= length < BLOCK:
        raise ValueError("1 <= k <= length is needed")
    rows = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(f"id is not null and length(text) >= {length}").withColumn("digest", F.unhex(F.md5("text")))
    members = rows.select("id", "digest").distinct()
    texts = rows.select("digest", "text").dropDuplicates(["digest"])
    table = materialise(texts.select("digest", "text").mapInArrow(_seed(k, length), "rid long, digest binary, text string, hashes array<long>, places array<array<long>>"), "seeds")
    # the order of representatives doesn't depend on the layout
    seeds = table.select("rid", F.xxhash64("digest").alias("rank"), F.explode(F.arrays_zip("hashes", "places")).alias("s")).select("rid", "rank", F.col("s.hashes").alias("hash"), F.col("s.places").alias("places"))
    tally = seeds.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min_by("rid", "rank").alias("representative")).where("n > 1")
    known = materialise(seeds.join(tally, "hash"), "shared")
    frequent = known.where(f"n > {hot}").select("hash", "rid", "rank", "places", "representative")
    few = known.where(f"n <= {hot}").select("hash", "rid", "places")
    seed = F.struct("pa", "pb")
    shared = (
        few.select("hash", F.col("rid").alias("rid_a"), F.col("places").alias("pa"))
        .join(few.select("hash", F.col("rid").alias("rid_b"), F.col("places").alias("pb")), "hash")
        .where("rid_a < rid_b")
        .groupBy("rid_a", "rid_b")
        .agg(F.collect_list(seed).alias("seeds"))
    )
    if frequent.limit(1).count():
        near = materialise(shared, "near")
        by_rid = frequent.groupBy("rid", "rank").agg(F.collect_list("places").alias("places"))
        spans = by_rid.join(table.select("rid", "text"), "rid").select("rid", "rank", "text", "places").mapInArrow(_around(k, length), "rid long, rank long, hash long")
        of_span = spans.groupBy("hash").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.min_by("rid", "rank").alias("representative")).where("lo < hi").select("hash", "representative")
        linked = _both_ways(frequent, "rid", "representative").unionByName(_both_ways(spans.join(of_span, "hash"), "rid", "representative"))
        pairs = near.select("rid_a", "rid_b").unionByName(linked).distinct()
        places = frequent.select("hash", "rid", "places")
        also = (
            pairs.join(places.select(F.col("rid").alias("rid_a"), "hash", F.col("places").alias("pa")), "rid_a")
            .join(places.select(F.col("rid").alias("rid_b"), "hash", F.col("places").alias("pb")), ["rid_b", "hash"])
            .groupBy("rid_a", "rid_b")
            .agg(F.collect_list(seed).alias("seeds"))
        )
        shared = near.unionByName(also).groupBy("rid_a", "rid_b").agg(F.flatten(F.collect_list("seeds")).alias("seeds"))

    def part(pairs: DataFrame, side: str) -> DataFrame:
        """With the part of the text that the pair's seeds reach, and where it begins."""
        all_places = F.flatten(F.col(f"seeds.p{side}"))
        text = table.select(F.col("rid").alias(f"rid_{side}"), F.col("text").alias("_text"))
        begun = pairs.withColumn(f"at_{side}", F.greatest(F.array_min(all_places) - length, F.lit(0))).withColumn("_end", F.array_max(all_places) + k + length)
        return begun.join(text, f"rid_{side}").withColumn(side, F.substr("_text", F.col(f"at_{side}").cast("int") + 1, (F.col("_end") - F.col(f"at_{side}")).cast("int"))).drop("_text", "_end")

    both = part(part(shared, "a"), "b").select("rid_a", "rid_b", "seeds", "at_a", "at_b", "a", "b")
    passages = both.mapInArrow(_align(k, gap, length), "rid_a long, rid_b long, a_start long, a_end long, b_start long, b_end long, exact boolean")
    return SharedSpans(passages, frequent.drop("rank"), table.select("rid", "digest", F.length("text").cast("long").alias("chars")), members, length)
