"""Near-duplicate records: an exact set-similarity join on word shingles.

Adaptive multi-match prefixes. All shingles are put in one global order, rare ones first. If two sets
reach Jaccard similarity t, then for every m the first ``|r| - ceil(t|r|) + m`` shingles of both share at
least m. Each record picks its own m by the estimated cost: a longer prefix reads more postings but
demands more common ones before a pair is verified. A pair must share ``min(m_a, m_b)`` prefix shingles.
Of a pair the smaller set is looked up by a shorter prefix, ``|r| - ceil(2t/(1+t) |r|) + m``: its partner is
no smaller, so they have more in common. Texts that only have a frequent passage in common, less of it
than would make them similar, then never meet: the passage's shingles come after those prefixes.
Rareness comes from counts of all shingles in a table of fixed width; any order keeps the result exact,
the counts only make it fast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.words import shingles, word_hashes
from glyphmill.storage import materialise

#: Bytes kept of a shingle's hash.
WIDTH = 6


@dataclass
class NearDuplicates:
    """``pairs`` (rid_a < rid_b, shared, size_a, size_b) holds every similar pair of different texts,
    ``classes`` (rid, digest) the texts, ``members`` (id, digest) the records of each text."""

    pairs: DataFrame
    classes: DataFrame
    members: DataFrame

    def class_pairs(self) -> DataFrame:
        """(digest_a, digest_b, shared, size_a, size_b)"""
        c = self.classes.select("rid", "digest")
        return (
            self.pairs.join(c.select(F.col("rid").alias("rid_a"), F.col("digest").alias("digest_a")), "rid_a")
            .join(c.select(F.col("rid").alias("rid_b"), F.col("digest").alias("digest_b")), "rid_b")
            .select("digest_a", "digest_b", "shared", "size_a", "size_b")
        )

    def record_pairs(self) -> DataFrame:
        """(id_a, id_b), smaller first: the pairs of classes and of copies, written out by record."""
        m, known = self.members, self.members.join(self.classes.select("digest"), "digest", "left_semi")
        a, b = m.select(F.col("id").alias("x"), F.col("digest").alias("digest_a")), m.select(F.col("id").alias("y"), F.col("digest").alias("digest_b"))
        across = self.class_pairs().join(a, "digest_a").join(b, "digest_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        copies = known.select("digest", F.col("id").alias("id_a")).join(known.select("digest", F.col("id").alias("id_b")), "digest").where("id_a < id_b").select("id_a", "id_b")
        return across.unionByName(copies)

    def links(self) -> DataFrame:
        """One row per record with a text: its class of equal texts and the number of similar other texts (0 if it is too short for any)."""
        p = self.pairs
        n = p.select(F.explode(F.array("rid_a", "rid_b")).alias("rid")).groupBy("rid").agg(F.count(F.lit(1)).alias("links"))
        of = self.classes.select("rid", "digest").join(n, "rid", "left").select("digest", F.coalesce("links", F.lit(0)).alias("links"))
        return self.members.join(of, "digest", "left").select("id", F.lower(F.hex("digest")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _tokenise(size: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            rids, digests, counts, sets = [], [], [], []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = word_hashes(text)
                if len(words) < max(min_words, size):
                    continue
                found = np.unique(shingles(words, size) & np.uint64((1 << 8 * WIDTH) - 1))
                rids.append(rid)
                rid += 1
                digests.append(digest)
                counts.append(len(found))
                sets.append(np.ascontiguousarray(found.view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(digests, pa.binary()), pa.array(counts, pa.int32()), pa.array(sets, pa.binary())], ["rid", "digest", "size", "grams"])

    return run


def unpack(data: bytes) -> np.ndarray:
    raw = np.zeros((len(data) // WIDTH, 8), np.uint8)
    raw[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return raw.view(np.uint64).ravel()


def _sketch(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            got = [unpack(x) for x in batch.column(0).to_pylist()]
            if got:
                total += np.bincount((np.concatenate(got) & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(total[slots])], ["slot", "n"])

    return run


def _prefixes(table, bits: int, t: Fraction, most: int, verify_cost: float):
    num, den = t.numerator, t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        mean = counts.sum() / len(counts)
        steps = np.arange(1, most + 1)
        for batch in batches:
            grams, rids, metas = [], [], []
            for rid, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                h = unpack(data)
                c = counts[(h & np.uint64((1 << bits) - 1)).astype(np.int64)]
                order = np.lexsort((h, c))
                need = (num * n + den - 1) // den
                reach = np.cumsum(np.maximum(1.0, c[order] - mean))
                m = steps[: max(1, min(most, need))]
                ends = n - need + m
                cost = reach[ends - 1] * (1 + verify_cost / m)
                best = int(np.argmin(cost))
                take = int(ends[best])
                index = min(take, n - (2 * num * n + den + num - 1) // (den + num) + best + 1)
                grams.append(h[order[:take]])
                rids.append(np.full(take, rid, np.int64))
                metas.append((n * 16 + best + 1) * 2 + (np.arange(take) < index).astype(np.int32))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(rids)), pa.array(np.concatenate(metas).astype(np.int32))], ["gram", "rid", "meta"])

    return run


def _overlap(t: Fraction):
    num, den = t.numerator, t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ga, gb = (c.to_pylist() for c in batch.columns)
            keep, shared, na, nb = [], [], [], []
            for k, (x, y) in enumerate(zip(ga, gb)):
                x, y = unpack(x), unpack(y)
                n = len(np.intersect1d(x, y, assume_unique=True))
                if den * n >= num * (len(x) + len(y) - n):
                    keep.append(k)
                    shared.append(n)
                    na.append(len(x))
                    nb.append(len(y))
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64()), *(pa.array(v, pa.int32()) for v in (shared, na, nb))], ["rid_a", "rid_b", "shared", "size_a", "size_b"])

    return run


def near_duplicates(records: DataFrame, id_col: str, text_col: str, *, shingle: int = 5, threshold: float | str = "0.8", min_words: int = 0, bits: int = 20, most_matches: int = 8, verify_cost: float = 8.0) -> NearDuplicates:
    """All pairs of records whose sets of word shingles have a Jaccard similarity of ``threshold`` or more.

    Rows that repeat an id with the same text count once; equal texts form one class and are joined once.
    Records with a null id, a null text, or fewer than ``max(min_words, shingle)`` words have no shingles
    and take part in no pair. An empty table gives empty results. Other columns are ignored, whatever
    their names. ``bits`` bounds the table of counts (8 bytes each) that is sent to all executors.
    """
    t = Fraction(str(threshold))
    if not 0 < t <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    if not 1 <= most_matches <= 15:
        raise ValueError("most_matches must lie between 1 and 15")
    spark = records.sparkSession
    rows = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").withColumn("digest", F.unhex(F.md5(F.col("text"))))
    members = rows.select("id", "digest").distinct()
    texts = rows.select("digest", "text").dropDuplicates(["digest"])
    sets = materialise(texts.select("digest", "text").mapInArrow(_tokenise(shingle, min_words), "rid long, digest binary, size int, grams binary"), "shingles")
    counted = sets.select("grams").mapInArrow(_sketch(bits), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << bits, np.int64)
    table[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    shared = spark.sparkContext.broadcast(table)
    postings = sets.select("rid", "size", "grams").mapInArrow(_prefixes(shared, bits, t, most_matches, verify_cost), "gram long, rid long, meta int")
    # meta: (size * 16 + m) * 2, and 1 if the shingle is in the shorter prefix
    low = postings.where(F.col("meta").bitwiseAND(1) == 1).select("gram", F.col("rid").alias("rid_a"), F.col("meta").alias("meta_a"))
    high = postings.select("gram", F.col("rid").alias("rid_b"), F.col("meta").alias("meta_b"))
    size_a, size_b = (F.shiftright(F.col(c), 5) for c in ("meta_a", "meta_b"))
    asked = lambda c: F.shiftright(F.col(c), 1).bitwiseAND(15)
    ordered = (size_a < size_b) | (size_a == size_b) & (F.col("rid_a") < F.col("rid_b"))
    candidates = (
        low.join(high, "gram")
        .where(ordered & (size_a * t.denominator >= size_b * t.numerator))
        .groupBy(F.least("rid_a", "rid_b").alias("rid_a"), F.greatest("rid_a", "rid_b").alias("rid_b"), F.least(asked("meta_a"), asked("meta_b")).alias("need"))
        .agg(F.count(F.lit(1)).alias("hits"))
        .where("hits >= need")
        .select("rid_a", "rid_b")
    )
    grams = sets.select("rid", "grams")
    both = candidates.join(grams.select(F.col("rid").alias("rid_a"), F.col("grams").alias("grams_a")), "rid_a").join(grams.select(F.col("rid").alias("rid_b"), F.col("grams").alias("grams_b")), "rid_b")
    pairs = both.select("rid_a", "rid_b", "grams_a", "grams_b").mapInArrow(_overlap(t), "rid_a long, rid_b long, shared int, size_a int, size_b int")
    return NearDuplicates(pairs, sets.select("rid", "digest"), members)
