"""Mixing sources to target weights by Pareto order sampling.

Each document is due the same number of copies, scaled by its weight if it has one. Whole copies are
certain; what is left is a chance of one copy more. Documents are ranked by random odds divided by the
odds of that chance and taken in that order until the source has its tokens. The cut in a ranking is found
by counting tokens in bins of the rank, then in finer bins of the bin that holds the cut: no source is
sorted in one task, however large it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.encode import DEFAULT, count_tokens
from glyphmill.storage import materialise

#: Targets up to this number are sent to all executors.
MOST_SENT = 100_000
#: Bins of a level. Two levels leave about one in 2^24 of a source's documents to be ranked one by one.
BINS = 4096


@dataclass
class Mix:
    """``chosen`` (mix_id, source, id, tokens, copies) and ``plan`` (mix_id, source, target_share, max_repeats,
    available, mean_weight, share, budget, in_reach, copies_due): what each source has and is due."""

    chosen: DataFrame
    plan: DataFrame

    def shares(self) -> DataFrame:
        """One row for each target: tokens, documents, copies, actual and target share, and whether it was in reach."""
        got = self.chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
        rows = self.plan.join(got, ["mix_id", "source"], "left")
        whole = got.groupBy("mix_id").agg(F.sum("tokens").alias("total"))
        tokens = F.coalesce("tokens", F.lit(0))
        return rows.join(whole, "mix_id", "left").select(
            "mix_id", "source", "target_share", "max_repeats", tokens.alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            F.coalesce(F.try_divide(tokens.cast("double"), F.col("total")), F.lit(0.0)).alias("actual_share"), F.col("share").alias("wanted_share"), "in_reach",
        )


def _cut(rows: DataFrame, bin_: F.Column, left: DataFrame) -> DataFrame:
    """For each mix and source the bin in which the tokens reach ``left``, and the tokens in the bins before it."""
    keys = ["mix_id", "source"]
    sums = rows.groupBy(*keys, bin_.alias("bin")).agg(F.sum("tokens").alias("tokens"))
    order = Window.partitionBy(*keys).orderBy("bin")
    run = sums.withColumn("until", F.sum("tokens").over(order)).join(left, keys)
    return run.where("until >= rest").groupBy(*keys, "rest").agg(F.min(F.struct("bin", (F.col("until") - F.col("tokens")).alias("before"))).alias("x")).select(*keys, F.col("x.bin").alias("cut"), (F.col("rest") - F.col("x.before")).alias("rest"))


def mix_sources(documents: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, total_tokens: int | None = None, seed: int = 42, tokenizer: str = DEFAULT) -> Mix:
    """Select documents so that each source has its target share of a mix's tokens.

    Shares are taken relative to the sum of those whose source has tokens; an absent source stays at nothing
    and is reported. Without ``total_tokens`` a mix is as large as it can be with every such source at its
    share; with it, a source that runs out at ``max_repeats`` copies falls short. No document is used more
    often than ``max_repeats`` (null means once, less than one never). Documents with a null source, without
    tokens, with a null id, or with a weight of null or not above 0 are not used; a repeated id counts once,
    with its least source and, of its texts there that have tokens, the one with the least hash. Targets given twice count once, with the largest share.
    A source's tokens differ from its due by half of one document at most, unless weights run into the cap.
    """
    spark = documents.sparkSession
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    rows = documents.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), weight.alias("weight")).where("id is not null and source is not null and text is not null and weight > 0")
    wanted = targets.groupBy("mix_id", "source").agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")).where("mix_id is not null and source is not null")
    small = F.broadcast if wanted.count() <= MOST_SENT else lambda df: df  # beyond that, plain joins
    rows = rows.join(small(wanted.select("source").distinct()), "source", "left_semi")
    kind = rows.select("id").schema[0].dataType.simpleString()
    packed = rows.select(F.struct("id", "source", F.xxhash64("text").alias("digest"), "weight").alias("id"), "text")
    counted = count_tokens(packed, "id", "text", tokenizer).select("id.*", "tokens").where("tokens > 0")
    one = counted.groupBy("id").agg(F.min(F.struct("source", "digest", "tokens", "weight")).alias("x"))  # no text is shuffled
    sized = materialise(one.select("id", "x.source", "x.weight", "x.tokens"), "sized")

    sizes = sized.groupBy("source").agg(F.sum("tokens").alias("available"), (F.sum(F.col("tokens") * F.col("weight")) / F.sum("tokens")).alias("mean_weight"))
    plan = wanted.join(sizes, "source", "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("cap", F.greatest(F.col("max_repeats"), F.lit(0)) * F.col("available"))
    per_mix = Window.partitionBy("mix_id")
    due = F.when((F.col("cap") > 0) & (F.col("target_share") > 0), F.col("target_share")).otherwise(0.0)
    plan = plan.withColumn("share", F.coalesce(F.try_divide(due, F.sum(due).over(per_mix)), F.lit(0.0)))
    most = F.min(F.when(F.col("share") > 0, F.col("cap") / F.col("share"))).over(per_mix)
    size = F.lit(float(total_tokens)) if total_tokens is not None else most
    plan = plan.withColumn("budget", F.coalesce(F.least(F.floor(size * F.col("share") + 1e-6), F.col("cap")), F.lit(0)).cast("long"))
    fits = (F.coalesce("target_share", F.lit(0.0)) <= 0) | (F.col("share") > 0) & (F.col("budget") + 1 >= size * F.col("share"))
    plan = plan.withColumn("in_reach", F.coalesce(fits, F.lit(False))).withColumn("copies_due", F.coalesce(F.try_divide(F.col("budget").cast("double"), F.col("available")), F.lit(0.0)))
    plan = materialise(plan.select("mix_id", "source", "target_share", "max_repeats", "available", "mean_weight", "share", "budget", "in_reach", "copies_due"), "plan")

    # A document's copies: its due ones, at most max_repeats. Whole ones are certain, the part beyond is a chance.
    docs = sized.join(small(plan.where("budget > 0").select("mix_id", "source", "max_repeats", "copies_due", "mean_weight")), "source")
    own = F.least(F.col("copies_due") * F.col("weight") / F.col("mean_weight"), F.col("max_repeats").cast("double"))
    docs = docs.withColumn("own", own).withColumn("whole", F.floor(F.col("own") + 1e-9).cast("int")).withColumn("chance", F.greatest(F.lit(0.0), F.col("own") - F.col("whole")))
    u = (F.pmod(F.xxhash64(F.lit(seed), "mix_id", "id"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    odds = (u / (1 - u)) / (F.greatest("chance", F.lit(1e-12)) / (1 - F.least("chance", F.lit(1 - 1e-12))))
    docs = docs.withColumn("rank", F.when(F.col("whole") < F.col("max_repeats"), odds / (1 + odds))).select("mix_id", "source", "id", "tokens", "whole", "rank")
    docs = materialise(docs, "ranked")

    keys = ["mix_id", "source"]
    certain = docs.groupBy(*keys).agg(F.sum(F.col("tokens") * F.col("whole")).alias("certain"))
    left = plan.join(certain, keys).select(*keys, (F.col("budget") - F.col("certain")).alias("rest")).where("rest > 0")
    first, fine = F.floor(F.col("rank") * BINS).cast("int"), F.floor(F.col("rank") * BINS * BINS).cast("long")
    ranked = docs.where("rank is not null")
    one = _cut(ranked, first, left)
    inside = ranked.join(small(one.select(*keys, F.col("cut").alias("one"))), keys).where(first == F.col("one"))
    two = _cut(inside, fine, one.select(*keys, "rest"))
    last = inside.join(small(two.select(*keys, F.col("cut").alias("two"), "rest")), keys).where(fine == F.col("two"))
    order = Window.partitionBy(*keys).orderBy("rank", "id")
    until = F.sum("tokens").over(order)
    edge = last.withColumn("before", until - F.col("tokens")).where("before < rest and rest - before >= tokens - (rest - before)").select(*keys, "id", F.lit(1).alias("edge"))
    cuts = one.select(*keys, F.col("cut").alias("one")).join(two.select(*keys, F.col("cut").alias("two")), keys, "left")
    below = (first < F.col("one")) | (first == F.col("one")) & (fine < F.col("two"))
    rest = left.select(*keys, F.lit(1).alias("some"))
    extra = F.when(F.col("rank").isNull() | F.col("some").isNull(), 0).when(F.col("one").isNull() | below | F.col("edge").isNotNull(), 1).otherwise(0)
    chosen = docs.join(small(rest), keys, "left").join(small(cuts), keys, "left").join(edge, [*keys, "id"], "left").withColumn("copies", F.col("whole") + extra).where("copies > 0").select("mix_id", "source", F.col("id").cast(kind).alias("id"), "tokens", "copies")
    return Mix(chosen, plan)
