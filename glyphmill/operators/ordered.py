"""Running totals and numbers in a group's order, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from glyphmill.storage import materialise


def running_total(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same keys that come before.

    Rows are laid out by range of keys and order; each stretch is summed on its own, and the stretches' sums
    (one row for each stretch and key) are added up. A group of any size is spread over as many stretches as
    its share of the rows asks for. ``order`` must be unique within the keys.
    """
    columns = [*map(F.col, keys), *map(F.col, order)]
    ranged = df.repartitionByRange(partitions, *columns) if partitions else df.repartitionByRange(*columns)
    laid = materialise(ranged.withColumn("_value", value).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = laid.groupBy(*keys, "_part").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = laid.join(starts, [*keys, "_part"])
    return joined.withColumn(name, F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_value", "_part", "_start")


#: Rows of a group in one block, besides those of its neighbours.
BLOCK = 100_000
#: Which rows of ``neighbours`` a block is for.
OWN = f"_block = at div {BLOCK}"


def beside() -> WindowSpec:
    """The window over a block of ``neighbours``."""
    return Window.partitionBy("grp", "_block").orderBy("at")


def neighbours(numbered: DataFrame, n: int) -> DataFrame:
    """``numbered`` (grp, at, ...), whose places count from 0 without gaps, in blocks with the row before and ``n`` rows after.

    Windows ``beside()`` then look one row back and n rows ahead, and no group is sorted as a whole. Rows
    of neighbouring blocks are repeated; what is for a block is told by ``OWN``. ``n`` is less than ``BLOCK``.
    """
    shifts = F.array(F.lit(-1), F.lit(n))
    blocks = F.array_distinct(F.transform(F.concat(F.array(F.lit(0)), shifts), lambda d: F.greatest(F.floor((F.col("at") - d) / BLOCK), F.lit(0))))
    return numbered.withColumn("_block", F.explode(blocks)).where(f"at >= _block * {BLOCK} - 1 and at < (_block + 1) * {BLOCK} + {n}")
