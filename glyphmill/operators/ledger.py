"""The ledger of hypothesis tests and its corrections for many comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log(battery: str, tests: DataFrame, name: F.Column) -> DataFrame:
    """Rows of a battery as ledger rows (battery, name, p_value, min_attainable_p)."""
    least = F.col("min_attainable_p") if "min_attainable_p" in tests.columns else F.lit(None).cast("double")
    return tests.select(F.lit(battery).alias("battery"), name.alias("name"), "p_value", least.alias("min_attainable_p"))


def corrected(ledger: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Each test with a p, with what Bonferroni asks and whether the test can reach it at all."""
    tests = ledger.where("p_value is not null")
    n = tests.agg(F.count(F.lit(1)).alias("n_tests"))
    rows = tests.crossJoin(F.broadcast(n)).withColumn("bonferroni_alpha", alpha / F.col("n_tests"))
    return rows.withColumn("nominal", F.col("p_value") < alpha).withColumn("survives", F.col("p_value") < F.col("bonferroni_alpha")).withColumn("resolvable", F.coalesce(F.col("min_attainable_p") < F.col("bonferroni_alpha"), F.lit(True)))


def summary(ledger: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: tests, expected false positives, nominal hits, Bonferroni level and survivors, tests that can't reach it."""
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).cast("long")
    one = corrected(ledger, alpha).agg(F.count(F.lit(1)).alias("n_tests"), count("nominal").alias("nominal"), count("survives").alias("survivors"), F.coalesce(F.sum((~F.col("resolvable")).cast("int")), F.lit(0)).cast("long").alias("unresolvable"))
    return one.select("n_tests", F.round(F.col("n_tests") * alpha, 6).alias("expected_false_positives"), "nominal", F.round(F.try_divide(F.lit(alpha), F.col("n_tests")), 12).alias("bonferroni_alpha"), "survivors", "unresolvable")


def names(ledger: DataFrame, column: str, alpha: float = 0.05) -> DataFrame:
    """The names of the nominal hits or the survivors, one a row: the list is not gathered."""
    return corrected(ledger, alpha).where(column).select("name", "p_value")


def by_prefix(ledger: DataFrame) -> DataFrame:
    """Tests, hits and least p by the first two parts of the name."""
    return ledger.where("p_value is not null").groupBy(F.substring_index("name", ":", 2).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("p_value") < 0.05).cast("int")).cast("long").alias("nominal"), F.min("p_value").alias("least_p"))
